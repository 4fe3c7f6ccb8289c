"""Text functions as Column expressions. All positions are code points, ranges are half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(x) for x in xs))


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def strip(x: Column) -> Column:
    """Unicode-aware strip (``trim`` only knows the space)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none outside."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """No-break spaces become spaces, zero-width spaces vanish, white space is squeezed."""
    return squeeze(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit(" ")), F.lit("​"), F.lit("")))


def count_tokens(x: Column) -> Column:
    """Non-empty parts between single spaces."""
    return F.size(F.filter(F.split(x, " "), lambda t: t != ""))


def slice_text(x: Column, start: Column, end: Column) -> Column:
    return F.substring(x, start + 1, F.greatest(end - start, F.lit(0)))


def find(text: Column, part: Column) -> Column:
    """First position of ``part``, -1 if absent."""
    return F.call_function("locate", part, text) - 1


def snippet(text: Column, at: Column, size: Column, margin: int, dots: bool = False) -> Column:
    """The text around ``[at, at + size)``; with ``dots`` cut ends are marked."""
    start, end = F.greatest(at - margin, F.lit(0)), F.least(at + size + margin, F.length(text))
    body = slice_text(text, start, end)
    if not dots:
        return body
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))


#: Matches whose places are added up in one fold; more go in blocks of so many.
_BLOCK = 64


def starts(lengths: Column) -> Column:
    """Where each match begins, from array<struct<gap, hit>> of lengths. A fold copies the array it
    builds, so it runs over blocks: the work grows with the number of matches, not with its square."""

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.struct(F.lit(0).alias("gap"), b["at"].alias("hit")))
        return F.flatten(F.zip_with(fold(totals)["out"], blocks, lambda base, b: F.transform(b["out"], lambda x: x + base)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda k: fold(F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK))))
    return F.when(F.size(lengths) <= _BLOCK, fold(lengths)["out"]).otherwise(let(blocks, joined))


def find_all(text: Column, pattern: str) -> Column:
    """Every match as array<struct<start, text>>.

    Spark's regexp functions give the matches without places. The gaps between them come
    from ``split``; the places are sums of the lengths of gaps and matches.
    """

    def of(both: Column) -> Column:
        lengths = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), both["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        return F.zip_with(let(lengths, starts), both["hits"], lambda s, h: F.struct(s.alias("start"), h.alias("text")))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    # ``split`` compiles its pattern for every row, ``rlike`` once: texts without a match never reach it.
    none = F.array().cast("array<struct<start:int,text:string>>")
    return F.when(F.coalesce(~text.rlike(pattern), F.lit(True)), none).otherwise(let(both, of))


def explode_matches(df: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, i, start, token) of every match: the same sums as ``find_all``, as a running window per row (``keys`` name a row)."""
    zipped = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hit"))
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode_outer(zipped).alias("i", "x")).where("x.hit is not null")
    upto = F.sum(F.length("x.gap") + F.length("x.hit")).over(W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*keys, "i", (upto - F.length("x.hit")).cast("int").alias("start"), F.col("x.hit").alias("token"))


def unfence_block(x: Column) -> Column:
    """Content of the first Markdown code fence (with its language tag)."""
    s = strip(x)
    parts = F.split(s, "```", -1)
    inner = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(F.element_at(parts, -1))
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def unfence_lines(x: Column) -> Column:
    """Without the opening fence line and a closing line that is only a fence."""
    s = strip(x)
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(s.startswith("```"), strip(body)).otherwise(s)


def braces(x: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such range."""
    return blank_to_null(F.regexp_extract(x, r"(?s)\{.*\}", 0))


def is_json(x: Column) -> Column:
    """Whether ``x`` is one JSON object or array with nothing behind it."""
    s = strip(x)
    whole = s.rlike(r"(?s)^\{.*\}$|^\[.*\]$")
    return F.coalesce(whole & F.try_parse_json(s).isNotNull(), F.lit(False))


def lenient_json(x: Column, fence: Callable[[Column], Column] = unfence_block) -> Column:
    """The JSON text in a model's answer: the answer itself, the fenced part, or the outermost braces; else null."""
    fenced = fence(x)
    inner = braces(fenced)
    return F.when(is_json(x), strip(x)).when(is_json(fenced), strip(fenced)).when(is_json(inner), inner)


#: Small letters of Vietnamese with marks, and the plain ones; combining marks.
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
COMBINING = "[̛̣̀́̃̉̂̆]"


def fold_name(x: Column) -> Column:
    """Name key: lower case, no diacritics (Vietnamese đ is d), white space squeezed."""
    return F.translate(squeeze(F.lower(F.regexp_replace(x, COMBINING, ""))), MARKED, PLAIN)
