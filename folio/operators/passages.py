"""Passages: packing of paragraphs and the fallback for articles without passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, let, starts, strip
from ..schemas import PASSAGE

MIN_TOKENS, MAX_TOKENS = 512, 1000
_SEGMENTS = "array<struct<first:int,last:int,n:int>>"


def _paragraph_starts(paragraphs: Column) -> Column:
    """Place of each paragraph in the text that joins them by blank lines."""
    return let(F.transform(paragraphs, lambda p, i: F.struct(F.when(i > 0, 2).otherwise(0).alias("gap"), F.length(p).alias("hit"))), starts)


def _segments(tokens: Column, min_tokens: int, max_tokens: int) -> Column:
    """(first, last, tokens) of the packed segments: fill up to ``max_tokens``, merge a short
    segment with the next one, and a short last one with the one before it."""
    one = "struct<first:int,last:int,n:int>"
    numbered = F.transform(tokens, lambda n, i: F.struct(i.alias("first"), i.alias("last"), n.alias("n")))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["n"] + b["n"]).alias("n"))

    def grouped(items: Column, goes_on: Callable[[Column, Column], Column]) -> Column:
        """Neighbours joined while ``goes_on`` (the open segment, the next one). Only closed segments are copied, so the work grows with their number."""
        zero = F.struct(F.array().cast(_SEGMENTS).alias("done"), F.lit(None).cast(one).alias("open"))

        def add(acc: Column, x: Column) -> Column:
            stays = acc["open"].isNull() | goes_on(acc["open"], x)
            return F.struct(
                F.when(stays, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
                F.when(acc["open"].isNotNull() & stays, joined(acc["open"], x)).otherwise(x).cast(one).alias("open"),
            )

        return F.aggregate(items, zero, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

    def tail(out: Column) -> Column:
        last, before = F.element_at(out, -1), F.element_at(out, -2)
        short = (F.size(out) >= 2) & (last["n"] < min_tokens)
        return F.when(short, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 2, F.lit(0))), F.array(joined(before, last)))).otherwise(out)

    filled = grouped(numbered, lambda a, x: a["n"] + x["n"] <= max_tokens)
    return let(grouped(filled, lambda a, x: a["n"] < min_tokens), tail)


def pack_passages(paragraphs: Column, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> Column:
    """Passages (array of struct) of an array of paragraphs. Null or no paragraphs: none."""
    filled = F.coalesce(paragraphs, F.array().cast("array<string>"))
    segments = _segments(F.transform(filled, count_tokens), min_tokens, max_tokens)

    def build(starts: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            stop = F.get(starts, s["last"]) + F.length(F.get(filled, s["last"]))
            return F.struct(
                i.alias("passage_id"),
                F.array_join(F.slice(filled, s["first"] + 1, s["last"] - s["first"] + 1), "\n\n").alias("text"),
                F.get(starts, s["first"]).alias("start"),
                stop.alias("end"),
                s["n"].alias("word_count"),
                F.sequence(s["first"], s["last"]).alias("paragraph_indices"),
            )

        return F.transform(segments, one).cast(f"array<{PASSAGE}>")

    return let(_paragraph_starts(filled), build)


def paragraph_passages(paragraphs: Column) -> Column:
    """One passage for each paragraph with text, with places in the joined article text."""
    filled = F.coalesce(paragraphs, F.array().cast("array<string>"))

    def build(starts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            raw = F.coalesce(p, F.lit(""))
            text = strip(raw)
            start = F.get(starts, i) + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
            words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
            return F.struct(i.alias("passage_id"), text.alias("text"), start.alias("start"), (start + F.length(text)).alias("end"), words.alias("word_count"), F.array(i).alias("paragraph_indices"))

        return F.filter(F.transform(filled, one), lambda x: x["text"] != "").cast(f"array<{PASSAGE}>")

    return let(_paragraph_starts(F.transform(filled, lambda p: F.coalesce(p, F.lit("")))), build)


def with_passages(articles: DataFrame) -> DataFrame:
    """``articles`` (doc_id, paragraphs, passages): passages where there are any, else from the paragraphs."""
    own = F.col("passages")
    return articles.withColumn("passages", F.when(F.size(F.coalesce(own, F.array().cast(f"array<{PASSAGE}>"))) > 0, own).otherwise(paragraph_passages(F.col("paragraphs"))))


def explode_passages(articles: DataFrame) -> DataFrame:
    """(doc_id, passage_id, text, start, end, word_count, paragraph_indices) of passages with text.
    A missing passage_id is the running number of such passages, a missing start is 0."""
    filled = F.filter("passages", lambda p: F.length(strip(F.coalesce(p["text"], F.lit("")))) > 0)
    rows = articles.select(F.coalesce(F.nullif("doc_id", F.lit("")), F.lit("unknown")).alias("doc_id"), F.posexplode_outer(filled).alias("i", "p")).where("p is not null")
    return rows.select("doc_id", F.coalesce("p.passage_id", "i").alias("passage_id"), "p.text", F.coalesce("p.start", F.lit(0)).alias("start"), "p.end", "p.word_count", "p.paragraph_indices")
