"""Why a span was dropped: where its text nearly stands in the article, and at what edit cost.

A dropped span's text is first looked for as it is, then but for case, white space or diacritics. If it isn't there, the cheapest approximate match in the whole article is found: the edit costs of all places where
a match can end are computed bit-parallel (a column of the edit table in two integers, one step for each character of the article), then where it begins from the
reversed texts. The spans of an article meet its text as one row; articles without dropped spans aren't moved at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_name, squeeze
from .verify import full_text

#: A match may cost so much of the length of the span's text.
WORST = 0.5


def end_costs(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Edit distance of ``pattern`` to the nearest substring of ``text`` that ends after 0, 1, 2 ... characters; with ``anchored`` to the prefix that ends there."""
    n = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << n >> 1
    plus, minus, score, out = every, 0, n, [n]
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus) & every, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | anchored, down << 1
        plus, minus = (down | ~(vertical | up)) & every, up & vertical & every
        out.append(score)
    return out


def _lowered(text: str) -> str:
    """Lower case, each character still one."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _bare(text: str) -> str:
    """Lower case without diacritics, each character still one."""
    return "".join("d" if c == "đ" else unicodedata.normalize("NFD", c)[0] for c in _lowered(text))


def _nearest(pattern: str, text: str, start: int) -> int | None:
    """The place of ``pattern`` nearest to ``start``, of equal ones the first."""
    at = text.find(pattern, max(0, start))
    before = text.rfind(pattern, 0, max(0, start) + len(pattern))
    found = [x for x in (before, at) if x >= 0]
    return min(found, key=lambda x: (abs(x - start), x), default=None)


def locate(pattern: str, text: str, start: int, end: int, worst: float = WORST) -> tuple[int, int, int] | None:
    """(start, end, cost) of where ``pattern`` nearly stands: as it is, else but for case, for white space, for diacritics, of several places the one nearest to ``start``; else of the
    cheapest matches the one whose end is nearest to ``end``, then the first, and of its beginnings the one that makes it nearest to the pattern's length, then the shorter. None if nothing is cheap enough."""
    if not pattern:
        return None
    for fold in (str, _lowered):
        at = _nearest(fold(pattern), fold(text), start)
        if at is not None:
            there = text[at : at + len(pattern)]
            return at, at + len(pattern), end_costs(pattern, there, anchored=True)[-1]
    words = pattern.split()
    if words:
        spaced = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), text)]
        if spaced:
            a, b = min(spaced, key=lambda x: (abs(x[0] - start), x))
            return a, b, end_costs(pattern, text[a:b], anchored=True)[-1]
    at = _nearest(_bare(pattern), _bare(text), start)
    if at is not None:
        return at, at + len(pattern), end_costs(pattern, text[at : at + len(pattern)], anchored=True)[-1]
    costs = end_costs(pattern, text)
    cost = min(costs)
    if cost > worst * len(pattern):
        return None
    stop = min((abs(j - end), j) for j, c in enumerate(costs) if c == cost)[1]
    back = end_costs(pattern[::-1], text[max(0, stop - len(pattern) - cost) : stop][::-1], anchored=True)
    size = min((abs(k - len(pattern)), k) for k, c in enumerate(back) if c == cost)[1]
    return stop - size, stop, cost


def explain_drops(checked: DataFrame, articles: DataFrame, worst: float = WORST) -> DataFrame:
    """The dropped spans of ``checked`` (a result of ``verify``) with found_start, found_end, found_text, cost and an explanation:

    ``moved`` (stands elsewhere or with another end), ``case``, ``white_space`` and ``diacritics`` (equal but for those), ``edited`` (a cheap approximate match), ``absent`` (none),
    ``no_article`` and ``no_text``. Rows with a null doc_id have no article. A repeated article counts once, the longest."""
    dropped = checked.where("not verified").select("doc_id", "span_type", "text", "start", "end", "reason")
    text = F.col("full_text") if "full_text" in articles.columns else full_text(F.col("paragraphs"))
    lists = dropped.groupBy("doc_id").agg(F.collect_list(F.struct("span_type", "text", "start", "end", "reason")).alias("spans"))
    whole = articles.select("doc_id", text.alias("whole")).join(lists.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("whole", F.length("whole")).alias("whole"))
    met = lists.join(whole, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1).to_pydict()
                article, spans = one["whole"][0], one["spans"][0]
                found = [None if article is None else locate(s["text"] or "", article, s["start"] or 0, s["end"] or 0, worst) for s in spans]
                columns = {c: pa.array([s[c] for s in spans], batch.schema.field("spans").type.value_type.field(c).type) for c in ("span_type", "text", "start", "end", "reason")}
                columns["found_start"] = pa.array([f and f[0] for f in found], pa.int32())
                columns["found_end"] = pa.array([f and f[1] for f in found], pa.int32())
                columns["cost"] = pa.array([f and f[2] for f in found], pa.int32())
                columns["found_text"] = pa.array([f and article[f[0] : f[1]] for f in found], pa.string())
                columns["there"] = pa.array([article is not None] * len(spans), pa.bool_())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array([k] * len(spans))), **columns})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dropped.schema)
    rows = met.select("doc_id", "spans", "whole").mapInArrow(run, schema + ", found_start int, found_end int, cost int, found_text string, there boolean")
    return rows.withColumn("explanation", _explanation(F.col("text"), F.col("found_text"))).drop("there")


def _explanation(wanted: Column, found: Column) -> Column:
    return (
        F.when(~F.col("there"), "no_article")
        .when(F.coalesce(wanted, F.lit("")) == "", "no_text")
        .when(found.isNull(), "absent")
        .when(found == wanted, "moved")
        .when(F.lower(found) == F.lower(wanted), "case")
        .when(squeeze(found) == squeeze(wanted), "white_space")
        .when(fold_name(found) == fold_name(wanted), "diacritics")
        .otherwise("edited")
    )
