"""Self-consistency of two extraction runs: their spans of a document aligned one to one, and how far the runs agree.

Spans that are equal in place and type are matched first, in order, by hash. The rest is matched greedily by overlap: of all pairs that share text the one with the greatest share of common
characters comes first, and each span is used once. Overlapping pairs are found by a sweep over the spans in order of their starts. A document's spans meet in one Arrow task; texts aren't needed.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIDE = ["span_type", "start", "end", "text", "confidence"]


def overlapping(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Index pairs of the ranges that share a character, by a sweep over both in order of their starts; only open ranges are looked at."""
    events = sorted([(a, b, 0, i) for i, (a, b) in enumerate(left) if a < b] + [(a, b, 1, i) for i, (a, b) in enumerate(right) if a < b])
    open_: tuple[list, list] = ([], [])  # heaps of (end, index)
    pairs = []
    for a, b, side, i in events:
        others = open_[1 - side]
        while others and others[0][0] <= a:
            heappop(others)
        pairs += [(i, j) if side == 0 else (j, i) for _, j in others]
        heappush(open_[side], (b, i))
    return pairs


def align(left: list[dict], right: list[dict]) -> list[tuple[int | None, int | None]]:
    """One-to-one pairs of span indices; unmatched spans have None on the other side. Both lists are in their order of output."""
    exact: dict[tuple, deque[int]] = defaultdict(deque)
    for j, s in enumerate(right):
        exact[s["span_type"], s["start"], s["end"]].append(j)
    pairs, used_left, used_right = [], set(), set()
    for i, s in enumerate(left):
        same = exact.get((s["span_type"], s["start"], s["end"]))
        if same:
            pairs.append((i, j := same.popleft()))
            used_left.add(i), used_right.add(j)
    rest_left, rest_right = ([k for k in range(len(side)) if k not in used] for side, used in ((left, used_left), (right, used_right)))
    places = lambda spans, rest: [(spans[k]["start"] or 0, spans[k]["end"] or 0) for k in rest]
    a, b = places(left, rest_left), places(right, rest_right)

    def rank(pair: tuple[int, int]) -> tuple:
        (x, y), (u, v) = a[pair[0]], b[pair[1]]
        shared = min(y, v) - max(x, u)
        i, j = rest_left[pair[0]], rest_right[pair[1]]
        return (-Fraction(shared, max(y, v) - min(x, u)), left[i]["span_type"] != right[j]["span_type"], i, j)

    for p, q in sorted(overlapping(a, b), key=rank):
        i, j = rest_left[p], rest_right[q]
        if i not in used_left and j not in used_right:
            pairs.append((i, j))
            used_left.add(i), used_right.add(j)
    return pairs + [(i, None) for i in rest_left if i not in used_left] + [(None, j) for j in rest_right if j not in used_right]


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each aligned pair and each unmatched span of two runs (doc_id, span_type, start, end, text, confidence): doc_id, the columns of both sides (left_*, right_*) and ``agreement``:

    ``same`` (place and type), ``moved`` (same type, other place), ``retyped`` (other type), ``left_only``, ``right_only``. Spans are taken in order of start, end, type and text. Empty and null places share no
    text with anything but equal ones. Spans with a null doc_id belong to one document without id."""
    sides = [df.select(F.col("doc_id").cast("string").alias("doc_id"), "span_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", F.col("confidence").cast("double").alias("confidence")) for df in (left, right)]
    kinds = {"span_type": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string(), "confidence": pa.float64()}

    def one(doc_id: str | None, both: list[dict]) -> pa.RecordBatch:
        order = lambda s: tuple((s[c] is not None, s[c]) for c in ("start", "end", "span_type", "text", "confidence"))
        spans = [sorted((s for s in both if s["side"] == side), key=order) for side in (0, 1)]
        pairs = align(*spans)
        columns = {"doc_id": pa.array([doc_id] * len(pairs), pa.string())}
        for side, name in ((0, "left"), (1, "right")):
            for c in _SIDE:
                columns[f"{name}_{c}"] = pa.array([None if p[side] is None else spans[side][p[side]][c] for p in pairs], kinds[c])

        def judge(i: int | None, j: int | None) -> str:
            if i is None or j is None:
                return "left_only" if j is None else "right_only"
            x, y = spans[0][i], spans[1][j]
            return "retyped" if x["span_type"] != y["span_type"] else "same" if (x["start"], x["end"]) == (y["start"], y["end"]) else "moved"

        return pa.RecordBatch.from_pydict({**columns, "agreement": pa.array([judge(*p) for p in pairs], pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [one(d, part.column("spans")[k].as_py()) for k, d in enumerate(part.column("doc_id").to_pylist())]
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    sql = {"span_type": "string", "start": "int", "end": "int", "text": "string", "confidence": "double"}
    schema = "doc_id string, " + ", ".join(f"{n}_{c} {sql[c]}" for n in ("left", "right") for c in _SIDE) + ", agreement string"
    # A document is a row with the spans of both runs: many of them go to Python at once, which a group each does not.
    both = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1)))
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("side", *_SIDE)).alias("spans")).mapInArrow(run, schema)


def agreement(compared: DataFrame) -> DataFrame:
    """By document: spans of each run, pairs by kind, ``rate`` (same of all pairs and unmatched spans) and ``text_rate`` (pairs of equal text), to six decimals."""
    of = lambda kind: F.count_if(F.col("agreement") == kind)
    equal = F.count_if(F.col("left_text").eqNullSafe(F.col("right_text")) & ~F.col("agreement").isin("left_only", "right_only"))
    counted = compared.groupBy("doc_id").agg(
        F.count_if(F.col("agreement") != "right_only").alias("n_left"), F.count_if(F.col("agreement") != "left_only").alias("n_right"),
        *(of(k).alias(f"n_{k}") for k in ("same", "moved", "retyped")), F.round(of("same") / F.count("*"), 6).alias("rate"), F.round(equal / F.count("*"), 6).alias("text_rate"),
    )
    return counted


def confirmed(compared: DataFrame, moved: bool = True) -> DataFrame:
    """The spans that both runs found, as in the left one, with the mean of both confidences; without ``moved`` only those at the same place."""
    kinds = ["same", "moved"] if moved else ["same"]
    mean = (F.coalesce("left_confidence", F.lit(0.5)) + F.coalesce("right_confidence", F.lit(0.5))) / 2
    return compared.where(F.col("agreement").isin(kinds)).select("doc_id", *(F.col(f"left_{c}").alias(c) for c in ("span_type", "start", "end", "text")), mean.alias("confidence"))
