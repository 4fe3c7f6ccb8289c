"""Nearest vectors by a partitioned index: coarse centroids, each with the list of the vectors nearest to it.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, those of the smallest hashed ids); every vector is assigned. Lists are cut into parts of about ``PART`` rows,
and the queries that probe a list into blocks of ``BLOCK``, so a list of very many equal vectors is many small groups. A part meets a block as two matrices in one Arrow task.

``search`` probes the lists nearest to a query. Its exact form goes on: with r the distance of the k-th vector found, a list whose centroid is further than r plus the list's radius
can't hold a nearer one (triangle inequality); all other lists are probed too, so the result equals that of comparing all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import delete, written

#: Vectors that the centroids are fitted on, and the most lists.
SAMPLE, MAX_LISTS = 20_000, 1024
#: Rows of a part of a list, and queries of a block.
PART, BLOCK = 20_000, 2_000
#: Distances are compared at six decimals; equal ones by id.
PLACES = 6


@dataclass
class VectorIndex:
    """``rows`` (id, vector, list, distance), ``centers`` and, for each list, its number of rows and radius."""

    rows: DataFrame
    centers: np.ndarray
    counts: np.ndarray
    radii: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def fit_centers(sample: np.ndarray, lists: int, turns: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly taken rows; a centre without rows takes the furthest one."""
    centers = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(turns):
        d = _distances(sample, centers)
        near = d.argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=lists)
        filled = n > 0
        centers[filled] = sums[filled] / n[filled, None]
        if not filled.all():
            centers[~filled] = sample[np.argsort(-d.min(axis=1))[: (~filled).sum()]]
    return centers


def build_index(vectors: DataFrame, lists: int | None = None) -> VectorIndex | None:
    """Index ``vectors`` (id, vector). Rows with a null id, or a vector that is null, holds a null or isn't as long as most, are left out; None if no row is left."""
    rows = vectors.where("id is not null and vector is not null and not exists(vector, x -> x is null)").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths or not widths[0].w:
        return None
    width, n = widths[0].w, widths[0]["count"]
    rows = rows.where(F.size("vector") == width)
    sample = rows.select("vector", "id").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toArrow()
    sample = _matrix(sample.column("vector"), width)
    lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, len(sample)))
    centers = fit_centers(sample, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                d = _distances(_matrix(part.column("vector"), width), centers)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "vector", "list", "distance"])

    assigned = written(rows.mapInArrow(assign, "id long, vector array<double>, list int, distance double"), "vectors")
    counts, radii = np.zeros(lists, np.int64), np.zeros(lists)
    for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect():
        counts[r.list], radii[r.list] = r.n, r.r
    return VectorIndex(assigned, centers, counts, radii)


def _probe(index: VectorIndex, queries: DataFrame, choose) -> DataFrame:
    """(query_id, vector, list) for the lists that ``choose`` (distances to centres, reach of each query, number probed) marks for each query."""
    centers = index.centers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                d = _distances(_matrix(part.column("vector"), centers.shape[1]), centers)
                q, at = np.nonzero(choose(d, np.asarray(part.column("reach"), np.float64)))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(q)), part.column("vector").take(pa.array(q)), pa.array(at.astype(np.int32))], names=["query_id", "vector", "list"])

    return queries.select("query_id", "vector", "reach").mapInArrow(run, "query_id long, vector array<double>, list int")


def _compare(index: VectorIndex, probes: DataFrame, k: int, others_only: bool) -> DataFrame:
    """(query_id, id, distance): the ``k`` nearest of each part that a query meets."""
    width = index.centers.shape[1]
    spark = probes.sparkSession
    parts = spark.createDataFrame([(i, max(1, -(-int(c) // PART))) for i, c in enumerate(index.counts)], "list int, parts int")
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    plan = F.broadcast(asked.join(parts, "list"))  # one row a list
    left = probes.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query_id", "vector")
    right = index.rows.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, out = np.asarray(b.column("id"), np.int64), []
        if len(ids) and a.num_rows:
            asked, q, v = np.asarray(a.column("query_id"), np.int64), _matrix(a.column("vector"), width), _matrix(b.column("vector"), width)
            for at in range(0, len(asked), 256):
                d = _distances(q[at : at + 256], v)
                for i, row in enumerate(d):
                    if others_only:
                        row[ids == asked[at + i]] = np.inf
                    edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                    some = np.flatnonzero((row <= edge + 10.0**-PLACES) & (row < np.inf))
                    near = np.round(row[some], PLACES)
                    first = np.lexsort((ids[some], near))[:k]
                    out.append((np.full(len(first), asked[at + i]), ids[some][first], near[first]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "id": columns[1], "distance": columns[2]})

    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, distance double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = True, others_only: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest vectors of each of ``queries`` (query_id, vector), by Euclidean distance to six decimals, then id. Without ``exact`` only the ``probes`` nearest lists
    are read. With ``others_only`` a query doesn't find the row of its own id. Queries with a null id or a vector that can't be compared find nothing; repeated queries count once."""
    width = index.centers.shape[1]
    asked = queries.where(f"query_id is not null and size(vector) = {width} and not exists(vector, x -> x is null)").dropDuplicates(["query_id"])
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(0.0).alias("reach"))
    filled, radii = index.counts > 0, index.radii
    n = min(probes, int(filled.sum()))

    def nearest(d: np.ndarray) -> np.ndarray:
        order = np.argsort(np.where(filled, d, np.inf), axis=1, kind="stable")[:, :n]
        marks = np.zeros(d.shape, bool)
        np.put_along_axis(marks, order, True, axis=1)
        return marks

    def rank(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

    probed = written(_probe(index, asked, lambda d, reach: nearest(d)), "probes")
    first = written(rank(_compare(index, probed, k, others_only)), "nearest")
    if not exact:
        delete(probed)
        return first
    reached = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("found"))
    again = asked.drop("reach").join(reached, "query_id", "left").withColumn("reach", F.coalesce("found", F.lit(float("inf"))))
    rest = written(_probe(index, again, lambda d, reach: filled & ~nearest(d) & (d - radii <= reach[:, None] + 10.0**-PLACES)), "probes")
    both = written(rank(first.select("query_id", "id", "distance").unionByName(_compare(index, rest, k, others_only))), "nearest")
    delete(probed, rest, first)
    return both
