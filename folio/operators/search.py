"""Passage gating by BM25: an index of postings and an exact top-k search.

The index is a table with a row for each passage: its length, its terms and their counts. Each task writes its own passages, so building shuffles nothing;
expanded, the rows are the postings (term, passage, count in it, length of the passage).

A search reads few lists. Each query first reads those of its rare terms; the best passages found that way are scored in full, and the k-th of
them is a score that the answer reaches at least. Terms whose greatest gains in any passage together stay below that can't bring a passage into the answer: only
passages with one of the other terms are candidates, and of those only the ones that could still reach it with all that the left-out terms add; these are looked up one by one.
A term that nearly every passage has is thus hardly ever expanded.

Where the terms that are left have so many postings that most passages would be candidates of most queries, the index is scanned instead: each task scores its own
passages for all queries at once and passes on its k best of each. Only those are shuffled, whatever the number of passages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import delete, written

K1, B = 1.2, 0.75
#: Scores are compared at six decimals, so sums in another order rank alike.
PLACES, SLACK = 6, 1e-5
#: Lists of up to so many passages are read first, always the shortest one that has enough for an answer; and of each query so many
#: passages for each place of the answer are scored in full.
PROBED, SCORED = 1000, 20
#: Passages that are looked up are broadcast up to so many rows of two ids; more are joined by shuffle.
MAX_BROADCAST = 200_000
#: Postings of essential terms, over all queries, up to which passages are looked up; beyond, the index is scanned, for so many (query, term) pairs at once.
MAX_EXPANDED, SCAN_TERMS = 2_000_000, 50_000
#: Passages that a scan scores at once, and hits that a task holds before it leaves out all but the best.
SCAN_ROWS, SCAN_HITS = 200, 50_000
_TERM = re.compile(r"[^\W_]+")
KEY = ["doc_id", "passage_id"]


def terms(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _TERM.findall((text or "").lower())


@dataclass
class Index:
    """``table`` (doc_id, passage_id, length, terms, tfs), the number of passages with a term and their mean length."""

    table: DataFrame
    passages: int
    mean_length: float

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, passage_id, tf, length)"""
        rows = self.table.select(*KEY, "length", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p"))
        return rows.select(F.col("p.terms").alias("term"), *KEY, F.col("p.tfs").alias("tf"), "length")


def build_index(passages: DataFrame, path: str | None = None) -> Index:
    """Index ``passages`` (doc_id, passage_id, text), at ``path`` or in the scratch folder. A passage is named by its two ids, which should be unique: rows without them or without a term aren't searched."""
    rows = passages.where("doc_id is not null and passage_id is not null").select(*KEY, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names, tfs, ends, lengths = [], [], [0], []
                for text in part.column("text").to_pylist():
                    counts = Counter(terms(text))
                    names += counts
                    tfs += counts.values()
                    ends.append(len(names))
                    lengths.append(counts.total())
                some = pa.array(np.flatnonzero(lengths))
                ends = pa.array(ends, pa.int32())
                columns = [*(part.column(k) for k in KEY), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(names, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], names=[*KEY, "length", "terms", "tfs"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEY)
    return _opened(written(rows.mapInArrow(run, f"{kinds}, length int, terms array<string>, tfs array<int>"), "postings", path))


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build_index`` wrote at ``path``."""
    return _opened(spark.read.parquet(path))


def _opened(table: DataFrame) -> Index:
    one = table.agg(F.sum("length").alias("words"), F.count("*").alias("n")).first()
    return Index(table, one.n, one.words / one.n if one.n else 0.0)


def _gain(index: Index) -> Column:
    """What a posting adds to a query, but for the term's weight."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(index.mean_length or 1.0))
    return F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, n) for k, text in enumerate(batch.column("text").to_pylist()) for t, n in Counter(terms(text)).items()]
            if rows:
                k, t, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(k)), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["query_id", "term", "qtf"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = queries.where("query_id is not null").select("query_id", "text").mapInArrow(run, f"query_id {kind}, term string, qtf long")
    return found.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` for a join with postings: broadcast, unless they are too many."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else rows


def _scanned(index: Index, known: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, passage_id, score) of the ``k`` best passages in each task of each query of ``known`` (query_id, term, weight, reached), a bounded number of rows."""
    given = known.select("query_id", "term", "weight", "reached").toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")])
    ids = pc.unique(given["query_id"].combine_chunks())
    vocabulary = pc.unique(given["term"].combine_chunks())
    of_query, of_term = (pc.index_in(given[c].combine_chunks(), value_set=v).to_numpy() for c, v in (("query_id", ids), ("term", vocabulary)))
    weight, reached = given["weight"].to_numpy(), np.zeros(len(ids))
    reached[of_query] = given["reached"].to_numpy()
    k1, b, mean, at_once, held_most, places, slack, key = K1, B, index.mean_length or 1.0, SCAN_ROWS, SCAN_HITS, PLACES, SLACK, KEY

    def best(hits: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(hits, ignore_index=True)
        rows["rounded"] = -np.floor(rows.score * 10**places + 0.5)
        return rows.sort_values(["q", "rounded", *key], kind="stable").groupby("q", sort=False).head(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((len(vocabulary), len(ids)))
        weights[of_term, of_query] = weight
        least, hits, held = reached.copy(), [], 0
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in key]
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                lists, length = part.column("terms"), part.column("length").to_numpy()
                row = pc.list_parent_indices(lists).to_numpy()
                term = pc.index_in(lists.flatten(), value_set=vocabulary)
                there = pc.is_valid(term).to_numpy(zero_copy_only=False)
                row, tf = row[there], part.column("tfs").flatten().to_numpy()[there]
                if not len(row):
                    continue
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                scores = np.add.reduceat(weights[term.drop_null().to_numpy()] * gain[:, None], starts, axis=0)
                i, q = np.nonzero((scores > 0) & (scores >= least))
                if len(i):
                    at = pa.array(row[starts[i]])
                    hits.append(pd.DataFrame({"q": q, **{c: part.column(c).take(at).to_pandas() for c in key}, "score": scores[i, q]}))
                    held += len(i)
                if held > held_most:
                    rows = best(hits)
                    full = rows.groupby("q").score.agg(["size", "min"])
                    full = full[full["size"] == k]
                    least[full.index] = np.maximum(least[full.index], full["min"] - slack)
                    hits, held = [rows], 0
        if hits:
            rows = best(hits)
            columns = [ids.take(pa.array(rows.q.to_numpy())), *(pa.array(rows[c].to_numpy(), t) for c, t in zip(key, kinds)), pa.array(rows.score.to_numpy(), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", *key, "score"])

    kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for c, t in (("query_id", known), *((c, index.table) for c in KEY)))
    return index.table.mapInArrow(run, f"{kinds}, score double")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, passage_id, score) of the ``k`` best passages of each of ``queries`` (query_id, text), equal scores by doc_id and
    passage_id. Passages that share no term with a query aren't found; neither are queries with a null id."""
    by_query = W.partitionBy("query_id")
    asked = written(_asked(queries), "query-terms")
    # Of the words of the queries: how many passages have them, and what they add at most.
    words = index.postings.join(_small(asked.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"), F.max(_gain(index)).alias("top"))
    weight = F.col("qtf") * F.log(F.lit(1.0) + (F.lit(index.passages) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(words, "term").select("query_id", "term", "df", weight.alias("weight"), "top")
    enough = F.min(F.when(F.col("df") >= k, F.col("df"))).over(by_query)
    known = written(known.withColumn("probe", (F.col("df") <= PROBED) | (F.col("df") <= enough)), "query-weights")

    def ranked(whole: DataFrame) -> DataFrame:
        best = whole.withColumn("score", F.round("score", PLACES)).withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), *KEY))).where(F.col("rank") <= k)
        return written(best.select("query_id", "rank", *KEY, "score"), "found")

    # A single scan is cheaper than to find out which of very many postings could be left out.
    postings, pairs = known.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count("*")).first()
    if postings > MAX_EXPANDED and pairs <= SCAN_TERMS:
        scanned = written(_scanned(index, known.withColumn("reached", F.lit(-SLACK)), k), "scanned")
        found = ranked(scanned)
        delete(asked, known, scanned)
        return found

    def sums(some: DataFrame) -> DataFrame:
        """Score of every passage that has one of these terms of a query, from these terms."""
        return _small(some.select("query_id", "term", "weight")).join(index.postings, "term").groupBy("query_id", *KEY).agg(F.sum(F.col("weight") * _gain(index)).alias("score"))

    def added(rows: DataFrame, some: DataFrame) -> DataFrame:
        """``rows`` (query_id, the ids of a passage, score) with what these terms of the query add."""
        lists = index.postings.join(_small(some.select("term").distinct()), "term", "left_semi").join(_small(rows.select(*KEY).distinct()), KEY)
        more = rows.select("query_id", *KEY).join(some.select("query_id", "term", "weight"), "query_id").join(lists, ["term", *KEY])
        more = more.groupBy("query_id", *KEY).agg(F.sum(F.col("weight") * _gain(index)).alias("more"))
        return rows.join(more, ["query_id", *KEY], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")

    first = sums(known.where("probe")).withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score"), *KEY))).where(F.col("r") <= SCORED * k).drop("r")
    first = written(first, "probed")
    full = added(first, known.where("not probe"))
    kth = full.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("reached"))
    # Terms by what they can add, the least first: those that together stay below what is reached are looked up later.
    most = F.col("weight") * F.col("top")
    upto = F.sum(most).over(by_query.orderBy(most, "term").rowsBetween(W.unboundedPreceding, 0))
    split = known.join(kth, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)) - SLACK).withColumn("later", upto < F.col("reached"))
    split = written(split.withColumn("most", most), "query-split")
    essential, common = split.where("not later"), split.where("later")
    open_ = split.groupBy("query_id").agg(F.first("reached").alias("reached"), F.sum(F.when(F.col("later"), F.col("most")).otherwise(0.0)).alias("most"))
    expanded = split.where("not later").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if expanded > MAX_EXPANDED:
        parts = -(-pairs // SCAN_TERMS)
        some = [_scanned(index, split.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k) for i in range(parts)]
        candidates = written(reduce(DataFrame.unionByName, some), "scanned")
        whole = candidates
    else:
        candidates = written(sums(essential).join(open_, "query_id").where(F.col("score") + F.col("most") >= F.col("reached")).select("query_id", *KEY, "score"), "candidates")
        whole = added(candidates, common)
    found = ranked(whole)
    delete(asked, known, first, split, candidates)
    return found


def gate(passages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``passages`` that are among the ``k`` best of a query, with n_queries and best_score; the others are left out."""
    index = build_index(passages)
    hits = search(index, queries, k).groupBy(*KEY).agg(F.count("*").alias("n_queries"), F.max("score").alias("best_score"))
    delete(index.table)
    return passages.join(_small(hits), KEY)
