"""BM25 and the vector index against plain Python."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import search, vectors

SF = "/root/testdata/sf0.1"


def bm25(passages, queries, k):
    """passages: {key: text}; queries: {id: text}."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    counts = {key: Counter(words(t)) for key, t in passages.items() if words(t)}
    size = {key: sum(c.values()) for key, c in counts.items()}
    mean = sum(size.values()) / len(size) if size else 0
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in queries.items():
        scores = []
        for key, c in counts.items():
            score = 0.0
            for t, w in Counter(words(text)).items():
                if c[t]:
                    idf = math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5))
                    score += w * idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[key] / mean))
            if set(words(text)) & set(c):
                scores.append((-round(score, 6), key))
        out += [(q, r, *key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    vocabulary = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(60)] + ["Zürich", "x_y", "a1", "🎉"]
    passages = {(d, p): " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for d in range(60) for p in range(3)}
    passages[99, 0], passages[99, 1], passages[99, 2] = None, "", " -- "
    passages |= {(100 + i, 0): "the same passage w1 w2" for i in range(40)}  # ties
    queries = {i: " ".join(rng.choice(vocabulary) for _ in range(6)) for i in range(25)}
    return passages, queries | {30: "the of", 31: "the", 32: None, 33: "", 34: "unknown", 35: "same same w1", 36: "ZÜRICH a1"}


@pytest.mark.parametrize("k, probed", [(1, 0), (1, 1000), (5, 5), (5, 1000), (200, 10)])
def test_search_equals_brute_force(spark, monkeypatch, k, probed):
    monkeypatch.setattr(search, "PROBED", probed)
    passages, queries = corpus()
    rows = [(d, p, t, "clash", "clash") for (d, p), t in passages.items()] + [(None, 0, "the w1", "", ""), (1, None, "the w1", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, passage_id int, text string, score string, term string").repartition(5)
    asked = spark.createDataFrame([*((q, t, "c") for q, t in queries.items()), (None, "the", "c")], "query_id long, text string, rank string")
    found = search.search(search.build_index(df), asked, k).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, r.passage_id, r.score) for r in found) == bm25(passages, queries, k)


@pytest.mark.parametrize("k, terms, hits", [(1, 50_000, 50_000), (5, 20, 10), (200, 50_000, 100)])
def test_scan_equals_brute_force(spark, monkeypatch, k, terms, hits):
    """With many candidates the index is scanned: the same answer, and only the best of each task are written."""
    monkeypatch.setattr(search, "MAX_EXPANDED", 0)
    monkeypatch.setattr(search, "SCAN_TERMS", terms)
    monkeypatch.setattr(search, "SCAN_HITS", hits)
    monkeypatch.setattr(search, "SCAN_ROWS", 7)
    passages, queries = corpus()
    df = spark.createDataFrame([(f"d{d:03}", p, t) for (d, p), t in passages.items()], "doc_id string, passage_id int, text string").repartition(5)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    kept, original = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name, path=None: kept.append(name) or original(df, name, path))
    found = search.search(search.build_index(df), asked, k).collect()
    named = {(f"d{d:03}", p): t for (d, p), t in passages.items()}
    assert sorted((r.query_id, r["rank"], r.doc_id, r.passage_id, r.score) for r in found) == bm25(named, queries, k)
    assert "scanned" in kept and "candidates" not in kept


def test_common_terms_are_not_expanded(spark, monkeypatch):
    """A term of every passage meets only the candidates that rarer terms name."""
    passages = {(d, 0): "the the of " + (f"rare{d % 50} " * (d % 3 + 1)) for d in range(1000)}
    df = spark.createDataFrame([(d, p, t) for (d, p), t in passages.items()], "doc_id long, passage_id int, text string")
    queries = {q: f"the of rare{q}" for q in range(20)}
    monkeypatch.setattr(search, "PROBED", 30)
    index = search.build_index(df)
    kept = []
    original = search.written
    try:
        search.written = lambda df, name, path=None: kept.append((name, original(df, name, path))) or kept[-1][1]
        search.delete, drop = lambda *t: None, search.delete
        found = search.search(index, spark.createDataFrame(list(queries.items()), "query_id long, text string"), 3).collect()
    finally:
        search.written, search.delete = original, drop
    tables = dict(kept)
    assert sorted((r.query_id, r["rank"], r.doc_id, r.passage_id, r.score) for r in found) == bm25(passages, queries, 3)
    assert tables["query-split"].where("later").select("term").distinct().count() == 2
    assert tables["candidates"].count() <= 20 * 20 and tables["probed"].count() <= 20 * 20


def test_index_on_disk_and_empty(spark, tmp_path):
    passages, queries = corpus()
    df = spark.createDataFrame([(d, p, t) for (d, p), t in passages.items()], "doc_id long, passage_id int, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    search.build_index(df, f"file://{tmp_path}/index")
    again = search.search(search.open_index(spark, f"file://{tmp_path}/index"), asked, 4)
    assert sorted((r.query_id, r["rank"], r.doc_id, r.passage_id, r.score) for r in again.collect()) == bm25(passages, queries, 4)
    empty = df.limit(0)
    assert search.search(search.build_index(empty), asked).collect() == []
    assert search.search(search.build_index(df), asked.limit(0)).collect() == []
    assert search.gate(empty, asked).collect() == []


def test_long_passage(spark):
    df = spark.createDataFrame([(1, 0, "a b " * 100_000), (2, 0, "b c"), (3, 0, "x" * 1_000_000)], "doc_id long, passage_id int, text string")
    found = search.search(search.build_index(df), spark.createDataFrame([(1, "a b")], "query_id long, text string"), 5).collect()
    assert [r.doc_id for r in found] == [1, 2]


def nearest(rows, queries, k, others_only=False):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for q, v in queries:
        d = np.round(np.sqrt(((m - np.array(v, float)) ** 2).sum(axis=1)), 6)
        order = [j for j in np.lexsort((ids, d)) if not (others_only and ids[j] == q)][:k]
        out += [(q, r, int(ids[j]), float(d[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def cloud(n=700, width=6, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, width)) * 3
    m = (centers[rng.integers(0, 9, n)] + rng.normal(size=(n, width))).astype(np.float32)
    m[: n // 3] = m[0]  # a third of all rows are one vector
    return [(i, m[i].tolist()) for i in range(n)]


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = cloud()
    bad = [(None, rows[0][1], "c"), (5000, None, "c"), (5001, [1.0], "c"), (5002, [1.0, None, 2.0, 3.0, 4.0, 5.0], "c")]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows] + bad, "id long, vector array<float>, distance string").repartition(6)
    index = vectors.build_index(df, 20)
    queries = [(i, v) for i, v in rows if i % 20 == 0] + [(9000, [50.0] * 6), (9001, [0.0] * 6)]
    asked = spark.createDataFrame(queries + queries[:3] + [(None, [0.0] * 6), (9002, [1.0]), (9003, None)], "query_id long, vector array<double>")
    for k, others in ((1, False), (10, True), (300, False), (1000, False)):
        got = vectors.search(index, asked, k, probes=2, others_only=others).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in got) == nearest(rows, queries, k, others), k


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert vectors.build_index(empty) is None
    one = vectors.build_index(spark.createDataFrame([(3, [1.0, 2.0])], "id long, vector array<double>"))
    assert [tuple(r) for r in vectors.search(one, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>"), 5).collect()] == [(1, 1, 3, 0.0)]
    assert vectors.search(one, empty.withColumnRenamed("id", "query_id")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_few_lists(spark):
    """Ids divisible by 50 against all rows: on these vectors, which have hardly any clusters, 26 of 44 lists find 0.9 of the ten neighbours."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.build_index(rows)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.search(index, asked, 10).collect()}
    few = {(r.query_id, r.id) for r in vectors.search(index, asked, 10, probes=26, exact=False).collect()}
    assert len(index.counts) == 44 and len(exact) == 400 and len(few & exact) >= 0.9 * len(exact), len(few & exact)
    plain = [(r.id, r.vector) for r in rows.collect()]
    assert {(q, i) for q, _, i, _ in nearest(plain, [x for x in plain if x[0] % 50 == 0], 10)} == exact
