"""Similar names and clusters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import clusters


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near(keys, accept):
    keys = sorted({k for k in keys if k is not None})
    score = lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1)
    return sorted((a, b, round(score(a, b), 9)) for i, a in enumerate(keys) for b in keys[i + 1 :] if score(a, b) >= accept - 1e-9)


def edited(rng, key, times):
    for _ in range(times):
        at = rng.randrange(len(key) + 1)
        key = rng.choice([key[:at] + rng.choice("abé ") + key[at:], key[:at] + key[at + 1 :], key[:at] + "x" + key[at + 1 :]])
    return key


def names(seed=1):
    rng = random.Random(seed)
    keys = ["", "a", "nguyen van a", "nguyen van b", "nguyen van", "van nguyen a", None, None]
    for _ in range(70):
        key = "".join(rng.choice("abcdefgé ") for _ in range(rng.choice([2, 5, 9, 10, 14, 19, 20, 25, 29, 30, 34, 41, 160])))
        keys += [key, key] + [edited(rng, key, rng.randint(1, 5)) for _ in range(3)]
    return keys


@pytest.mark.parametrize("accept", [0.6, 0.8, 0.85, 0.9, 1.0])
def test_similar_keys(spark, accept):
    keys = names()
    if accept == 0.6:
        keys = [k for k in keys if k is None or len(k) < 16]
    df = spark.createDataFrame([(k, "c", 1) for k in keys], "name_key string, a string, score int").repartition(5)
    got = sorted((r.a, r.b, round(r.score, 9)) for r in clusters.similar_keys(df, accept).collect())
    assert got == near(keys, accept) and (got or accept == 1.0)


def test_threshold(spark):
    with pytest.raises(ValueError):
        clusters.similar_keys(spark.createDataFrame([], "name_key string"), 0.5)
    assert clusters.similar_keys(spark.createDataFrame([], "name_key string")).collect() == []


def test_frequent_surname_is_no_block(spark):
    """Names that share all but a given name don't meet, unless that is nearly equal too."""
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) + " nguyen" for _ in range(400)]
    kept = []
    original = clusters.written
    try:
        clusters.written = lambda df, name, path=None: kept.append((name, original(df, name, path))) or kept[-1][1]
        clusters.delete, drop = lambda *t: None, clusters.delete
        found = clusters.similar_keys(spark.createDataFrame([(k,) for k in keys], "name_key string"), 0.9)
    finally:
        clusters.written, clusters.delete = original, drop
    signed = dict(kept)["signatures"]
    assert signed.groupBy("s", "longer").count().agg(F.max("count")).first()[0] < 10
    assert sorted((r.a, r.b, round(r.score, 9)) for r in found.collect()) == near(keys, 0.9)


def union(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in parent)


def test_components(spark):
    rng = random.Random(4)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(200)]
    loose = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    odd = [(None, "q"), ("q", None), ("self", "self"), ("s1", "hub"), ("s1", "hub")]
    links = chain + star + loose + odd
    rng.shuffle(links)
    got = clusters.components(spark.createDataFrame([(a, b, "x") for a, b in links], "a string, b string, component string")).collect()
    assert sorted((r.node, r.component) for r in got) == union(links)
    assert clusters.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_people_clusters(spark):
    rows = [("tran thi mai", "Trần Thị Mai", "1"), ("tran thi mai", "TRẦN THỊ MAI", "1"), ("tran thi mai", "Trần Thị Mai", "2"), ("tran thi may", "Tran Thi May", "3"), ("le", "Lê", "3"), ("le", "Lê", None), (None, "?", "4")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "name_key string, name string, doc_id string, cluster string")
    got = sorted(tuple(r) for r in clusters.people_clusters(df).collect())
    assert got == [("le", "le", "Lê", 1, 2, 1), ("tran thi mai", "tran thi mai", "Trần Thị Mai", 2, 4, 3), ("tran thi may", "tran thi mai", "Trần Thị Mai", 2, 4, 3)]


def test_clusters_meet_without_texts(spark):
    """Signatures carry no keys, keys that differ in one place make a star and no clique, and the clusters are those of all pairs."""
    rng = random.Random(5)
    alike = [f"nguyen va{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    words = ["ement", "onnttion,", "by"]
    long = [" ".join([w] * k) for w in words for k in (4, 5, 9, 20, 22, 23, 31)] + [edited(rng, " ".join(["ement"] * 22), 9) for _ in range(3)]
    keys = sorted({*alike, *long, *(k for k in names(6)[:80] if k)})
    kept = []
    original, drop = clusters.written, clusters.delete
    try:
        clusters.written = lambda df, name, path=None: kept.append((name, original(df, name, path))) or kept[-1][1]
        clusters.delete = lambda *t: None
        df = spark.createDataFrame([(k, k.title(), str(i % 7)) for i, k in enumerate(keys)], "name_key string, name string, doc_id string")
        got = {r.name_key: r.cluster for r in clusters.people_clusters(df, 0.85).collect()}
    finally:
        clusters.written, clusters.delete = original, drop
    links = near(keys, 0.85)
    first = {}
    for name, table in kept:
        first.setdefault(name, table)
    assert "string" not in dict(first["signatures"].dtypes).values()
    among = [(a, b) for a, b, _ in links if a in alike and b in alike]
    assert len(among) == 26 * 25 // 2 and first["edges"].count() < len(links) - len(among) + 2 * len(alike)
    assert got == {k: k for k in keys} | dict(union([(a, b) for a, b, _ in links]))
