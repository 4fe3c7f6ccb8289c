"""Merging allegations: the order of statements doesn't count, batch and stream agree."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from folio.operators import allegations

KIND = "person string, allegation string, status string, at timestamp, mask string"
START = datetime(2024, 1, 1)
IMPLIES = {"alleged": {"alleged"}, "charged": {"alleged", "charged"}, "convicted": {"alleged", "charged", "convicted"}, "acquitted": {"alleged", "charged", "acquitted"}}
IMPLIES["contested"] = IMPLIES["convicted"] | IMPLIES["acquitted"]


def status(said):
    known = set().union(*(IMPLIES[s] for s in said))
    return next(s for s, v in IMPLIES.items() if v == known)


def test_lattice(spark):
    """The merge of any two is the least status that implies both."""
    df = spark.createDataFrame(list(product(IMPLIES, IMPLIES)), "a string, b string")
    for r in df.select("*", allegations.status_of(allegations.mask_of(F.upper("a")).bitwiseOR(allegations.mask_of(F.col("b")))).alias("m")).collect():
        assert r.m == status([r.a, r.b])


def said(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + list("abcdefgh")), rng.choice(["x", "y"]), rng.choice(["alleged"] * 6 + ["Charged", "charged", "convicted", "ACQUITTED"]), START + timedelta(minutes=rng.randrange(5000)), "c") for _ in range(n)]
    rng.shuffle(rows)
    return rows


def test_merge(spark):
    rows = said() + [(None, "x", "alleged", START, ""), ("a", None, "alleged", START, ""), ("a", "x", "rumour", START, ""), ("a", "x", None, START, ""), ("undated", "x", "charged", None, "")]
    got = {(r.person, r.allegation): r for r in allegations.present(allegations.merge(spark.createDataFrame(rows, KIND).repartition(5))).collect()}
    keys = {}
    for p, a, s, at, _ in rows:
        if p and a and s and s != "rumour":
            keys.setdefault((p, a), []).append((s.lower(), at))
    assert set(got) == set(keys)
    for key, told in keys.items():
        r, dated = got[key], [at for _, at in told if at]
        assert r.status == status([s for s, _ in told]) and r.as_fact == (r.status == "convicted") and r.n_statements == len(told)
        assert (r.first_at, r.last_at) == ((min(dated), max(dated)) if dated else (None, None))
        for s in ("alleged", "charged", "convicted", "acquitted"):
            assert r[f"{s}_at"] == min((at for x, at in told if at and s in IMPLIES[x]), default=None)
    assert allegations.merge(spark.createDataFrame([], KIND)).collect() == []


def test_parts_merge_to_the_whole(spark):
    df = spark.createDataFrame(said(), KIND)
    parts = allegations.merge(df.where("at < '2024-01-02'")).unionByName(allegations.merge(df.where("at >= '2024-01-02'"))).unionByName(allegations.merge(df.where("at >= '2024-01-02'")).withColumn("n_statements", F.lit(0).cast("long")))
    assert sorted(map(repr, allegations.merge_states(parts).collect())) == sorted(map(repr, allegations.merge(df).select(*allegations.STATE).collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_agrees_with_batch(spark, tmp_path, parts):
    df = spark.createDataFrame(said(300), KIND)
    for k in range(parts):
        df.where(F.pmod(F.hash("person", "at", "status"), F.lit(parts)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = []
    query = allegations.follow(stream, 0, "30 days").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda batch, n: found.extend((n, r) for r in batch.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for _, r in sorted(found, key=lambda x: x[0]):
        assert allegations.MASKS[r.status] > allegations.MASKS.get(last.get((r.person, r.allegation)), 0)  # only rises
        last[r.person, r.allegation] = r.status
    assert last == {(r.person, r.allegation): r.status for r in allegations.present(allegations.merge(df)).collect()}


def test_stale_allegations(spark, tmp_path):
    days = [[("a", "x", "alleged", 0)], [("b", "x", "charged", 1)], [("b", "x", "charged", 40)], [("a", "x", "convicted", 41)], [("c", "x", "alleged", 90)], [("c", "x", "alleged", 91)]]
    for k, rows in enumerate(days):
        spark.createDataFrame([(p, a, s, START + timedelta(days=d), "") for p, a, s, d in rows], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    found = []
    query = allegations.follow(stream, 30 * 86_400, "1 day").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda batch, n: found.extend((n, r.person, r.status) for r in batch.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    of = lambda p: [s for _, q, s in sorted(found) if q == p]
    assert of("a") in (["alleged", "stale", "convicted", "stale"], ["alleged", "convicted", "stale"]) and of("b")[0] == "charged" and of("b")[-1] == "stale" and of("c") == ["alleged"], found
