"""Periods of validity, reads as of a time and overlapping periods against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.operators import facts


def plain_periods(rows, max_age):
    latest = {}
    for key, at, value, seq in rows:
        if key is not None and at is not None:
            rank = (seq is not None, seq, value is not None, value or "")
            if (key, at) not in latest or rank > latest[key, at][0]:
                latest[key, at] = (rank, value)
    by_key = defaultdict(list)
    for (key, at), (_, value) in sorted(latest.items(), key=lambda x: x[0]):
        by_key[key].append((at, value))
    out = []
    for key, said in by_key.items():
        open_ = None  # value, from, last, n
        for at, value in [*said, (facts.FOREVER, "end of time")]:
            if open_ and open_[0] == value and (max_age is None or at - open_[2] <= max_age):
                open_ = (value, open_[1], at, open_[3] + 1)
                continue
            if open_:
                out.append((key, open_[0], open_[1], at if max_age is None else min(at, open_[2] + max_age), open_[3]))
            open_ = (value, at, at, 1)
    return sorted(map(repr, (p for p in out if p[3] > p[2])))


def said(seed=3, n=900):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abcde"), rng.randrange(400), rng.choice(["x", "x", "y", None]), rng.choice([1, 2, 3])) for _ in range(n)]
    return rows + rows[:20] + [(None, 5, "x", 1), ("a", None, "x", 1), ("z", 0, "only", None), ("z", 0, "onlz", None)]


@pytest.mark.parametrize("max_age, bucket", [(None, 1 << 16), (None, 7), (3, 7), (1, 1), (50, 100)])
def test_periods(spark, max_age, bucket):
    rows = said()
    df = spark.createDataFrame([(*r, "c") for r in rows], "key string, at long, value string, seq int, valid_from string").repartition(5)
    got = facts.periods(df, max_age, bucket).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_periods(rows, max_age)
    assert facts.periods(df.limit(0)).collect() == []


def test_blocks_partition_a_period():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.choice([0, rng.randrange(1 << 12), rng.randrange(1 << 39)])
        b = rng.choice([facts.FOREVER, a + rng.randrange(1, 5000)])
        blocks = list(facts._blocks(a, b))
        assert len(blocks) <= 2 * facts.LEVELS and sum(1 << lv for lv, _ in blocks) == b - a
        for at in {a, b - 1, (a + b) // 2, rng.randrange(a, b)}:
            assert sum(at >> lv == bl for lv, bl in blocks) == 1
        for at in (a - 1, b):
            assert not any(at >= 0 and at >> lv == bl for lv, bl in blocks)


def test_as_of(spark):
    rows = said()
    known = facts.periods(spark.createDataFrame(rows, "key string, at long, value string, seq int"), 20)
    periods = [tuple(r) for r in known.collect()]
    rng = random.Random(2)
    reads = [(i, rng.choice(["hot", "a", "b", "nobody", None]), rng.choice([None, -5, 10**13, rng.randrange(500)])) for i in range(400)]
    reads += reads[:10]
    got = facts.as_of(known, spark.createDataFrame([(*r, "c") for r in reads], "id int, key string, at long, level string")).collect()
    expected = []
    for i, key, at in reads:
        hit = [p for p in periods if p[0] == key and at is not None and p[2] <= at < p[3]]
        assert len(hit) <= 1
        expected.append((i, key, at, *(hit[0][1:4] if hit else (None, None, None))))
    assert sorted(map(repr, expected)) == sorted(repr((r.id, r.key, r.at, r.value, r.valid_from, r.valid_to)) for r in got)


def test_overlaps(spark):
    rng = random.Random(4)

    def made(n):
        return [(rng.choice(["hot", "hot", "a", None]), f"v{i}", at := rng.randrange(300), rng.choice([at, at + 1, at + rng.randrange(80), facts.FOREVER])) for i in range(n)]

    left, right = made(150) + [("one", "l", 5, 9)], made(150) + [("one", "r", 9, 12), ("one", "s", 5, 6), ("one", "t", 0, 6)]
    kind = "key string, value string, valid_from long, valid_to long"
    got = facts.overlaps(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect()
    expected = [(k, v, w, max(a, c), min(b, d)) for k, v, a, b in left for x, w, c, d in right if k is not None and k == x and max(a, c) < min(b, d) and a < b and c < d]
    assert sorted(tuple(r) for r in got) == sorted(expected) and len(expected) > 1000
    assert facts.overlaps(spark.createDataFrame([], kind), spark.createDataFrame(right, kind)).collect() == []


def test_a_period_takes_few_rows(spark):
    df = spark.createDataFrame([("k", "v", 12345, facts.FOREVER)], "key string, value string, valid_from long, valid_to long")
    assert facts._in_blocks(df).count() <= 2 * facts.LEVELS
    assert facts._in_blocks(df).agg(F.sum(F.expr("shiftleft(1L, level)"))).first()[0] == facts.FOREVER - 12345


def test_rows_that_were_multiplied_are_not_broadcast(spark):
    """Tables that are small before a row is listed for each length or block."""
    known = spark.range(50).selectExpr("id % 7 key", "'v' value", "id * 10 valid_from", f"if(id % 2 = 0, {facts.FOREVER}, id * 10 + 10) valid_to")
    reads = spark.range(50).selectExpr("id % 7 key", "id * 11 at")
    for df in (facts.as_of(known.where(f"valid_to < {facts.FOREVER}"), reads), facts.overlaps(known, known), facts.periods(reads.selectExpr("key", "at", "'v' value", "1 seq"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_open_periods_take_few_lengths(spark):
    """Moments are listed for the lengths that meet within their time, not up to the end of time."""
    known = spark.createDataFrame([("k", "v", 100, facts.FOREVER), ("k", "w", 5, 100), (None, "n", 0, 9)], "key string, value string, valid_from long, valid_to long")
    reads = spark.createDataFrame([("k", t) for t in (99, 100, 106, 4, None, -1, facts.FOREVER + 1)], "key string, at long")
    made = []
    plain, facts._in_blocks = facts._in_blocks, lambda rows: made.append(plain(rows)) or made[-1]
    try:
        got = facts.as_of(known, reads).collect()
    finally:
        facts._in_blocks = plain
    assert {r.at: r.value for r in got} == {99: "w", 100: "v", 106: "v", 4: None, None: None, -1: None, facts.FOREVER + 1: None}
    assert made[0].agg(F.max("level")).first()[0] <= 7
