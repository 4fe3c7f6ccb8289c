"""Alignment of two extraction runs against plain Python."""

import random
from collections import Counter
from fractions import Fraction

from folio.operators import consistency

KIND = "doc_id string, span_type string, start int, end int, text string, confidence double, agreement string"


def plain(left, right):
    """Greedy one-to-one pairs over all pairs of two lists of (type, start, end, text, confidence)."""
    order = lambda s: tuple((x is not None, x) for x in (s[1], s[2], s[0], s[3], s[4]))
    left, right = sorted(left, key=order), sorted(right, key=order)
    free_left, free_right, out = list(range(len(left))), list(range(len(right))), []
    for i in list(free_left):
        j = next((j for j in free_right if left[i][:3] == right[j][:3]), None)
        if j is not None:
            free_left.remove(i), free_right.remove(j)
            out.append((left[i], right[j], "same"))
    pairs = []
    for i in free_left:
        for j in free_right:
            (a, b), (c, d) = ((x[1] or 0, x[2] or 0) for x in (left[i], right[j]))
            if a < b and c < d and max(a, c) < min(b, d):
                pairs.append((-Fraction(min(b, d) - max(a, c), max(b, d) - min(a, c)), left[i][0] != right[j][0], i, j))
    for _, other, i, j in sorted(pairs):
        if i in free_left and j in free_right:
            free_left.remove(i), free_right.remove(j)
            out.append((left[i], right[j], "retyped" if other else "moved"))
    return out + [(left[i], None, "left_only") for i in free_left] + [(None, right[j], "right_only") for j in free_right]


def spans(rng, n):
    out = []
    for _ in range(n):
        a = rng.randrange(40)
        out.append((rng.choice(["person", "location"]), rng.choice([a, a, None]), rng.choice([a + rng.randrange(8), a + 3, None]), rng.choice(["x", "y", None]), rng.choice([0.5, 0.9, None])))
    return out


def test_equals_plain_alignment(spark):
    rng = random.Random(5)
    left = {d: spans(rng, rng.randint(0, 25)) for d in [None, *map(str, range(40))]}
    right = {d: spans(rng, rng.randint(0, 25)) + rng.sample(left[d], len(left[d]) // 2) for d in left}
    left["only"], right["other"] = spans(rng, 3), spans(rng, 3)
    made = lambda side: spark.createDataFrame([(d, *s, "clash") for d, ss in side.items() for s in ss], KIND).repartition(4)
    compared = consistency.compare_runs(made(left), made(right))
    got = Counter()
    for r in compared.collect():
        of = lambda side: tuple(r[f"{side}_{c}"] for c in ("span_type", "start", "end", "text", "confidence"))
        got[r.doc_id, None if r.agreement == "right_only" else of("left"), None if r.agreement == "left_only" else of("right"), r.agreement] += 1
    expected = Counter((d, a, b, kind) for d in left.keys() | right.keys() for a, b, kind in plain(left.get(d, []), right.get(d, [])))
    assert got == expected and {k[3] for k in got} == {"same", "moved", "retyped", "left_only", "right_only"}
    by = {r.doc_id: r for r in consistency.agreement(compared).collect()}
    for d, r in by.items():
        kinds = Counter(k for _, _, k in plain(left.get(d, []), right.get(d, [])))
        assert (r.n_left, r.n_right, r.n_same, r.n_moved, r.n_retyped) == (len(left.get(d, [])), len(right.get(d, [])), kinds["same"], kinds["moved"], kinds["retyped"])
        assert r.rate == round(kinds["same"] / kinds.total(), 6)
    assert consistency.confirmed(compared).count() == sum(n for k, n in got.items() if k[3] in ("same", "moved"))
    assert consistency.confirmed(compared, moved=False).count() == sum(n for k, n in got.items() if k[3] == "same")


def test_empty(spark):
    none, one = spark.createDataFrame([], KIND), spark.createDataFrame([("1", "person", 0, 3, "abc", 0.9, "")], KIND)
    assert consistency.compare_runs(none, none).collect() == [] and consistency.agreement(consistency.compare_runs(none, none)).collect() == []
    assert [r.agreement for r in consistency.compare_runs(one, none).collect()] == ["left_only"]
    assert [r.agreement for r in consistency.compare_runs(none, one).collect()] == ["right_only"]


def test_sweep_looks_at_open_ranges_only():
    left, right = [(i * 10, i * 10 + 9) for i in range(50_000)], [(i * 10 + 5, i * 10 + 12) for i in range(50_000)]
    assert len(consistency.overlapping(left, right)) == 99_999
    same = [{"span_type": "a", "start": 0, "end": 9, "text": "", "confidence": None}] * 3000
    assert consistency.align(same, same) == [(i, i) for i in range(3000)]


def test_documents_meet_as_rows(spark):
    """A document isn't a group of its own for Python, and a null id is one document."""
    kind = "doc_id string, span_type string, start int, end int, text string, confidence double"
    left = spark.createDataFrame([(d, "person", 0, 3, "Ann", 0.5) for d in ("a", None, None)], kind)
    right = spark.createDataFrame([(d, "person", 0, 3, "Ann", 0.5) for d in (None, "b")], kind)
    df = consistency.compare_runs(left, right)
    assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r.doc_id), r.agreement) for r in df.collect())
    assert got == [("None", "left_only"), ("None", "same"), ("a", "left_only"), ("b", "right_only")]
