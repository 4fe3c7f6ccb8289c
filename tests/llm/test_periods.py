"""Periodic runs against a brute-force search."""

import hashlib
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from folio.llm import periods
from folio.llm.queries import QUERIES, with_planted_runs

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, runs string, n_words string, collapsed int"


def brute(words, exponent=4, least=6):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return (text or "").encode().split()


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x\x0bx\x0cx x x x\x1cx x x x x x x", "ä ä ä ä ä ä ä b \xa0"]
    for _ in range(300):  # few different words, planted periods, two runs that touch
        words = [rng.choice("ab" if rng.random() < 0.3 else "abcdefgh") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            seed = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (seed * 9)[: rng.randint(3 * len(seed), 7 * len(seed))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 9)])
def test_equals_brute_force(spark, exponent, least):
    rows = [(k % 290, t, "x", "y", 1) for k, t in enumerate(texts())] + [(None, "a a a a a a", "x", "y", 1)] * 2
    got = periods.find_runs(spark.createDataFrame(rows, DOC), exponent, least).collect()
    assert len(got) == len(rows)
    expected = []
    for d, t, *_ in rows:
        words = [w.decode() for w in split(t)]
        runs = brute(words, exponent, least)
        expected.append((d, len(words), runs, collapse(words, runs)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got)


def test_empty_table(spark):
    assert periods.find_runs(spark.createDataFrame([], DOC)).collect() == []


def test_long_texts(spark):
    rng = random.Random(3)
    noise = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    unit = noise(30_000)
    rows = [(1, " ".join(["la"] * 400_000)), (2, " ".join(noise(500) + unit * 4 + noise(700))), (3, " ".join((["a", "b"] * 30 + ["c"]) * 2000)), (4, "x" * 3_000_000)]
    got = {r.doc_id: r for r in periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "la"
    (only,) = got[2].runs
    assert only.period == 30_000 and only.start <= 500 and only.length >= 120_000
    assert (0, 122_000, 61) in [tuple(x) for x in got[3].runs] and len(got[3].runs) == 2001
    assert got[4].runs == [] and got[4].n_words == 1


def test_probes_find_all_alignments():
    """A run is found wherever it lies on the grid."""
    for p in (1, 2, 3, 7):
        for shift in range(2 * p + 1):
            codes = np.array([100 + i for i in range(shift)] + list(range(p)) * 6 + [90] + [-1])
            got = periods.runs_of(codes, np.array([len(codes)]), np.array([len(codes) - 1]))
            assert got == [(shift, shift + 6 * p, p)]


def test_planted(spark):
    rows = [(d, f"w{d} " + " ".join(f"v{i}" for i in range(n))) for d in range(400) for n in (0, 1, 30)] + [(None, "a b"), (7, None)]
    got = with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = []
    for d, t in rows:
        h = zlib.crc32(str(d).encode())
        words = (t or "").split()
        if d is not None and words and h % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            t = " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
        expected.append((d, t))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text)) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    docs = with_planted_runs(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and sum(r.n_runs for r in got.values()) > 10
    for d in docs:
        words = [w.decode() for w in split(d.text)]
        runs, r = brute(words) if len(words) < 3000 else None, got[d.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
