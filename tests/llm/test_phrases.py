"""Collocations against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import phrases

DOC = "doc_id long, text string, lang string, phrase string, n string, a int"


def brute(rows, least, longest, top):
    """rows are (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: c for p, c in f.items() if c >= least and 2 <= len(p) <= longest}
        inner = Counter()
        for p, c in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], c)
        scored = []
        for p, a in cand.items():
            if inner[p] and 100 * inner[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def made(n=400, seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ß", "É", "🎉", "a-b", "x\xa0y", "k\x1c"] + [f"v{i}" for i in range(30)]
    weights = [30, 5, 20, 8, 8, 8] + [2] * (len(words) - 6)
    rows = [(None, None), ("en", ""), ("en", " \t\n.,"), ("und", "new york"), (None, "of new york\tcity")]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(["in new york city", "of the", "a b c d e"]) if rng.random() < 0.1 else rng.choices(words, weights)[0])
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "]))
        rows.append((rng.choice(["en", "en", "de", None]), "".join(parts)))
    return rows


def run(spark, rows, *args):
    df = spark.createDataFrame([(k % 50 if k % 7 else None, t, lang, "x", "y", 0) for k, (lang, t) in enumerate(rows)], DOC)
    return sorted(tuple(r) for r in phrases.mine(df.repartition(5), *args).collect())


@pytest.mark.parametrize("least, longest, top", [(3, 4, 2000), (2, 2, 7), (4, 3, 50), (2, 6, 2000)])
def test_equals_brute_force(spark, least, longest, top):
    rows = made()
    got = run(spark, rows, least, longest, top)
    assert got == brute(rows, least, longest, top) and got


def test_hot_pairs_and_small_folds(spark, monkeypatch):
    """A passage in every text, and a pair that a third of all words belong to, with the folders emptied all the time."""
    monkeypatch.setattr(phrases, "FOLD_POINTERS", 50)
    monkeypatch.setattr(phrases, "FOLD_WORDS", 20)
    rows = [(lang, f"{t or ''} hot pair v{k % 9} hot pair v{k % 4} v{k % 3} hot pair one passage of the license") for k, (lang, t) in enumerate(made())]
    assert run(spark, rows, 5, 4, 2000) == brute(rows, 5, 4, 2000)


def test_shared_codes_change_the_seed(spark, monkeypatch):
    seeds, count = [], phrases.count_words

    def clash(docs, seed):
        seeds.append(seed)
        found = count(docs, seed)
        return found.withColumn("code", F.lit(5).cast("long")) if seed == 0 else found

    monkeypatch.setattr(phrases, "count_words", clash)
    rows = made(150)
    assert run(spark, rows, 3, 4, 2000) == brute(rows, 3, 4, 2000) and seeds == [0, 2]


def test_empty(spark):
    for rows in ([], [("en", "a b c")], [(None, None)]):
        df = spark.createDataFrame([(1, t, lang, "", "", 0) for lang, t in rows], DOC)
        got = phrases.mine(df)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.collect() == []


def test_long_text(spark):
    rows = [("en", "la " * 300_000 + "x" * 1_000_000 + " la la")]
    assert run(spark, rows, 30, 4, 10) == [("en", 1, "la la la la", 299_997, 300_002, 299_998, 300_003, 2_000_000 * 299_997 // 600_000)]


def test_scores_past_64_bits(spark):
    big = 8 * 10**12  # 2000000 times this is more than 2**63
    ones = spark.createDataFrame([(11, 22, 0, 0, big, 2)], "w1 long, w2 long, w3 long, w4 long, n long, size int")
    words = spark.createDataFrame([("en", "p", 11, big), ("en", "q", 22, 3 * big)], "lang string, word string, code long, n long")
    (r,) = phrases._ranked(ones, words, words, 4, 10).collect()
    assert tuple(r) == ("en", 1, "p q", big, big, 3 * big, 4 * big, 500_000)


def test_walk_holds_open_prefixes():
    rng = np.random.default_rng(1)
    words = np.array(sorted(map(tuple, rng.integers(0, 3, (200, 4)).tolist()))).T
    n = rng.integers(1, 9, 200)
    for depth in (3, 4):
        level, got = phrases._Open(depth), []
        for a in range(0, 200, 7):
            got += zip(*map(np.ndarray.tolist, (lambda k, s: (k.T, s))(*level.feed(words[:, a : a + 7], n[a : a + 7]))))
        got += zip(*map(np.ndarray.tolist, (lambda k, s: (k.T, s))(*level.close())))
        expected = Counter()
        for w, c in zip(words.T.tolist(), n.tolist()):
            expected[tuple(w[:depth])] += c
        assert [(tuple(k), c) for k, c in got] == sorted(expected.items())
