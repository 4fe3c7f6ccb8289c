"""Suffix dedup, MinHash near-dedup and line dedup against brute-force versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import line_dedup, minhash, suffix_dedup

SCHEMA = "doc_id long, text string, kept string, n int"


def table(spark, rows):
    """Documents with further columns, also ones named like outputs."""
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def vocabulary(seed, size=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 8))) for _ in range(size)]


def corpus(seed=1):
    """Copies, near copies, shared passages, periodic and odd texts."""
    rng, words = random.Random(seed), vocabulary(seed)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, long = text(120), text(40), text(3000)
    rows = [base, base, base.upper(), "", None, "  \n\t ", "one", "one", text(3), long, long[:9000] + " " + text(50), "ab" * 300, "b" + "ab" * 200, "é" * 300]
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [text(30) + " " + passage + " " + text(30) for _ in range(6)]
    return list(enumerate(rows))


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("max_group", [4000, 1])
def test_suffix_dedup(spark, max_group):
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows), max_group=max_group).collect()}
    assert got == brute_suffix(rows)
    assert sum(x[1] for x in got.values()) > 5000


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    rows = corpus(2)
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {d: x[3] for d, x in brute_suffix(rows).items()}


def test_suffix_dedup_of_repeated_ids(spark):
    """Texts of one doc_id keep their own bytes; equal rows are treated alike."""
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(500)) for _ in range(2))
    rows = [(1, a), (2, b), (2, "z" * 50 + a), (3, b), (3, b)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    assert got == [(1, 500, 0), (2, 500, 0), (2, 550, 500), (3, 500, 500), (3, 500, 500)]
    # Two texts of one doc_id with a passage in common: one of them loses it.
    two = [(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, [(5, "x" + a), (5, a + "yy")])).collect()]
    assert sorted(two, key=lambda x: x[1])[0][1] == 0 and sum(x[1] for x in two) == 500


def test_suffix_dedup_edges(spark):
    empty = suffix_dedup.remove_repeats(table(spark, []))
    assert empty.count() == 0 and "kept_sha256" in empty.columns
    rows = suffix_dedup.remove_repeats(table(spark, [(None, "x" * 300), (None, None), (1, "y" * 99)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (99, 0), (300, 0)]


def test_transform_finds_equal_windows():
    rng = np.random.default_rng(3)
    segments = [bytes(rng.integers(97, 99, rng.integers(20, 60)).astype(np.uint8)) for _ in range(40)]
    doc, pos = suffix_dedup.repeated_windows(segments, np.arange(40), np.zeros(40, np.int64), 12)
    seen, expected = set(), set()
    for d, s in enumerate(segments):
        for p in range(len(s) - 11):
            if s[p : p + 12] in seen:
                expected.add((d, p))
            seen.add(s[p : p + 12])
    assert set(zip(doc.tolist(), pos.tolist())) == expected


def sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").lower().encode().split()
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_classes(rows):
    found = sets(rows)
    root = {d: d for d in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(found), 2):
        both = len(found[a] & found[b])
        if both and 9 * both >= 4 * (len(found[a]) + len(found[b])):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: top(d) for d in found}


@pytest.mark.parametrize("seed", [1, 7])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.group_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    expected = brute_classes(rows)
    assert got == {d: (g, d == g) for d, g in expected.items()}
    assert len(set(expected.values())) < len(rows) - 5


def test_near_duplicate_chains(spark):
    """Neighbours are alike, the ends of a chain are not: one class all the same."""
    words = vocabulary(5)
    rng = random.Random(5)
    now, rows = [rng.choice(words) for _ in range(150)], []
    for d in range(30):
        rows.append((d * 7 % 30, " ".join(now)))
        now = list(now)
        now[(d * 13) % 150] = rng.choice(words) + "x"
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_classes(rows) == {d: 0 for d in range(30)}


def test_rare_pairs_lose_no_link(spark):
    """The exact stage alone finds every link between documents of different classes."""
    rows = [r for r in corpus(3) if r[1] and len(r[1].split()) >= 5]
    found = sets(rows)
    code = {g: i for i, g in enumerate(sorted({g for s in found.values() for g in s}))}
    df = spark.createDataFrame([(d, sorted(code[g] for g in s)) for d, s in found.items()], "doc_id long, shingles array<long>")
    items = df.select("doc_id", F.col("doc_id").alias("root"))
    pairs = minhash._rare_pairs(items, df, (4, 5))
    got = {(r.a, r.b) for r in minhash._verified(pairs, df, (4, 5)).collect()}
    expected = {(a, b) for a, b in itertools.combinations(sorted(found), 2) if 9 * len(found[a] & found[b]) >= 4 * (len(found[a]) + len(found[b])) and found[a] & found[b]}
    assert got == expected and expected


def test_near_duplicate_edges(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    got = minhash.near_duplicates(table(spark, [(None, "a b"), (1, None), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, "A  b")])).collect()
    assert sorted((r.doc_id or -1, r.group_id if r.group_id is not None else -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 4, False)]


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_minhash_estimates_similarity(weighted):
    rng, errors = np.random.default_rng(0), []
    for _ in range(60):
        names, weights = rng.integers(0, 2**63, 400).astype(np.uint64), rng.uniform(0.2, 6, 400) if weighted else np.ones(400)
        a, b = minhash.dart_minhash(names[:300], weights[:300], 80), minhash.dart_minhash(names[60:], weights[60:], 80)
        errors.append((a == b).mean() - weights[60:300].sum() / weights.sum())
    assert abs(np.mean(errors)) < 0.02 and len(minhash.dart_minhash(names[:1], weights[:1], 80)) == 80
    assert len(minhash.dart_minhash(names[:0], weights[:0], 80)) == 0


def test_dart_minhash_takes_few_calls(monkeypatch):
    """A strip's darts are hashed at once, whatever the number of its cells; the signatures are those of the loop over the cells."""
    calls, names = [], np.arange(1, 251, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix = minhash.mix
    monkeypatch.setattr(minhash, "mix", lambda h: calls.append(1) or mix(h))
    minhash.dart_minhash(names, np.ones(250), 80)  # the cells are made once
    calls.clear()
    plain = minhash.dart_minhash(names, np.ones(250), 80)
    assert len(calls) % 3 == 0 and len(calls) <= 6  # a second turn where a coordinate stayed empty
    weighted = minhash.dart_minhash(names, np.arange(250) % 5 + 1.0, 80)
    assert [int(np.bitwise_xor.reduce(s)) for s in (plain, weighted)] == [0xA5988501AACBC3E0, 0x1EF96EC96311A81C]


def test_weighted_signatures(spark):
    df = spark.createDataFrame([(1, "a b c d e f a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert minhash.signatures(df, weighting="count").first().keys != minhash.signatures(df).first().keys


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def brute_lines(rows, chars=40, docs=5):
    space = " \t\n\x0b\x0c\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(upper)
    found = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                found[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(found.get(key(x), ())) >= docs and d != max(found[key(x)]))]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(4)
    common = ["Ä shared line that is long enough to count, number %d" % i for i in range(6)]
    rows = []
    for d in range(40):
        lines = ["own line %d of document %d, long enough to be looked at" % (i, d) for i in range(3)]
        lines += [("  " + c.upper() + "\t" if rng.random() < 0.3 else c) for i, c in enumerate(common) if rng.random() < (i + 1) / 8]
        rng.shuffle(lines)
        rows.append((d * 3, "\n".join(lines + lines[:1])))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, common[5])]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(table(spark, rows), batches=batches, fanout=fanout, buckets=3).collect()}
    assert got == brute_lines(rows)
    assert sum(x[1] for x in got.values()) > 20


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    line = "x" * 40
    rows = [(None, line)] * 5 + [(1, line)] * 6
    assert {r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows)).collect()} == {0}
    kept = line_dedup.dedup_lines(table(spark, [(i, line) for i in range(5)]), keep=("n",)).collect()
    assert sorted((r.doc_id, r.text, r.n) for r in kept) == [(0, "", 1), (1, "", 1), (2, "", 1), (3, "", 1), (4, line, 1)]


def test_line_ends_are_ascii_only(spark):
    """Only ASCII white space is stripped: lines that differ in U+0085 or U+2028 have different keys."""
    base = "a" * 45
    odd = [base + " \u0085", base + "\u0085", base + "\u2028", base + "\u00a0", base]
    rows = [(3 * k + j, x) for k in range(3) for j, x in enumerate(odd)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert len({r[1] for r in rows}) == 5 and got == brute_lines(list({r[0]: r for r in rows}.values()))


def test_repeated_ids_and_sparse_ids(spark):
    """Texts of one doc_id lose their own lines only; far-off ids change nothing."""
    line, other = "shared line of more than forty characters, no doubt", "a second shared line of more than forty characters"
    rows = [(i, line) for i in range(4)] + [(7, "first\n" + line), (7, line + "\nsecond"), (10**15, other + "\n" + line)] + [(i, other) for i in range(20, 24)]
    found = line_dedup.dedup_lines(table(spark, rows), batches=3).collect()
    assert sorted(r.text for r in found if r.doc_id == 7) == ["first", "second"]
    assert {r.doc_id: r.text for r in found if r.doc_id != 7} == {**{i: "" for i in (0, 1, 2, 3, 20, 21, 22, 23)}, 10**15: other + "\n" + line}
    # Repeated rows of one document are one document.
    few = [(1, line)] * 9 + [(2, line), (3, line), (4, line)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(table(spark, few)).collect()} == {0}


def _batch(spark, rows):
    return spark.createDataFrame([(h, h, 1, d) for h, d in rows], line_dedup._RUN.replace("holder", "top"))


def test_runs_are_levelled_and_can_be_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    for k in range(5):
        runs = line_dedup.LineRuns(spark, folder, buckets=2)
        for _ in range(2):  # the second time is left out
            runs.add(_batch(spark, [(h, 100 - k) for h in range(k, k + 3)]), f"batch {k}")
        runs.close()
    runs = line_dedup.LineRuns(spark, folder)
    assert runs.buckets == 2 and [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r.h1: (r.n, r.holder) for r in runs.state().collect()}
    assert got == {0: (1, 100), 1: (2, 100), 2: (3, 100), 3: (3, 99), 4: (3, 98), 5: (2, 97), 6: (1, 96)}
    assert {r.h1 for r in runs.fresh(spark.createDataFrame([(6, 6), (7, 7)], "h1 long, h2 long")).collect()} == {7}
    runs.drop()


def test_the_anti_join_decides_the_holder(spark, monkeypatch):
    line = "shared line of more than forty characters, no doubt"
    rows = [(i, line) for i in range(8)]
    assert {r.doc_id for r in line_dedup.dedup_lines(table(spark, rows)).where("n_dropped = 0").collect()} == {7}
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, batch: batch)
    assert {r.doc_id for r in line_dedup.dedup_lines(table(spark, rows)).where("n_dropped = 0").collect()} != {7}


def test_a_later_call_meets_the_runs_of_earlier_ones(spark, tmp_path):
    folder, line = f"file://{tmp_path}/runs", "shared line of more than forty characters, no doubt"
    first = line_dedup.dedup_lines(table(spark, [(i, line) for i in range(3)]), runs_at=folder, name="a")
    assert {r.n_dropped for r in first.collect()} == {0}
    for _ in range(2):
        later = line_dedup.dedup_lines(table(spark, [(10, line), (11, line)]), runs_at=folder, name="b")
        assert {r.n_dropped for r in later.collect()} == {1}
