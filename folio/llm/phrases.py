"""Collocations by contiguous pattern growth: frequent phrases, scored by how much their halves occur together.

Everything is per language. Patterns grow to the right from frequent prefixes:

1. Words are counted. A word is carried as a 64-bit code of (language, word); if two of them share a code, all is done again with another seed.
2. Pairs of frequent words that follow each other are counted; the frequent pairs are the prefixes to grow from.
3. Each occurrence of a prefix is projected to a pointer: the words after it, as far as every further pair is frequent too. Equal pointers are folded, and all of one
   prefix go to one task. A prefix with more than ``HOT_SHARE`` of all occurrences is grown from its extensions by one word instead, each in a task of its own.
4. A task gets its pointers in order, so that walking them is the depth-first growth: each prefix is followed by its extensions, whose
   counts are complete when the walk leaves them. Only the open prefix of each length is held.

Bit arrays of bounded size tell the scans which words and pairs may be frequent; they let a few others through, which the counts then drop.
Every part of a frequent phrase is frequent, so the counts for the scores come from the same tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import bit_array, has_bit
from .common import materialise, mix, release, slices

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase is dropped if a longer one that contains it has so many hundredths of its occurrences.
COVERED = 80
#: The share of all pairs from which a prefix is split by its next word: at most 1 / HOT_SHARE pairs have it.
HOT_SHARE = 0.001
#: Distinct words, and pointers, that a task folds before it passes them on.
FOLD_WORDS, FOLD_POINTERS = 1 << 16, 1 << 17
#: Words whose codes a task remembers, texts that it holds as Python objects at once, and rows that it passes on at once.
KNOWN_WORDS, TEXTS, PASSED = 1 << 16, 100, 1 << 14

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_SPACES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b" " * 10)
_STOP = bytes(8)


class _Codes(dict):
    """Word to its code as bytes; the oldest memory goes when there are too many."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_digest(word, self.seed)
        return code


def _lang_code(lang: str, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed + 1))


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    """Lower-cased (A-Z) texts of a batch by language."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        if text:
            found.setdefault(lang, []).append(text.lower())
    return found


def _coded(batch: pa.RecordBatch, codes: _Codes) -> Iterator[np.ndarray]:
    """Codes of the words of the batch, language by language, a 0 after each piece."""
    for lang, texts in _by_lang(batch).items():
        parts = []
        for text in texts:
            for piece in text.translate(_ENDS).split(b"\n"):
                words = piece.split()
                if words:
                    parts += map(codes.__getitem__, words)
                    parts.append(_STOP)
        found = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)  # digests are big-endian
        found[found != 0] ^= _lang_code(lang, codes.seed)
        yield found


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix((out + c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _fold(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows become one with the sum of ``n``. Should hashes collide, some equal rows stay apart, which is harmless."""
    order = np.argsort(_hash(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


class _Folder:
    """Collects rows of codes and passes them on folded."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.size = names, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.rows.append((columns, np.ones(len(columns[0]), np.int64)))
        self.size += len(columns[0])
        if self.size > FOLD_POINTERS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns, n = _fold([np.concatenate(c) for c in zip(*(r[0] for r in self.rows))], np.concatenate([r[1] for r in self.rows]))
            self.rows, self.size = [], 0
            yield from slices([pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=[*self.names, "n"])], PASSED)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, code and n of every word of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                codes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in found], np.uint64) ^ _lang_code(lang, seed)
                columns = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(codes.view(np.int64)), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "code", "n"])
            counts.clear()

        for batch in slices(batches, TEXTS):
            for lang, texts in _by_lang(batch).items():
                found = counts.setdefault(lang, Counter())
                for text in texts:
                    found.update(text.translate(_SPACES).split())
            if sum(map(len, counts.values())) > FOLD_WORDS:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, word string, code long, n long").groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, seed: int, bits: bytes) -> DataFrame:
    """w1, w2 and n of the neighbours in a piece that may both be frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, folder = _Codes(seed), _Folder(["w1", "w2"])
        for batch in slices(batches, TEXTS):
            for c in _coded(batch, codes):
                fits = (c != 0) & has_bit(bits, c)
                at = np.flatnonzero(fits[:-1] & fits[1:])
                yield from folder.add([c[at], c[at + 1]])
        yield from folder.flush()

    # Tasks fold on their own; most pairs are rare, so a hash table before the shuffle would hold much and fold little.
    return docs.mapInArrow(run, "w1 long, w2 long, n long").repartition("w1", "w2").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def _names(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def project(docs: DataFrame, seed: int, bits: bytes, hot: np.ndarray, longest: int) -> DataFrame:
    """Pointers: every occurrence of a frequent pair with the words after it, as far as pairs are frequent; 0 where there is no further word. Those without a
    third word say nothing new and aren't kept. ``hot`` holds hashes of the pairs to be split."""
    names = _names(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, folder = _Codes(seed), _Folder([*names, "hot"])
        for batch in slices(batches, TEXTS):
            for c in _coded(batch, codes):
                if len(c) < 3:
                    continue
                h = _hash([c[:-1], c[1:]])
                fits = (c[:-1] != 0) & (c[1:] != 0) & has_bit(bits, h)
                at = np.flatnonzero(fits[:-1] & fits[1:])
                columns, open_ = [c[at], c[at + 1], c[at + 2]], np.ones(len(at), bool)
                for k in range(3, longest):
                    step = np.minimum(at + k - 1, len(fits) - 1)
                    open_ &= (at + k - 1 < len(fits)) & fits[step]
                    columns.append(np.where(open_, c[step + 1], np.uint64(0)))
                yield from folder.add([*columns, np.isin(h[at], hot).astype(np.uint64)])
        yield from folder.flush()

    return docs.mapInArrow(run, ", ".join(f"{w} long" for w in names) + ", hot long, n long")


class _Open:
    """The open prefix of one length during the walk, with its count so far."""

    def __init__(self, depth: int):
        self.depth, self.key, self.total = depth, None, 0

    def feed(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes that the rows close, and their counts."""
        words = words[: self.depth]
        new = np.ones(len(n), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
        starts = np.flatnonzero(new)
        keys, sums = words[:, starts], np.add.reduceat(n, starts)
        if self.key is not None:
            if (keys[:, 0] == self.key).all():
                sums[0] += self.total
            else:
                keys, sums = np.concatenate([self.key[:, None], keys], axis=1), np.concatenate([[self.total], sums])
        self.key, self.total = keys[:, -1].copy(), int(sums[-1])
        return keys[:, :-1], sums[:-1]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.zeros((self.depth, 0), np.int64), np.zeros(0, np.int64)) if self.key is None else (self.key[:, None], np.array([self.total]))


def grow(pointers: DataFrame, least: int, longest: int) -> DataFrame:
    """Frequent phrases of 3 to ``longest`` words with their counts, grown depth-first from the pointers of each prefix."""
    names = _names(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Open(d) for d in range(3, longest + 1)]

        def frequent(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            keep = np.flatnonzero((sums >= least) & (keys[-1] != 0))
            rows = np.zeros((longest, len(keep)), np.int64)
            rows[: len(keys)] = keys[:, keep]
            return pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(sums[keep])], names=[*names, "n"])

        for batch in batches:
            if batch.num_rows:
                words = np.array([batch.column(w).to_numpy() for w in names])
                n = batch.column("n").to_numpy()
                for level in levels:
                    yield frequent(*level.feed(words, n))
        for level in levels:
            yield frequent(*level.close())

    own = F.when(F.col("hot") == 1, F.col("w3")).otherwise(F.lit(0))
    return pointers.repartition("w1", "w2", own).sortWithinPartitions(*names).mapInArrow(run, ", ".join(f"{w} long" for w in names) + ", n long")


def _parts(phrase: list[Column], start: int, stop: int) -> Column:
    """Words ``start`` to ``stop`` as a phrase, zeros behind."""
    return F.array(*phrase[start:stop], *([F.lit(0).cast("long")] * (len(phrase) - stop + start)))


def _exploded(phrases: DataFrame, longest: int, parts: list[tuple[int, list[Column]]]) -> DataFrame:
    """A row for each part of each phrase; ``parts`` are (words of the phrase, structs that name a part)."""
    at_length = F.coalesce(*(F.when(F.col("size") == k, F.array(*p)) for k, p in parts))
    return phrases.withColumn("part", F.explode(at_length))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a (its occurrences), l and r (those of its two parts at the cut that scores
    lowest), n (words of the language) and score, floor(2000000 a / (l + r)).

    Words are runs without space and tab, phrases don't cross ``.,;:!?`` or a line end. A null lang is ``und``, a null or empty text has no words. Repeated rows
    count as often as they occur; an empty table, or one without a frequent pair, gives an empty result."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    names = _names(longest)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for seed in range(0, 100, 2):
        words = materialise(count_words(docs, seed), "phrase-words")
        shared = words.groupBy("code").agg(F.count("*").alias("k"), F.bool_or(F.col("code") == 0).alias("zero")).where("k > 1 or zero")
        if shared.isEmpty():
            break
        release(words)
    frequent = words.where(F.col("n") >= least)
    pairs = materialise(count_pairs(docs, seed, bit_array(frequent.select("code"))).where(F.col("n") >= least), "phrase-pairs")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hash([b.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")]).view(np.int64)), b.column("n")], names=["h", "n"])

    hashed = pairs.select("w1", "w2", "n").mapInArrow(hashes, "h long, n long")
    found = pairs
    for w in names[2:]:
        found = found.withColumn(w, F.lit(0).cast("long"))
    if longest > 2:
        total = pairs.agg(F.sum("n").alias("n")).first().n or 0
        hot = hashed.where(F.col("n") > HOT_SHARE * total).select("h").toArrow().column("h").to_numpy().view(np.uint64)
        found = found.unionByName(grow(project(docs, seed, bit_array(hashed.select("h")), hot, longest), least, longest))
    size = sum((F.when(F.col(w) != 0, 1).otherwise(0) for w in names), F.lit(0))
    phrases = materialise(found.withColumn("size", size), "phrases")
    result = materialise(_ranked(phrases, frequent, words, longest, top), "phrases-ranked")
    release(words, pairs, phrases)
    return result


def _ranked(phrases: DataFrame, frequent: DataFrame, words: DataFrame, longest: int, top: int) -> DataFrame:
    names = _names(longest)
    w = [F.col(c) for c in names]
    inside = [(k, [_parts(w, i, j).alias("p") for i in range(k) for j in range(i + 2, k + 1) if j - i < k]) for k in range(3, longest + 1)]
    stay = phrases.withColumn("cover", F.lit(None).cast("long"))
    if inside:
        covers = _exploded(phrases, longest, inside).groupBy("part").agg(F.max("n").alias("cover"))
        stay = phrases.join(covers.select(*(F.get("part", F.lit(i)).alias(c) for i, c in enumerate(names)), "cover"), names, "left")

    def times(x: str, k: int) -> Column:
        return F.col(x).cast("decimal(38,0)") * F.lit(k).cast("decimal(10,0)")

    stay = stay.where(F.col("cover").isNull() | (times("cover", 100) < times("n", COVERED))).drop("cover").withColumnRenamed("n", "a")
    cuts = [(k, [F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), p.alias("words")) for c in range(1, k) for side, p in (("l", _parts(w, 0, c)), ("r", _parts(w, c, k)))]) for k in range(2, longest + 1)]
    known = phrases.select(*names, F.col("n").alias("f")).unionByName(frequent.select(F.col("code").alias("w1"), *(F.lit(0).cast("long").alias(c) for c in names[1:]), F.col("n").alias("f")))
    asked = _exploded(stay, longest, cuts).select(*(F.col(c).alias("c" + c) for c in names), "a", "size", "part.cut", "part.side", *(F.get("part.words", F.lit(i)).alias(c) for i, c in enumerate(names)))
    of = ["c" + c for c in names]
    halves = asked.join(known, names).groupBy(*of, "a", "size", "cut").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    score = F.expr("(cast(a as decimal(38,0)) * cast(2000000 as decimal(10,0))) div (l + r)")
    lowest = halves.withColumn("score", score).groupBy(*of, "a", "size").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spelt = lowest.withColumn("codes", F.filter(F.array(*of), lambda x: x != 0)).select(*of, "a", "best", F.posexplode("codes").alias("at", "code")).join(frequent.select("code", "lang", "word"), "code")
    spelt = spelt.groupBy(*of, "a", "best", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    first = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", F.col("best.score").cast("long").alias("score"))
