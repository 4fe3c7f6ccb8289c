"""Near-duplicate documents by DartMinHash signatures and banded joining.

Darts are thrown at the plane of (weight, rank) of every element: the plane is cut
into cells that are the same for all documents, a hash gives each cell a Poisson
number of darts and each dart its place and its coordinate of the signature. The
darts of a document are those below its weights; they are made in order of rank
bands until every coordinate has one, and the earliest one per coordinate is kept.
Long documents thus cost about one hash per element, short ones about k log k.

Classes are found without emitting the pairs of a group:
exact copies are folded first; documents that agree on a band are compared with the
smallest one of that bucket only, then, where a bucket still holds several classes,
with a randomly chosen one of each bucket. Documents of buckets that are still mixed
after a few turns are joined on their rarest shingles (prefix filter, exact for the
given similarity), across different classes only. Every link is verified on the full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_array, has_bit
from .common import WordCodes, materialise, mix, release, slices, windows, word_codes

WIDTH = 5
#: A similarity of 4/5, kept as integers so that the comparison is exact.
SIMILAR = (4, 5)
#: 20 bands of 4 coordinates: a pair of similarity 0.8 is missed with probability 3e-5.
BANDS, ROWS = 20, 4

#: Turns with random partners before the exact join takes the rest.
TURNS = 2

_RANK0 = 1 / 8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    """Results by argument; there are few different arguments (powers of two)."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(*key)
        return out


def _make_cells(strip: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a weight strip [2**strip - 1, 2**(strip+1) - 1) up to rank _RANK0 * 2**level:
    id, lowest rank, height, area. No cell is larger than 1."""
    low, high = [], []
    for band in range(level + 1):
        a = 0.0 if band == 0 else _RANK0 * 2 ** (band - 1)
        b = _RANK0 * 2**band
        edges = np.linspace(a, b, max(1, int(np.ceil((b - a) * 2**strip))) + 1)
        low.append(edges[:-1])
        high.append(edges[1:])
    lo, hi = np.concatenate(low), np.concatenate(high)
    ids = mix((np.arange(1, len(lo) + 1, dtype=np.uint64) + (np.uint64(strip) << np.uint64(40))) * _GOLDEN)
    return ids, lo, hi - lo, (hi - lo) * 2**strip


def _make_poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts."""
    p, out, k = np.exp(-area), [], 0
    total = p
    while k < 24:
        out.append(total)
        k += 1
        p *= area / k
        total += p
    return np.array(out)


_CELLS, _POISSON = _Memo(_make_cells), _Memo(_make_poisson)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Signature of ``k`` coordinates; two sets agree on one with the probability of their weighted Jaccard similarity."""
    total = float(weights.sum())
    if not total > 0:
        return np.zeros(0, np.uint64)
    bound = (k * np.log(k) + 2 * k) / total
    while True:
        rank, coordinate, name = _darts(elements, weights, k, bound)
        order = np.argsort(-rank, kind="stable")
        signature, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        signature[coordinate[order]] = name[order]  # the earliest is written last
        filled[coordinate] = True
        if filled.all():
            return signature
        bound *= 2


def _darts(elements: np.ndarray, weights: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    level = max(0, int(np.ceil(np.log2(bound / _RANK0))))
    ranks, coordinates, names = [], [], []
    strip, top = 0, float(weights.max())
    while 2**strip - 1 < top:
        base = 2**strip - 1
        some = weights > base
        own, limit = elements[some], weights[some]
        ids, low, height, area = _CELLS[strip, level]
        used = int(np.searchsorted(low, bound))
        # One row a cell. All darts of a strip are made at once: documents are short, so the number of calls is what they cost.
        seeds = mix(ids[:used, None] ^ own)
        u = (seeds >> np.uint64(11)).astype(np.float64) * 2.0**-53
        many = np.empty(seeds.shape, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(area[:used])) + 1).tolist(), used]
        for a, b in zip(edges, edges[1:]):  # cells of one area
            many[a:b] = np.searchsorted(_POISSON[(float(area[a]),)], u[a:b], side="right")
        counts = many.ravel()
        ends = counts.cumsum()
        at = np.repeat(np.arange(len(counts)), counts)
        j = np.arange(1, len(at) + 1) - np.repeat(ends - counts, counts)
        cell = np.repeat(np.arange(used), many.sum(axis=1))
        dart = mix(seeds.ravel()[at] + j.astype(np.uint64) * _GOLDEN)
        rank = low[cell] + (dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * height[cell]
        early = np.flatnonzero(rank < bound)
        dart, rank, row = dart[early], rank[early], at[early] - cell[early] * len(own)
        place = mix(dart ^ _GOLDEN)
        weight = base + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * 2**strip
        hit = weight < limit[row]
        ranks.append(rank[hit])
        coordinates.append((((place[hit] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64))
        names.append(dart[hit])
        strip += 1
    if not ranks:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(ranks), np.concatenate(coordinates), np.concatenate(names)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for part in signature[: bands * rows].reshape(bands, rows).T:
        out = mix(out ^ part) + part
    return mix(out)


def shingle_sets(docs: DataFrame, wanted: bytes, width: int = WIDTH) -> DataFrame:
    """doc_id, shingles: the distinct hashes of ``width``-word windows, sorted, of the
    documents in the bit array ``wanted`` (and a few more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            batch = batch.filter(pa.array(has_bit(wanted, ids.to_numpy().astype(np.uint64))))
            sets = [np.unique(windows(word_codes(t, codes), width).view(np.int64)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """doc_id, d1, d2 (digest of the word sequence; null without words), keys: one per band.

    ``weighting``: "set" gives every distinct shingle weight 1 (plain Jaccard), "count"
    weighs it by its occurrences (weighted Jaccard).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches):
            d1, d2, keys = [], [], []
            for text in batch.column("text").to_pylist():
                words = word_codes(text, codes)
                if not len(words):
                    d1.append(None), d2.append(None), keys.append([])
                    continue
                digest = xxhash.xxh3_128_intdigest(words.tobytes())
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                found, count = np.unique(windows(words, width), return_counts=True)
                weights = count.astype(np.float64) if weighting == "count" else np.ones(len(found))
                keys.append(band_keys(dart_minhash(found, weights, bands * rows), bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "d1", "d2", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the smallest node of the
    component. Large-star and small-star steps in turn; every step is a join and a
    partial aggregation, no neighbour list is ever gathered."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        done = edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        if done:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        now = materialise(small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        release(edges)
        edges = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    out = materialise(roots, "roots")
    release(edges)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    num, den = similar
    sized = sets.withColumn("n", F.size("shingles"))
    both = pairs.join(sized.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na")), "a").join(
        sized.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb")), "b"
    )
    both = both.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * (den + num) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _rare_pairs(items: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """All pairs of ``items`` (doc_id, root) with different roots that can be similar:
    each must share one of its rarest shingles (prefix filter) and have a like size."""
    num, den = similar
    rows = sets.join(items, "doc_id").select("doc_id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rows = materialise(rows, "shingles")
    shared = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    ranked = rows.join(shared.select("s", "df", (F.col("r0") < F.col("r1")).alias("mixed")), "s")
    # n - ceil(n * num / den) + 1 rarest shingles; by document, so the sorted lists are bounded by its length.
    ordered = ranked.groupBy("doc_id", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s", "mixed"))).alias("l"))
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1
    prefix = ordered.select("doc_id", "root", "n", F.posexplode(F.slice("l", F.lit(1), length)).alias("i", "x")).where("x.mixed")
    prefix = prefix.select(F.col("x.s").alias("s"), "doc_id", "root", "n", "i")
    other = prefix.select("s", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("i").alias("j"))
    like = F.least("n", "nb") * den >= F.greatest("n", "nb") * num
    # Positional filter: at a pair's first common shingle, what can be common from there on must reach the overlap that the similarity takes.
    enough = (1 + F.least(F.col("n") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)) * (den + num) >= (F.col("n") + F.col("nb")) * num
    pairs = prefix.join(other, "s").where((F.col("doc_id") < F.col("b")) & (F.col("root") != F.col("rb")) & like & enough)
    out = materialise(pairs.select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")
    release(rows)
    return out


def _mixed(items: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, doc_id, root) of the buckets that hold more than one class."""
    named = items.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    return materialise(named.join(several, "key", "left_semi"), "mixed")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least ``similar`` of their word shingles.

    Returns doc_id, group_id (smallest doc_id of the class), kept (doc_id = group_id),
    one row per input row. A text shorter than ``width`` words is one shingle. A document
    without words (null, empty, white space) is a class of its own. Words are compared
    lower-cased. A null doc_id gets a null group and is kept. Repeated rows of a doc_id
    share its class. An empty table gives no rows.
    """
    all_docs = docs.select("doc_id", "text")
    docs = all_docs.where("doc_id is not null")
    signed = materialise(signatures(docs, width, bands, rows, weighting), "signatures")
    copies = materialise(signed.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "copies")
    buckets = signed.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key")).distinct()
    low = buckets.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a")
    shared = materialise(buckets.join(low, "key").select("key", "a", F.col("doc_id").alias("b")), "buckets")
    pairs = materialise(shared.where("a <> b").select("a", "b").distinct(), "pairs")
    wanted = materialise(shared.select(F.col("b").alias("doc_id")).distinct(), "wanted")
    sets = shingle_sets(docs, bit_array(wanted), width).dropDuplicates(["doc_id"])
    sets = materialise(sets.join(wanted, "doc_id", "left_semi"), "sets")
    links = materialise(_verified(pairs, sets, similar), "links")
    release(pairs)
    roots = components(links)
    items = shared.select("key", F.col("b").alias("doc_id"))

    def link(pairs: DataFrame) -> bool:
        """Verify pairs; if any are linked, the links and classes are renewed."""
        nonlocal links, roots
        more = materialise(_verified(pairs, sets, similar), "links")
        if more.isEmpty():
            release(more)
            return False
        old, links = (links, more), materialise(links.unionByName(more), "links")
        release(*old, roots)
        roots = components(links)
        return True

    for turn in range(TURNS):
        mixed = _mixed(items, roots)
        chosen = mixed.groupBy("key").agg(F.min_by(F.struct("doc_id", "root"), F.xxhash64("doc_id", "key", F.lit(turn))).alias("c"))
        pairs = mixed.join(chosen, "key").where("root <> c.root").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
        pairs = materialise(pairs, "pairs")
        found = link(pairs)
        release(mixed, pairs)
        if not found:
            break
    mixed = _mixed(items, roots)
    pairs = _rare_pairs(mixed.select("doc_id", "root").distinct(), sets, similar)
    link(pairs)
    release(mixed, pairs, sets, shared, links, wanted)
    of_copies = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("group_id"))
    classed = signed.select("doc_id", "d1", "d2").join(of_copies, ["d1", "d2"], "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))
    out = classed.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))
    nulls = all_docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)
