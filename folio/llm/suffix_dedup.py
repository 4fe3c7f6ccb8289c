"""Exact removal of repeated byte strings by threshold-bounded interval expansion.

A byte is removed when a string of ``length`` bytes that covers it also starts
earlier in the corpus. The work is spread in such a way that equal strings meet:

1. Every ``length``-byte window has an *anchor*: the K-gram with the smallest hash
   in it (leftmost on ties). Equal windows have equal anchors, so a window whose
   anchor occurs once in the corpus is unique. Anchors are counted with partial
   aggregation; a bit array of bounded size carries the repeated ones to the next
   scan as a pre-filter (a false hit costs time, never a wrong result).
2. The windows around one occurrence of an anchor form a *segment* of at most
   ``2 * length - K`` bytes. Equal segments are folded to their first occurrence
   before any bytes are shuffled: in later ones every window is a repeat. Exact copies
   are thus found by this fold alone, by 64-bit digest within an anchor.
3. Where one anchor has several distinct segments, their first occurrences go,
   sorted by anchor, to tasks that build a Burrows-Wheeler transform of a run of
   whole anchor groups and derive common prefixes by backward extension, breadth
   first, in increasing value, up to ``length``. Rows never separated below that
   value are equal windows; all but the earliest are repeats.
   An anchor with more than ``max_group`` distinct segments is first broken into
   single windows keyed by (anchor, window hash), windows that occur once dropped,
   so no task ever needs all rows of a hot anchor.
4. Repeated windows return to their documents as byte ranges.

Texts of one repeated doc_id are one document: each different text has its own range of
positions in it, 2**BASE_BITS apart, in the order of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import bit_array, has_bit
from .common import materialise, mix, release, slices

LENGTH = 100
K = 24
#: Documents are scanned in pieces of so many bytes (the anchor key has 24 bits for a position).
PIECE = 1 << 23
#: Bytes of segments per transform; whole anchor groups stay together.
CHUNK = 1 << 20
#: Distinct segments of one anchor (at most 176 bytes each) that one transform takes; beyond, the anchor is broken into windows.
MAX_GROUP = 20_000

#: Bits of a byte position within a text; above them is the text's number among those of its doc_id.
BASE_BITS = 40

_OCCURRENCE = "h long, digest long, doc_id long, at long, n long, k long, first boolean"
_SEGMENT = "h long, doc_id long, at long, k long, bytes binary"


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each K-gram by doubling (1, 2, 4, 8, 16, then 16 + 8)."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    powers = {w: np.uint64(pow(0x9E3779B97F4A7C15, w, 1 << 64)) for w in (1, 2, 4, 8, 16)}
    kept = h
    while width < 16:
        h = h[:-width] * powers[width] + h[width:]
        width *= 2
        if width == K - 16:
            kept = h
    n = len(data) - K + 1
    return mix(h[:n] * powers[K - 16] + kept[16 : 16 + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each run of windows with the same anchor: anchor hash, first window, number of windows, anchor's place after the first window."""
    found = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        h = kgram_hashes(part)
        # 40 bits of hash, then the position: the minimum is the leftmost smallest hash.
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span, width = length - K + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        where = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        found.append((h[where[cut]], begin + cut, np.diff(np.append(cut, len(where))), where[cut] - cut))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _rows(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    parts = [x.strip().split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts)], names=[n for n, _ in parts])


def _anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            all_h = [anchors(np.frombuffer(_bytes(t), np.uint8), length)[0] for t in batch.column("text").to_pylist()]
            h, n = np.unique(np.concatenate(all_h) if all_h else np.zeros(0, np.uint64), return_counts=True)
            yield _rows([_signed(h), n], "h long, n long")

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _digests(raw: bytes, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Content hashes of segments."""
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + (length - 1)).tolist())]), np.int64)


def _occurrences(docs: DataFrame, bits: bytes, length: int) -> DataFrame:
    """Segments of possibly repeated anchors; ``first``: the first one with these bytes in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for doc, text, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "base"))):
                raw = _bytes(text)
                h, at, n, where = anchors(np.frombuffer(raw, np.uint8), length)
                ok = np.flatnonzero(has_bit(bits, h))
                if not len(ok):
                    continue
                h, at, n, where = _signed(h[ok]), at[ok], n[ok], where[ok]
                digest = _digests(raw, at, n, length)
                first = np.zeros(len(h), bool)
                first[np.unique(digest, return_index=True)[1]] = True
                parts.append((h, digest, np.full(len(h), doc, np.int64), at + base, n, where, first))
            if parts:
                yield _rows([np.concatenate(c) for c in zip(*parts)], _OCCURRENCE)

    return docs.select("doc_id", "text", "base").mapInArrow(run, _OCCURRENCE)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (up to 256) or more: prefix doubling, from seven packed symbols."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = padded[:n]
    for k in range(1, 7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    width = 7
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
        nxt = np.zeros(n, np.uint64)
        nxt[: n - width] = rank[width:]
        key = (rank << np.uint64(32)) | nxt
        width *= 2


def separated(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Breadth-first backward extension on the transform of ``symbols``.

    Returns, for each row of the sorted suffixes, whether its common prefix with the
    row above is shorter than ``length``. Symbol 0 separates strings: no two of its rows
    have anything in common. A row ``b`` with symbol c in the transform and the row
    ``a`` before it with the same symbol extend backward to two neighbouring rows; these
    part at value v + 1 as soon as a boundary of value v lies between ``a`` and ``b``.
    """
    bwt = symbols[order - 1]  # the text ends with a separator, so the wrap-around is one too
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable").astype(np.int32)  # row by_symbol[x] extends to row x
    symbol = bwt[by_symbol]
    part = np.ones(len(symbols), bool)
    part[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)
    open_rows = np.flatnonzero(~part).astype(np.int32)
    b, a = by_symbol[open_rows], by_symbol[open_rows - 1]
    for _ in range(1, length):
        upto = np.cumsum(part, dtype=np.int32)
        hit = upto[b] != upto[a]
        if not hit.any():
            break
        part[open_rows[hit]] = True
        keep = np.flatnonzero(~hit)
        open_rows, b, a = open_rows[keep], b[keep], a[keep]
    return part


def repeated_windows(segments: list[bytes], docs: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the segments that also start in an earlier place: (document, position)."""
    sizes = np.array([len(s) for s in segments], np.int64)
    total = int(sizes.sum()) + len(segments)
    symbols, ends = np.zeros(total, np.uint16), np.cumsum(sizes + 1) - 1
    body = np.ones(total, bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + np.uint16(1)
    order = suffix_order(symbols, length + 1)
    group = np.cumsum(separated(symbols, order, length))
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(total) - (ends - sizes)[owner]
    valid = (offset <= sizes[owner] - length)[order]
    rows, group = order[valid], group[valid]
    doc, pos = docs[owner[rows]], at[owner[rows]] + offset[rows]
    best = np.lexsort((pos, doc, group))
    later = np.concatenate([[False], group[best][1:] == group[best][:-1]])
    # The same place may come twice (overlapping pieces of one document); it isn't its own repeat.
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(best))))
    d, p = doc[best], pos[best]
    later &= (d != d[head]) | (p != p[head])
    return d[later], p[later]


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows as (document, first window, number of windows)."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(doc)) - 1 if len(doc) else cut
    return doc[cut], pos[cut], pos[last] - pos[cut] + 1


def _can_match(group: list[tuple], length: int) -> list[tuple]:
    """Segments (doc, at, anchor's place, bytes) of one anchor that can share a window with another one:
    a window has ``length - K`` bytes beside its anchor, so at least half of them lie on one side."""
    half = (length - K) // 2
    sides: dict[bytes, int] = {}
    keys = []
    for _, _, k, raw in group:
        own = [b"<" + raw[k - half : k]] if k >= half else []
        own += [b">" + raw[k + K : k + K + half]] if len(raw) - k - K >= half else []
        keys.append(own)
        for x in own:
            sides[x] = sides.get(x, 0) + 1
    return [s for s, own in zip(group, keys) if any(sides[x] > 1 for x in own)]


def _expand(segments: DataFrame, length: int) -> DataFrame:
    """h, doc_id, at, k, bytes, sorted by h within partitions -> repeated windows as (doc_id, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, held, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            doc, pos = repeated_windows([x[3] for x in held], np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), length)
            return _rows(list(_runs(doc, pos)), "doc_id long, at long, n long")

        for batch in slices(batches):
            for h, *segment in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "at", "k", "bytes"))):
                if h != key:
                    group = _can_match(group, length)
                    held += group
                    size += sum(len(x[3]) for x in group)
                    key, group = h, []
                    if size > CHUNK:
                        yield flush()
                        held, size = [], 0
                group.append(segment)
        held += _can_match(group, length)
        if held:
            yield flush()

    return segments.select("h", "doc_id", "at", "k", "bytes").mapInArrow(run, "doc_id long, at long, n long")


def _place_hash(doc: int, digest: np.ndarray) -> np.ndarray:
    return mix(digest.view(np.uint64) + np.uint64((doc * 0x9E3779B97F4A7C15) % (1 << 64)))


def _place_bits(places: DataFrame) -> bytes:
    """Bit array over (doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, digest = (batch.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in (0, 1))
            yield _rows([mix(digest + doc * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)], "h long")

    return bit_array(places.select("doc_id", "digest").mapInArrow(run, "h long"))


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Segments (h, doc_id, at, k, bytes) of the wanted places (h, doc_id, digest), cut from the
    texts in a scan. A false hit of the bit arrays adds a true segment of the corpus, which changes no verdict."""
    bits, of_anchors = _place_bits(wanted), bit_array(wanted.select("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc, text, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "base"))):
                raw = _bytes(text)
                h, at, n, where = anchors(np.frombuffer(raw, np.uint8), length)
                ok = np.flatnonzero(has_bit(of_anchors, h))
                if not len(ok):
                    continue
                h, at, n, where = _signed(h[ok]), at[ok], n[ok], where[ok]
                digest = _digests(raw, at, n, length)
                first = np.sort(np.unique(digest, return_index=True)[1])  # later ones in the same text are repeats already
                for i in first[has_bit(bits, _place_hash(doc, digest[first]))].tolist():
                    for c, v in zip(out, (int(h[i]), doc, int(at[i]) + base, int(where[i]), raw[at[i] : at[i] + n[i] + length - 1])):
                        c.append(v)
            yield _rows(out, _SEGMENT)

    return docs.select("doc_id", "text", "base").mapInArrow(run, _SEGMENT)


def _single_windows(segments: DataFrame, length: int) -> DataFrame:
    """Break segments into windows keyed by anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for h, doc, at, k, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "at", "k", "bytes"))):
                for i in range(len(raw) - length + 1):
                    one = raw[i : i + length]
                    for c, v in zip(out, (xxhash.xxh3_64_intdigest(one, seed=h & 0xFFFFFFFF) - (1 << 63), doc, at + i, k - i, one)):
                        c.append(v)
            yield _rows(out, _SEGMENT)

    return segments.select("h", "doc_id", "at", "k", "bytes").mapInArrow(run, _SEGMENT)


def with_base(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, base: where the positions of a text begin within its doc_id; and whether a doc_id comes twice, as only then are texts shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return docs.withColumn("base", F.lit(0).cast("long")), False
    named = docs.withColumn("name", F.xxhash64("text"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("name")) - 1
    bases = named.join(twice, "doc_id", "left_semi").select("doc_id", "name").distinct().withColumn("base", rank.cast("long") * (1 << BASE_BITS))
    return named.join(bases, ["doc_id", "name"], "left").select("doc_id", "text", F.coalesce("base", F.lit(0).cast("long")).alias("base")), True


def repeated_ranges(docs: DataFrame, several: bool, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, at, n) of the result of ``with_base``: runs of ``n`` windows from byte ``at`` that also start earlier."""
    docs = docs.where("doc_id is not null")
    repeated = materialise(_anchor_counts(docs, length).where("n > 1").select("h"), "repeated")
    bits = bit_array(repeated)
    release(repeated)
    found = materialise(_occurrences(docs, bits, length), "anchors")
    # The first text with a segment; the number of a text counts only beside others of its doc_id.
    text = F.struct("doc_id", F.shiftright("at", BASE_BITS).alias("number")) if several else F.col("doc_id")
    folded = found.groupBy("h", "digest").agg(F.min(text).alias("text0"), F.count("*").alias("n_occ"))
    groups = folded.groupBy("h").agg(F.sum("n_occ").alias("n_anchor"), F.count("*").alias("n_segments")).where("n_anchor > 1")
    folded = materialise(folded.join(groups, "h").select("h", "digest", "text0", "n_segments"), "segments")
    placed = materialise(found.join(folded, ["h", "digest"]).withColumn("origin", F.col("first") & (text == F.col("text0"))).drop("text0", "first"), "placed")
    release(found, folded)
    later = placed.where("not origin").select("doc_id", "at", "n")
    contested = placed.where("origin and n_segments > 1").select("h", "doc_id", "digest", "n_segments")
    segments = _cut_out(docs, contested, length)
    hot = contested.where(F.col("n_segments") > max_group).select("h").distinct()
    if hot.isEmpty():
        found_windows = _expand(segments.repartition("h").sortWithinPartitions("h"), length)
    else:
        segments = materialise(segments, "cut")
        found_windows = _expand(segments.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h"), length)
        single = materialise(_single_windows(segments.join(hot, "h", "left_semi"), length), "windows")
        twice = single.groupBy("h").count().where("count > 1").select("h")
        # Equal windows fold to their first place; the others are repeats at once.
        first = single.join(twice, "h").groupBy("h", "k", "bytes").agg(F.min(F.struct("doc_id", "at")).alias("o"))
        own = single.join(first, ["h", "k", "bytes"])
        repeats = own.where("o.doc_id <> doc_id or o.at <> at").select("doc_id", "at", F.lit(1).cast("long").alias("n"))
        rest = first.select("h", F.col("o.doc_id").alias("doc_id"), F.col("o.at").alias("at"), "k", "bytes")
        found_windows = found_windows.unionByName(_expand(rest.repartition("h").sortWithinPartitions("h"), length)).unionByName(repeats)
    return later.unionByName(found_windows)


def remove_repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier
    (smaller doc_id, or same document and earlier start).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes
    that stay), one row per input row. A null text is empty. A row with a null doc_id
    keeps all its bytes and is no source of repeats. Repeated rows of the same doc_id and text are one
    text and treated alike; different texts of one doc_id are parts of one document, in the order of a hash, no match crosses them.
    Texts shorter than ``length`` bytes keep everything. An empty table gives no rows.
    """
    docs, several = with_base(docs)
    ranges = repeated_ranges(docs, several, length, max_group).groupBy("doc_id").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
    ranges = materialise(ranges, "ranges")
    bits = bit_array(ranges.select("doc_id"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def touched(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
        return has_bit(bits, ids.astype(np.int64)) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(~touched(batch)))
            raw = [_bytes(t) for t in batch.column("text").to_pylist()]
            zero = [0] * len(raw)
            yield _rows([batch.column("doc_id").to_pylist(), [len(x) for x in raw], zero, zero, [hashlib.sha256(x).hexdigest() for x in raw], raw], schema)

    def dirty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(touched(batch)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, text, base, ats, ns in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "base", "ats", "ns"))):
                raw = _bytes(text)
                change = np.zeros(len(raw) + 1, np.int64)
                if ats:
                    begin, many = np.array(ats, np.int64) - base, np.array(ns, np.int64)
                    own = (begin >= 0) & (begin < 1 << BASE_BITS)
                    begin, many = begin[own], many[own]
                    np.add.at(change, np.minimum(begin, len(raw)), 1)
                    np.add.at(change, np.minimum(begin + many + length - 1, len(raw)), -1)
                gone = np.cumsum(change)[: len(raw)] > 0
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for c, v in zip(out, (doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            yield _rows(out, schema)

    texts = docs.select("doc_id", "text", "base")
    # Only texts that lose something (and a few false hits) are shuffled to their ranges.
    joined = texts.mapInArrow(dirty, "doc_id long, text string, base long").join(ranges, "doc_id", "left").select("doc_id", "text", "base", "ats", "ns")
    return texts.mapInArrow(clean, schema).unionByName(joined.mapInArrow(cut, schema))
