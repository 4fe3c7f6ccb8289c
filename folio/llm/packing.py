"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised inside Spark tasks. A document longer than the capacity
is first cut into full sequences; what remains of each document is cut into items
of at most a quarter of the capacity, small enough to balance. Items are dealt by hash into groups of a bounded expected size, and each group
is partitioned in its own task: partial partitions (tuples of window loads) with
the largest spreads are merged in opposing order, which leaves near-equal
windows. While the fullest window exceeds the capacity, the window count rises.
Windows that come out below the capacity are padded to it.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

CAPACITY = 2048
#: Expected documents of a group; bounds the memory and time of one packing task.
GROUP_DOCS = 1000

#: Texts with one of these are encoded whole: separators that only ``str.split`` knows, and the marks of special tokens.
_UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The vocabulary's own split of a lower-cased word into pieces that are encoded one by one.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


#: Texts that a vocabulary must encode word by word to the same ids as whole.
_PROBES = (
    "Don't STOP: it's 12,345.67 (or -3e5)!  We'll see\nthey've\tgone...", "naïve Ärger, Straße & ΣΊΣΥΦΟΣ; 東京 Ёлка I'm x_y a-b #tag @me", "...--- \"quoted\" ‘single’ don’t 1st 2nd 3½ ½ e\u0301",
    "a\u00a0b\u2028c\u0085d \u200be co\u00adop", "THE Quick\r\nbrown\x0bfox",
)


class Words:
    """Token ids (little-endian 32 bits) of white-space separated words and their pieces.

    No token of this kind of vocabulary spans white space or a border of pieces, so the ids
    of a text are those of its words one after the other, and those of a word the ids
    of its pieces. New pieces are encoded many at a time, joined by spaces, and told apart
    by the tokens that end a word. ``LIMIT`` bounds what is remembered: of words and of pieces
    so many. A ``thrifty`` one takes less than half the memory at more CPU time: it only remembers what is met a
    second time, as most words of a large table are rare, and fewer of them."""

    LIMIT, THRIFTY_LIMIT = 1 << 20, 1 << 17
    #: Texts that are split at once.
    TEXTS, THRIFTY_TEXTS = 1000, 250
    #: Places by hash that tell what was met before (a few are remembered too early).
    PLACES = 1 << 22

    def __init__(self, path: str, thrifty: bool = False):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # The same vocabulary for text that is already normalised and split into pieces.
        self.of_pieces = Tokenizer(self.tokenizer.model)
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(_PIECES + "|\n").findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.limit, self.texts = (self.THRIFTY_LIMIT, self.THRIFTY_TEXTS) if thrifty else (self.LIMIT, self.TEXTS)
        #: What was met of words and of pieces.
        self.met = [np.zeros(self.PLACES, bool) for _ in range(2)] if thrifty else None
        self.once: list[tuple[dict[str, bytes], list[str]]] = []
        #: Whether this vocabulary splits texts as assumed here; if not, every text is encoded whole.
        self.fits = self._fits()

    def _fits(self) -> bool:
        if not self.ends.any():
            return False
        try:
            return all(b"".join(self._known(t.split())) == self.whole(t) for t in _PROBES)
        except (KeyError, ValueError, IndexError):
            return False

    def _known(self, words: list[str]) -> list[bytes]:
        self.learn(set(words))
        return [self.words[w] for w in words]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        for k in range(0, len(new), 5000):
            some = new[k : k + 5000]
            # Without the places of tokens in the text, which nobody reads.
            found = self.of_pieces.encode_batch_fast([" ".join(some[i : i + 1000]) for i in range(0, len(some), 1000)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self.pieces.update(zip(some, _slices(ids.tobytes(), stops * 4)))
            else:
                self.pieces.update((x, self.whole(x)) for x in some)

    def _meet(self, known: dict[str, bytes], new: list[str]) -> None:
        """Note which of these are met for the first time."""
        if self.met is None:
            return
        met = self.met[known is self.pieces]
        places = np.fromiter(map(hash, new), np.int64, len(new)) & (self.PLACES - 1)
        self.once.append((known, list(compress(new, (~met[places]).tolist()))))
        met[places] = True

    def _forget(self) -> None:
        for known, once in self.once:
            for x in once:
                known.pop(x, None)
        self.once.clear()
        for known in (self.words, self.pieces):
            if len(known) > self.limit:
                known.clear()
        for met in self.met or []:
            if np.count_nonzero(met) > self.PLACES // 2:
                met[:] = False

    def learn(self, words: set[str]) -> None:
        """Make sure that these words are known, until the next are learnt."""
        self._forget()
        new = list(words - self.words.keys())
        self._meet(self.words, new)
        # Lower-casing and splitting them together must give what the normaliser gives for each.
        odd = [w for w in new if not w.isascii() and (not is_normalized("NFC", w) or "Σ" in w or "İ" in w)]
        self.words.update((w, self.whole(w)) for w in odd)
        if odd:
            new = list(set(new).difference(odd))
        if not new:
            return
        pieces = self.split("\n".join(new).lower())
        pieces.append("\n")
        self.pieces["\n"] = _BORDER
        fresh = list(set(pieces) - self.pieces.keys())
        self._meet(self.pieces, fresh)
        self._learn_pieces(fresh)
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), "<u4")
        borders = np.flatnonzero(ids == 0xFFFFFFFF)
        self.words.update(zip(new, _slices(ids[ids != 0xFFFFFFFF].tobytes(), (borders - np.arange(len(borders))) * 4)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for k in range(0, len(texts), self.texts):
            some = [t.split() if self.fits and not any(x in t for x in _UNSURE) else None for t in texts[k : k + self.texts]]
            self.learn(set().union(*(x for x in some if x)))
            get = self.words.__getitem__
            for text, words in zip(texts[k : k + self.texts], some):
                yield self.whole(text) if words is None else b"".join(map(get, words))


#: Stands between words while they are learnt; no vocabulary has this id.
_BORDER = b"\xff\xff\xff\xff"


def _slices(raw: bytes, stops: np.ndarray) -> list[bytes]:
    at, out = 0, []
    for stop in stops.tolist():
        out.append(raw[at:stop])
        at = stop
    return out


def _words(path: str, thrifty: bool = False) -> Words:
    """The ``Words`` of this worker process, made once for all its tasks. Kept on ``sys``, as functions
    and classes that are shipped by value are new in each task."""
    kept = sys.__dict__.setdefault("_folio_words", {})
    if (path, thrifty) not in kept:
        kept[path, thrifty] = Words(path, thrifty)
    return kept[path, thrifty]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full sequences, then quarters at most."""
    full = n - n % capacity
    quarter = max(1, capacity // 4)
    return [(k, capacity) for k in range(0, full, capacity)] + [(k, min(quarter, n - k)) for k in range(full, n, quarter)]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False, thrifty: bool = False) -> DataFrame:
    """One row per document: doc_id, doc_tokens and, for each piece of at most
    ``capacity`` ids, its checksum (and its ids if ``keep_ids``); ``salt`` numbers equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer, thrifty), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, 1000):
            sums, sizes, ids, salts = [], [], [], []
            for raw in words.encode([t or "" for t in batch.column("text").to_pylist()]):
                of = np.frombuffer(raw + end, "<u4")
                pieces = [of[k : k + size] for k, size in cuts(len(of), capacity)]
                sums.append([zlib.crc32(p.tobytes()) for p in pieces])
                sizes.append(len(of))
                ids.append([p.tolist() for p in pieces] if keep_ids else None)
            # Equal rows are told apart by their number in the task: it doesn't depend on the order of rows.
            for key in zip(batch.column("doc_id").to_pylist(), sizes, map(tuple, sums)):
                h = hash(key)
                salts.append(seen[h] << 32 | task)
                seen[h] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.list_(pa.int64()))), pa.array(salts, pa.int64())],
                names=["doc_id", "doc_tokens", "sums", "ids", "salt"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>, ids array<array<long>>, salt long")


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp: split items into ``m`` sets of near-equal sums; returns item numbers by set."""
    if m == 1:
        return [list(range(len(sizes)))]
    # A partial partition: loads less the smallest, in falling order, and a set of members for each nonzero load. Below len(sizes)
    # a set is that item, above it one that joins two others.
    heap: list = []
    for k, s in enumerate(sizes):
        heap.append((-s, k, np.array([s], np.int64), np.array([k])))
    heapq.heapify(heap)
    joined, made = [], len(sizes)
    while len(heap) > 1:
        _, k, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        free = m - len(a)
        # The largest loads of one side meet the smallest (here: empty) of the other.
        loads, members = np.concatenate([a, b[:free]]), np.concatenate([of_a, of_b[:free]])
        if len(b) > free:
            over = len(b) - free
            met = slice(len(a) - over, len(a))
            loads[met] += b[free:][::-1]
            joined += zip(members[met].tolist(), of_b[free:][::-1].tolist())
            members[met] = range(made, made + over)
            made += over
        order = np.argsort(-loads, kind="stable")
        loads, members = loads[order], members[order]
        heapq.heappush(heap, (-_spread(loads, m), k, _reduced(loads, m), members))
    final = heap[0][3].tolist() if heap else []
    return [_leaves(x, joined, len(sizes)) for x in final] + [[] for _ in range(m - len(final))]


def _spread(loads: np.ndarray, m: int) -> int:
    return int(loads[0] - (loads[-1] if len(loads) == m else 0))


def _reduced(loads: np.ndarray, m: int) -> np.ndarray:
    """Loads stay relative to the smallest; a set whose relative load is 0 keeps its members."""
    return loads - loads[-1] if len(loads) == m else loads


def _leaves(root: int, joined: list[tuple[int, int]], n: int) -> list[int]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x >= n:
            stack.extend(joined[x - n])
        else:
            out.append(x)
    return out


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest windows, counted up from the lower bound, whose loads all fit."""
    if not sizes:
        return []
    low = -(-sum(sizes) // capacity)
    m = low
    while True:
        sets = difference(sizes, m)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return [s for s in sets if s]
        m += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, group_docs: int = GROUP_DOCS, keep_ids: bool = False, thrifty: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (null unless ``keep_ids``).

    A null or empty text is the end id alone. Repeated rows are packed as often as
    they occur. Rows with a null doc_id are packed too. An empty table gives no rows.
    ``thrifty``: the tokenisers hold less memory, for executors that other steps have filled; they run at once, and their
    checksums (and ids) are written into the shared folder.
    """
    of = tokenised(docs, tokenizer, capacity, end_id, keep_ids, thrifty)
    if thrifty:
        of = materialise(of, "tokens")
    groups = max(1, -(-(of if thrifty else docs).count() // group_docs))
    of = of.withColumn("g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "sums", "salt"), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable").reset_index(drop=True)
        base, out, rest = int(key[0]) << 32, [], []
        for k, (doc, n, sums) in enumerate(zip(rows.doc_id, rows.doc_tokens, rows.sums)):
            for i, (crc, (start, length)) in enumerate(zip(sums, cuts(n, capacity))):
                piece = [doc, start, length, crc, n, None, 0, rows.ids[k][i] if keep_ids else None]
                (out if length == capacity else rest).append(piece)
        for seq, piece in enumerate(out):
            piece[5] = base + seq
        seq = len(out)
        for members in pack_group([p[2] for p in rest], capacity):
            at = 0
            for i in members:
                rest[i][5:7] = base + seq, at
                at += rest[i][2]
            seq += 1
        return pd.DataFrame(out + rest, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return of.groupBy("g").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<long>")
