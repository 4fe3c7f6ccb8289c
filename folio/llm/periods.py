"""Periodic runs of words: stretches that repeat with a period, found by harmonic grid probing.

A run is a maximal stretch of words with a smallest period p that is at least ``exponent`` periods
and ``least`` words long. Every such run holds ``exponent - 1`` neighbouring multiples of p at which the word
equals the one p further on. So for each p only the words at jp and (j+1)p are compared, which makes
n/1 + n/2 + n/3 + ... probes of a text; where enough neighbours in a row are equal, the stretch is
extended to both sides by comparing chunks of growing length. A grid point inside a run found with a
divisor of p is skipped: all it could give is that run again.

Texts of an Arrow batch are probed together, the longest first, so a period only visits the texts that are long enough for it.
A text stays in its row and needs nothing of any other row, so nothing is shuffled and no row can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

EXPONENT, LEAST = 4, 6
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Words of a probed batch, but for one text that is longer.
BATCH_WORDS = 1 << 20


def _extend(codes: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The range of places around ``at`` whose code equals the one p further on."""
    low, chunk = at, 64
    while low > 0:
        a = max(0, low - chunk)
        differ = np.flatnonzero(codes[a:low] != codes[a + p : low + p])
        if len(differ):
            low = a + int(differ[-1]) + 1
            break
        low, chunk = a, chunk * 2
    high, chunk, end = at, 64, len(codes) - p
    while high < end:
        b = min(end, high + chunk)
        differ = np.flatnonzero(codes[high:b] != codes[high + p : b + p])
        if len(differ):
            high += int(differ[0])
            break
        high, chunk = b, chunk * 2
    return low, high


def runs_of(codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) in the codes of several texts, each closed by a code that occurs nowhere else; ``ends`` are the
    places after the texts, whose ``lengths`` descend."""
    owner, reach = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    known, found = set(), []
    shrinking = -lengths
    for p in range(1, int(lengths[0]) // exponent + 1 if len(lengths) else 1):
        n_texts = int(np.searchsorted(shrinking, -max(exponent * p, least), side="right"))
        if not n_texts:
            break
        need = max(exponent - 1, (least - p) // p)
        grid = codes[: int(ends[n_texts - 1]) : p]
        same = grid[:-1] == grid[1:]
        if len(same) < need:
            continue
        survivors = same[: len(same) - need + 1].copy()
        for k in range(1, need):
            survivors &= same[k : len(same) - need + 1 + k]
        at = np.flatnonzero(survivors) * p
        if not len(at):
            continue
        period = owner[at]
        at = at[(period == 0) | (p % np.maximum(period, 1) != 0) | (reach[at] < at + need * p)]
        until = -1
        for x in at.tolist():
            if x < until:
                continue
            low, high = _extend(codes, x, p)
            until, stop = high, high + p
            if stop - low >= max(exponent * p, least) and (low, stop) not in known:
                known.add((low, stop))
                found.append((low, stop, p))
                owner[low:stop], reach[low:stop] = p, stop
    return found


def _judge(texts: list[bytes | None], exponent: int, least: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    words = [(t or b"").split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-lengths, kind="stable")
    codes: dict[bytes, int] = {}
    parts = []
    for k in order.tolist():
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words[k]), np.int64, len(words[k])))
        parts.append(np.array([-1 - k], np.int64))
    ends = np.cumsum(lengths[order] + 1)
    starts = ends - lengths[order] - 1
    spans = [[] for _ in texts]
    for low, stop, p in runs_of(np.concatenate(parts), ends, lengths[order], exponent, least):
        at = int(np.searchsorted(ends, low, side="right"))
        spans[order[at]].append((low - int(starts[at]), stop - low, p))
    for w, found in zip(words, spans):
        found.sort(key=lambda r: (r[0], r[2]))
        kept = w
        if found:
            stays = np.ones(len(w), bool)
            for start, length, p in found:
                stays[start + p : start + length] = False
            kept = [w[i] for i in np.flatnonzero(stays).tolist()]
        yield len(w), [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(kept)


def _few_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_WORDS words at most, judged by bytes."""
    sizes = np.array([len(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], np.int64)
    part = np.cumsum(sizes) // (6 * BATCH_WORDS)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; further columns are not read) with ``n_words``, its ``runs`` by start and period, and ``collapsed``: the words joined by one
    space, of each run only the first period. Words are runs without ASCII white space.

    A null or an empty text has no words, no runs and an empty ``collapsed``; rows with a repeated or a
    null doc_id are judged one by one; an empty table gives an empty result."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            for part in _few_words(batch):
                n, runs, collapsed = zip(*_judge(part.column("text").cast(pa.binary()).to_pylist(), exponent, least))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
