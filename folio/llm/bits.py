"""A bit array over 64-bit hashes: a pre-filter whose size follows the number of hashes
up to a fixed bound, so it can always be broadcast. It only ever lets too much
through; what passes is checked by an exact join. Far beyond 2**MAX_LOG_BITS hashes it lets nearly
everything through, and the exact join does the work alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the smallest and the largest array: 2 and 32 MB. Few hashes get a sparse array, as false hits cost more than its size.
BITS_A_HASH, MIN_LOG_BITS, MAX_LOG_BITS = 8, 24, 28


def _places(h: np.ndarray, log_bits: int) -> np.ndarray:
    # Hashes may be minima, so their high bits aren't even.
    h = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - log_bits)).astype(np.int64)


def bit_array(hashes: DataFrame) -> bytes:
    """The array over a one-column table of longs, which is also counted, so it should be a written
    one. Tasks send the words they set, merged by word before the driver gets them: at
    most 2**MAX_LOG_BITS / 64 rows."""
    log_bits = max(MIN_LOG_BITS, min(MAX_LOG_BITS, (BITS_A_HASH * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log_bits - 3), np.uint8)
        for batch in batches:
            p = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), log_bits)
            np.bitwise_or.at(bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        words = bits.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    words = hashes.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (log_bits - 6), "<i8")
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.tobytes()


def has_bit(bits: bytes, h: np.ndarray) -> np.ndarray:
    array = np.frombuffer(bits, np.uint8)
    p = _places(h, int(len(array)).bit_length() + 2)
    return (array[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
