"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and as an RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in
    ``spark.checkpoint.dir``. Where that is unset, a local folder serves if the session runs
    in one process (tests); on a cluster that is an error, as executors wouldn't share it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage so
    that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing still to be computed reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


#: Bits for each key of a filter, and the largest filter: 2**26 bits are a million rows of 16 bytes.
BITS_A_KEY, MAX_LOG_BITS = 16, 26


def parted(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``column`` may be in ``keys`` (one column of that name), and
    those whose isn't. A few others are in the first part too, so it takes an exact join; nulls are in the second.

    The bits of the hashed keys, 64 to a row, are broadcast: at most 2**(MAX_LOG_BITS - 6) rows,
    whatever the number of keys. Beyond about 2**MAX_LOG_BITS keys most rows land in the first part."""
    log = max(12, min(MAX_LOG_BITS, (BITS_A_KEY * keys.count()).bit_length()))

    def place(c: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col(c).cast("long")), 64 - log)

    def low(p: Column) -> Column:
        return p.bitwiseAND(F.lit(63)).cast("int")

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low(F.col("__p")))
    words = keys.select(place(column).alias("__p")).select(F.shiftright("__p", 6).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    words = materialise(words, "bits")
    names = rows.columns
    marked = rows.withColumn("__p", place(column)).withColumn("__word", F.shiftright("__p", 6)).join(F.broadcast(words), "__word", "left")
    there = F.col(column).isNotNull() & F.coalesce(F.getbit("__bits", low(F.col("__p"))) == 1, F.lit(False))
    return marked.where(there).select(*names), marked.where(~there).select(*names)


def named(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``name`` for each row, and whether rows may share one: the name is the doc_id, or a hash of id and text where the id is null or stands on
    several rows. Rows of one name are equal in both. Only ids are shuffled to find the repeated ones."""
    several = docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null")
    if several.isEmpty():
        return docs.withColumn("name", F.col("doc_id")), False
    repeated = materialise(several.where("doc_id is not null").select("doc_id"), "repeated")
    maybe, others = parted(docs, repeated, "doc_id")
    digest = F.xxhash64("doc_id", "text")
    marked = maybe.join(repeated.withColumn("__again", F.lit(True)), "doc_id", "left")
    marked = marked.select(*docs.columns, F.when(F.col("__again"), digest).otherwise(F.col("doc_id")).alias("name"))
    return marked.unionByName(others.withColumn("name", F.when(F.col("doc_id").isNull(), digest).otherwise(F.col("doc_id")))), True


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression (Catalyst has no LET of its own)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is much faster and equal on plain ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches: bounds what a task holds as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class WordCodes(dict):
    """Word to its 64-bit code (as bytes), remembered per task; ``LIMIT`` bounds the memory."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_digest(word)
        return code


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` codes; a shorter text has one window, itself; an empty one has none."""
    if not len(codes):
        return codes
    width = min(width, len(codes))
    out = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        out = (out + codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(width))


def word_codes(text: str | None, codes: WordCodes) -> np.ndarray:
    """Codes of the lower-cased words (runs without ASCII white space)."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return np.frombuffer(b"".join(map(codes.__getitem__, words)), np.uint64)
