"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next stage's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialise, named, parted, read
from folio.llm.decontaminate import contaminated
from folio.llm.line_dedup import dedup_lines
from folio.llm.minhash import near_duplicates
from folio.llm.packing import pack
from folio.llm.quality import judge
from folio.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of a batch that goes to Python. By default there are 10,000; whole texts of that many fill a hundred MB of an executor for each of its cores, in both processes.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs that run inside: batches of ``BATCH_ROWS`` at most."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    rows, _ = named(docs.select(*COLUMNS))
    judged = judge(rows, read(spark, sf_dir, "labels"), keep=("name",))
    return _without(rows, materialise(judged.where("not kept").select("name").distinct(), "rejected"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The named ``rows`` but those with a name in ``gone`` (name, distinct); only texts that may go are shuffled."""
    maybe, others = parted(rows, gone, "name")
    return maybe.join(gone, "name", "left_anti").select(*COLUMNS).unionByName(others.select(*COLUMNS))


def _as_docs(rows: DataFrame) -> DataFrame:
    """Named rows for an operator: the name is the id."""
    return rows.drop("doc_id").withColumnRenamed("name", "doc_id")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, from all documents but the last that holds them; a document that only consisted of such lines keeps an empty text."""
    return dedup_lines(docs, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id (or hash, where ids are null or repeated). Of rows
    that agree in id and text one stays."""
    rows, shared = named(docs.select(*COLUMNS))
    with small_batches(spark):
        found = near_duplicates(_as_docs(rows))
        gone = materialise(found.where("not kept").select(F.col("doc_id").alias("name")).distinct(), "copies")
    return _without(_once(rows) if shared else rows, gone)


def _once(rows: DataFrame) -> DataFrame:
    """One of the named rows of each name; only texts whose name is shared (and a few more) move."""
    again = materialise(rows.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "again")
    many, single = parted(rows, again, "name")
    once = many.join(again, "name", "left_semi").groupBy("name").agg(*(F.first(c).alias(c) for c in COLUMNS))
    return single.unionByName(many.join(again, "name", "left_anti")).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows, _ = named(docs.select(*COLUMNS))
    with small_batches(spark):
        found = contaminated(_as_docs(rows), read(spark, sf_dir, "benchmark"))
        gone = materialise(found.where("contaminated").select(F.col("doc_id").alias("name")).distinct(), "leaked")
    return _without(rows, gone)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. The executors still hold what the stages before it took, so the tokenisers are thrifty and their batches small."""
    with small_batches(spark):
        return pack(docs, tokenizer_path(), thrifty=True).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Near-duplicate classes and tokenised packing have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
