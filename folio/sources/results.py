"""The engine's own outputs as documents: span documents, verified documents, extractions and reports.

One JSON object per document. Files of one object each and JSON lines are both read; lines are written,
so a run over many documents makes as many files as it has tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, lenient_json
from ..schemas import PEOPLE, SPAN

_STATS = "struct<regex_spans:bigint,ner_spans:bigint,total_spans:bigint,sentences:bigint,passages:bigint,detector_hits:map<string,bigint>>"
SPAN_DOCUMENT = f"doc_id string, title string, source_path string, stats {_STATS}, spans array<{SPAN}>"
EXTRACTION = (
    "doc_id string, passage_id int, article_title string, model string, passage struct<text:string,start:int,end:int>, "
    f"request_error string, response struct<raw:string,parsed:{PEOPLE}>"
)


def _read(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return df.withColumn("source_file", F.col("_metadata.file_name")).withColumn("doc_id", F.coalesce("doc_id", F.lit("")) if lines else first_filled(F.col("doc_id"), name))


def span_documents(spans: DataFrame, stats: DataFrame, articles: DataFrame) -> DataFrame:
    """doc_id, title, source_path, stats, spans in order: one row per document with statistics. ``articles``: doc_id, title and optionally source_path."""
    fields = [f.split(":")[0] for f in SPAN[len("struct<") : SPAN.index(",attributes")].split(",")] + ["attributes"]
    span = F.struct(*(F.col(c) for c in fields)).cast(SPAN)
    key = F.struct("start", "end", "span_type", "first_emit", span.alias("span"))
    lists = spans.select("doc_id", key.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x"), _by_place).alias("x"))
    packed = stats.select("doc_id", F.struct("regex_spans", "ner_spans", "total_spans", "sentences", "passages", "detector_hits").cast(_STATS).alias("stats"))
    path = F.col("source_path") if "source_path" in articles.columns else F.lit(None).cast("string").alias("source_path")
    joined = packed.join(articles.select("doc_id", "title", path), "doc_id", "left").join(lists, "doc_id", "left")
    return joined.select("doc_id", "title", "source_path", "stats", F.coalesce(F.transform("x", lambda x: x["span"]), F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _by_place(a, b):
    """Comparison by start, end, type and first emission (attributes can't be compared)."""
    out = F.lit(0)
    for field in ("first_emit", "span_type", "end", "start"):
        out = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(out)
    return out


def read_span_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Span documents with ``source_file``; a missing doc_id is the file's name."""
    return _read(spark, path, SPAN_DOCUMENT, lines)


def spans_of(documents: DataFrame) -> DataFrame:
    """Span rows (doc_id and the fields of a span) of span documents."""
    return documents.select("doc_id", F.explode_outer("spans").alias("s")).where("s is not null").select("doc_id", "s.*")


def verified_documents(checked: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, article_title, baseline_stats, verifier_stats, spans (verified), dropped: one row per span document (doc_id, title, stats)."""
    whole = [c for c in checked.columns if c not in ("doc_id", "reason", "verified", "emit_seq", "first_emit")]
    lost = ["span_type", "start", "end", "reason", "text"]
    ok = F.col("verified")
    lists = checked.groupBy("doc_id").agg(
        F.collect_list(F.when(ok, F.struct(*(F.col(c) for c in whole)))).alias("spans"),
        F.sort_array(F.collect_list(F.when(~ok, F.struct("start", "end", "span_type", "text", "reason")))).alias("lost"),
        F.count("*").alias("n"), F.count_if(ok).alias("v"),
    )
    dropped = F.transform("lost", lambda x: F.struct(*(x[c].alias(c) for c in lost)))
    joined = documents.select("doc_id", F.col("title").alias("article_title"), F.col("stats").alias("baseline_stats")).join(lists, "doc_id", "left")
    zero = F.lit(0).cast("long")
    stats = F.struct(F.coalesce("n", zero).alias("input_spans"), F.coalesce("v", zero).alias("verified_spans"), (F.coalesce("n", zero) - F.coalesce("v", zero)).alias("dropped_spans"))
    empty = {c: F.array().cast(lists.schema[c].dataType) for c in ("spans", "lost")}
    joined = joined.withColumn("spans", F.coalesce("spans", empty["spans"])).withColumn("lost", F.coalesce("lost", empty["lost"]))
    return joined.select("doc_id", "article_title", "baseline_stats", stats.alias("verifier_stats"), "spans", dropped.alias("dropped"))


def extraction_documents(passages: DataFrame) -> DataFrame:
    """The output of a model run over passages (doc_id, passage_id, article_title, model, passage_text, raw, people, error) as documents with a file name for each passage."""
    parsed = F.struct(F.col("people").alias("people"), F.col("error").alias("error")).cast(PEOPLE)
    passage = F.struct(F.col("passage_text").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return passages.select("doc_id", "passage_id", "article_title", "model", passage.alias("passage"), F.col("error").alias("request_error"), F.struct(F.col("raw"), parsed.alias("parsed")).alias("response"), file_name().alias("file_name"))


def file_name():
    """Name of a passage's file: document, ``_p`` and passage number."""
    return F.concat(F.col("doc_id"), F.lit("_p"), F.col("passage_id").cast("string"), F.lit(".json"))


def read_extractions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Extraction documents in the form that ``validate`` takes: doc_id, passage_id, article_title, original_model,
    passage_text, people, source_file. People come from the parsed answer, else from the JSON text in the raw one."""
    df = _read(spark, path, EXTRACTION, lines)
    raw = F.from_json(lenient_json(F.col("response.raw")), PEOPLE)["people"]
    people = F.when(F.size(F.coalesce("response.parsed.people", F.array())) > 0, F.col("response.parsed.people")).otherwise(raw)
    return df.select(
        "doc_id", F.coalesce("passage_id", F.lit(0)).alias("passage_id"), "article_title", F.coalesce("model", F.lit("unknown")).alias("original_model"),
        F.coalesce("passage.text", F.lit("")).alias("passage_text"), people.alias("people"), "source_file",
    )


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as JSON lines; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
