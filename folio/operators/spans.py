"""Span tables: dedupe, validity and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import SPAN_SOURCES, SPAN_TYPES

KEY = ["doc_id", "span_type", "start", "end", "source", "text"]


def dedupe(spans: DataFrame, emitted: str = "emit_seq") -> DataFrame:
    """One span for each key: the highest confidence (null is 0), of equal ones the first
    emitted. ``first_emit`` is the place of the key's first emission: the last sort key of a document's spans."""
    w = W.partitionBy(*KEY)
    ranked = spans.withColumn("first_emit", F.min(emitted).over(w)).withColumn("__rank", F.row_number().over(w.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), emitted)))
    return ranked.where("__rank = 1").drop("__rank")


def in_order(spans: DataFrame) -> DataFrame:
    return spans.orderBy("doc_id", "start", "end", "span_type", "first_emit")


def violations(spans: DataFrame) -> DataFrame:
    """``spans`` with the array column ``violations``; an empty one means a valid span.
    An end before the start is no violation: the verifier finds it."""
    rules = {
        "text": F.coalesce(F.length("text"), F.lit(0)) < 1,
        "start": F.coalesce(F.col("start"), F.lit(-1)) < 0,
        "end": F.coalesce(F.col("end"), F.lit(-1)) < 0,
        "passage_id": F.coalesce(F.col("passage_id"), F.lit(0)) < 0,
        "confidence": ~F.coalesce(F.col("confidence"), F.lit(0.0)).between(0, 1),
        "span_type": ~F.coalesce(F.col("span_type").isin(SPAN_TYPES), F.lit(False)),
        "source": ~F.coalesce(F.col("source").isin(SPAN_SOURCES), F.lit(False)),
    }
    return spans.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))


def strict(spans: DataFrame) -> DataFrame:
    """``spans`` unchanged; a span with a violation fails the job."""
    checked = violations(spans)
    bad = F.concat(F.lit("invalid span: "), F.array_join("violations", ", "))
    return checked.where(F.assert_true(F.size("violations") == 0, bad).isNull()).drop("violations")


def detector_hits(spans: DataFrame) -> DataFrame:
    """(doc_id, detector, hits) of deduplicated regex spans."""
    found = spans.where("source = 'regex' and attributes.detector is not null")
    return found.groupBy("doc_id", F.col("attributes.detector").alias("detector")).agg(F.count("*").alias("hits"))


def span_length(start: Column, end: Column) -> Column:
    """Length of a span; 0 where the end lies before the start."""
    return F.greatest(end - start, F.lit(0))


def document_stats(emitted: DataFrame) -> DataFrame:
    """Per document: regex_spans and ner_spans (before dedupe), total_spans (after), sentences, passages, detector_hits.

    ``emitted``: the rows of ``emit`` with ``all_sentences``. One pass: rows are counted by span key, where the
    dedupe's choice is a minimum, then by document and detector, then by document."""
    first = F.coalesce(F.col("k") == 0, F.lit(True))
    choice = F.struct(-F.coalesce("confidence", F.lit(0.0)), F.struct("passage_ord", "ord", "k"), F.col("attributes.detector").alias("detector"))
    there = F.col("span_type").isNotNull()
    keys = emitted.groupBy(*KEY).agg(
        F.count_if(there).alias("n"), F.count_if(first).alias("sentences"), F.count_if(first & (F.col("ord") == 0)).alias("passages"), F.min(F.when(there, choice)).alias("c")
    )
    regex, kept = F.col("source") == "regex", F.col("n") > 0
    by = keys.groupBy("doc_id", F.when(regex, F.col("c.detector")).alias("detector")).agg(
        F.sum(F.when(regex, F.col("n")).otherwise(0)).alias("regex_spans"), F.sum(F.when(F.col("source") == "ner", F.col("n")).otherwise(0)).alias("ner_spans"),
        F.count_if(kept).alias("total_spans"), F.sum("sentences").alias("sentences"), F.sum("passages").alias("passages"),
    )
    hits = F.sort_array(F.collect_list(F.when(F.col("detector").isNotNull(), F.struct("detector", F.col("total_spans").alias("hits")))))
    sums = [F.sum(c).alias(c) for c in ("regex_spans", "ner_spans", "total_spans", "sentences", "passages")]
    return by.groupBy("doc_id").agg(*sums, F.map_from_entries(hits).alias("detector_hits"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("docs"), F.coalesce(F.sum("total_spans"), F.lit(0)).alias("spans"))
