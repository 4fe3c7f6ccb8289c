"""Verification of spans against their article, verbatim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slice_text, squeeze


def full_text(paragraphs: Column) -> Column:
    return F.array_join(F.coalesce(paragraphs, F.array().cast("array<string>")), "\n\n", "")


def failure(text: Column, start: Column, end: Column, span_text: Column) -> Column:
    """Why a span can't be verified, in this order; null if it can."""
    there = slice_text(text, start, end)
    return (
        F.when(end > F.length(text), "out_of_bounds")
        .when((end <= start) | (there == ""), "empty_slice")
        .when(squeeze(there) != squeeze(F.coalesce(span_text, F.lit(""))), "text_mismatch")
    )


def verify(spans: DataFrame, articles: DataFrame) -> DataFrame:
    """``spans`` joined with ``articles`` (doc_id and full_text, or paragraphs): adds verified,
    reason, derivations, birth_year and rounds the confidence (default 0.5).

    A span whose article is missing gets the reason ``missing_article``; it doesn't stop the others.
    """
    text = F.col("full_text") if "full_text" in articles.columns else full_text(F.col("paragraphs"))
    # A document's spans meet its text as one row; the text itself isn't repeated for each of them.
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*(F.col(c) for c in spans.columns))).alias("__spans"))
    met = lists.join(articles.select("doc_id", text.alias("__text")), "doc_id", "left")
    why = F.transform("__spans", lambda s: F.struct(s.alias("s"), F.when(F.col("__text").isNull(), "missing_article").otherwise(failure(F.col("__text"), s["start"], s["end"], s["text"])).alias("reason")))
    joined = met.select(F.explode_outer(why).alias("x")).where("x is not null").select("x.s.*", "x.reason")
    year = F.regexp_extract(F.coalesce("attributes.normalized", "text"), r"(19|20)\d{2}", 0)
    year = F.when(F.col("span_type") == "date_of_birth", F.nullif(year, F.lit(""))).cast("int")
    at = F.array("start", "end").alias("source_span")
    dob = F.when(year.isNotNull(), F.struct(F.lit("birth_year").alias("field"), F.lit("dob->birth_year").alias("derivation"), at))
    money = F.when((F.col("span_type") == "currency_amount") & F.col("attributes.amount_vnd").isNotNull(), F.struct(F.lit("amount_vnd").alias("field"), F.lit("currency_normalizer").alias("derivation"), at))
    checked = joined.withColumn("verified", F.col("reason").isNull())
    ok = F.col("verified")
    return checked.select(
        *(c for c in spans.columns if c != "confidence"),
        F.when(ok, F.bround(F.coalesce("confidence", F.lit(0.5)), 4)).otherwise(F.col("confidence")).alias("confidence"),
        "verified",
        "reason",
        F.when(ok, year).alias("birth_year"),
        F.when(ok, F.array_compact(F.array(dob, money))).alias("derivations"),
        F.when(ok, "verbatim").alias("verifier_source"),
    )


def kept(checked: DataFrame) -> DataFrame:
    return checked.where("verified").drop("reason")


def dropped(checked: DataFrame) -> DataFrame:
    return checked.where("not verified").select("doc_id", "span_type", "text", "start", "end", "reason")


def document_stats(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc_id").agg(F.count("*").alias("input_spans"), F.count_if("verified").alias("verified_spans"), F.count_if(~F.col("verified")).alias("dropped_spans"))


def by_type(checked: DataFrame, running: bool = False) -> DataFrame:
    """(doc_id, span_type, total, verified, avg_confidence): the mean is rounded once, to 4 places. With ``running`` it is
    rounded at every step, in the order of start, end and text."""
    if running:
        ordered = F.sort_array(F.collect_list(F.when(F.col("verified"), F.struct("start", "end", "text", F.coalesce("confidence", F.lit(0.0)).alias("c")))))
        mean = running_mean(F.transform(ordered, lambda x: x["c"]))
        return checked.groupBy("doc_id", "span_type").agg(F.count("*").alias("total"), F.count_if("verified").alias("n_verified"), mean.alias("avg_confidence")).withColumnRenamed("n_verified", "verified")
    mean = F.coalesce(F.bround(F.avg(F.when(F.col("verified"), F.coalesce("confidence", F.lit(0.0)))), 4), F.lit(0.0))
    return checked.groupBy("doc_id", "span_type").agg(F.count("*").alias("total"), F.count_if("verified").alias("n_verified"), mean.alias("avg_confidence")).withColumnRenamed("n_verified", "verified")


def running_mean(confidences: Column) -> Column:
    """The mean of an ordered array, rounded to 4 places at every step (the order counts)."""
    zero = F.struct(F.lit(0.0).alias("avg"), F.lit(0).alias("n"))
    return F.aggregate(confidences, zero, lambda a, c: F.struct(F.bround((a["avg"] * a["n"] + F.coalesce(c, F.lit(0.0))) / (a["n"] + 1), 4).alias("avg"), (a["n"] + 1).alias("n")), lambda a: a["avg"])


def failure_reasons(checked: DataFrame) -> DataFrame:
    return checked.where("not verified").groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("input_spans"), F.count_if("verified").alias("verified_spans"), F.count_if(~F.col("verified")).alias("dropped_spans"))
