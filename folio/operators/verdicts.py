"""Verdicts of a second model: prompt, answer, usable rule and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lenient_json, unfence_lines
from ..schemas import VERDICT, VERDICT_ISSUES, VERDICT_SEVERITIES, VERDICTS

MAX_PASSAGE_CHARS = 12_000
_ISSUES = "array<struct<type:string,severity:string,person_name:string,field:string,description:string,evidence:string>>"
_MISSING = "array<struct<name:string,snippet:string>>"
SYSTEM_PROMPT = (
    "You check an extraction of people against a passage. Rely on the passage only; report invented, conflicting and missing facts. Answer with JSON only: "
    '{"verdict": "supported|unsure|unsupported", "issues": [{"type": "hallucination|missing_info|conflict|other", "severity": "critical|warning|info", '
    '"person_name": null, "field": null, "description": "", "evidence": null}], "missing_people": [{"name": "", "snippet": null}], "usable": true, "confidence": 0.0, "notes": null}. '
    "usable is true only for a supported verdict without missing people and critical issues; an issue without severity is critical."
)
#: The answer of a dry run.
DRY_RUN = '{"verdict": "unsure", "issues": [{"type": "other", "description": "Dry run: no model was called."}], "missing_people": []}'


def verdict_prompt(passage: Column, truncated: Column, payload: Column) -> Column:
    """Header, a note if the passage was cut, and the payload (a struct) as JSON."""
    note = F.when(truncated, "NOTE: the passage was cut at the maximum length.\n").otherwise("")
    return F.concat(F.lit("Is every person and action below supported by the passage text alone?\n"), note, F.lit("\nPAYLOAD:\n"), F.to_json(F.struct(passage.alias("passage_text"), payload.alias("extraction"))))


def one_of(x: Column, allowed: list[str], default: str | None) -> Column:
    """``x`` lower-cased if it is allowed, else the default."""
    return F.when(F.lower(x).isin(allowed), F.lower(x)).otherwise(F.lit(default))


def has_critical(issues: Column) -> Column:
    """A missing severity counts as critical."""
    return F.exists(issues, lambda i: F.coalesce(i["severity"], F.lit("critical")) == "critical")


def usable(verdict: Column, issues: Column, missing: Column, given: Column) -> Column:
    """Supported, nobody missing, nothing critical, and the model doesn't say otherwise."""
    return (verdict == "supported") & (F.size(missing) == 0) & ~has_critical(issues) & F.coalesce(given, F.lit(True))


def reports(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Reports of model answers: verdict, issues, missing_people, usable, confidence and counts.
    An answer that isn't JSON gives an unsure verdict with one critical ``parsing_error``."""
    parsed = answers.withColumn("__v", F.from_json(lenient_json(F.col(raw), unfence_lines), VERDICT))
    v, bad = F.col("__v"), F.col("__v").isNull()

    def tidy(i: Column) -> Column:
        kind = one_of(i["type"], VERDICT_ISSUES, "other")
        return F.struct(kind.alias("type"), one_of(i["severity"], VERDICT_SEVERITIES, None).alias("severity"), i["person_name"].alias("person_name"), i["field"].alias("field"), F.coalesce(i["description"], F.lit("")).alias("description"), i["evidence"].alias("evidence"))

    unread = F.array(F.struct(F.lit("parsing_error").alias("type"), F.lit("critical").alias("severity"), F.lit(None).alias("person_name"), F.lit(None).alias("field"), F.lit("The answer was not valid JSON.").alias("description"), F.lit(None).alias("evidence")))
    issues = F.when(bad, unread.cast(_ISSUES)).otherwise(F.coalesce(F.transform(F.filter(v["issues"], lambda i: i.isNotNull()), tidy), F.array().cast(_ISSUES)).cast(_ISSUES))
    missing = F.coalesce(F.filter(v["missing_people"], lambda p: F.coalesce(p["name"], F.lit("")) != ""), F.array().cast(_MISSING))
    out = parsed.withColumns({"verdict": one_of(v["verdict"], VERDICTS, "unsure"), "issues": issues, "missing_people": missing, "confidence": v["confidence"].try_cast("double"), "__given": v["usable"]})
    out = out.withColumn("usable", usable(F.col("verdict"), F.col("issues"), F.col("missing_people"), F.col("__given")))
    return out.withColumns({"issue_count": F.size("issues"), "missing_people_count": F.size("missing_people")}).drop("__v", "__given")


def percentage(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row: counts by verdict, issues, missing people, usable, and their percentages."""
    n = F.col("total_files_processed")
    counts = reports.agg(
        F.count("*").alias("total_files_processed"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("long").alias("total_issues"),
        F.coalesce(F.sum(F.size("missing_people")), F.lit(0)).cast("long").alias("total_missing_people"),
        F.count_if(usable(F.col("verdict"), F.col("issues"), F.col("missing_people"), F.col("usable"))).alias("total_usable"),
        F.count_if(F.col("verdict") == "supported").alias("total_supported"),
        F.count_if(F.col("verdict") == "unsure").alias("total_unsure"),
        F.count_if(~F.col("verdict").isin("supported", "unsure")).alias("total_unsupported"),
    )
    return counts.select("*", *(percentage(F.col(f"total_{k}"), n).alias(f"{k}_percentage") for k in ("usable", "supported", "unsure", "unsupported")))
