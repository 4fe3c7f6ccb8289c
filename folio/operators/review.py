"""Manual review: report texts, marks and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import percentage


def issue_text(verdict: Column, issues: Column, missing: Column) -> Column:
    """A report as text: verdict, counts, numbered issues, missing people."""

    def lines(i: Column, k: Column) -> Column:
        head = F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), F.coalesce(i["type"], F.lit("unknown")), F.when(i["person_name"] != "", F.concat(F.lit(" | Person: "), i["person_name"])).otherwise(""), F.when(i["field"] != "", F.concat(F.lit(" | Field: "), i["field"])).otherwise(""))
        return F.concat_ws("\n", head, F.when(i["description"] != "", F.concat(F.lit("  "), i["description"])), F.when(i["evidence"] != "", F.concat(F.lit("  Evidence: "), i["evidence"])), F.lit(""))

    people = F.transform(missing, lambda p: F.concat(F.lit("- "), F.coalesce(p["name"], F.lit("unknown")), F.when(p["snippet"] != "", F.concat(F.lit(" — "), p["snippet"])).otherwise("")))
    head = F.concat(F.lit("Issues: "), F.size(issues).cast("string"), F.lit(" | Missing people: "), F.size(missing).cast("string"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Verdict: "), F.coalesce(verdict, F.lit("unknown"))),
        head,
        F.when(F.size(issues) > 0, F.concat(F.lit("\nIssues\n"), F.array_join(F.transform(issues, lines), "\n"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing People\n"), F.array_join(people, "\n"))),
    )
    return F.regexp_replace(body, r"\s+$", "")


def people_text(people: Column, available: Column, error: Column) -> Column:
    """The extracted people as text, one numbered entry with its JSON each."""
    entries = F.transform(people, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(p["name"]["text"], F.lit("unknown")), F.lit("\n   "), F.to_json(p)))
    listed = F.when(F.size(F.coalesce(people, F.array())) == 0, "  (none)").otherwise(F.array_join(entries, "\n"))
    return F.when(available, F.concat(F.lit("Parsed People (source extraction)\n"), listed)).otherwise(F.concat(F.lit("Parsed people unavailable ("), F.coalesce(error, F.lit("source file unavailable")), F.lit(")")))


def report_view(reports: DataFrame, extractions: DataFrame) -> DataFrame:
    """(doc_id, passage_id, left_text, right_text): passage and people beside the report; a report without its extraction stays, with a placeholder."""
    source = extractions.select("doc_id", "passage_id", F.col("passage_text").alias("__text"), F.col("people").alias("__people"), F.lit(True).alias("__there"))
    joined = reports.join(source, ["doc_id", "passage_id"], "left")
    there = F.coalesce("__there", F.lit(False))
    left = F.concat(F.coalesce("__text", F.lit("")), F.lit("\n\n"), people_text(F.col("__people"), there, F.lit(None).cast("string")))
    return joined.select("doc_id", "passage_id", left.alias("left_text"), issue_text(F.col("verdict"), F.col("issues"), F.col("missing_people")).alias("right_text"))


def latest_marks(marks: DataFrame) -> DataFrame:
    """The last mark of each report of a log (doc_id, passage_id, status, ts): ``skip`` changes nothing, ``unset`` clears."""
    last = marks.where("status <> 'skip'").groupBy("doc_id", "passage_id").agg(F.max_by("status", "ts").alias("s"))
    return last.select("doc_id", "passage_id", mark(F.col("s")).alias("manual_status"))


def mark(status: Column) -> Column:
    return F.when(status.isin("valid", "invalid"), status)


def manual_summary(reports: DataFrame, status: str = "manual_status") -> DataFrame:
    """One row: reports, counts and percentages of valid, invalid and unset (anything else)."""
    s = F.coalesce(mark(F.col(status)), F.lit("unset"))
    counts = reports.agg(F.count("*").alias("total"), *(F.count_if(s == k).alias(k) for k in ("valid", "invalid", "unset")))
    return counts.select("*", *(percentage(F.col(k), F.col("total")).alias(f"{k}_percentage") for k in ("valid", "invalid", "unset")))
