"""Rules over extracted people: positions, vocabulary and facts, as one array of issues a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find, let, slice_text, snippet, squeeze
from ..schemas import ISSUE, PREDICATES, ROLES

ISSUE_TYPES = ["hallucination", "wrong_position", "missing_entity", "schema_violation", "wrong_law_article"]
COUNTERS = {"critical_issues": "critical", "errors": "error", "warnings": "warning", "info_issues": "info"}
TYPE_COUNTERS = {"hallucinations": "hallucination", "wrong_positions": "wrong_position", "missing_entities": "missing_entity", "schema_violations": "schema_violation", "wrong_law_articles": "wrong_law_article"}
#: More than this many dong looks wrong.
MAX_AMOUNT = 1_000_000_000_000
_LAW = r"(?iuU)(?:điều|khoản|điểm)\s+\w+.*?(?:bộ luật|luật)\s+\w+"


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def issue(kind: str, severity: str, person: Column, field: Column, expected: Column, actual: Column, description: Column, text_snippet: Column | None = None) -> Column:
    values = (F.lit(kind), F.lit(severity), person, field, expected, actual, description, F.lit(None) if text_snippet is None else text_snippet)
    names = ("type", "severity", "person_name", "field", "expected", "actual", "description", "text_snippet")
    return F.struct(*(v.cast("string").alias(n) for n, v in zip(names, values))).cast(ISSUE)


def _range_issue(person: Column, field: Column, start: Column, end: Column, passage: Column) -> Column:
    expected = F.concat(F.lit("valid position in range [0, "), F.length(passage).cast("string"), F.lit("]"))
    actual = F.concat(F.lit("start="), start.cast("string"), F.lit(", end="), end.cast("string"))
    return issue("wrong_position", "error", person, field, expected, actual, F.lit("Position is out of bounds or invalid"))


def _outside(start: Column, end: Column, passage: Column) -> Column:
    return (start < 0) | (end > F.length(passage)) | (start >= end)


def span_issue(person: Column, field: Column, span: Column, passage: Column) -> Column:
    """The issue of a span with text and position; null if it is right, without text, or has no position (-1 or null)."""
    start, end, text = F.coalesce(span["start"], F.lit(-1)), F.coalesce(span["end"], F.lit(-1)), span["text"]

    def misplaced(at: Column) -> Column:
        moved = issue(
            "wrong_position",
            "error",
            person,
            field,
            F.concat(F.lit("'"), text, F.lit("' at position "), at.cast("string")),
            F.concat(F.lit("'"), slice_text(passage, start, end), F.lit("' at position "), start.cast("string")),
            F.concat(F.lit("Text differs at this position; found at "), at.cast("string")),
            snippet(passage, at, F.length(text), 20),
        )
        made_up = issue("hallucination", "critical", person, field, F.lit("text present in passage"), F.concat(F.lit("'"), text, F.lit("' not found")), F.concat(F.lit("Text '"), text, F.lit("' isn't in the passage")))
        return F.when(at >= 0, moved).otherwise(made_up)

    given = (F.coalesce(text, F.lit("")) != "") & (start != -1) & (end != -1)
    out = F.when(_outside(start, end, passage), _range_issue(person, F.concat(field, F.lit(".start/end")), start, end, passage))
    out = out.when(slice_text(passage, start, end) != text, let(find(passage, text), misplaced))
    return F.when(given, out)


def _indexed(items: Column, name: str, make) -> Column:
    """Issues of a list field, null-safe; ``make`` gets the item and the field name with its index."""
    return F.coalesce(F.transform(items, lambda x, i: make(x, F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")))), _none())


def position_issues(p: Column, person: Column, passage: Column) -> Column:
    age = p["age"]
    start, end = F.coalesce(age["start"], F.lit(-1)), F.coalesce(age["end"], F.lit(-1))
    placed = age["value"].isNotNull() & (start != -1) & (end != -1) & (start != end)
    wrong_age = F.when(placed & _outside(start, end, passage), _range_issue(person, F.lit("age.start/end"), start, end, passage))

    def single(field: str) -> Column:
        return F.array(span_issue(person, F.lit(field), p[field], passage))

    def several(field: str) -> Column:
        return _indexed(p[field], field, lambda x, name: span_issue(person, name, x, passage))

    return F.concat(single("name"), F.array(wrong_age), single("birth_place"), several("phones"), single("national_id"), several("aliases"))


def _vocabulary(items: Column, name: str, key: str, allowed: list[str], what: str, person: Column) -> Column:
    listed = ", ".join(sorted(allowed))

    def one(x: Column, field: Column) -> Column:
        value = x[key]
        bad = (F.coalesce(value, F.lit("")) != "") & ~value.isin(allowed)
        return F.when(bad, issue("schema_violation", "warning", person, F.concat(field, F.lit("." + key)), F.lit(f"one of {listed}"), value, F.concat(F.lit(f"{what} '"), value, F.lit("' is not in the allowed set"))))

    return _indexed(items, name, one)


def schema_issues(p: Column, person: Column) -> Column:
    return F.concat(_vocabulary(p["roles"], "roles", "label", ROLES, "Role label", person), _vocabulary(p["actions"], "actions", "predicate", PREDICATES, "Action predicate", person))


def fact_issues(p: Column, person: Column, passage: Column, squeezed: Column, laws: Column) -> Column:
    def one(a: Column, field: Column) -> Column:
        law, amount = a["law_article"], a["amount_vnd"]
        expected = F.when(F.size(laws) > 0, F.concat(F.lit("law article present in text (found: "), F.array_join(F.slice(laws, 1, 3), "; "), F.lit(")"))).otherwise(F.lit("law article present in text"))
        absent = (F.coalesce(law, F.lit("")) != "") & ~squeezed.contains(squeeze(law))
        wrong = F.when(absent, issue("wrong_law_article", "critical", person, F.concat(field, F.lit(".law_article")), expected, law, F.concat(F.lit("Law article '"), law, F.lit("' isn't in the passage"))))
        huge = F.when(amount > MAX_AMOUNT, issue("hallucination", "warning", person, F.concat(field, F.lit(".amount_vnd")), F.lit("reasonable amount"), amount.cast("string"), F.concat(F.lit("Amount "), amount.cast("string"), F.lit(" VND seems unusually large"))))
        return F.array(wrong, huge)

    return F.coalesce(F.flatten(F.transform(p["actions"], lambda a, i: one(a, F.concat(F.lit("actions["), i.cast("string"), F.lit("]"))))), _none())


def completeness_issues(missing: Column, error: Column, passage: Column) -> Column:
    """Names that a checker found missing and that are in the passage; a failed check is an info issue."""

    def one(name: Column) -> Column:
        known = (F.length(F.trim(F.coalesce(name, F.lit("")))) > 0) & passage.contains(name)
        around = snippet(passage, find(passage, name), F.length(name), 50, dots=True)
        return F.when(known, issue("missing_entity", "warning", F.lit(None), F.lit("people"), F.concat(F.lit("extraction should include '"), name, F.lit("'")), F.lit("not extracted"), F.concat(F.lit("Person '"), name, F.lit("' is in the text but wasn't extracted")), around))

    failed = F.when(error.isNotNull(), issue("incomplete_extraction", "info", F.lit(None), F.lit("completeness_check"), F.lit("completeness check"), F.lit("check failed"), F.concat(F.lit("Could not check completeness: "), error)))
    return F.concat(F.coalesce(F.transform(missing, one), _none()), F.array(failed))


def validate(extractions: DataFrame) -> DataFrame:
    """``extractions`` (passage_text, people; optionally missing_people, check_error): adds ``issues`` in
    rule order: for each person positions, vocabulary, facts; completeness last. Nulls at any level are no issue."""
    passage = F.coalesce("passage_text", F.lit(""))
    missing = F.col("missing_people") if "missing_people" in extractions.columns else F.array().cast("array<string>")
    error = F.col("check_error") if "check_error" in extractions.columns else F.lit(None).cast("string")

    def of_passage(seen: Column) -> Column:
        def of_person(p: Column) -> Column:
            person = F.coalesce(F.nullif(p["name"]["text"], F.lit("")), F.lit("Unknown"))
            return F.concat(position_issues(p, person, seen["text"]), schema_issues(p, person), fact_issues(p, person, seen["text"], seen["squeezed"], seen["laws"]))

        people = F.flatten(F.coalesce(F.transform("people", of_person), F.array().cast(f"array<array<{ISSUE}>>")))
        return F.array_compact(F.concat(people, completeness_issues(missing, error, seen["text"])))

    # The passage's normal form and its laws are made once a row.
    seen = F.struct(passage.alias("text"), squeeze(passage).alias("squeezed"), F.regexp_extract_all(passage, F.lit(_LAW), F.lit(0)).alias("laws"))
    return extractions.withColumn("issues", let(seen, of_passage))


def _count(key: str, value: str) -> Column:
    return F.size(F.filter("issues", lambda i: i[key] == value)).cast("long")


def report_counts(reports: DataFrame) -> DataFrame:
    """Adds the counters of a report: people, issues, by severity and by type (``incomplete_extraction`` has none)."""
    of = {"total_people_extracted": F.size("people").cast("long"), "total_issues_found": F.size("issues").cast("long")}
    of |= {c: _count("severity", s) for c, s in COUNTERS.items()}
    of |= {c: _count("type", t) for c, t in TYPE_COUNTERS.items()}
    return reports.withColumns(of)


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row over all reports (with counters, original_model and a sort key ``source_file``)."""
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total_people_extracted", *COUNTERS, *TYPE_COUNTERS)]
    return reports.agg(
        F.count("*").alias("total_files_processed"),
        F.count_if(F.col("total_issues_found") > 0).alias("total_files_with_issues"),
        F.coalesce(F.sum("total_issues_found"), F.lit(0).cast("long")).alias("total_issues"),
        *sums,
        F.coalesce(F.min_by("original_model", "source_file"), F.lit("unknown")).alias("original_model"),
    )


def priority(reports: DataFrame) -> DataFrame:
    """Reports with critical issues."""
    return reports.where("critical_issues > 0")


def missed_names(found: DataFrame, people: DataFrame, keys: tuple[str, ...] = ("doc_id", "passage_id")) -> DataFrame:
    """Rows of ``found`` (keys, name: names in the text) that are part of no extracted name of their passage, without
    regard to case. ``people``: keys, name. A passage without extracted names misses all of its names."""
    known = people.where("name is not null").groupBy(*keys).agg(F.collect_set(F.lower("name")).alias("__known"))
    joined = found.join(known, list(keys), "left")
    inside = F.exists("__known", lambda k: F.contains(k, F.lower("name")))
    return joined.where(~F.coalesce(inside, F.lit(False))).drop("__known")
