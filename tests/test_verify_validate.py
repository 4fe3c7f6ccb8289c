import json

from pyspark.sql import functions as F

from folio.operators import extraction, linking, review, validation, verdicts, verify
from folio.operators.detectors import DETECTORS, detect
from folio.schemas import PERSON, SPAN

PARAGRAPHS = ["Ông Nguyễn Văn A sinh ngày 05/11/1984.", "Ông A bị truy tố theo Điều 174."]


def spans_of(spark, *rows):
    attrs = dict.fromkeys(("detector", "normalized", "raw", "e164", "length", "precision", "year", "month", "day", "amount_vnd", "unit", "code", "backend"))
    made = [("d", {**{"span_type": t, "text": x, "start": s, "end": e, "sentence_id": "0.0", "source": "regex", "passage_id": 0, "confidence": c}, "attributes": {**attrs, "normalized": n}}) for t, x, s, e, c, n in rows]
    return spark.createDataFrame(made, f"doc_id string, s {SPAN}").select("doc_id", "s.*")


def test_verify(spark):
    found = spans_of(
        spark,
        ("date_of_birth", "05/11/1984", 27, 37, 0.85, "1984-11-05"),
        ("person", "Sai lệch", 0, 3, 0.5, None),
        ("person", "x", 5, 9999, 0.5, None),
        ("person", "x", 5, 5, 0.5, None),
        ("person", "Nguyễn  Văn\tA", 4, 16, None, None),
    )
    articles = spark.createDataFrame([("d", PARAGRAPHS)], "doc_id string, paragraphs array<string>")
    got = verify.verify(found, articles)
    rows = got.orderBy("start", "end").collect()
    by = {(r.start, r.end): r for r in rows}
    assert by[27, 37].verified and by[27, 37].birth_year == 1984 and by[27, 37].derivations[0].derivation == "dob->birth_year"
    assert by[0, 3].reason == "text_mismatch" and by[5, 9999].reason == "out_of_bounds" and by[5, 5].reason == "empty_slice"
    assert by[4, 16].verified and by[4, 16].confidence == 0.5
    assert verify.document_stats(got).first().asDict() == {"doc_id": "d", "input_spans": 5, "verified_spans": 2, "dropped_spans": 3}
    assert {(r.reason, r.n) for r in verify.failure_reasons(got).collect()} == {("text_mismatch", 1), ("out_of_bounds", 1), ("empty_slice", 1)}
    assert verify.dropped(got).count() == 3 and verify.kept(got).count() == 2
    lost = verify.verify(found, articles.where("false"))
    assert {r.reason for r in lost.collect()} == {"missing_article"}


def test_own_spans_are_verbatim(spark):
    text = "\n\n".join(PARAGRAPHS) + " CCCD số 079 123 456 789 cấp. Nợ 2,5 tỷ đồng."
    df = spark.createDataFrame([("d", text)], "doc_id string, full_text string")
    found = df.select("doc_id", F.explode(detect(F.col("full_text"), F.lit(0), F.lit("0.0"), F.lit(0), DETECTORS)).alias("s")).select("doc_id", "s.*")
    assert found.count() >= 4
    assert verify.totals(verify.verify(found, df)).first().dropped_spans == 0


def test_running_mean(spark):
    got = spark.range(1).select(verify.running_mean(F.array(F.lit(0.8), F.lit(0.95), F.lit(None).cast("double"))).alias("m")).first().m
    assert got == 0.5833


def status(spark, raw, error=None):
    df = spark.createDataFrame([(raw, error)], "raw string, e string")
    s = df.select(extraction.parse_status(F.col("raw"), F.col("e")).alias("s")).first().s
    return s.status, s.error


def test_answers(spark):
    assert status(spark, '```json\n{"people": []}\n```') == ("ok", None)
    assert status(spark, "not json") == ("parse_error", "JSON decode error")
    assert status(spark, "{}") == ("parse_error", None)
    assert status(spark, '{"error": "no_answer"}') == ("ok", None)
    assert status(spark, None, "timeout") == ("request_error", "timeout")


def test_generate_and_people(spark):
    class Echo:
        def generate(self, *, system_prompt, user_prompt):
            if "bad" in user_prompt:
                raise extraction.ClientError("down", 503)
            return json.dumps({"people": [{"name": {"text": user_prompt[:3], "start": 0, "end": 3}}]})

    df = spark.createDataFrame([("a", 0, "Abc def"), ("b", 0, "bad")], "doc_id string, passage_id int, user_prompt string")
    found = extraction.extractions(extraction.generate(df, Echo))
    got = {r.doc_id: r for r in found.withColumn("people", extraction.people(F.col("parsed"), F.col("raw"))).collect()}
    assert got["a"].status == "ok" and got["a"].people[0].name.text == "Abc"
    assert got["b"].status == "request_error" and got["b"].error == "down" and got["b"].people == []
    counts = extraction.run_counts(found).first()
    assert (counts.docs, counts.passages, counts.ok, counts.issues) == (2, 2, 1, 1)
    assert extraction.missing_outputs(df, found.where("status = 'ok'")).first().doc_id == "b"


def test_truncate_and_prompt(spark):
    df = spark.createDataFrame([("x" * 4001,), (None,)], "text string")
    rows = extraction.truncate(df).collect()
    assert (len(rows[0].text), rows[0].truncated, rows[0].original_length) == (4000, True, 4001)
    assert (rows[1].text, rows[1].truncated) == ("", False)
    prompt = df.limit(1).select(extraction.user_prompt(F.lit("PASSAGE"), title=F.lit(None).cast("string")).alias("p")).first().p
    assert "title: None" in prompt and "<<<\nPASSAGE\n>>>" in prompt


def issues_of(spark, person, passage="Ông Nguyễn Văn A bị bắt.", missing=None, error=None):
    df = spark.createDataFrame([(passage, [json.dumps(person)], missing, error)], "passage_text string, p array<string>, missing_people array<string>, check_error string")
    df = df.withColumn("people", F.transform("p", lambda x: F.from_json(x, PERSON)))
    return [(i.type, i.severity, i.field) for i in validation.validate(df).first().issues], validation.validate(df).first().issues


def test_position_rules(spark):
    kinds, full = issues_of(spark, {"name": {"text": "Nguyễn", "start": 0, "end": 6}})
    assert kinds == [("wrong_position", "error", "name")] and "at position 4" in full[0].expected and full[0].text_snippet == "Ông Nguyễn Văn A bị bắt."
    assert issues_of(spark, {"name": {"text": "Trần", "start": 0, "end": 4}})[0] == [("hallucination", "critical", "name")]
    assert issues_of(spark, {"phones": [{"text": "09", "start": 3, "end": 99}]})[0] == [("wrong_position", "error", "phones[0].start/end")]
    assert issues_of(spark, {"name": {"text": "Nguyễn", "start": -1, "end": 3}})[0] == []
    assert issues_of(spark, {"age": {"value": 35, "start": 5, "end": 5}, "name": None, "aliases": None})[0] == []
    assert issues_of(spark, {"age": {"value": 35, "start": 5, "end": 99}})[0] == [("wrong_position", "error", "age.start/end")]
    assert issues_of(spark, {"name": {"text": "Nguyễn", "start": 4, "end": 10}})[0] == []


def test_vocabulary_and_fact_rules(spark):
    kinds, _ = issues_of(spark, {"roles": [{"label": "driver"}, {"label": None}], "actions": [{"predicate": "fled"}]})
    assert kinds == [("schema_violation", "warning", "roles[0].label"), ("schema_violation", "warning", "actions[0].predicate")]
    kinds, full = issues_of(spark, {"actions": [{"law_article": "Điều 999"}]}, "theo Điều 174 Bộ luật Hình sự.")
    assert kinds == [("wrong_law_article", "critical", "actions[0].law_article")] and "found:" in full[0].expected
    assert issues_of(spark, {"actions": [{"law_article": "Điều  174"}]}, "theo Điều\n174 Bộ luật Hình sự.")[0] == []
    assert issues_of(spark, {"actions": [{"amount_vnd": 1_000_000_000_001}]})[0] == [("hallucination", "warning", "actions[0].amount_vnd")]
    assert issues_of(spark, {"actions": [{"amount_vnd": 1_000_000_000_000}]})[0] == []


def test_completeness_rules(spark):
    kinds, full = issues_of(spark, {}, missing=["Văn A", "Nobody", " ", None])
    assert kinds == [("missing_entity", "warning", "people")] and full[0].text_snippet == "Ông Nguyễn Văn A bị bắt."
    assert issues_of(spark, {}, error="down")[0] == [("incomplete_extraction", "info", "completeness_check")]


def test_validate_nulls(spark):
    df = spark.createDataFrame([(None, None)], f"passage_text string, people array<{PERSON}>")
    assert validation.validate(df).first().issues == []
    assert validation.batch_summary(validation.report_counts(validation.validate(df)).selectExpr("*", "'m' original_model", "'f' source_file")).first().total_issues == 0


def report(spark, raw):
    return verdicts.reports(spark.createDataFrame([(raw,)], "raw string")).first()


def test_verdicts(spark):
    got = report(spark, json.dumps({"verdict": "supported", "issues": [{"type": "missing_info", "description": "x"}], "missing_people": []}))
    assert (got.verdict, got.issue_count, got.usable) == ("supported", 1, False)
    bad = report(spark, "not json")
    assert (bad.verdict, bad.issues[0].type, bad.issues[0].severity, bad.usable) == ("unsure", "parsing_error", "critical", False)
    warn = {"verdict": "SUPPORTED", "issues": [{"type": "odd", "severity": "WARNING"}], "missing_people": [{"name": ""}], "confidence": 0.7}
    assert [report(spark, json.dumps({**warn, **u})).usable for u in ({}, {"usable": True}, {"usable": False})] == [True, True, False]
    assert report(spark, json.dumps(warn)).issues[0].type == "other" and report(spark, json.dumps(warn)).confidence == 0.7
    assert report(spark, verdicts.DRY_RUN).verdict == "unsure"
    assert report(spark, None).verdict == "unsure"


def test_summaries(spark):
    raws = [json.dumps({"verdict": v, "issues": [], "missing_people": []}) for v in ("supported", "unsure", "unsupported")]
    s = verdicts.batch_summary(verdicts.reports(spark.createDataFrame([(r,) for r in raws], "raw string"))).first()
    assert (s.usable_percentage, s.supported_percentage, s.unsure_percentage, s.unsupported_percentage) == (33.33, 33.33, 33.33, 33.33)
    empty = verdicts.batch_summary(verdicts.reports(spark.createDataFrame([], "raw string"))).first()
    assert (empty.total_files_processed, empty.usable_percentage) == (0, 0.0)
    m = review.manual_summary(spark.createDataFrame([("valid",), ("invalid",), (None,), ("foo",)], "manual_status string")).first()
    assert (m.valid, m.invalid, m.unset, m.unset_percentage) == (1, 1, 2, 50.0)


def test_marks_and_texts(spark):
    marks = spark.createDataFrame([("a", 0, "valid", 1), ("a", 0, "skip", 2), ("b", 0, "valid", 1), ("b", 0, "unset", 2)], "doc_id string, passage_id int, status string, ts int")
    assert {r.doc_id: r.manual_status for r in review.latest_marks(marks).collect()} == {"a": "valid", "b": None}
    raw = json.dumps({"verdict": "unsure", "issues": [{"type": "conflict", "person_name": "A", "field": "age", "description": "d", "evidence": "e"}], "missing_people": [{"name": "B", "snippet": "s"}]})
    r = verdicts.reports(spark.createDataFrame([("x", 0, raw)], "doc_id string, passage_id int, raw string"))
    view = review.report_view(r, spark.createDataFrame([], f"doc_id string, passage_id int, passage_text string, people array<{PERSON}>")).first()
    assert view.right_text == "Verdict: unsure\nIssues: 1 | Missing people: 1\n\nIssues\n[1] conflict | Person: A | Field: age\n  d\n  Evidence: e\n\nMissing People\n- B — s"
    assert "unavailable" in view.left_text


def test_linking(spark):
    rows = [("1", "0.0", "Nguyễn An", "nguyen an"), ("1", "0.0", "Tran Binh", "tran binh"), ("2", "0.1", "nguyen an", "nguyen an"), ("2", "0.1", "Nguyễn An", "nguyen an")]
    df = spark.createDataFrame(rows, "doc_id string, sentence_id string, name string, name_key string")
    pair = linking.co_mentions(df).collect()
    assert [(p.a, p.b, p.n, p.evidence) for p in pair] == [("nguyen an", "tran binh", 1, ["1:0.0"])]
    people = {r.name_key: (r.display_name, r.n_mentions, r.n_documents) for r in linking.people_index(df).collect()}
    assert people["nguyen an"] == ("Nguyễn An", 3, 2)
    links = linking.candidate_links(spark.createDataFrame([("nguyen van an",), ("nguyen vann an",), ("le binh",)], "name_key string")).collect()
    assert [(r.a, r.b, r.link) for r in links] == [("nguyen van an", "nguyen vann an", "same")]
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string"), spark.createDataFrame([(1, None, "z"), (3, "c", None)], "k int, p string, q string")
    assert {(r.k, r.p, r.q) for r in linking.upsert(old, new, "k", ["p", "q"]).collect()} == {(1, "a", "z"), (2, "b", "y"), (3, "c", None)}


def test_links_equal_all_pairs(spark):
    """The join on last word and length finds the pairs of a plain double loop."""
    first = ["an", "ann", "anna", "hanna", "bao", "b", "van an", "van anh", "thi ngoc anh", "", "johannes"]
    names = [f"{f} {last}".strip() for f in first for last in ("nguyen", "li")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    score = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a in names for b in names if a < b and a.split()[-1] == b.split()[-1]}
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name_key string")
    got = {(r.a, r.b): (round(r.score, 9), r.link) for r in linking.candidate_links(df).collect()}
    assert got == {p: (round(s, 9), "same" if s >= 0.9 else "review") for p, s in score.items() if s >= 0.6} and len(got) > 10
