import random

import pytest
from pyspark.sql import functions as F

from folio.operators import backends, ner, spans
from folio.operators.detectors import detect
from folio.operators.passages import pack_passages, paragraph_passages
from folio.operators.sentences import sentences
from folio.plans import baseline
from folio.queries import QUERIES


def detected(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    rows = df.select(F.explode(detect(F.col("t"), F.lit(0), F.lit("0.0"), F.lit(0))).alias("s")).select("s.*").collect()
    return {(r.attributes.detector, r.start, r.end): r for r in rows}


def test_phone_and_the_currency_trap(spark):
    got = detected(spark, "Liên hệ qua số +84 912-345-678 để xác minh.")
    phone = got["phone", 15, 30]
    assert (phone.attributes.normalized, phone.attributes.e164, phone.confidence) == ("0912345678", "+84912345678", 0.95)
    assert got["currency", 27, 32].attributes.amount_vnd == 678


def test_national_id_keeps_the_unstripped_end(spark):
    got = detected(spark, "CCCD số 079 123 456 789 cấp tại Hà Nội.")
    found = got["national_id", 0, 24]
    assert (found.attributes.normalized, found.attributes.length, found.text) == ("079123456789", 12, "CCCD số 079 123 456 789")
    assert got["phone", 8, 22].attributes.normalized == "07912345678"


def test_dates(spark):
    got = detected(spark, "Bị can sinh ngày 05/11/1984, sinh năm 1984.")
    assert got["dob_full", 7, 27].attributes.normalized == "1984-11-05"
    assert got["dob_year", 29, 42].attributes.normalized == "1984"
    assert got["dob_full", 7, 27].attributes.precision == "date"
    odd = detected(spark, "sinh 31/02/198")
    assert odd["dob_full", 5, 14].attributes.normalized == "2098-02-31"
    split = detected(spark, "sinh ngày 05/11/1984")
    assert ("dob_full", 0, 21) in split
    assert not detected(spark, "32/13/2000")


def test_currency(spark):
    two = detected(spark, "Số tiền chiếm đoạt khoảng 2,5 tỷ đồng.")["currency", 26, 32]
    assert (two.attributes.amount_vnd, two.attributes.unit) == (2_500_000_000, "tỷ")
    assert detected(spark, "1.500.000 đồng")["currency", 0, 14].attributes.amount_vnd == 1_500_000
    assert detected(spark, "5 đối tượng")["currency", 0, 3].attributes.amount_vnd == 5
    assert not detected(spark, "1\xa0500 đồng") or all(k[0] != "currency" or k[1] > 0 for k in detected(spark, "1\xa0500 đồng"))


def test_law(spark):
    got = detected(spark, "Bị cáo bị truy tố theo Điều 174 Bộ luật Hình sự 2015.")["law_article", 23, 52]
    assert (got.attributes.normalized, got.attributes.code, got.attributes.year) == ("174", "Bộ luật Hình sự", 2015)
    upper = detected(spark, "ĐIỀU\xa0174 blhs")
    assert next(r for k, r in upper.items() if k[0] == "law_article").attributes.code == "blhs"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Ông A bị bắt. Ông A khai báo.", [(0, "Ông A bị bắt."), (14, "Ông A khai báo.")]),
        ("  \t\n  Ông A bị bắt.", [(6, "Ông A bị bắt.")]),
        ("...", [(0, "...")]),
        ("Hết… Sau", [(0, "Hết… Sau")]),
        ("1.500.000 đồng", [(0, "1."), (2, "500."), (6, "000 đồng")]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s")).first().s
    assert [(x.start, x.text) for x in got] == expected


def names(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(ner.person_names(F.col("t")).alias("e")).first().e
    return [(e.text, e.start, e.end, e.score) for e in got]


def test_person_names(spark):
    assert names(spark, "Ông Nguyễn Văn A bị bắt.") == [("Ông Nguyễn Văn", 0, 14, 0.57)]
    assert names(spark, "Gặp ông Nguyễn Văn An hôm qua") == [("Gặp", 0, 3, 0.53), ("ông Nguyễn Văn An", 4, 21, 0.69)]
    assert names(spark, "thiếu tá Trần Bình") == [("Trần Bình", 9, 18, 0.55)]
    assert names(spark, "gặp Lê Nam, Hồ Bắc") == [("Lê Nam, Hồ Bắc", 4, 18, 0.59)]
    assert names(spark, "") == []


def test_bio_decoder(spark):
    rows = [("Ông Nguyễn Văn A ở Hà Nội", [("Ông", "O"), ("Nguyễn_Văn", "B-PER"), ("A", "I-PER"), ("ở", "O"), ("Hà_Nội", "B-LOC"), ("Mars", "B-LOC")])]
    df = spark.createDataFrame(rows, "s string, t array<struct<token:string,tag:string>>")
    got = df.select(ner.decode_bio(F.col("s"), F.col("t")).alias("e")).first().e
    assert [(e.label, e.text, e.start) for e in got] == [("person", "Nguyễn Văn A", 4), ("location", "Hà Nội", 19)]


def packed(spark, counts, low, high):
    paragraphs = [" ".join(["w"] * n) for n in counts]
    df = spark.createDataFrame([(paragraphs,)], "p array<string>")
    got = df.select(pack_passages(F.col("p"), low, high).alias("x")).first().x
    text = "\n\n".join(paragraphs)
    assert all(text[x.start : x.end] == x.text for x in got)
    return [(x.paragraph_indices[0], x.paragraph_indices[-1], x.word_count) for x in got]


def test_packing(spark):
    assert packed(spark, [60, 50, 30, 10, 90], 1, 100) == [(0, 0, 60), (1, 3, 90), (4, 4, 90)]
    assert packed(spark, [10, 95, 20], 30, 100) == [(0, 2, 125)]
    assert packed(spark, [], 1, 10) == []


def test_packing_equals_a_plain_version(spark):
    import random

    rng = random.Random(5)
    for _ in range(8):
        counts, low, high = [rng.randint(1, 60) for _ in range(rng.randint(1, 25))], rng.choice([1, 20, 40]), rng.choice([50, 80])
        segments, start, n = [], 0, 0
        for i, c in enumerate(counts):
            if i > start and n + c > high:
                segments.append([start, i - 1, n])
                start, n = i, 0
            n += c
        segments.append([start, len(counts) - 1, n])
        merged = []
        for s in segments:
            if merged and merged[-1][2] < low:
                merged[-1] = [merged[-1][0], s[1], merged[-1][2] + s[2]]
            else:
                merged.append(s)
        if len(merged) > 1 and merged[-1][2] < low:
            tail = merged.pop()
            merged[-1] = [merged[-1][0], tail[1], merged[-1][2] + tail[2]]
        assert packed(spark, counts, low, high) == [tuple(x) for x in merged]


def test_paragraph_fallback_keeps_places(spark):
    paragraphs = ["  a b ", "", "c"]
    got = spark.createDataFrame([(paragraphs,)], "p array<string>").select(paragraph_passages(F.col("p")).alias("x")).first().x
    text = "\n\n".join(paragraphs)
    assert [(x.passage_id, text[x.start : x.end]) for x in got] == [(0, "a b"), (2, "c")]


ARTICLE = "doc_id string, paragraphs array<string>, passages array<struct<passage_id:int,text:string,start:int,end:int,word_count:int,paragraph_indices:array<int>>>"


def test_baseline_plan(spark):
    text = "Ông Nguyễn Văn A sinh năm 1984. Điện thoại 0912 345 678."
    df = spark.createDataFrame([("doc123", [text], [(0, text, 0, len(text), 11, [0])]), (None, None, None)], ARTICLE)
    got = baseline.run(df)
    found = {(r.span_type, r.start, r.end) for r in got.spans.collect()}
    assert found == {("date_of_birth", 17, 30), ("phone_number", 43, 55), ("person", 0, 14), ("person", 32, 36)}
    stats = got.stats.first()
    assert (stats.doc_id, stats.regex_spans, stats.ner_spans, stats.total_spans, stats.sentences, stats.passages) == ("doc123", 2, 2, 4, 2, 1)
    assert stats.detector_hits == {"dob_year": 1, "phone": 1}
    assert baseline.run(df, ner="none").spans.where("source = 'ner'").isEmpty()
    with pytest.raises(ValueError):
        ner.backend_entities(F.lit(""), "vncorenlp")


def test_dedupe_keeps_the_best_then_the_first(spark):
    rows = [("d", "person", 0, 3, "ner", "Abc", c, n, s) for c, n, s in ((0.6, 0, "0.0"), (0.8, 1, "0.1"), (0.8, 2, "0.2"), (None, 3, "0.3"))]
    df = spark.createDataFrame(rows, "doc_id string, span_type string, start int, end int, source string, text string, confidence double, emit_seq int, sentence_id string")
    got = spans.dedupe(df).collect()
    assert [(r.confidence, r.sentence_id, r.first_emit) for r in got] == [(0.8, "0.1", 0)]


def test_span_rules(spark):
    rows = [("person", "a", 0, 1, "ner", 0, 0.5), ("person", "a", -1, 1, "ner", 0, 0.5), ("person", "", 5, 1, "x", -1, 2.0), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "span_type string, text string, start int, end int, source string, passage_id int, confidence double")
    got = [set(r.violations) for r in spans.violations(df).collect()]
    assert got[0] == set() and got[1] == {"start"} and got[2] == {"text", "source", "passage_id", "confidence"}
    assert {"text", "start", "end"} <= got[3]
    assert spans.strict(df.limit(1)).count() == 1
    with pytest.raises(Exception, match="invalid span"):
        spans.strict(df).collect()


def test_amounts_beyond_64_bits(spark):
    """A digest's digits before a d; the job goes on, the amount is in the text alone."""
    texts = ["id 99999999999999999999d end", "12345678901 tỷ", "9223372036854775807 d", "9" * 400 + "d", "7 đồng"]
    got = [[(s.attributes.normalized, s.attributes.amount_vnd) for k, s in sorted(detected(spark, t).items()) if k[0] == "currency"] for t in texts]
    assert got == [[("100000000000000000000", None)], [("12345678901000000000", None)], [("9223372036854775807", 9223372036854775807)], [], [("7", 7)]]


def test_digits_of_other_scripts(spark):
    """Dates, years of birth and of laws in digits that the patterns match but no cast reads."""
    texts = {"dob_full": ["ngày ٣/2/١٩٩٩ x", "\U0001d7d9/2/34", "٣٣/2/34"], "dob_year": ["sinh năm 19٤٥ x"], "law_article": ["Điều 3 BLHS ١٩٩٩"]}
    got = {d: [(s.attributes.normalized, s.attributes.year) for t in some for k, s in detected(spark, t).items() if k[0] == d] for d, some in texts.items()}
    assert got == {"dob_full": [("1999-02-03", 1999), ("1934-02-01", 1934)], "dob_year": [("1945", 1945)], "law_article": [("3", 1999)]}


@pytest.mark.parametrize("name", ["detector_hits", "spans_currency", "span_dedupe", "baseline_stats", "verify_spans"])
def test_queries_over_a_digest(spark, tmp_path, name):
    text = "key 99999999999999999999d and 5 đồng, 1.5.99\n" + "1.234 567" * 2000 + " đ\n" + "1 " * 5000
    spark.createDataFrame([(1, text, "en"), (2, "x 7 d", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {"1", "2"}


def test_names_in_batches_equal_the_expressions(spark):
    """The same entities, sentences and lines as the Column expressions find, also with odd white space, capitals and digits; so do decoded tags."""
    rng = random.Random(5)
    bits = ["Ông", "Nguyễn", "Văn", "ông", "bà.", "(Anh)", "USA", "Ab3", "x", "ǅa", "“Lê", "Straße", "İpek", "ΣΑΣ", "Σα", "\x1c", "\xa0", "  ", "\n", ". ", "! ", "…", " ", "A", "Bo", "\U00010400\U00010428", "\x85", "\x1fAbc", " ", "B_c", '"Ana"']
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(25))) for _ in range(1500)] + [None, "", "...", " \n ! "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("ord", "s")).select("doc_id", "ord", F.col("s.start").alias("base"), F.col("s.text").alias("sentence"))
    lines = docs.select("doc_id", F.posexplode(paragraph_passages(F.split("text", "\n"))).alias("ord", "p")).select("doc_id", "ord", (F.col("p.start") - F.get("p.paragraph_indices", F.lit(0))).alias("base"), F.col("p.text").alias("sentence"))
    for units, by_line in ((rows, False), (lines, True)):
        found = units.select("doc_id", "ord", "base", F.explode(ner.person_names(F.col("sentence"))).alias("e"))
        expected = found.select("doc_id", "ord", F.col("base") + F.col("e.start"), F.col("base") + F.col("e.end"), "e.text", "e.score").collect()
        assert sorted(map(tuple, expected)) == sorted(map(tuple, ner.document_names(docs, by_line).collect())) and len(expected) > 1000
    model = backends.choose("capitals")
    plain = backends.with_tags(rows, model).select("doc_id", "ord", ner.decode_bio(F.col("sentence"), F.col("tagged"), model.score).alias("e"))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, backends.with_entities(rows, model).select("doc_id", "ord", F.col("entities").alias("e")).collect()))


@pytest.mark.parametrize("name", ["detector_summary", "baseline_spans", "explain_drops", "verify_by_type", "verify_reasons", "verify_stats"])
def test_more_queries_over_a_digest(spark, tmp_path, name):
    spark.createDataFrame([(1, "key 99999999999999999999d and 5 đồng, 1.5.99 gặp Ông An", "en"), (2, "x 7 d", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect()
