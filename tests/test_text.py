import re

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a1b22", "1", "🎉 12 x 3🎉4", "no digits", "  7\n8  "])
def test_find_all_has_python_places(spark, text):
    got = [(m.start, m.text) for m in one(spark, T.find_all(F.col("t"), r"\d+"), t=text)]
    assert got == [(m.start(), m.group()) for m in re.finditer(r"\d+", text)]


def test_find_all_of_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.find_all(F.col("t"), "x").alias("x")).first().x == []


def test_explode_matches_equals_find_all(spark):
    texts = [(1, "ab  cd 🎉 e"), (2, ""), (3, "x")]
    rows = T.explode_matches(spark.createDataFrame(texts, "k int, t string"), "t", r"(?U)\S+", ["k"]).orderBy("k", "i").collect()
    assert [(r.k, r.start, r.token) for r in rows] == [(k, m.start(), m.group()) for k, t in texts for m in re.finditer(r"\S+", t)]


def test_strip_squeeze_clean(spark):
    assert one(spark, T.strip(F.col("t")), t="\xa0 a b \t\n") == "a b"
    assert one(spark, T.squeeze(F.col("t")), t=" a\xa0\n b ") == "a b"
    assert one(spark, T.clean(F.col("t")), t="a\xa0b​c  d") == "a bc d"


def test_snippet(spark):
    text = "x" * 60 + "NAME" + "y" * 60
    got = one(spark, T.snippet(F.col("t"), F.lit(60), F.lit(4), 50, dots=True), t=text)
    assert got == "..." + "x" * 50 + "NAME" + "y" * 50 + "..."
    assert one(spark, T.snippet(F.col("t"), F.lit(0), F.lit(1), 20), t="ab") == "ab"


@pytest.mark.parametrize(
    "raw,found",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"people": []}\n```', '{"people": []}'),
        ('Sure: {"a": {"b": 2}} ok', '{"a": {"b": 2}}'),
        ("not json", None),
        ("{} x", "{}"),
        ("{broken", None),
        ("", None),
    ],
)
def test_lenient_json(spark, raw, found):
    assert one(spark, T.lenient_json(F.col("t")), t=raw) == found


def test_unfence_lines(spark):
    assert one(spark, T.unfence_lines(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.unfence_lines(F.col("t")), t=" plain ") == "plain"


def test_fold_name(spark):
    assert one(spark, T.fold_name(F.col("t")), t=" Nguyễn  Văn Đức ") == "nguyen van duc"
