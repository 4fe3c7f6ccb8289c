"""Tagging backends: selection, loading once, and their spans."""

import pytest
from pyspark.sql import functions as F

from folio.operators import backends, ner
from folio.plans import baseline

ROWS = "doc_id string, passage_id int, passage_ord int, ord int, sentence_id string, base int, sentence string, tagged string"


def rows(spark, texts):
    return spark.createDataFrame([(str(i), 0, 0, 0, "0.0", 100, t, "clash") for i, t in enumerate(texts)], ROWS)


def test_choice():
    known = dict(backends._BACKENDS)
    try:
        assert backends.choose("simple") is backends.choose("none") is backends.choose("auto") is None
        assert backends.choose("capitals").name == "capitals"
        with pytest.raises(ValueError):
            backends.choose("unheard of")
        with pytest.raises(ValueError):
            backends.register(backends.Backend("simple", backends.Capitals))
        backends.register(backends.Backend("phobert", backends.Capitals))
        backends.register(backends.Backend("vncorenlp", backends.Capitals, missing=lambda: "no Java"))
        assert backends.choose("auto").name == "phobert"
        with pytest.raises(RuntimeError, match="no Java"):
            backends.choose("vncorenlp")
    finally:
        backends._BACKENDS.clear()
        backends._BACKENDS.update(known)


def test_model_runs_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backends, "BATCH", 3)
    log = str(tmp_path / "loads")

    class Counting:
        """Tags by a word list; its tokens join two words by ``_``. Tells how often it was loaded."""

        def __init__(self):
            import os

            self.pid = str(os.getpid())
            with open(log, "a") as f:
                f.write(self.pid + "\n")

        def tag(self, sentences):
            out = []
            for s in sentences:
                s = s.replace("Hà Nội", "Hà_Nội")
                out.append([(t, "B-LOC" if t == "Hà_Nội" else "B-PER" if t == "An" else "I-PER" if t == "Bình" else "B-MISC" if t == "Tết" else "O") for t in s.split()])
            return out

    backends.register(backends.Backend("counting", Counting, score=0.85))
    try:
        texts = ["An Bình ở Hà Nội .", None, "", "  ", "Tết An", "không ai"] * 20
        found = baseline.emit(rows(spark, texts).drop("tagged").repartition(4), [], ner="counting").collect()
    finally:
        backends._BACKENDS.pop("counting")
    first = sorted((r.span_type, r.start, r.end, r.text, r.confidence, r.attributes.backend) for r in found if r.doc_id == "0")
    assert first == [("location", 110, 116, "Hà Nội", 0.85, "counting"), ("person", 100, 107, "An Bình", 0.85, "counting")]
    assert [(r.span_type, r.text) for r in found if r.doc_id == "4"] == [("person", "An")] and len(found) == 60
    loads = open(log).read().split()
    assert 1 <= len(loads) == len(set(loads))  # one model in each worker


def test_wrong_number_of_answers(spark):
    class Short:
        def tag(self, sentences):
            return []

    tagged = backends.with_tags(rows(spark, ["An"]), backends.Backend("short", Short), out="more")
    with pytest.raises(Exception, match="tagged 0 of 1"):
        tagged.collect()
    assert backends.with_tags(rows(spark, [None]), backends.Backend("short", Short), out="more").collect()[0].more == []


def test_capitals_agrees_with_the_token_rule(spark):
    """The model and the Column expression call the same tokens names."""
    texts = ["Ông Nguyễn Văn An, 30, và NASA (Hà Nội) x1 A1 É ǅabc ßx \"Tên\" 'Abc'"]
    tokens = [t for t, g in backends.Capitals().tag(texts)[0] if g != "O"]
    df = spark.createDataFrame([(t,) for t in texts[0].split()], "t string")
    assert tokens == [r.t for r in df.where(ner.is_name_token(F.col("t"))).collect()]
