"""Sentence splitting that keeps places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_all, lstrip, strip

#: A run without end marks or line breaks, then its end marks. Breaks at every full stop, also inside numbers.
SENTENCE = r"[^.!?\n]+[.!?…]*"


def sentences(text: Column) -> Column:
    """array<struct<start, text>> of stripped, non-empty sentences; a text without any is one sentence."""

    def tidy(x: Column) -> Column:
        lead = F.length(x["text"]) - F.length(lstrip(x["text"]))
        return F.struct((x["start"] + lead).alias("start"), strip(x["text"]).alias("text"))

    found = F.filter(F.transform(find_all(text, SENTENCE), tidy), lambda x: x["text"] != "")
    whole = F.array(F.struct((F.length(text) - F.length(lstrip(text))).alias("start"), strip(text).alias("text")))
    return F.when(F.size(found) > 0, found).when(F.length(strip(text)) > 0, whole).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def explode_sentences(passages: DataFrame) -> DataFrame:
    """(doc_id, passage_id, sentence_id, ord, base, sentence): ``base`` is the sentence's place in the article."""
    rows = passages.select("doc_id", "passage_id", "start", F.posexplode_outer(sentences(F.col("text"))).alias("ord", "s")).where("s is not null")
    return rows.select(
        "doc_id",
        "passage_id",
        F.concat_ws(".", F.col("passage_id").cast("string"), F.col("ord").cast("string")).alias("sentence_id"),
        "ord",
        (F.col("start") + F.col("s.start")).alias("base"),
        F.col("s.text").alias("sentence"),
    )
