"""Articles to deduplicated spans: the deterministic detection plan.

Passages and sentences are expanded from their document's row without a shuffle; the only
exchange before the statistics is the one on the span key for the dedupe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.backends import choose, with_entities
from ..operators.detectors import DETECTORS, Detector, detect
from ..operators.ner import backend_entities, entity_spans
from ..operators.passages import with_passages
from ..operators.sentences import sentences
from ..operators.spans import dedupe, document_stats


@dataclass(frozen=True)
class Baseline:
    sentences: DataFrame
    emitted: DataFrame
    spans: DataFrame
    stats: DataFrame


def sentence_rows(articles: DataFrame) -> DataFrame:
    """(doc_id, passage_id, passage_ord, ord, sentence_id, base, sentence) of ``articles`` (doc_id, paragraphs, passages)."""
    filled = F.filter("passages", lambda p: F.length(strip(F.coalesce(p["text"], F.lit("")))) > 0)
    passages = with_passages(articles).select(F.coalesce(F.nullif("doc_id", F.lit("")), F.lit("unknown")).alias("doc_id"), F.posexplode_outer(filled).alias("passage_ord", "p")).where("p is not null")
    rows = passages.select("doc_id", "passage_ord", F.coalesce("p.passage_id", "passage_ord").alias("passage_id"), F.coalesce("p.start", F.lit(0)).alias("start"), F.posexplode_outer(sentences(F.col("p.text"))).alias("ord", "s"))
    return rows.where("s is not null").select(
        "doc_id",
        "passage_id",
        "passage_ord",
        "ord",
        F.concat_ws(".", F.col("passage_id").cast("string"), F.col("ord").cast("string")).alias("sentence_id"),
        (F.col("start") + F.col("s.start")).alias("base"),
        F.col("s.text").alias("sentence"),
    )


def emit(rows: DataFrame, detectors: Sequence[Detector] = DETECTORS, ner: str = "simple", all_sentences: bool = False) -> DataFrame:
    """All spans of sentence rows, detectors before names in each sentence; ``emit_seq`` orders those of a document.
    ``ner`` is ``simple``, ``none``, ``auto`` or a registered backend. With ``all_sentences``, a sentence without spans is a row of nulls, and the parts of ``emit_seq`` are columns too."""
    at = (F.col("base"), F.col("sentence_id"), F.col("passage_id"))
    model = choose(ner)
    if model is None:
        entities = backend_entities(F.col("sentence"), ner)
    else:
        rows, ner = with_entities(rows, model), model.name
        entities = F.col("entities")
    found = F.concat(detect(F.col("sentence"), *at, detectors), entity_spans(entities, *at, ner))
    spans = rows.select("doc_id", "passage_ord", "ord", F.posexplode_outer(found).alias("k", "s"))
    if all_sentences:
        return spans.select("doc_id", "passage_ord", "ord", "k", "s.*")
    spans = spans.where("s is not null")
    return spans.select("doc_id", "s.*", F.struct("passage_ord", "ord", "k").alias("emit_seq"))


def run(articles: DataFrame, detectors: Sequence[Detector] = DETECTORS, ner: str = "simple", doc_ids: Sequence[str] | None = None, limit: int | None = None) -> Baseline:
    """Detect spans. ``doc_ids`` keeps those documents; ``limit`` the first ones by doc_id (documents, not rows)."""
    if doc_ids is not None:
        articles = articles.where(F.col("doc_id").isin(list(doc_ids)))
    if limit is not None:
        articles = articles.orderBy("doc_id").limit(limit)
    rows = sentence_rows(articles)
    emitted = emit(rows, detectors, ner)
    kept = dedupe(emitted)
    return Baseline(rows, emitted, kept, document_stats(emit(rows, detectors, ner, all_sentences=True)))
