"""Pages to articles: parse, pack, leave out what exists, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.passages import pack_passages
from ..operators.selection import not_done
from ..sources.articles import document_id
from ..sources.html import Selectors, parse_articles


def load_articles(pages: DataFrame, done: DataFrame | None = None, where: Selectors = Selectors(), key: str = "page_id") -> DataFrame:
    """Articles of ``pages`` (key, url, html) whose doc_id isn't in ``done``: the columns of ``parse_articles`` with doc_id
    (from the url; without one, the key), passages, full_text and the raw html.

    A page that can't be fetched or parsed is a row with ``error``; write the table once, then split it by that column
    and count it with ``outcome``. The html meets its parsed form in the same row of a Parquet table, so no file per page is written."""
    named = pages.select(F.coalesce(F.nullif(document_id(F.col("url")), F.lit("")), F.col(key).cast("string")).alias("doc_id"), "url", "html")
    if done is not None:
        named = not_done(named, done, "doc_id")
    parsed = parse_articles(named, where, "doc_id", keep_html=True)
    return parsed.withColumns({"passages": pack_passages(F.col("paragraphs")), "full_text": F.array_join("paragraphs", "\n\n")})


def outcome(loaded: DataFrame) -> DataFrame:
    """(loaded, failed): how many pages became articles and how many didn't."""
    return loaded.agg(F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
