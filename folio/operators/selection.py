"""Selecting rows of article sources: filters, orders, first-wins dedupe, set membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CATEGORY_COLUMNS = ("ingest_category_slug", "category_id", "category_name")


def normalise_category(category: str | None) -> str | None:
    """Stripped and lower-cased; blank is no category."""
    return (category or "").strip().lower() or None


def in_category(category: str | None, columns: Sequence[str] = CATEGORY_COLUMNS) -> Column:
    """Any of the columns equals the category, case-insensitively; no category accepts all."""
    wanted = normalise_category(category)
    if wanted is None:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | (F.lower(c) == wanted)
    return out


def matches_keyword(keyword: str | None, *columns: str) -> Column:
    """Any of the columns contains the keyword, case-insensitively; no keyword accepts all."""
    if keyword is None:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(c).contains(keyword.lower())
    return out


def select_source(df: DataFrame, *, site: str | None = None, category: str | None = None, order: str = "newest", limit: int = 10, published: str = "publish_date", created: str = "created_at", ties: Sequence[str] = ()) -> DataFrame:
    """The newest (nulls last) or oldest (nulls first) ``limit`` articles of a site and category; ``ties`` make the order total."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    kept = df.where(in_category(category))
    if site is not None:
        kept = kept.where(F.col("site_slug") == site)
    if order not in ("newest", "oldest"):
        raise ValueError("order is newest or oldest")
    by = [F.desc_nulls_last(c) if order == "newest" else F.asc_nulls_first(c) for c in (published, created)]
    return kept.orderBy(*by, *ties).limit(limit)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return df.join(done.select(key), key, "left_anti")


def missing_ids(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Asked-for ids that the table lacks."""
    return ids.select(key).join(df.select(key), key, "left_anti")


def first_documents(df: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The first documents by key, before anything is expanded."""
    return df.orderBy(key).limit(limit)


def collect_timeline(entries: DataFrame, *, limit: int = 20, max_pages: int = 10, keyword: str | None = None) -> DataFrame:
    """Timeline entries of the first pages, once for each canonical url (or url), in page order, up to ``limit``."""
    kept = entries.where((F.col("page") <= max_pages) & matches_keyword(keyword, "category_url", "category_name"))
    keyed = kept.withColumn("__key", F.coalesce(F.nullif("canonical_url", F.lit("")), "url"))
    return first_wins(keyed, ["__key"], ["page", "position"]).drop("__key").orderBy("page", "position").limit(limit)


def attach_children(articles: DataFrame, children: DataFrame, name: str, columns: Sequence[str], parent: str = "article_id") -> DataFrame:
    """A list column of each article's child rows, ordered by sequence_number; an article without any gets an empty list."""
    rows = F.sort_array(F.collect_list(F.struct("sequence_number", *columns)))
    lists = children.groupBy(F.col(parent).alias("id")).agg(rows.alias(name))
    joined = articles.join(lists, "id", "left")
    empty = F.array().cast(lists.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(name, empty))


def media_path(kind: str) -> Column:
    """File name of an image or video: ``{article_id}_img_{n}.{ext}`` or ``{article_id}_video_{n}.{ext}``."""
    return F.format_string(f"%s_{'img' if kind == 'image' else 'video'}_%d.%s", "article_id", "sequence_number", "extension")
