"""Readers and writers of articles, and adapters between their forms."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, first_filled, strip
from ..schemas import ARTICLE, PASSAGE, RAW_ARTICLE, TIMELINE


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a few large row groups would leave most of them
    idle in the text expressions. A table with enough partitions is left as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON files, one article each; a missing doc_id is the file's name."""
    df = spark.read.schema(ARTICLE).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return df.withColumn("doc_id", first_filled(F.col("doc_id"), name))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of raw articles; blank lines are skipped. ``doc_id`` is id or doc_id."""
    return spark.read.schema(RAW_ARTICLE).json(path).withColumn("doc_id", first_filled(F.col("id"), F.col("doc_id")))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMELINE).option("multiLine", True).json(path)


def database_url(given: str | None = None) -> str:
    """The url given, else DATABASE_URL, else CRAWLER_DATABASE_URL."""
    found = given or os.environ.get("DATABASE_URL") or os.environ.get("CRAWLER_DATABASE_URL")
    if not found:
        raise ValueError("no database url: pass one or set DATABASE_URL")
    return found


def read_database(spark: SparkSession, table: str = "articles", url: str | None = None, partition: tuple[str, str, str, int] | None = None) -> DataFrame:
    """A table by JDBC; ``partition`` (column, lower, upper, number) makes parallel reads. Filters, sort and limit are pushed down."""
    reader = spark.read.format("jdbc").option("url", database_url(url)).option("dbtable", table)
    if partition:
        column, lower, upper, number = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=number)
    return reader.load()


def from_orm(df: DataFrame) -> DataFrame:
    """Relational rows to raw articles: ISO times, tags as a list (none: empty)."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("publish_date", "created_at", "updated_at")}
    tags = F.when(F.coalesce("tags", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("tags", ","))
    return df.withColumns({**iso, "tags": tags})


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def adapt_raw(df: DataFrame) -> DataFrame:
    """Raw articles to articles with one passage of the whole content; content stays as paragraphs too, so spans can be verified."""
    content = F.coalesce("content", F.lit(""))
    text = strip(content)
    paragraphs = F.filter(F.transform(F.split(content, "\n\n"), strip), lambda p: p != "")
    n = F.size(paragraphs)
    indices = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array(F.lit(0)))
    passage = F.struct(F.lit(0).alias("passage_id"), text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("end"), word_count(text).alias("word_count"), indices.alias("paragraph_indices"))
    return df.select(
        first_filled(F.col("id"), F.col("doc_id")).alias("doc_id"),
        "title",
        first_filled(F.col("publish_date"), F.col("published_at")).alias("published_at"),
        F.array(passage).cast(f"array<{PASSAGE}>").alias("passages"),
        text.alias("full_text"),
        F.lit("jsonl").alias("source"),
    )


def document_id(url: Column) -> Column:
    """The number before ``.htm``, else the last part of the path without ``.htm``."""
    number = blank_to_null(F.regexp_extract(url, r"-(\d+)\.htm", 1))
    last = F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
    return F.coalesce(number, F.replace(last, F.lit(".htm"), F.lit("")))


def absolute_url(href: Column, base: str) -> Column:
    """``href`` resolved against the page ``base`` as RFC 3986 says, dot segments included; null stays null."""
    at = urlsplit(base)
    root, folder = f"{at.scheme}://{at.netloc}", (at.path or "/").rpartition("/")[0] + "/"
    path, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"(?s)[?#].*$", 0)
    query = F.when(href.startswith("?"), "").otherwise(f"?{at.query}" if at.query else "")
    segments = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder), path)), "/")

    def step(out: Column, segment: Column) -> Column:
        parent = F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        return F.when(segment == ".", out).when(segment == "..", parent).otherwise(F.concat(out, F.array(segment)))

    resolved = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    end = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(at.scheme + ":"), href))
        .when(path == "", F.concat(F.lit(root + at.path), query, rest))
        .otherwise(F.concat(F.lit(root), resolved, end, rest))
    )


def page_urls(spark: SparkSession, template: str, pages: int) -> DataFrame:
    """(page, url) of the first timeline pages; ``{page}`` in the template is the number."""
    return spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), F.replace(F.lit(template), F.lit("{page}"), F.col("id").cast("string")).alias("url"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The canonical form: Parquet."""
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)

