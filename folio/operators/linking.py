"""People across documents: name keys, candidate links, co-mentions and a people index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_name


def name_key(name: Column) -> Column:
    return fold_name(name)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def birth_year(published_at: Column, age: Column) -> Column:
    """Year of birth of a person of ``age`` in an article of ``published_at``; null if either is."""
    return F.year(published_at) - age


def candidate_links(people: DataFrame, accept: float = 0.9, review: float = 0.6) -> DataFrame:
    """Pairs of distinct name keys with the same last word, scored: ``same`` from ``accept`` on, ``review`` from ``review`` on.

    ``people`` has name_key; nulls have no links. An edit distance of at most (1 - review) of the longer name bounds
    the difference of lengths, so a key meets only the keys of its last word and of a length that can be near enough:
    the join key is (last word, length), which also splits the names of a frequent last word. Every pair comes once."""
    keys = people.where("name_key is not null").select("name_key").distinct().select("name_key", F.substring_index("name_key", " ", -1).alias("block"), F.length("name_key").alias("n"))
    lengths = F.sequence(F.ceil(review * F.col("n") - 1e-9).cast("int"), F.col("n"))
    longer = keys.select(F.col("name_key").alias("x"), F.col("n").alias("nx"), "block", F.explode(lengths).alias("n"))
    shorter = keys.withColumnRenamed("name_key", "y")
    met = longer.join(shorter, ["block", "n"]).where((F.col("nx") > F.col("n")) | (F.col("x") < F.col("y")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), similarity(F.col("x"), F.col("y")).alias("score"))
    return pairs.where(F.col("score") >= review).withColumn("link", F.when(F.col("score") >= accept, "same").otherwise("review"))


def co_mentions(mentions: DataFrame, cap: int = 5) -> DataFrame:
    """(a, b, n, evidence): people named in the same sentence, ordered pairs once, with up to ``cap`` first sentence ids.

    ``mentions``: doc_id, sentence_id, name_key."""
    sentence = mentions.groupBy("doc_id", "sentence_id").agg(F.sort_array(F.collect_set("name_key")).alias("names")).where(F.size("names") > 1)
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    every = F.flatten(F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: pair(x, y))))
    pairs = sentence.select("doc_id", "sentence_id", F.explode_outer(every).alias("p")).where("p is not null").select("doc_id", "sentence_id", "p.a", "p.b")
    # Both results read the same exchange. A limit by rank is applied before the exchange too, so a frequent pair never gathers its rows.
    rank = F.row_number().over(W.partitionBy("a", "b").orderBy("doc_id", "sentence_id"))
    shown = pairs.withColumn("r", rank).where(F.col("r") <= cap).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.concat_ws(":", "doc_id", "sentence_id"))).alias("evidence"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).join(shown, ["a", "b"])


def people_index(mentions: DataFrame) -> DataFrame:
    """(name_key, display_name, n_mentions, n_documents): the display name is the most frequent spelling, of equal ones the first."""
    # Both results read the exchange of this count.
    each = mentions.groupBy("name_key", "name", "doc_id").agg(F.count("*").alias("n"))
    spelled = each.groupBy("name_key", "name").agg(F.sum("n").alias("n"))
    display = spelled.groupBy("name_key").agg(F.min(F.struct(-F.col("n"), F.col("name").alias("display_name"))).alias("d")).select("name_key", "d.display_name")
    counts = each.groupBy("name_key", "doc_id").agg(F.sum("n").alias("n"), F.count("name").alias("spellings")).groupBy("name_key").agg(F.sum("n").alias("n_mentions"), F.count("*").alias("n_documents"))
    return display.join(counts, "name_key")


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Merge by key: a new value wins where it isn't null, an old one stays otherwise."""
    o, n = old.select(key, *columns).alias("o"), new.select(key, *columns).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))
