"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, read


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def surrogate_key() -> str:
    """The key of the surrogates: of real data it is a secret, set in the environment."""
    return os.environ.get("FOLIO_SURROGATE_KEY", "an example, not a secret")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents"), surrogate_key())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages")).drop("score")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), " ")
    return rotate(read(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(read(spark, sf_dir, "pages")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the CRC of the id, get a periodic end: from a word a on, the words
    repeat with a period p. The others keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def text(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = F.pmod(g, n)
        return let(F.struct(a.alias("a"), (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).alias("p")), lambda at: F.array_join(F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, (at["a"] + (i - at["a"]) % at["p"]).cast("int")))), " "))

    words = F.regexp_extract_all("text", F.lit(f"({SPACE.replace('[', '[^')}+)"))
    planted = F.when((h % 10 == 0) & F.col("text").rlike(SPACE.replace("[", "[^")), let(words, text)).otherwise(F.col("text"))
    return docs.select("doc_id", planted.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import find_runs

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    found = find_runs(with_planted_runs(read(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in six shards by the hash of their source, so unevenly, to eight shards of equal bytes."""
    from .resharding import place

    now = F.pmod(F.xxhash64("source"), F.lit(6))
    placed = place(read(spark, sf_dir, "documents"), now)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


_ALL = (
    op1_minhash_near_dedup,
    op2_quality_rules,
    op3_decontamination,
    op4_suffix_array_dedup,
    op5_pii_surrogates,
    op6_url_filter,
    op7_chat_rotation,
    op8_warc_derivatives,
    op9_line_dedup,
    op10_packing,
    op11_phrases,
    op12_periodic_runs,
    op13_reshard,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
