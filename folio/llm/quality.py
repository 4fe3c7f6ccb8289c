"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets a few signals. The learnt rule rejects documents of which a signal
lies beyond its cutoff. The cutoffs are tightened step by step along a fixed path, one signal
at a time, so one sequence of tests per stratum covers all signals: a step is accepted as
long as an exact binomial bound on labelled good documents shows that the rule up to it
rejects at most a share ``alpha`` of them, and the first step that fails ends the sequence
(fixed-sequence testing, which spends a stratum's level once). The level is corrected
for the number of strata after Bonferroni; strata with too few labels to certify anything
even by themselves aren't tested and take no share of it. With probability 1 - ``delta`` no stratum
then loses more than a share ``alpha`` of its good documents to the learnt rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, materialise

ALPHA, DELTA = 0.02, 0.05
#: Signal -> cutoffs, the most lenient first; a document is beyond a cutoff if its signal is larger.
#: Repeated words have a base rule of their own.
CUTOFFS: dict[str, list[float]] = {
    "symbol_ratio": [0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005],
    "upper_ratio": [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.17, 0.15, 0.12, 0.1, 0.09, 0.08, 0.07, 0.06],
    "mean_word": [14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.75, 6.5, 6.25, 6.0],
}
#: Step of the path at which a signal gets a cutoff: the signals take turns.
STEP = {(s, i): i * len(CUTOFFS) + k for k, s in enumerate(CUTOFFS) for i in range(len(CUTOFFS[s]))}
N_STEPS = len(STEP)
#: Accepted steps are broadcast up to so many rows; beyond, they are joined by shuffle.
MAX_BROADCAST = 10_000
#: Terms of a binomial tail that are summed; the rest is bounded by a geometric series, upwards.
MAX_TERMS = 2_000

_WORD_SPLIT = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words covered by ``5``-word windows that occur twice or more in the text."""
    n = F.size(words)

    def of_hashes(h: Column) -> Column:
        w = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
        return let(w, of_windows)

    def of_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, of_ordered))

    def of_ordered(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

        places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum")), lambda a: a["sum"])

    return F.when(n < 5, F.lit(0)).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def features(docs: DataFrame, stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, counts and signals of every document, and the columns named in ``keep``; one scan, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        F.array_remove(F.split(text, _WORD_SPLIT), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    solid = F.regexp_replace(text, _WORD_SPLIT, "")
    of = docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
        counted.alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select(*keep, "doc_id", "stratum", "w.n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "w.n_repeat_words")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return of.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("n_upper") / chars).alias("upper_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("word_chars") / words).alias("mean_word"),
    ).withColumn("step", reject_step())


def reject_step() -> Column:
    """The first step of the path whose rule rejects the document; N_STEPS if none does."""

    def of(signal: str) -> Column:
        out = F.lit(N_STEPS)
        for i, c in reversed(list(enumerate(CUTOFFS[signal]))):
            out = F.when(F.col(signal) > c, F.lit(STEP[signal, i])).otherwise(out)
        return out

    return F.least(*(of(s) for s in CUTOFFS))


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double") + 1
    stirling = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): summed from the term of k downwards; never too small. 1 where k >= n p."""
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.lit(MAX_TERMS)).cast("int")
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"), F.lit(0.0).alias("ratio"))

    def add(acc: Column, i: Column) -> Column:
        ratio = (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct((acc["sum"] + acc["term"] * ratio).alias("sum"), (acc["term"] * ratio).alias("term"), ratio.cast("double").alias("ratio"))

    done = F.when(steps < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))))
    tail = F.aggregate(done, zero, add, lambda a: a["sum"] + F.when(k > MAX_TERMS, a["term"] * a["ratio"] / (1 - a["ratio"])).otherwise(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_term) * tail))


def _good(labels: DataFrame, wanted: int = 1) -> DataFrame:
    """doc_ids with a quality label that all say ``wanted``; null labels count as not good."""
    q = F.coalesce("quality", F.lit(0))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(q).alias("low"), F.max(q).alias("high")).where((F.col("low") == wanted) & (F.col("high") == wanted)).select("doc_id")


def fewest(delta: float, alpha: float) -> float:
    """Labelled good documents that can certify a step which rejects none of them."""
    return math.log(delta) / math.log1p(-alpha)


def thresholds(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n, accepted): the last accepted step of each stratum that has one.

    ``found``: the result of ``features``. ``labels``: doc_id, quality (1 good). Counts run
    over all labelled good documents that pass the base rules; a doc_id with several labels is good if all say so.
    """
    held = found.where("not base_failed").join(_good(labels), "doc_id", "left_semi")
    by_step = materialise(held.groupBy("stratum", "step").agg(F.count("*").alias("n")), "counts")
    totals = by_step.groupBy("stratum").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest(delta, alpha))
    share = delta / max(1, totals.count())
    # At most N_STEPS rows a stratum: how many good documents the rule up to each step rejects.
    every = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(N_STEPS - 1))))
    counts = by_step.select("stratum", F.col("step").alias("i"), F.col("n").alias("here"))
    upto = F.sum(F.coalesce("here", F.lit(0))).over(W.partitionBy("stratum").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    tested = every.join(counts, ["stratum", "i"], "left").withColumn("k", upto).withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha) <= share)
    first_bad = F.coalesce(F.min(F.when(~F.col("ok"), F.col("i"))), F.lit(N_STEPS))
    return tested.groupBy("stratum", "n").agg((first_bad - 1).alias("accepted")).where("accepted >= 0")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, signals and the verdict of every document, one row per input row.

    Returns the columns of ``features`` (with those named in ``keep``) and ``kept``: not base_failed and not rejected by the
    rule up to the accepted step of the document's stratum. Null and empty texts have no words and
    fail the base rules; a null stratum is a stratum of its own; null labels count as not
    good. Repeated rows are judged alike. An empty table gives no rows; without labels only
    the base rules apply.
    """
    found = materialise(features(docs, stratum, keep), "features")
    accepted = materialise(thresholds(found, labels, alpha, delta).select("stratum", "accepted"), "accepted")
    small = accepted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = found.join(F.broadcast(accepted) if small else accepted, "stratum", "left")
    beyond = F.coalesce(F.col("step") <= F.col("accepted"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("accepted")


def power(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, good, good_rejected, junk, junk_rejected): labelled documents that pass the base rules, and those of them that the learnt rule rejects."""
    good, junk = (_good(labels, q).withColumn("good", F.lit(q == 1)) for q in (1, 0))
    met = judged.where("not base_failed").join(good.unionByName(junk), "doc_id")
    g, out = F.col("good"), ~F.col("kept")
    return met.groupBy("stratum").agg(F.count_if(g).alias("good"), F.count_if(g & out).alias("good_rejected"), F.count_if(~g).alias("junk"), F.count_if(~g & out).alias("junk_rejected"))
