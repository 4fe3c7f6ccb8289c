"""Facts that age: from dated statements to periods of validity, reads as of a date, and periods that overlap.

``periods`` merges the statements of a key in order: equal neighbours are one period, another value or too long a silence ends it. It works in time buckets: the statements of a (key, bucket)
are ordered on their own and only one row for each bucket passes state on to later ones, so a key with very many statements is many small groups.

Joins by time use dyadic intervals: a period is cut into the few aligned blocks of power-of-two length that make it up, a moment lies in one
block of each length. So a moment meets a period in exactly one block and the join is an equality; no period is compared with all others of its key.
Two periods overlap if the later start lies in the other period. Periods are first cut to the time in which there are moments, so an open one takes no blocks
up to the end of time and moments are listed for the few lengths that occur. All these joins are sort-merge joins by hint: the optimiser takes the size of a table before
its rows are multiplied for the size after, and would broadcast it through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Block lengths are 2**0 to 2**LEVELS; times are longs of 0 and more (days, seconds ...) below 2**LEVELS.
LEVELS = 40
FOREVER = (1 << LEVELS) - 1


def periods(statements: DataFrame, max_age: int | None = None, bucket: int = 1 << 16) -> DataFrame:
    """(key, value, valid_from, valid_to, n) from ``statements`` (key, at, value, seq). Of several statements of one key and time the one with the greatest seq, then value, counts.

    A period holds from its first statement to the next other value, ``FOREVER`` if there is none; with ``max_age`` at most so long after its last statement, and a later equal one
    begins a new period. Rows with a null key or time say nothing; a null value is a value of its own (nothing known), which ends the period before it."""
    rows = statements.where("key is not null and at is not null").select("key", F.col("at").cast("long").alias("at"), "value", "seq")
    latest = rows.groupBy("key", "at").agg(F.max(F.struct("seq", "value")).alias("s")).select("key", "at", "s.value", F.floor(F.col("at") / bucket).alias("bucket"))
    within = W.partitionBy("key", "bucket").orderBy("at")
    over = W.partitionBy("key").orderBy("bucket")
    # What each bucket tells the next ones: its last statement.
    edges = latest.groupBy("key", "bucket").agg(F.max_by(F.struct("at", "value"), "at").alias("last"), F.min("at").alias("first_at"))
    edges = edges.select("key", "bucket", F.lag("last").over(over).alias("before"), F.lead("first_at").over(over).alias("after"))
    joined = latest.join(edges.hint("merge"), ["key", "bucket"])
    previous = F.coalesce(F.lag(F.struct("at", "value")).over(within), F.col("before"))
    marked = joined.withColumn("previous", previous).withColumn("next_at", F.coalesce(F.lead("at").over(within), F.col("after")))
    too_old = F.lit(False) if max_age is None else F.col("at") - F.col("previous.at") > max_age
    starts = F.col("previous").isNull() | ~F.col("value").eqNullSafe(F.col("previous.value")) | too_old
    marked = marked.withColumn("opens", starts)
    # The number of a period: openings up to here, those of earlier buckets added.
    opened = marked.groupBy("key", "bucket").agg(F.count_if("opens").alias("k"))
    base = opened.select("key", "bucket", F.coalesce(F.sum("k").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = marked.withColumn("own", F.sum(F.col("opens").cast("long")).over(within.rowsBetween(W.unboundedPreceding, 0))).join(base.hint("merge"), ["key", "bucket"]).withColumn("period", F.col("base") + F.col("own"))
    # The last statement of a period knows when the next one of the key comes.
    made = numbered.groupBy("key", "period").agg(F.first("value").alias("value"), F.min("at").alias("valid_from"), F.max("at").alias("last_at"), F.max_by(F.coalesce("next_at", F.lit(FOREVER)), "at").alias("next_at"), F.count("*").alias("n"))
    end = F.col("next_at") if max_age is None else F.least("next_at", F.col("last_at") + max_age)
    return made.select("key", "value", "valid_from", end.alias("valid_to"), "n").where("valid_to > valid_from")


def _blocks(start: int, end: int) -> Iterator[tuple[int, int]]:
    """(level, block) of the aligned power-of-two blocks that [start, end) is made of."""
    while start < end:
        level = min((start & -start).bit_length() - 1 if start else LEVELS, (end - start).bit_length() - 1)
        yield level, start >> level
        start += 1 << level


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Periods (with valid_from and valid_to), a row for each block, at most two for each level."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, level, block = [], [], []
            for k, (a, b) in enumerate(zip(batch.column("valid_from").to_pylist(), batch.column("valid_to").to_pylist())):
                for lv, bl in _blocks(a, b):
                    at.append(k), level.append(lv), block.append(bl)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(level, pa.int32()), pa.array(block, pa.int64())], names=[*names, "level", "block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where(f"valid_from >= 0 and valid_to <= {FOREVER} and valid_from < valid_to").mapInArrow(run, schema + ", level int, block long")


def _meetings(moments: DataFrame, at: str, periods: DataFrame) -> DataFrame:
    """All columns of ``moments`` and those of ``periods`` (valid_from, valid_to) for each moment that lies in a period of the same ``key``. Both are read twice, so they should be written."""
    low, high = moments.where(F.col(at).between(0, FOREVER)).agg(F.min(at), F.max(at)).first()
    if low is None:
        low, high = 0, 0
    # Times from the first moment on; what a period has outside of them meets nothing.
    cut = periods.withColumns({"whole_from": F.col("valid_from"), "whole_to": F.col("valid_to"), "valid_from": F.greatest("valid_from", F.lit(low)) - low, "valid_to": F.least("valid_to", F.lit(high + 1)) - low})
    longest = cut.agg(F.max(F.col("valid_to") - F.col("valid_from"))).first()[0]
    levels = F.sequence(F.lit(0), F.lit(max(1, longest or 1).bit_length() - 1))
    asked = moments.where(F.col(at).between(low, high)).withColumn("level", F.explode(levels)).withColumn("block", F.call_function("shiftright", F.col(at).cast("long") - low, F.col("level")))
    blocks = _in_blocks(cut).drop("valid_from", "valid_to").withColumnsRenamed({"whole_from": "valid_from", "whole_to": "valid_to"})
    return asked.hint("merge").join(blocks.hint("merge"), ["key", "level", "block"]).drop("level", "block")


def as_of(facts: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads`` (key, at and further columns) with the value that held then and its valid_from and valid_to; without one these are null. ``facts``: a result of
    ``periods``, or any (key, value, valid_from, valid_to) that don't overlap within a key. Reads with a null key or time find nothing but stay."""
    known = written(facts.where("key is not null").select("key", "value", "valid_from", "valid_to"), "facts")
    asked = written(reads.withColumn("read", F.monotonically_increasing_id()), "reads")  # numbers that stay
    hit = _meetings(asked.where("key is not null").select("read", "key", "at"), "at", known).select("read", "value", "valid_from", "valid_to")
    return asked.join(hit.hint("merge"), "read", "left").drop("read")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_value, right_value, valid_from, valid_to): what two sets of periods say of the same key at the same time, a row for each pair of periods that share time."""
    a, b = (
        written(side.where("key is not null and valid_from < valid_to").select("key", F.col("value").alias(name), "valid_from", "valid_to"), name)
        for side, name in ((left, "left_value"), (right, "right_value"))
    )

    def starting_in(starts: DataFrame, periods: DataFrame, strictly: bool) -> DataFrame:
        """Pairs in which the start of the first lies in the second; with ``strictly`` after its start."""
        met = _meetings(starts.withColumnsRenamed({"valid_from": "s_from", "valid_to": "s_to"}), "s_from", periods)
        met = met.where("s_from > valid_from") if strictly else met
        return met.select("key", "left_value", "right_value", F.col("s_from").alias("valid_from"), F.least("s_to", "valid_to").alias("valid_to"))

    return starting_in(a, b, False).unionByName(starting_in(b, a, True))
