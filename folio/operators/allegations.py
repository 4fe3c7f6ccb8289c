"""What is established about an allegation: statements merged over a partial order.

A status stands for all that it implies: ``charged`` implies ``alleged``, ``convicted`` and ``acquitted`` both imply ``charged`` and neither the other. As a set of bits a status is its own bit and those of what it
implies, so merging is a bitwise or: associative, commutative and idempotent. Statements may come in any order, repeatedly and in parts; a frequent key is folded before the
shuffle; merged states merge further. Both verdicts together are ``contested``. A status never goes back.

The stream does the same key by key and reports every rise; an allegation that no statement touches within ``stale_after`` seconds of event time is reported as stale, once, and stays known.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status -> the bits of what it establishes.
MASKS = {"alleged": 0b0001, "charged": 0b0011, "convicted": 0b0111, "acquitted": 0b1011, "contested": 0b1111}
KEY = ["person", "allegation"]
STATE = [*KEY, "mask", "first_at", "last_at", "n_statements", *(f"{s}_at" for s in MASKS if s != "contested")]


def mask_of(status: Column) -> Column:
    """Bits of a status in any letter case; null for another word."""
    out = F.lit(None).cast("int")
    for s, m in MASKS.items():
        out = F.when(F.lower(status) == s, m).otherwise(out)
    return out


def status_of(mask: Column) -> Column:
    """The status that a merged mask stands for."""
    out = F.lit(None).cast("string")
    for s, m in MASKS.items():
        out = F.when(mask == m, s).otherwise(out)
    return out


def merge(statements: DataFrame) -> DataFrame:
    """The state (columns of ``STATE``) of each (person, allegation) of ``statements`` (person, allegation, status, at): the merged mask, the first and last time of any statement, their number, and
    for each status the first time that something established it. Rows with a null key or an unknown status say nothing; a null time counts but dates nothing."""
    rows = statements.withColumn("mask", mask_of(F.col("status"))).where("person is not null and allegation is not null and mask is not null")
    parts = rows.select(*KEY, "mask", F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.lit(1).cast("long").alias("n_statements"), *(F.when(F.col("mask").bitwiseAND(F.lit(m)) == m, F.col("at")).alias(f"{s}_at") for s, m in MASKS.items() if s != "contested"))
    return merge_states(parts)


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of the statements as states of all of them."""
    return states.groupBy(*KEY).agg(F.bit_or("mask").alias("mask"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n_statements").alias("n_statements"), *(F.min(f"{s}_at").alias(f"{s}_at") for s in MASKS if s != "contested"))


def present(states: DataFrame) -> DataFrame:
    """States with their ``status`` and ``as_fact``: only an uncontested conviction may be told as a fact."""
    return states.withColumn("status", status_of(F.col("mask"))).withColumn("as_fact", F.col("mask") == MASKS["convicted"])


def follow(stream: DataFrame, stale_after: int, delay: str = "1 hour") -> DataFrame:
    """The stream of rises: (person, allegation, status, at, n_statements) whenever a micro-batch lifts a status, and a row of status ``stale`` when event time has
    passed ``stale_after`` seconds beyond the last statement. ``stream``: person, allegation (strings), status, at (timestamp); rows later than ``delay`` still count, but don't move the timer back.
    The state of a key is its mask and three numbers."""
    statuses = {m: s for s, m in MASKS.items()}

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        mask, last, n, stale = state.get if state.exists else (0, 0, 0, False)
        if state.hasTimedOut:
            state.update((mask, last, n, True))
            yield pd.DataFrame({"person": [key[0]], "allegation": [key[1]], "status": ["stale"], "at": [pd.Timestamp(last, unit="ms")], "n_statements": [n]})
            return
        before = mask
        for batch in batches:
            for m, at in zip(batch["mask"], batch["millis"]):
                mask, last, n = mask | int(m), max(last, int(at)), n + 1
        state.update((mask, last, n, False))
        if stale_after:
            state.setTimeoutTimestamp(max(last + stale_after * 1000, state.getCurrentWatermarkMs() + 1))
        if mask != before or stale:
            yield pd.DataFrame({"person": [key[0]], "allegation": [key[1]], "status": [statuses[mask]], "at": [pd.Timestamp(last, unit="ms")], "n_statements": [n]})

    rows = stream.withColumn("mask", mask_of(F.col("status"))).where("person is not null and allegation is not null and mask is not null and at is not null").withWatermark("at", delay)
    rows = rows.select(*KEY, "mask", "at", F.unix_millis("at").alias("millis"))
    return rows.groupBy(*KEY).applyInPandasWithState(
        step, "person string, allegation string, status string, at timestamp, n_statements long", "mask int, last long, n long, stale boolean", "update", "EventTimeTimeout"
    )
