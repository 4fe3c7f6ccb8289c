"""Chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation gets the dialogue rendered from their side: their
turns are the assistant's, everybody else is a user with a name, system turns stay system
turns. The loss mask covers what the assistant says and its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release

#: Turns of one rendered part; a longer dialogue comes in several parts, so no task gathers an unbounded one.
PART_TURNS = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` with n, the rank of a turn in its conversation ``__c`` from 0 on, and the table that it reads.

    Rows are dealt by ranges of (conversation, turn, role, digest), so a long conversation is spread over several
    tasks. A rank is the number of the conversation's rows in earlier ranges and the place in the own one."""
    order = ["turn", "role", "__d"]
    dealt = materialise(turns.repartitionByRange("__c", *order).withColumn("__p", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("__c", "__p").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(W.partitionBy("__c").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("__c", "__p", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("__c", "__p").orderBy(*order))
    placed = dealt.withColumn("place", place).join(before, ["__c", "__p"])
    return placed.withColumn("n", F.col("before") + F.col("place") - 1).drop("place", "before", "__p", "__d"), dealt


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render conversations (conv_id, turn, role, text), once for each participant.

    Returns conv_id, perspective, part, n_turns, n_context, text, mask (array of (start, stop) code
    point ranges of ``text`` that count for the loss), mask_chars. Participants are the
    roles of the conversation other than ``system``; a conversation of system turns only has none and
    gives no row. A dialogue of more than ``part_turns`` turns is cut into parts of that many, whatever the
    turn numbers are; each later part opens with the system turns of the first one (n_context of
    them, not counted in n_turns). A part in which the perspective's speaker is silent is still
    rendered, with an empty mask.

    Ties of a turn number are ordered by role and MD5 of the text; a row repeated exactly counts once.
    A null role is the participant ``unknown``; a null text is empty; a null turn comes
    first; each row with a null conv_id is a conversation of its own. An empty table gives
    no rows. Calling it writes two tables of turns; the lazy last step reads the second.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    row = F.md5(F.to_json(F.struct("turn", role.alias("role"), text.alias("text"))))
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), row)).alias("__c"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text).alias("__d")
    ).distinct()
    numbered, dealt = _numbered(turns)
    part = F.floor(F.col("n") / part_turns).alias("part")
    parts = materialise(numbered.groupBy("__c", "conv_id", part).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns")), "parts")
    release(dealt)
    speakers = parts.select("__c", F.explode(F.array_distinct(F.transform("turns", lambda t: t["role"]))).alias("perspective")).where("perspective <> 'system'").distinct()
    context = parts.where("part = 0").select("__c", F.filter("turns", lambda t: t["role"] == "system").alias("context"))
    both = parts.join(speakers.join(context, "__c"), "__c")
    both = both.withColumn("context", F.when(F.col("part") > 0, F.col("context")).otherwise(F.slice("context", 1, 0)))

    def seat(x):
        own = x["role"] == F.col("perspective")
        header = F.when(own, F.lit("assistant")).when(x["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), x["role"]))
        head = F.concat(F.lit(START), header, F.lit("\n"))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, x["text"], F.lit(END)).alias("piece"))

    seated = both.withColumn("pieces", F.transform(F.concat("context", "turns"), seat))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(acc, p):
        stop = acc["at"] + F.length(p["piece"])
        span = F.array(F.struct((acc["at"] + p["head"]).alias("start"), (stop - 1).alias("stop")))  # the last newline isn't learnt
        return F.struct(stop.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    masked = seated.withColumn("mask", F.aggregate("pieces", start, add, lambda acc: acc["spans"]))
    return masked.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("context").cast("long").alias("n_context"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["stop"] - m["start"]).alias("mask_chars"),
    )
