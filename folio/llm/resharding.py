"""Resharding that moves the fewest bytes, by a minimum-cost flow from old shard sizes to new capacities.

A byte that stays in its shard costs nothing, any other costs one (or what ``cost`` says), so the cheapest flow that fills the new capacities
names for each pair of shards how many bytes go from one to the other. The flow's graph has a node for each shard, whatever the data.

``place`` deals the rows of a table: rows are hashed into blocks within their old shard, block sizes are counted in Spark, and
whole blocks follow the flow, the largest first, each to the target that still lacks most. What is left of the difference is evened out by exchanging
single blocks. A row's shard and slot then follow from its block. At most ``MAX_OLD * BLOCKS`` block sizes reach the driver and the plan that is broadcast.

``write_shards``, ``reshard`` and ``read_shards`` do the same to files: a file that goes to another shard as a whole only changes its line
in the manifest, and the few files that a transfer cuts are rewritten, a piece for each shard.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, remove

SHARDS = 8
#: Blocks of an old shard, and the most old shards: bounds of what reaches the driver.
BLOCKS, MAX_OLD = 4096, 256
#: Equal rows are dealt in chunks of so many.
COPIES = 1000
#: Exchanges of blocks at most to even out what the largest first leaves, until shards differ by no more than 1 / NEAR.
REPAIRS, NEAR = 256, 5000

_FAR = np.int64(1) << np.int64(60)


def min_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Amounts from each source to each sink: all supply, no capacity exceeded, least total cost. Successive
    shortest paths with potentials; costs are integers of 0 or more."""
    n, m = cost.shape
    supply, capacity = np.asarray(supply, np.int64), np.asarray(capacity, np.int64)
    if supply.sum() > capacity.sum():
        raise ValueError("the capacities don't hold the supply")
    source, sink = n + m, n + m + 1
    price, room = np.zeros((n + m + 2, n + m + 2), np.int64), np.zeros((n + m + 2, n + m + 2), np.int64)
    price[:n, n : n + m], price[n : n + m, :n] = cost, -cost.T
    room[:n, n : n + m] = _FAR
    room[source, :n], room[n : n + m, sink] = supply, capacity
    potential = np.zeros(n + m + 2, np.int64)
    left = int(supply.sum())
    while left:
        reduced = np.where(room > 0, price + potential[:, None] - potential[None, :], _FAR)
        distance, before, done = np.full(n + m + 2, _FAR), np.full(n + m + 2, -1), np.zeros(n + m + 2, bool)
        distance[source] = 0
        while True:
            k = int(np.argmin(np.where(done, _FAR, distance)))
            if done[k] or distance[k] >= _FAR:
                break
            done[k] = True
            through = np.minimum(distance[k] + reduced[k], _FAR)
            nearer = (through < distance) & ~done
            distance[nearer], before[nearer] = through[nearer], k
        potential += np.minimum(distance, distance[sink])
        path, k = [], sink
        while k != source:
            path.append((int(before[k]), k))
            k = int(before[k])
        amount = min(left, *(int(room[e]) for e in path))
        for a, b in path:
            room[a, b] -= amount
            room[b, a] += amount
        left -= amount
    return room[n : n + m, :n].T.copy()


def even(total: int, shards: int) -> np.ndarray:
    """Capacities that sum to ``total`` and differ by one at most."""
    return total // shards + (np.arange(shards) < total % shards).astype(np.int64)


def transfers(sizes: np.ndarray, capacities: np.ndarray, cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old shard to each new one. Shards of one number are the same place."""
    if cost is None:
        cost = (np.arange(len(sizes))[:, None] != np.arange(len(capacities))[None, :]).astype(np.int64)
    return min_cost_flow(sizes, capacities, cost)


def deal(old: np.ndarray, size: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """A new shard for each block (its old shard and size), so that the sums follow the flow."""
    lacks, target = flow.astype(np.int64).copy(), np.zeros(len(old), np.int64)
    order = np.lexsort((np.arange(len(old)), -size))
    for k in order.tolist():
        row = lacks[old[k]]
        target[k] = j = int(np.argmax(row))
        row[j] -= size[k]
    lacks = lacks.sum(axis=0)
    near = int(size.sum()) // (NEAR * len(lacks))
    for _ in range(REPAIRS if len(old) else 0):
        full, empty = int(np.argmin(lacks)), int(np.argmax(lacks))
        gap = int(lacks[empty] - lacks[full])
        if gap <= near:
            break
        given = np.flatnonzero(target == full)
        back = np.flatnonzero(target == empty)
        back = np.append(back[np.argsort(size[back], kind="stable")], -1)
        sizes = np.append(size[back[:-1]], _FAR)
        place = np.searchsorted(sizes, size[given] - gap // 2)
        # One block against one of the other shard, or against none: the pair whose difference is nearest to half the gap.
        best, pair = gap, None
        for other, weight in ((back[place], sizes[place]), (back[place - 1], sizes[place - 1]), (np.full(len(given), -1), 0)):
            rest = np.abs(gap - 2 * (size[given] - np.where(other < 0, 0, weight)))
            k = int(np.argmin(rest)) if len(rest) else 0
            if len(rest) and rest[k] < best:
                best, pair = int(rest[k]), (given[k], other[k])
        if pair is None:
            break
        for k, shard, other in ((pair[0], empty, full), (pair[1], full, empty)):
            if k >= 0:
                target[k] = shard
                lacks[shard] -= size[k]
                lacks[other] += size[k]
    return target


def _size() -> Column:
    return F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1).cast("long")


def place(docs: DataFrame, old: Column, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text and what ``old`` reads): doc_id, size (UTF-8 bytes of the text and one), text_crc32, old_shard, shard and
    slot, gapless from 0 in each shard. ``old`` is the number of the shard that a row is in now (null: 0). New shards are of equal bytes, as near as blocks allow.

    A null text is empty. Equal rows (same id, text and old shard) are counted and dealt in chunks, so any number of them is spread. Rows of one doc_id
    or of one text aren't kept together. An empty table gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard")
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32", "old_shard").agg(F.count("*").alias("n"))
    chunks = counted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).withColumn("copies", F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("chunk"))).drop("n")
    chunks = materialise(chunks.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "chunk"), F.lit(blocks)).cast("int")), "reshard-chunks")
    sizes = chunks.groupBy("old_shard", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    # One more than the bound, so that exceeding it shows.
    got = sizes.limit(MAX_OLD * blocks + 1).toArrow()
    columns = {c: got.column(c).to_numpy() for c in got.column_names}
    order = np.lexsort((columns["block"], columns["old_shard"]))
    was, block, size, n = (columns[c][order].astype(np.int64) for c in ("old_shard", "block", "bytes", "rows"))
    if len(was) > MAX_OLD * blocks or (len(was) and (was.min() < 0 or was.max() >= MAX_OLD)):
        raise ValueError(f"old shards are numbered from 0 to {MAX_OLD - 1}")
    before = np.zeros(int(was.max(initial=0)) + 1, np.int64)
    np.add.at(before, was, size)
    target = deal(was, size, transfers(before, even(int(size.sum()), shards)))
    first = np.zeros(len(was), np.int64)
    for s in range(shards):
        here = np.flatnonzero(target == s)
        first[here] = np.cumsum(n[here]) - n[here]
    plan = pa.table({"old_shard": pa.array(was.astype(np.int32)), "block": pa.array(block.astype(np.int32)), "shard": pa.array(target.astype(np.int32)), "first": pa.array(first)})
    placed = chunks.join(F.broadcast(docs.sparkSession.createDataFrame(plan, "old_shard int, block int, shard int, first long")), ["old_shard", "block"])
    earlier = W.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size", "chunk").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("first") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))).withColumn("k", F.explode(F.expr("sequence(0L, copies - 1L)")))
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("start") + F.col("k")).alias("slot"))


def _commit(files: DataFrame, root: str, version: int) -> None:
    files.select("path", "shard", "rows", "bytes").write.parquet(f"{root}/manifest-{version:06d}")


def _version(spark: SparkSession, root: str) -> int:
    """The number of the last complete manifest, 0 if there is none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return max((int(str(f.getPath().getParent().getName())[9:]) for f in found or []), default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The live files: path, shard, rows and bytes."""
    return spark.read.schema("path string, shard int, rows long, bytes long").parquet(f"{root}/manifest-{_version(spark, root):06d}")


def _described(spark: SparkSession, folder: str) -> DataFrame:
    """Path, shard, rows and bytes of the files of a written folder."""
    written = spark.read.parquet(folder)
    return written.groupBy(F.col("_metadata.file_path").alias("path"), "shard").agg(F.count("*").alias("rows"), F.sum(_size()).alias("bytes"))


def write_shards(docs: DataFrame, root: str, shard: Column) -> None:
    """Write a table (with a text) as shards: files below ``root`` and a manifest that names them."""
    folder = f"{root}/data-{uuid.uuid4().hex}"
    docs.withColumn("shard", shard.cast("int")).write.partitionBy("shard").parquet(folder)
    _commit(_described(docs.sparkSession, folder), root, _version(docs.sparkSession, root) + 1)


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the live files with their ``shard``; other files of the folder don't count."""
    live = manifest(spark, root)
    paths = [r.path for r in live.select("path").toLocalIterator()]
    return spark.read.parquet(*paths).withColumn("path", F.col("_metadata.file_path")).join(live.select("path", "shard"), "path").drop("path")


def reshard(spark: SparkSession, root: str, shards: int) -> dict[str, int]:
    """Bring a folder of ``write_shards`` to ``shards`` shards of equal bytes by moving the fewest bytes, and return what was done: bytes moved, files rewritten, files kept.

    The files of an old shard lie one after the other; the flow cuts that row into a range for each new shard, its own first. A file inside one range is kept as it is,
    a file over several ranges is rewritten as one piece for each. Nothing is deleted: the old manifest and its files stay readable."""
    live = manifest(spark, root)
    sums = {r.shard: r.b for r in live.groupBy("shard").agg(F.sum("bytes").alias("b")).limit(MAX_OLD + 1).collect()}
    if len(sums) > MAX_OLD or max(sums, default=0) >= MAX_OLD:
        raise ValueError(f"old shards are numbered from 0 to {MAX_OLD - 1}")
    sizes = np.zeros(max(max(sums, default=0) + 1, shards), np.int64)
    for s, b in sums.items():
        sizes[s] = b
    flow = transfers(sizes, even(int(sizes.sum()), shards))
    ranges = []
    for o in range(len(sizes)):
        at = 0
        for s in sorted(range(shards), key=lambda s: (s != o, s)):
            if flow[o, s]:
                ranges.append((o, s, at, at + int(flow[o, s])))
                at += int(flow[o, s])
    cuts = spark.createDataFrame(ranges, "old int, new int, low long, high long")
    order = W.partitionBy("shard").orderBy(F.desc("bytes"), "path").rowsBetween(W.unboundedPreceding, 0)
    placed = live.withColumn("stop", F.sum("bytes").over(order)).withColumn("start", F.col("stop") - F.col("bytes"))
    pieces = placed.join(F.broadcast(cuts), (F.col("shard") == F.col("old")) & (F.col("start") < F.col("high")) & (F.col("stop") > F.col("low")))
    pieces = materialise(pieces.withColumn("n", F.count("*").over(W.partitionBy("path"))), "reshard-pieces")
    cut = pieces.where("n > 1").select("path", "new", "start", "low", "high")
    paths = [r.path for r in cut.select("path").distinct().collect()]  # at most a file for each range
    kept = pieces.where("n = 1").select("path", F.col("new").alias("shard"), "rows", "bytes")
    if paths:
        rows = spark.read.parquet(*paths).withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index"), "__size": _size()})
        middle = F.sum("__size").over(W.partitionBy("__path").orderBy("__row")) - F.col("__size") / 2
        rows = rows.withColumn("__middle", middle).join(F.broadcast(cut), (F.col("__path") == F.col("path")) & (F.col("__middle") + F.col("start") >= F.col("low")) & (F.col("__middle") + F.col("start") < F.col("high")))
        folder = f"{root}/data-{uuid.uuid4().hex}"
        names = [c for c in spark.read.parquet(paths[0]).columns if c != "shard"]
        rows.select(*names, F.col("new").alias("shard")).write.partitionBy("shard").parquet(folder)
        kept = kept.unionByName(_described(spark, folder))
    version = _version(spark, root)
    _commit(kept, root, version + 1)
    n_kept = pieces.where("n = 1").count()
    remove(spark, pieces.scratch_path)
    return {"moved": int(flow.sum() - sum(flow[s, s] for s in range(min(flow.shape)))), "rewritten": len(paths), "kept": n_kept}
