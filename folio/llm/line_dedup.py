"""Line deduplication over levelled, sorted runs of line hashes.

A run is a table of (line hash, number of documents, holder) bucketed and sorted by
hash, kept with a manifest in a folder that all executors share, so that a later call can
open the runs again. Each new batch of lines is merge-anti-joined with the runs: a hash
that no run has is fresh and gets its holder, the largest document of the batch; a known
one only adds to its document count. The batch then becomes a run of level 0. As soon as a
level has ``fanout`` runs they are compacted into one run of the next level, so a hash meets a
number of runs that grows with the logarithm of the batches only. All runs of a folder
have the same buckets, so joins and compactions between them move no data.

A holder is written once, by the batch that brought the hash: where runs are merged, the
newer one's value wins, as it can only be there if no older run had the hash.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_case, let, materialise, parted, release, remove, shared_dir

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of one call and runs per level.
BATCHES, FANOUT = 4, 2
#: Hashes of a bucket, and the most buckets: their number follows from the first call's hashes.
BUCKET_ROWS, MAX_BUCKETS = 250_000, 4096

_BLANKS = " \t\n\x0b\x0c\r"
_RUN = "h1 bigint, h2 bigint, n bigint, holder bigint"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return fold_case(F.btrim(line, F.lit(_BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_id, i, first): line ``i`` has a key of at least ``min_chars`` code
    points; ``first`` marks one line of each key of a text. ``text_id`` tells the texts of a repeated doc_id apart.

    The hash has 128 bits: two hashes of differently salted text (a second seed alone would depend on the first)."""

    def hashed(x: Column) -> Column:
        salted = F.concat(F.lit("\x01"), x["k"])
        return F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(salted).alias("h2"), x["i"].alias("i"))

    def marked(s: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before = F.get(s, j - 1)
            return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["i"].alias("i"), F.coalesce((before["h1"] != x["h1"]) | (before["h2"] != x["h2"]), F.lit(True)).alias("first"))

        return F.transform(s, one)

    # Lines shorter than the limit can't have a long key, so their keys are never built.
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.when(F.length(x) >= min_chars, line_key(x)).alias("k")))
    long = F.filter(numbered, lambda x: F.length(x["k"]) >= min_chars)
    rows = docs.where("doc_id is not null").where(F.length("text") >= min_chars)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.explode_outer(let(F.sort_array(F.transform(long, hashed)), marked)).alias("x")).where("x is not null")
    return rows.select("x.h1", "x.h2", "doc_id", "text_id", "x.i", "x.first")


class LineRuns:
    """Levelled runs in ``folder``: those that its manifest lists, or none yet.

    Columns of a run: h1, h2, n (documents), holder (null unless the run's batch was the first with
    the hash). The manifest is a row of JSON lines for each version, so a change that fails
    leaves the version before it valid."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8, fanout: int = FANOUT):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version, self.buckets, self.fanout = 0, buckets, fanout
        #: Levels from the newest to the oldest, the runs of a level from the oldest to the newest.
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self._tables: dict[str, str] = {}
        self._open()

    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def _open(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return
        last = self.spark.read.schema("version int, content string").json(self._manifest()).agg(F.max_by("content", "version")).first()[0]
        if last is not None:
            found = json.loads(last)
            self.version, self.buckets, self.fanout = found["version"], found["buckets"], found["fanout"]
            self.levels, self.batches = found["levels"], found["batches"]

    def _save(self) -> None:
        self.version += 1
        content = json.dumps({"version": self.version, "buckets": self.buckets, "fanout": self.fanout, "levels": self.levels, "batches": self.batches})
        self.spark.createDataFrame([(self.version, content)], "version int, content string").coalesce(1).write.mode("append").json(self._manifest())

    def _table(self, run: str) -> DataFrame:
        if run not in self._tables:
            name = f"line_run_{uuid.uuid4().hex}"
            path = f"{self.folder}/{run}"
            self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, df: DataFrame) -> str:
        run, name = f"run-{uuid.uuid4().hex}", f"line_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{run}").saveAsTable(name)
        self._tables[run] = name
        return run

    def _drop(self, run: str) -> None:
        self._close(run)
        remove(self.spark, f"{self.folder}/{run}")

    def _close(self, run: str) -> None:
        if run in self._tables:
            self.spark.sql(f"DROP TABLE {self._tables.pop(run)}")

    def close(self) -> None:
        """Forget the tables; the files and the manifest stay."""
        for run in list(self._tables):
            self._close(run)

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.folder)

    def runs(self) -> list[DataFrame]:
        """From the oldest to the newest."""
        return [self._table(r) for level in reversed(self.levels) for r in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (h1, h2, ...) whose hash no run has."""
        return reduce(lambda df, run: df.join(run.select(*_KEY), _KEY, "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame, name: str) -> None:
        """Add (h1, h2, n, top): hashes of a batch, their documents and the largest one; bucketed like the runs if no data
        is to move. A batch that the manifest names already is left out, so a job that failed can be run again."""
        if name in self.batches:
            return
        holders = self.fresh(batch).select(*_KEY, F.col("top").alias("holder"))
        run = self._write(batch.select(*_KEY, "n").join(holders, _KEY, "left"))
        gone: list[str] = []
        self._put(0, run, gone)
        self.batches.append(name)
        self._save()
        for old in gone:
            self._drop(old)

    def _put(self, level: int, run: str, gone: list[str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            gone.extend(full)
            self._put(level + 1, self._write(self._merged([self._table(r) for r in full])), gone)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        def merge(older: DataFrame, newer: DataFrame) -> DataFrame:
            both = older.join(newer.select(*_KEY, F.col("n").alias("n2"), F.col("holder").alias("holder2")), _KEY, "full_outer")
            n = F.coalesce("n", F.lit(0).cast("long")) + F.coalesce("n2", F.lit(0).cast("long"))
            return both.select(*_KEY, n.alias("n"), F.coalesce("holder2", "holder").alias("holder"))

        return reduce(merge, runs)

    def state(self) -> DataFrame:
        """(h1, h2, n, holder) of every hash."""
        runs = self.runs()
        return self._merged(runs) if runs else self.spark.createDataFrame([], _RUN)


def _edges(docs: DataFrame, batches: int) -> list[int]:
    """Lower ends of ``batches`` ranges of doc_id with about equally many rows, falling; the last range has none."""
    cuts = docs.where("doc_id is not null").agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    return sorted({x + 1 for x in cuts or []}, reverse=True)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None,
    keep: tuple[str, ...] = (), runs_at: str | None = None, name: str | None = None,
) -> DataFrame:
    """Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents
    lose all their lines except in the largest doc_id that holds them.

    Returns doc_id, n_lines, n_dropped, text (the other lines joined by newlines) and the
    columns named in ``keep``, one row per input row. A null or empty text is one empty line; a row with a null doc_id keeps
    all lines and counts for no key; repeated rows of a doc_id count as one document; each
    keeps or loses its own lines. An empty table gives no rows.

    With ``runs_at``, a shared folder, the runs stay there and those of earlier calls count: a key that an
    earlier call has brought keeps its holder, and this call's documents lose it once
    ``min_docs`` documents of all calls hold it. ``name`` makes such a call repeatable: its documents count once.
    """
    spark = docs.sparkSession
    lines = materialise(line_hashes(docs, min_chars), "lines")
    firsts = lines.where("first").select(*_KEY, "doc_id")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        firsts = firsts.distinct()
    edges = _edges(docs, batches)
    number = reduce(lambda c, x: c + (F.col("doc_id") < x).cast("int"), edges, F.lit(0))
    if buckets is None:
        buckets = min(MAX_BUCKETS, 1 + lines.count() // BUCKET_ROWS)
    call, folder = name or uuid.uuid4().hex, runs_at or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
    runs = LineRuns(spark, folder, buckets, fanout)
    # Combined before the exchange, so a line of very many documents is one row a task; then dealt into the runs' buckets once for all batches.
    counted = firsts.groupBy(number.alias("batch"), *_KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).repartition(runs.buckets, *_KEY)
    table = f"line_batch_{uuid.uuid4().hex}"
    counted.write.format("parquet").partitionBy("batch").bucketBy(runs.buckets, *_KEY).sortBy(*_KEY).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    # The highest documents first: who brings a line is its holder.
    for k in range(len(edges) + 1):
        runs.add(spark.table(table).where(F.col("batch") == k).select(*_KEY, "n", "top"), f"{call}-{k}")
    spark.sql(f"DROP TABLE {table}")
    remove(spark, f"{shared_dir(spark)}/{table}")
    frequent = runs.state().where(F.col("n") >= min_docs).select(*_KEY, "holder")
    gone = lines.join(frequent, _KEY).where("doc_id <> holder").groupBy("doc_id", "text_id").agg(F.collect_set("i").alias("gone"))
    gone = materialise(gone, "gone")
    runs.close() if runs_at else runs.drop()
    release(lines)
    # Only texts that lose a line (and a few more) move to their line numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *(F.col(c) for c in keep))
    touched, others = parted(texts, gone.select("doc_id").distinct(), "doc_id")
    touched = touched.withColumn("text_id", F.xxhash64("text")).join(gone, ["doc_id", "text_id"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.coalesce("gone", F.array().cast("array<int>")))
    left = let(_lines(F.col("text")), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    n_lines, n_dropped = F.size(_lines(F.col("text"))).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    a = touched.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), left.alias("text"), *keep)
    b = others.select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    return a.unionByName(b)
