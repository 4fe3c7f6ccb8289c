"""Incremental runs: new files of a folder through the same transforms as a batch run.

The stream's own checkpoint takes the place of looking for existing outputs, and a
stateful first-wins dedupe by url within a watermark that of a set of seen urls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RAW_ARTICLE


def read_new_articles(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW_ARTICLE).option("maxFilesPerTrigger", max_files).json(path)


def dedupe_urls(stream: DataFrame, time: str = "publish_date", delay: str = "1 day") -> DataFrame:
    """First row of each url within the watermark; the state stays bounded."""
    timed = stream.withColumn("event_time", F.coalesce(F.try_to_timestamp(time), F.timestamp_seconds(F.lit(0))))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["url"])


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch transform to every micro-batch and append its result. A batch that is
    replayed after a failure overwrites its own folder, so results are written once."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
