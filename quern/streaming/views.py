"""Streams: windowed counts with late data, deduplication, and newest-wins views kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import newest


def tail(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(folder)


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes", slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) by event-time window; rows later than `late` behind the newest are dropped with their window's state."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is kept only so long."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep_newest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], deleted: str | None = None) -> StreamingQuery:
    """A newest-wins table under `path`, one version a batch, with a pointer file to the current one.

    Each batch merges its newest rows into the table before it and writes a new folder, so a reader never sees half a batch
    and a repeated batch writes the same folder again. Tombstones stay until a compaction.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, epoch - 1)
        rows = newest(batch, key, order)
        both = rows if before is None else newest(before.unionByName(rows), key, order)
        both.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, epoch: int | None = None, deleted: str | None = None) -> DataFrame | None:
    """The newest version of a kept table (or that of an epoch); None before the first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) and (epoch is None or int(n[1:]) <= epoch)]
    if not done:
        return None
    d = spark.read.parquet(f"{path}/v{max(done)}")
    return d if deleted is None else d.where(~F.coalesce(F.col(deleted), F.lit(False)))
