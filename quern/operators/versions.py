"""Reads over append-only versions: newest wins, snapshots, expiry, last-writer merges, wide-column partitions.

Each is one aggregation by key with max_by, which combines before the shuffle, so a key with very many versions costs one
row for each task and never a sorted group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The newest version of each key by `order`; keys whose newest is a tombstone are left out."""
    rest = [c for c in df.columns if c not in key]
    mark = {"_dead": deleted} if deleted is not None else {}
    d = df.withColumns(mark)
    out = d.groupBy(*key).agg(F.max_by(F.struct(*rest, *mark), F.struct(*order)).alias("_v")).select(*key, "_v.*")
    return out.where(~F.coalesce(F.col("_dead"), F.lit(False))).drop("_dead") if mark else out


def range_scan(df: DataFrame, key: str, lo, hi, order: list[str], deleted: Column | None = None) -> DataFrame:
    """Newest versions with a key from lo to hi, both included, in key order. The range is filtered before the aggregation."""
    return newest(df.where(F.col(key).between(lo, hi)), [key], order, deleted).orderBy(key)


def as_of(versions: DataFrame, snapshot, key: str = "key", seq: str = "commit_seq", deleted: str | None = None) -> DataFrame:
    """What a snapshot reads: for each key the newest version committed at or before it."""
    return newest(versions.where(F.col(seq) <= F.lit(snapshot)), [key], [seq], F.col(deleted) if deleted else None)


def as_of_each(reads: DataFrame, versions: DataFrame, key: str = "key", seq: str = "commit_seq", value: str = "value", at: str = "snapshot") -> DataFrame:
    """As-of join: each read (key, snapshot) with the value it sees, or null.

    Reads and versions of a key are put in one order and the last version is carried forward: one sort by key, not all
    pairs of a read and its older versions.
    """
    cols = [c for c in reads.columns]
    r = reads.select(F.col(key).alias("_k"), F.col(at).cast("double").alias("_t"), F.lit(1).alias("_read"), F.struct(*cols).alias("_row"), F.lit(None).cast(versions.schema[value].dataType).alias("_value"), F.lit(None).cast("boolean").alias("_hit"))
    v = versions.select(F.col(key).alias("_k"), F.col(seq).cast("double").alias("_t"), F.lit(0).alias("_read"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(True).alias("_hit"))
    w = Window.partitionBy("_k").orderBy("_t", "_read").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_hit"), F.struct("_value")), ignorenulls=True).over(w)
    return r.unionByName(v).withColumn("_seen", last).where("_read = 1").select("_row.*", F.col("_seen._value").alias(value))


def write_conflicts(writes: DataFrame, versions: DataFrame, key: str = "key", seq: str = "commit_seq", snapshot: str = "snapshot") -> DataFrame:
    """Writes whose key has a version newer than the writer's snapshot: under first-committer-wins they must not commit."""
    last = versions.groupBy(key).agg(F.max(seq).alias("_last"))
    return writes.join(last, key).where(F.col("_last") > F.col(snapshot)).drop("_last")


def live(log: DataFrame, now, key: str = "key", offset: str = "offset", expires: str = "expires_at", tombstone: str = "tombstone") -> DataFrame:
    """The key-value view of a log: the newest record of each key that is no tombstone and not expired (expired from its time on)."""
    dead = F.coalesce(F.col(tombstone), F.lit(False)) | F.coalesce(F.lit(now) >= F.col(expires), F.lit(False))
    return newest(log, [key], [offset], dead)


def compaction(log: DataFrame, now, **names) -> DataFrame:
    """(before, after): records in the log, and records that a compacted log keeps."""
    return log.agg(F.count("*").alias("before")).join(live(log, now, **names).agg(F.count("*").alias("after")))


def increments(log: DataFrame, key: str, amount: str, order: list[str]) -> DataFrame:
    """The value of a counter after each increment."""
    return log.withColumn("total", F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_writer(writes: DataFrame, key: str = "key", ts: str = "ts", node: str = "node") -> DataFrame:
    """The merge of replicas: per key the write with the largest time, and of equal times the larger node name."""
    return newest(writes, [key], [ts, node])


def lost_writes(writes: DataFrame, side: str = "side", key: str = "key", ts: str = "ts", node: str = "node") -> DataFrame:
    """Each side's last write of a key that the merge doesn't keep."""
    own = newest(writes, [key, side], [ts, node])
    won = last_writer(writes, key, ts, node).select(key, F.col(ts).alias("_t"), F.col(node).alias("_n"))
    return own.join(won, key).where((F.col(ts) != F.col("_t")) | (F.col(node) != F.col("_n"))).select(*own.columns)


def merge_columns(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A wide-column upsert: per row key, each column's newest value that isn't null."""
    rest = [c for c in df.columns if c not in key and c not in order]
    at = F.struct(*order)
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])


class QueryError(ValueError):
    """A query that the store refuses to plan."""


def select_partition(df: DataFrame, partition: dict, clustering: list[str], start: tuple = (), end: tuple = (), descending: bool = False, limit: int | None = None) -> DataFrame:
    """One partition's rows from `start` to `end` (prefixes of the clustering key, both included), in clustering order."""
    for k, v in partition.items():
        df = df.where(F.col(k) == F.lit(v))
    for bound, low in ((start, True), (end, False)):
        if bound:
            row, given = F.struct(*clustering[: len(bound)]), F.struct(*[F.lit(v).alias(c) for v, c in zip(bound, clustering)])
            df = df.where(row >= given if low else row <= given)
    df = df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in clustering])
    return df if limit is None else df.limit(limit)


def select_where(df: DataFrame, condition: Column, allow_filtering: bool = False) -> DataFrame:
    """A scan of all partitions; it has to be asked for."""
    if not allow_filtering:
        raise QueryError("this reads every partition; pass allow_filtering=True")
    return df.where(condition)


def newest_rows(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each partition; Spark keeps k rows a task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
