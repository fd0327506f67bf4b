"""Analysis of write-ahead, commit and audit logs as plans over their records.

wal: lsn, kind (BEGIN UPDATE CLR COMMIT ABORT END CKPT_BEGIN CKPT_END), tx_id, prev_lsn, page_id, before, after, undo_next_lsn,
and on CKPT_END att array<struct<tx,status,last_lsn>> and dpt array<struct<page,rec_lsn>>.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDOABLE = ("UPDATE", "CLR")


def analysis(wal: DataFrame, start: int = 1) -> DataFrame:
    """(tx_id, status, last_lsn) of transactions without an END, from a start LSN, checkpointed ones included."""
    log = wal.where(F.col("lsn") >= start)
    own = log.where("tx_id is not null").groupBy("tx_id").agg(F.max("lsn").alias("last_lsn"), F.max(F.col("kind") == "END").alias("ended"), F.max_by("kind", F.when(F.col("kind").isin("COMMIT", "ABORT"), F.col("lsn"))).alias("fate"))
    ck = log.where("kind = 'CKPT_END'").select(F.explode("att").alias("a")).select(F.col("a.tx").alias("tx_id"), F.col("a.status").alias("ck_status"), F.col("a.last_lsn").alias("ck_last"))
    ck = ck.groupBy("tx_id").agg(F.max("ck_status").alias("ck_status"), F.max("ck_last").alias("ck_last"))
    fate = F.when(F.col("fate") == "COMMIT", "committed").when(F.col("fate") == "ABORT", "aborting")
    both = own.join(ck, "tx_id", "full").where("not coalesce(ended, false)")
    return both.select("tx_id", F.coalesce(fate, "ck_status", F.lit("running")).alias("status"), F.coalesce("last_lsn", "ck_last").alias("last_lsn"))


def dirty_pages(wal: DataFrame, start: int = 1) -> DataFrame:
    """(page_id, rec_lsn): a checkpoint's own entry, else the first change that analysis sees; of both the smaller LSN."""
    log = wal.where(F.col("lsn") >= start)
    own = log.where(F.col("kind").isin(*REDOABLE)).select("page_id", F.col("lsn").alias("rec_lsn"))
    ck = log.where("kind = 'CKPT_END'").select(F.explode("dpt").alias("d")).select(F.col("d.page").alias("page_id"), F.col("d.rec_lsn").alias("rec_lsn"))
    return own.unionByName(ck).groupBy("page_id").agg(F.min("rec_lsn").alias("rec_lsn"))


def redo(wal: DataFrame, disk: DataFrame, start: int = 1) -> DataFrame:
    """(lsn, page_id, decision) of each record that redo examines. A page's LSN grows with each record that is applied."""
    dpt = dirty_pages(wal, start)
    first = dpt.agg(F.min("rec_lsn").alias("_first"))
    log = wal.where(F.col("kind").isin(*REDOABLE)).join(F.broadcast(first)).where(F.col("lsn") >= F.col("_first"))
    d = log.join(dpt, "page_id", "left").join(disk.select("page_id", "page_lsn"), "page_id", "left")
    early = F.when(F.col("rec_lsn").isNull(), "not in DPT").when(F.col("lsn") < F.col("rec_lsn"), "LSN < recLSN")
    before = F.max(F.when(early.isNull(), F.col("lsn"))).over(Window.partitionBy("page_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1))
    page_lsn = F.greatest(F.col("page_lsn"), F.coalesce(before, F.lit(0)))
    return d.select("lsn", "page_id", F.coalesce(early, F.when(page_lsn >= F.col("lsn"), "pageLSN >= LSN"), F.lit("apply")).alias("decision"))


def redo_decision(kind: str, lsn: int, page: str, dpt: dict[str, int], page_lsn: int) -> str:
    """The three tests for one record, in order."""
    if kind not in REDOABLE:
        raise ValueError("only UPDATE and CLR are redone")
    return "not in DPT" if page not in dpt else "LSN < recLSN" if lsn < dpt[page] else "pageLSN >= LSN" if page_lsn >= lsn else "apply"


def undo_records(wal: DataFrame, losers: DataFrame) -> DataFrame:
    """(lsn, tx_id, page_id, before) of updates to compensate, newest first.

    A CLR says that all updates between its undo_next_lsn and itself are undone. So an update still counts unless some later CLR of
    its transaction has a smaller undo_next_lsn: the smallest one after each record, by one pass over each transaction.
    """
    own = wal.join(losers.select("tx_id"), "tx_id", "left_semi")
    later = Window.partitionBy("tx_id").orderBy("lsn").rowsBetween(1, Window.unboundedFollowing)
    to = F.when(F.col("kind") == "CLR", F.coalesce("undo_next_lsn", F.lit(0)))
    d = own.withColumn("_to", F.min(to).over(later)).where("kind = 'UPDATE'")
    return d.where(F.coalesce(F.col("_to") >= F.col("lsn"), F.lit(True))).select("lsn", "tx_id", "page_id", "before").orderBy(F.col("lsn").desc())


def undo_chain(wal: DataFrame, tx_id: int) -> list[int]:
    own = wal.where(F.col("tx_id") == tx_id)
    kinds = {r["kind"] for r in own.select("kind").distinct().collect()}
    if not kinds or "COMMIT" in kinds:
        raise ValueError("the transaction is unknown or committed")
    return [r["lsn"] for r in undo_records(wal, own.select("tx_id").distinct()).collect()]


def truncation_point(wal: DataFrame, master: int = 0) -> int:
    """The oldest LSN that a recovery could need: of the checkpoint, of dirty pages and of open transactions' BEGIN."""
    open_ = analysis(wal, 1).where("status <> 'committed'").select("tx_id")
    begins = wal.where("kind = 'BEGIN'").join(open_, "tx_id", "left_semi").agg(F.min("lsn").alias("l")).first()["l"]
    pages = dirty_pages(wal, master or 1).agg(F.min("rec_lsn").alias("l")).first()["l"]
    return min(x for x in (master or 1, begins, pages) if x is not None)


def failover_loss(commits: DataFrame, standby_lsn: int) -> DataFrame:
    """(lost array of tx ids, window): commits after the standby's LSN, and the time from the last kept to the last lost one."""
    if standby_lsn < 0:
        raise ValueError("an LSN is not negative")
    gone = F.col("commit_lsn") > standby_lsn
    d = commits.agg(
        F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("commit_lsn", "tx_id")))), lambda x: x["tx_id"]).alias("lost"),
        F.max(F.when(gone, F.col("commit_time"))).alias("l"),
        F.min(F.when(gone, F.col("commit_time"))).alias("f"),
        F.max(F.when(~gone, F.col("commit_time"))).alias("k"),
    )
    return d.select("lost", F.when(F.size("lost") == 0, F.lit(0.0)).otherwise(F.col("l") - F.coalesce("k", "f")).alias("window"))


def two_phase(votes: DataFrame, decisions: DataFrame, prepared: DataFrame) -> dict[str, DataFrame]:
    """outcome (tx, decision) by the votes, where a missing vote is a no; in_doubt (participant, tx) prepared without a decision.

    resolved gives each transaction in doubt the coordinator's record; without one it aborted.
    """
    outcome = votes.groupBy("tx").agg(F.when(F.bool_and(F.coalesce(F.col("vote") == "YES", F.lit(False))), "COMMIT").otherwise("ABORT").alias("decision"))
    doubt = prepared.where("kind = 'PREPARED'").select("participant", "tx").join(prepared.where("kind in ('COMMIT', 'ABORT')").select("participant", "tx"), ["participant", "tx"], "left_anti").distinct()
    known = decisions.groupBy("tx").agg(F.max("kind").alias("kind"))
    return {"outcome": outcome, "in_doubt": doubt, "resolved": doubt.join(known, "tx", "left").select("participant", "tx", F.coalesce("kind", F.lit("ABORT")).alias("decision"))}


GENESIS = "0" * 64  #: what the first entry of a log follows


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (log, seq, body) by log and seq: each body gets the hash of the one before, and its own hash of the sorted JSON."""
    log, last = None, GENESIS
    for b in it:
        bodies, hashes = [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            log, last = name, last if name == log else GENESIS
            bodies.append(json.dumps({**json.loads(text), "prev_hash": last}, sort_keys=True))
            last = hashlib.sha256(bodies[-1].encode()).hexdigest()
            hashes.append(last)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.string()), pa.array(hashes, pa.string())], names=["log", "seq", "body", "hash"])


def seal(events: DataFrame, log: str, seq: str, body: Column) -> DataFrame:
    """(log, seq, body, hash): each log's events (JSON objects) as a hash chain. A chain is sequential, so a log is read by one
    task, as a stream; logs are independent."""
    rows = events.select(F.col(log).cast("string").alias("log"), F.col(seq).cast("long").alias("seq"), body.alias("body"))
    return rows.repartition("log").sortWithinPartitions("log", "seq").mapInArrow(_links, "log string, seq long, body string, hash string")


def first_damaged(audit: DataFrame, log: str = "log") -> DataFrame:
    """(log, first_damaged): the seq of each log's first entry whose hash or link to the entry before is wrong, or null.

    Hashes are checked where the rows are; links need the entry before, by seq. A deleted entry shows at its successor.
    """
    from ..functions.scalar import canonical_sha256

    before = F.lag(F.struct("seq", "hash")).over(Window.partitionBy(log).orderBy("seq"))
    a = audit.withColumns({"_before": before, "_own": canonical_sha256(F.col("body")), "_prev": F.get_json_object("body", "$.prev_hash")})
    link = F.when(F.col("_before").isNull(), GENESIS).when(F.col("_before.seq") == F.col("seq") - 1, F.col("_before.hash"))
    bad = (F.col("_own") != F.col("hash")) | ~F.col("_prev").eqNullSafe(link)
    return a.groupBy(log).agg(F.min(F.when(bad, F.col("seq"))).alias("first_damaged"))
