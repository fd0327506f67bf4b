"""Tenants and shards over document collections: scopes that cannot be left, routed reads, batches that are checked whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import Collection, WriteError, condition, run_pipeline
from .partitioning import Ranges, target


class Session:
    """One tenant's view of collections: every read, write and lookup is filtered to it, whatever the caller's query says."""

    def __init__(self, collections: dict[str, Collection], tenant, field: str = "tenant"):
        self.all, self.tenant, self.field = collections, tenant, field

    def scope(self, query: dict | None) -> dict:
        return {"$and": [{self.field: self.tenant}, query or {}]}

    def find(self, name: str, query: dict | None = None, **how) -> DataFrame:
        return self.all[name].find(self.scope(query), **how)

    def count(self, name: str, query: dict | None = None) -> int:
        return self.all[name].count_documents(self.scope(query))

    def aggregate(self, name: str, stages: list[dict]) -> DataFrame:
        only = {self.field: self.tenant}
        return run_pipeline(self.all[name].df, [{"$match": only}, *stages], lambda n: self.all[n].df, only).drop("_seq")

    def insert(self, name: str, docs: list[dict]) -> list:
        if any(d.get(self.field, self.tenant) != self.tenant for d in docs):
            raise WriteError("a document of another tenant")
        self.all[name], ids = self.all[name].insert_many([{**d, self.field: self.tenant} for d in docs])
        return ids

    def update(self, name: str, query: dict, update: dict) -> dict:
        touched = [p for k, fields in update.items() for p in (fields if k.startswith("$") else [k])]
        if any(p == self.field or p.startswith(f"{self.field}.") for p in touched):
            raise WriteError("a document stays with its tenant")
        self.all[name], n = self.all[name].update_many(self.scope(query), update)
        return n

    def delete(self, name: str, query: dict) -> int:
        self.all[name], n = self.all[name].delete_many(self.scope(query))
        return n


class Router:
    """A collection cut by ranges of a shard key. Queries name the shards that they can touch; Spark prunes by the same filter."""

    def __init__(self, df: DataFrame, key: str, ranges: Ranges):
        self.key, self.ranges, self.last_route = key, ranges, list(ranges.names)
        self.df = df.withColumn("_shard", ranges.shard(F.col(key)))

    def find(self, query: dict, sort: list[tuple[str, int]] | None = None, skip: int = 0, limit: int = 0, projection: dict | None = None) -> DataFrame:
        """A sort with a limit is a top-k of each task, merged."""
        self.last_route = target(query, self.key, self.ranges)
        c = Collection(self.df.where(F.col("_shard").isin(self.last_route)))
        return c.find(query, projection, sort, skip, limit).drop("_shard")

    def aggregate(self, stages: list[dict]) -> DataFrame:
        first = stages[0].get("$match", {}) if stages else {}
        self.last_route = target(first, self.key, self.ranges)
        return Collection(self.df.where(F.col("_shard").isin(self.last_route)).drop("_shard")).aggregate(stages)

    def insert(self, docs: DataFrame) -> Router:
        if not docs.where(F.col(self.key).isNull()).isEmpty():
            raise WriteError("the shard key is required")
        return Router(self.df.drop("_shard").unionByName(docs, allowMissingColumns=True), self.key, self.ranges)

    def check_update(self, update: dict) -> None:
        if any(self.key in fields for k, fields in update.items() if k.startswith("$")) or self.key in update:
            raise WriteError("the shard key of a document doesn't change")

    def load(self) -> DataFrame:
        return self.df.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


def all_or_nothing(before: DataFrame, after: DataFrame, rules: dict[str, Column], publish: Callable[[DataFrame], None]) -> DataFrame:
    """Publishes `after` when no row breaks a rule; else publishes nothing and returns the broken rows with their rule."""
    bad = after.select("*", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    if bad.isEmpty():
        publish(after)
    return bad


def transfers(accounts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, accounts after): moves (tx, src, dst, amount) of one batch, each with its accounts to itself.

    A move commits when both accounts exist, its source can pay and no move before it in the batch touches either account;
    a later one that does aborts, as one that meets a lock would. The total never changes.
    """
    a = accounts.select("account", "balance")
    ends = moves.select("tx", F.explode(F.array("src", "dst")).alias("account"))
    first = ends.groupBy("account").agg(F.min("tx").alias("first"))
    free = ends.join(first, "account").groupBy("tx").agg(F.bool_and(F.col("tx") == F.col("first")).alias("free"))
    m = moves.join(free, "tx").join(a.select(F.col("account").alias("src"), F.col("balance").alias("have")), "src", "left").join(a.select(F.col("account").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    ok = F.col("free") & F.coalesce(F.col("have") >= F.col("amount"), F.lit(False)) & F.coalesce("known", F.lit(False)) & (F.col("src") != F.col("dst"))
    out = m.select("tx", "src", "dst", "amount", F.when(ok, "COMMIT").otherwise("ABORT").alias("outcome"))
    done = out.where("outcome = 'COMMIT'")
    delta = done.select(F.col("src").alias("account"), (-F.col("amount")).alias("d")).unionByName(done.select(F.col("dst").alias("account"), F.col("amount").alias("d"))).groupBy("account").agg(F.sum("d").alias("d"))
    return out.select("tx", "outcome"), a.join(delta, "account", "left").select("account", (F.col("balance") + F.coalesce("d", F.lit(0))).alias("balance"))


def tickets(df: DataFrame, tenant: str = "tenant", extra: str = "priority") -> DataFrame:
    return df.groupBy(tenant, extra).agg(F.count("*").alias("n"))


def filtered(df: DataFrame, query: dict) -> DataFrame:
    return df.where(condition(df, query))
