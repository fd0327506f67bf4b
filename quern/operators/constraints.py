"""Constraints, upserts, triggers and audits, as plans over whole tables: files enforce none of these themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def violations(df: DataFrame, key: list[str], checks: dict[str, Column] | None = None, not_null: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = (), foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(key..., rule): one row for each rule that a row breaks. A check that is null passes, as in SQL."""
    rules = {f"not_null:{c}": F.col(c).isNull() for c in not_null} | {f"check:{n}": ~F.coalesce(c, F.lit(True)) for n, c in (checks or {}).items()}
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])) if rules else F.array().cast("array<string>")
    out = df.select(*key, F.explode(hit).alias("rule"))
    for cols in unique:
        twice = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        out = out.unionByName(df.join(twice, list(cols), "left_semi").select(*key, F.lit(f"unique:{','.join(cols)}").alias("rule")))
    for c, (other, name) in (foreign or {}).items():
        known = other.select(F.col(name).alias("_known")).distinct()
        out = out.unionByName(df.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("_known"), "left_anti").select(*key, F.lit(f"foreign:{c}").alias("rule")))
    return out


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds the rows whose key is new; of new rows with one key, the smallest in column order."""
    fresh = rows.join(target.select(*key), key, "left_anti")
    value = F.min(F.struct(*[c for c in target.columns if c not in key])).alias("_v")
    once = fresh.groupBy(*key).agg(value).select(*key, "_v.*") if len(key) < len(target.columns) else fresh.distinct()
    return target.unionByName(once.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key, of several new ones the largest; others are added. One shuffle by key, without a join."""
    rest = [c for c in target.columns if c not in key]
    both = target.select("*", F.lit(0).alias("_g")).unionByName(rows.select(*target.columns, F.lit(1).alias("_g")))
    return both.groupBy(*key).agg(F.max(F.struct("_g", *rest)).alias("_v")).select(*key, *[F.col("_v")[c].alias(c) for c in rest]).select(*target.columns)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The table after an UPDATE; null conditions match nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def compare_and_set(df: DataFrame, writes: DataFrame, key: str, value: str, version: str = "version") -> DataFrame:
    """Writes (key, expected, new) take effect where the version is the expected one, which then grows by one; `applied` tells.

    Of writes with the same key and expectation one can win: the smallest new value, so that reruns agree.
    """
    best = writes.groupBy(F.col(key).alias("_k"), F.col("expected").alias("_e")).agg(F.min("new").alias("_new"))
    done = F.col("_k").isNotNull()
    new = {value: F.when(done, F.col("_new")).otherwise(F.col(value)), version: F.col(version) + done.cast("int")}
    return df.join(best, (df[key] == best["_k"]) & (df[version] == best["_e"]), "left").select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], done.alias("applied"))


def reserve(stock: DataFrame, requests: DataFrame, item: str, have: str, want: str, order: list[str]) -> DataFrame:
    """Requests with `accepted`: one after another, in order, each takes its amount from what its item has left, or is refused and
    takes nothing. Unknown items and null amounts are refused.

    What a request finds depends on the fate of all before it, so an item's requests are one stream in one task; items are
    independent, and a task holds one batch and one number, however many requests an item has.
    """
    rows = requests.join(stock.select(item, F.col(have).alias("_have")), item, "left")
    fields = [*rows.drop("_have").schema.fields, T.StructField("accepted", T.BooleanType())]
    names = rows.columns
    key, amount, has = names.index(item), names.index(want), names.index("_have")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0
        for b in it:
            out = []
            for k, n, h in zip(*(b.column(i).to_pylist() for i in (key, amount, has))):
                now, left = k, left if k == now else h or 0
                out.append(n is not None and n <= left)
                left -= n if out[-1] else 0
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names)) if i != has), pa.array(out, pa.bool_())], names=[f.name for f in fields])

    return rows.repartition(item).sortWithinPartitions(item, *order).mapInArrow(run, T.StructType(fields))


def audit_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, operation, old_row, new_row) of each row that was added, changed or removed; rows as JSON."""
    cols = [c for c in before.columns]
    b = before.select(F.col(key).alias("_k"), F.to_json(F.struct(*cols)).alias("old_row"))
    a = after.select(F.col(key).alias("_k"), F.to_json(F.struct(*cols)).alias("new_row"))
    op = F.when(F.col("old_row").isNull(), "INSERT").when(F.col("new_row").isNull(), "DELETE").otherwise("UPDATE")
    both = b.join(a, "_k", "full").where(~F.col("old_row").eqNullSafe(F.col("new_row")))
    return both.select(F.col("_k").alias(key), op.alias("operation"), "old_row", "new_row")
