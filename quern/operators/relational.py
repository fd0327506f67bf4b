"""Scans, filters, projections, limits, joins and aggregates, each a thin guard around a DataFrame plan.

The guards keep what an explicit operator tree would check (column names, limits, key types); the plan itself is left to
Catalyst, which prunes columns, pushes filters into the scan and picks the join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def from_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """A frame of row dicts; an empty list needs a schema."""
    return spark.createDataFrame(rows, schema)


def from_columns(spark: SparkSession, columns: dict[str, list], batch_size: int = 1024) -> DataFrame:
    """A frame of equally long columns, as Arrow. batch_size is only checked: Spark sizes its own batches."""
    import pyarrow as pa

    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(pa.table(columns))


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter; a condition that isn't boolean is refused when the plan is analysed."""
    return df.where(condition)


def compare(column: str, op: str, value) -> Column:
    """A predicate from an allow-list of operators; comparison with None is never true."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    return F.lit(False) if value is None else getattr(F.col(column), OPS[op])(F.lit(value))


def project(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)
    return df.select(*columns)


def limit(df: DataFrame, n: int) -> DataFrame:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("limit must be an integer of 0 or more")
    return df.limit(n)


def page(df: DataFrame, order: list[Column], skip: int = 0, size: int | None = None) -> DataFrame:
    """Sorted rows from `skip` on; with a size Spark keeps only skip + size rows a partition."""
    out = df.orderBy(*order).offset(skip) if skip else df.orderBy(*order)
    return out if size is None else out.limit(size)


def hash_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", build: str | None = None) -> DataFrame:
    """Equi join on one column. `build` ("left" or "right") asks for a hash table of that side, shuffled, never broadcast."""
    for side in (left, right):
        if key not in side.columns:
            raise KeyError(key)
        if not isinstance(side.schema[key].dataType, T.AtomicType):
            raise ValueError("join keys must be scalars")
    if build == "left":
        left = left.hint("shuffle_hash")
    elif build == "right":
        right = right.hint("shuffle_hash")
    return left.join(right, key, how)


def join_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_index, right_index) of all pairs with equal keys."""
    r = right.select(F.col(key).alias("_k"), F.col(right_id).alias("right_index"))
    return left.select(F.col(key).alias("_k"), F.col(left_id).alias("left_index")).join(r, "_k").select("left_index", "right_index")


def average(df: DataFrame, column: str, minimum=None) -> DataFrame:
    """One row with the average of the values of at least `minimum`; null where nothing qualifies. Reads one column."""
    d = df.select(column)
    return (d if minimum is None else d.where(F.col(column) >= minimum)).agg(F.avg(column).alias(f"avg_{column}"))


def digest(df: DataFrame, column: str) -> DataFrame:
    """md5 over the sorted values of a column, to show that two plans return the same rows. One group: for small results only."""
    return df.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col(column).cast("string"), 20, "0"))), ",")).alias("digest"))


def order_digest(df: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): the same purpose at any size, as a sum of row hashes that needs no order and combines before the shuffle."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def bound_sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """SQL with parameters; values are bound and never become part of the text."""
    return spark.sql(text, args=args)


ROLES = {"reader": {"read"}, "writer": {"read", "write"}, "admin": {"read", "write", "manage"}}


def authorize(role: str, permission: str, roles: dict[str, set[str]] | None = None) -> None:
    """Refuses what the role doesn't hold; an unknown role holds nothing."""
    if permission not in (roles or ROLES).get(role, set()):
        raise PermissionError(f"role {role!r} has no permission {permission!r}")
