"""Scalar functions: SQL functions of a session, and hashes that have no built-in."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register(spark: SparkSession) -> None:
    """The SQL functions, for this session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION celsius_to_fahrenheit(c DOUBLE) RETURNS DOUBLE RETURN c * 9 / 5 + 32")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION line_total(quantity DECIMAL(18,2), price DECIMAL(18,2)) RETURNS DECIMAL(30,2) RETURN quantity * price")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or has length 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column) -> Column:
    """The vector at length 1; one of length 0 is an error."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error("a zero vector has no direction").cast("array<double>"))


def md5_hash(c: Column) -> Column:
    """60 bits of md5 as a long, which SQL engines can compute as well."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


@F.pandas_udf(T.DecimalType(20, 0))
def blake2b_64(s: pd.Series) -> pd.Series:
    """blake2b of 8 bytes, big-endian, of the text."""
    from decimal import Decimal

    return s.map(lambda x: None if x is None else Decimal(int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big")))


@F.pandas_udf(T.StringType())
def canonical_sha256(s: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys and the usual separators."""
    return s.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest())
