"""Readers and writers: tables, wide rows, text corpora, databases, binary objects with a manifest, encrypted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A file table. CSV and JSON need a schema: inferring one would read all files twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), bloom: tuple[str, ...] = ()) -> None:
    """Writes a table; sorted rows and Bloom filters let later point and range reads skip files and row groups."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    w = df.write.format(fmt).mode(mode)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database table; partition is (column, lower, upper, number of parallel reads). TLS and login are driver options."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        c, lo, hi, n = partition
        r = r.options(partitionColumn=c, lowerBound=lo, upperBound=hi, numPartitions=n)
    return r.load()


def corpus(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size_bytes, modified, content) of binary files; columns that a query doesn't use, content above all, aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    d = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return d.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


CONTENT_TYPES = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "json": "application/json"}


def manifest(files: DataFrame, bucket: str) -> DataFrame:
    """A pointer row for each object: (bucket, object_key, file_name, content_type, size_bytes, sha256)."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    kinds = F.create_map(*[x for k, v in CONTENT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    sha = F.sha2("content", 256)
    return files.select(F.lit(bucket).alias("bucket"), F.concat_ws("/", F.substring(sha, 1, 2), sha, name).alias("object_key"), name.alias("file_name"), F.coalesce(kinds[ext], F.lit("application/octet-stream")).alias("content_type"), "size_bytes", sha.alias("sha256"), "path")


def verified(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """The objects behind pointer rows (path, sha256) with `intact`; a missing object is not intact."""
    f = files.select("path", "content", F.sha2("content", 256).alias("_sha"))
    return pointers.join(f, "path", "left").withColumn("intact", F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False))).drop("_sha")


def orphans(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """Objects without a pointer row: what a failed upload leaves and a clean-up removes."""
    return files.select("path", "size_bytes").join(pointers.select("path"), "path", "left_anti")


def encrypted(page: Column, page_id: Column, key: str) -> Column:
    """AES-GCM with a fresh nonce; the page id is authenticated, so a page cannot stand in for another."""
    return F.aes_encrypt(page, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), page_id.cast("string").cast("binary"))


def decrypted(page: Column, page_id: Column, key: str) -> Column:
    """The page, or null where it was changed, moved or encrypted with another key."""
    return F.try_aes_decrypt(page, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), page_id.cast("string").cast("binary"))
