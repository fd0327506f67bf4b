"""Secret scans over an incremental blob ledger, in SQL functions only.

A blob is a content address (SHA-256 of the text). Every path, a document at some version, points to one blob; a pair of
blob and rule version is scanned once, whatever number of paths have it now or had it earlier. Findings join back to paths.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, found, joined, labelled, text_of

RULES_VERSION = 1
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Rules beside the base ones: kind and pattern, each anchored by a fixed prefix.
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    ("maps_key", r"AIza[A-Za-z0-9_-]{35,}"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<s:bigint,k:int,e:bigint,kind:string>>"
_KIND = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("e", T.LongType()), T.StructField("kind", T.StringType())]))
SCHEMA = T.StructType([T.StructField("blob", T.StringType()), *[T.StructField(c, _KIND) for c in (*BASE, "more")], T.StructField("rules_version", T.IntegerType())])


def no_spans() -> Column:
    return F.array().cast(SPANS)


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _gates(t: Column) -> dict[str, Column]:
    """What a text must hold for a kind to match at all; cheap, and exact."""
    return {
        "assign": (t.contains(":") | t.contains("=")) & t.rlike(ASSIGN),
        "access": t.contains("AKIA") & t.rlike(ACCESS),
        "hex": t.rlike(r"[0-9a-f]{32}"),
        **{k: t.contains({"private_key": "-----BEGIN ", "forge_token": "gh", "chat_token": "xox", "web_token": "eyJ", "maps_key": "AIza"}[k]) & t.rlike(p) for k, p in MORE},
    }


def scan_texts(df: DataFrame) -> DataFrame:
    """(blob, base, more) of (blob, text): base is an array of spans for each base kind in turn, more the other kinds'."""
    t, g = F.col("text"), _gates(F.col("text"))
    assign = labelled(found(t, ASSIGN, g["assign"]), "assign", 0, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    kinds = {"assign": assign, "access": labelled(found(t, ACCESS, g["access"]), "access", 1), "hex": labelled(found(t, HEX, g["hex"]), "hex", 2)}
    more = [labelled(found(t, p, g[k]), k, 3 + i) for i, (k, p) in enumerate(MORE)]
    return df.select("blob", *[c.alias(k) for k, c in kinds.items()], F.concat(*more).alias("more"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules_version: int = RULES_VERSION, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: (blob, rules_version, assign, access, hex, more) of each unseen pair of blob and rule version.

    `ledger` has at least (blob, rules_version); its blobs of this rule version are not scanned again. Texts that no rule
    can match are settled by the gates where they are read; only the others are shuffled, once for each different blob.
    Null texts count as empty; an empty table gives an empty ledger.
    """
    rows = versions.select(text_of(text_col).alias("text")).select(blob_of(F.col("text")).alias("blob"), "text")
    gate = None
    for c in _gates(F.col("text")).values():
        gate = c if gate is None else gate | c
    some = rows.where(gate).groupBy("blob").agg(F.first("text").alias("text"))  # equal blobs meet before they are compared with the ledger
    none = rows.where(~gate).select("blob").distinct()
    if ledger is not None:
        seen = ledger.where(F.col("rules_version") == rules_version).select("blob").distinct()
        some, none = (x.join(seen, "blob", "left_anti") for x in (some, none))
    hits = scan_texts(some)
    return hits.unionByName(none.select("blob", *[no_spans().alias(c) for c in (*BASE, "more")])).withColumn("rules_version", F.lit(rules_version))


def findings_by_path(paths: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules_version: int = RULES_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each path, or version of a path (repeats and null ids included): (doc_id, blob, assign, access, hex, more[, the
    columns in `keep`]) of its blob."""
    p = paths.select(paths[id_col].alias("doc_id"), blob_of(text_of(text_col)).alias("blob"), *keep)
    found_ = ledger.where(F.col("rules_version") == rules_version).where(F.size("assign") + F.size("access") + F.size("hex") + F.size("more") > 0)
    out = p.join(found_.select("blob", *BASE, "more"), "blob", "left")
    return out.select("doc_id", "blob", *[F.coalesce(c, no_spans()).alias(c) for c in (*BASE, "more")], *keep)


class Ledger:
    """The ledger as a table in a shared folder, a folder for each rule version; update() appends what is new.

    A run that fails appends nothing, and one that is repeated finds its blobs there. It outlives sessions, so the next scan
    of a growing history reads texts once to address them and scans only unseen ones.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], SCHEMA)

    def update(self, versions: DataFrame, rules_version: int = RULES_VERSION, text_col: str = "text") -> None:
        new = update_ledger(versions, self.read(), rules_version, text_col)
        new.select(*SCHEMA.names).write.mode("append").partitionBy("rules_version").parquet(self.path)

    def findings(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules_version: int = RULES_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
        return findings_by_path(versions, self.read(), id_col, text_col, rules_version, keep)


def scan(df: DataFrame, ledger: Ledger | None = None, increments: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, assign, access, hex, more), one row for each input row, whose blobs the ledger has afterwards.

    Without a ledger, one is made for this run. With several `increments`, rows come to it in so many steps, by a hash of their id, as a
    history would: each step scans only blobs that no step before has met. Null texts count as empty, repeated rows and null ids
    are paths of their own, and an empty table gives an empty result. Texts are scanned whole, whatever their length, and
    further columns of any name are not read.
    """
    ledger = ledger or Ledger(df.sparkSession, Scratch(df.sparkSession, "secrets").root + "/ledger")
    for k in range(increments):
        ledger.update(df.where(F.pmod(F.xxhash64(df[id_col]), F.lit(increments)) == k) if increments > 1 else df, text_col=text_col)
    return ledger.findings(df, id_col, text_col)


def digest(rows: DataFrame) -> DataFrame:
    base = F.concat(*BASE)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "more")).alias("spans"),
    )
