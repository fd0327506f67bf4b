"""What the operators of this subpackage share: the word rule, span finding in SQL functions, and tables in the shared folder.

Null text counts as empty everywhere. Input frames may have further columns: each operator takes the columns that it needs
by name into a frame of its own, and one that returns whole rows adds columns under names that `fresh` finds to be free.
"""

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a Python worker never holds copies of more texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a Python worker gives freed memory back to the system: it lives on for other stages, and would keep it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library has it
            trim(0)

    return tidied


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one is made and set on a local master (tests), and
    anything else is an error: executors would not see each other's files."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables of one operator's run, as Parquet in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._drop, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._drop(f"{self.root}/{name}")

    def _drop(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended before the process; the folder's owner clears it
            pass


def found(text: Column, regex: str, gate: Column | None = None) -> Column:
    """array<struct<s, e, m>>: the leftmost non-overlapping matches of a Java regex, in code points, end exclusive.

    The gaps between matches come from split() and the matches from regexp_extract_all(), so no Python is needed.
    """
    m = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    g = F.split(text, regex, -1)
    pairs = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: F.struct(F.length(a).cast("long").alias("g"), F.length(b).cast("long").alias("l"), b.alias("m")))
    kind = "array<struct<s:bigint,e:bigint,m:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.struct((s + x["l"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["l"]).alias("e"), x["m"].alias("m")))).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    test = text.rlike(regex) if gate is None else gate & text.rlike(regex)
    return F.when(test, spans).otherwise(F.array().cast(kind))


def labelled(spans: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<s, k, e, kind>>, ready to be sorted by start and then by kind."""
    spans = F.filter(spans, keep) if keep else spans
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
