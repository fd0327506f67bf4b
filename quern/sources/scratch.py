"""Tables between the steps of an iteration, in the folder that spark.checkpoint.dir names."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables of one run; they cut lineage and outlive lost executors. A temporary folder only where none is set on a local master."""

    def __init__(self, spark: SparkSession, name: str):
        sc = spark.sparkContext
        at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not at:
            at = f"file://{tempfile.mkdtemp(prefix='quern-')}"
            sc.setCheckpointDir(at)
        self.spark, self.root = spark, f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes and rereads; with `by`, a folder for each value, so that a filter on it reads only its folders."""
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before the process
            pass
