"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

All stages take null and empty texts (one and the same), null ids, repeated rows and further columns of any name, and give an
empty table for an empty one. What each does with them is said below.
"""

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, ngram_join, pieces, quality_classifier
from quern.llm.common import Scratch
from quern.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: a score of 0.3 or more. Each row is judged by its own text, an empty one
    too; without labels of both classes every score is 0.5 or the one class's share, so all rows stay or go alike."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows with that id, one. All empty texts are equal. A null id stays only
    where its group has no other."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles at 0.8 or more connect, the one with the smallest id. Empty texts link with
    nothing and stay; null ids stay; rows that repeat an id stay or go together."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Empty texts have no words to take and go; null ids and the null source take part."""
    return mixing.repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces: one row for each row, null ids too; empty texts have no pieces."""
    return pieces.encode(docs, pieces.read_model(PIECE_MODEL))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
#: None: no stage's model, random rounding or piece table can be written in SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tmp = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = tmp.save(stage(spark, docs, sf_dir), name)
        if i:
            tmp.drop(STAGES[i - 1][0])
    return docs
