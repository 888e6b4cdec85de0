"""A training corpus from raw documents: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() writes each result as Parquet to the shared folder and
reads it as the next stage's docs, so a lost executor costs one stage's open tasks. Once
the last result is written, those of the stages before it are removed.

Cases, for every stage: an empty table gives an empty result; null and empty texts fail
the quality rules, so none reach later stages; nulls in other columns stay as they are;
repeated rows are judged each by quality, redacted, mixed and encoded each, and dedup
keeps one row for each id and text; ties of near copies go to the smallest id; columns
beyond those of documents are dropped, so none can clash.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, minhash, mixing, pii, quality
from quillgrid.llm.common import cut, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids are broadcast up to this count (8 bytes each, and as much again for the table) and shuffled beyond it.
BROADCAST_IDS = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group. Of rows that repeat an id, it keeps one for each text if any of them is kept."""
    docs = docs.select(*COLUMNS)
    marks = cut(minhash.groups(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone, again = marks.where("not kept").select("doc_id"), marks.where("n > 1").select("doc_id")
    size = marks.agg(F.count_if(~F.col("kept")).alias("gone"), F.count_if(F.col("n") > 1).alias("again")).first()

    def without(df: DataFrame, ids: DataFrame, count: int, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("_id"))
        return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_id")), how)

    left = without(docs, gone, size.gone, "left_anti")
    if not size.again:
        return left
    return without(left, again, size.again, "left_anti").unionByName(without(left, again, size.again, "left_semi").dropDuplicates(["doc_id", "text"]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked probabilities draw."""
    return mixing.mix(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, with digests of them and of the text they decode to."""
    return bpe.encode_documents(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the forest, the signatures or the encoding; tests/llm compares run() with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    for name, _ in STAGES[:-1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return docs
