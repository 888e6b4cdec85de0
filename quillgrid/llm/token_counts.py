"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed changes.

A change inserts a document's count, deletes it or revises it. A batch of changes
becomes one row of signed sums for each key. Committing a batch writes its sums aside and
moves them into the batch's folder under a name of their own, as one attempt. Totals are
sums over the first attempt of each batch, so they never read documents again, and a batch
counts once however often it is sent, also by rivals at the same time: an attempt that
finds an earlier one beside it removes itself, and one that is still there is not read. A
name stands for the same changes each time. Moving a folder must be atomic, as it is on
HDFS and local disks.

A tokenizer version is a pattern, each match of which is a token, or the file of a word
BPE tokenizer, which the automaton of bpe.py encodes with. Counting is one pass over the
texts for all versions.

Cases: null and empty texts count as documents with no tokens; null source or language
is a key of its own; repeated rows count, are deleted and are revised each; a null doc_id
has no label; a key whose documents and tokens are all gone has no row; an empty batch
can be committed; other columns are ignored.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import pii
from quillgrid.llm.bpe import WordTokenizer, default_path
from quillgrid.llm.common import WORD, bounded_batches, cut, shared_dir, table, trim_memory

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
#: Ids of documents to revise are broadcast up to this count and shuffled beyond it.
BROADCAST_IDS = 2_000_000


def versions() -> dict[str, str]:
    """What each tokenizer version of the query counts: the plain words, and the tokens of a public vocabulary."""
    return {"words-1": WORD, "word-bpe-49k": default_path()}


def counter(spec: str):
    """The number of tokens of a text."""
    if spec.endswith(".json"):
        return WordTokenizer(spec).count_of
    if spec == WORD:  # bytes.split() splits at exactly the characters between words
        return lambda text: len(text.encode("utf-8", "surrogatepass").split())
    pattern = regex.compile(spec)
    return lambda text: sum(1 for _ in pattern.finditer(text))


def measured(docs: DataFrame, of: Mapping[str, str], texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, source, lang, tokenizer and a count named as each of the columns texts: a row for each document and version, from one scan."""
    names = [f"n_{t}" for t in texts]
    schema = ", ".join(["doc_id long, source string, lang string, tokenizer string", *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {v: counter(spec) for v, spec in of.items()}
        for batch in batches:
            bodies = [[x or "" for x in batch.column(t).to_pylist()] for t in texts]
            keys = [batch.column(c) for c in ("doc_id", "source", "lang")]
            for v, count in counters.items():
                yield pa.RecordBatch.from_arrays([*keys, pa.array([v] * batch.num_rows, pa.string()), *(pa.array(list(map(count, b)), pa.int64()) for b in bodies)], ["doc_id", "source", "lang", "tokenizer", *names])
        counters.clear()
        trim_memory()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), *texts).mapInArrow(run, schema)


def counted(docs: DataFrame, of: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens."""
    return measured(docs, of or versions()).withColumnRenamed("n_text", "tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(1), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(-1), -F.col("tokens"))


def revisions(counts: DataFrame, new: Column) -> DataFrame:
    """Counts whose tokens are replaced by new, row by row."""
    return _signed(counts, F.lit(0), new - F.col("tokens"))


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


class RollupStore:
    """Committed batches of signed sums in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/committed"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def committed(self, batch: str) -> bool:
        return bool(self._names(f"{self.folder}/committed/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sums the changes and commits them under a name; False, and nothing is changed, if that name is committed."""
        if self.committed(batch):
            return False
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS]).write.parquet(aside)
        home, mine = f"{self.folder}/committed/{batch}", f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(home))
        if not self._fs.rename(self._path(aside), self._path(f"{home}/{mine}")):
            raise OSError(f"{aside} could not be moved to {home}")
        if self._names(home)[0] != mine:  # a rival was first
            self._fs.delete(self._path(f"{home}/{mine}"), True)
            return False
        return True

    def totals(self) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        home = f"{self.folder}/committed"
        first = [f"{home}/{batch}/{names[0]}" for batch in self._names(home) if (names := self._names(f"{home}/{batch}"))]
        rows = self.spark.read.schema(schema).parquet(*first) if first else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_token_counts: every document is inserted; those labelled bad are deleted; the others labelled toxic are revised to the counts of their text without personal data. The first batch is then sent again."""
    store = RollupStore(spark, os.path.join(shared_dir(spark), f"rollup-{uuid.uuid4().hex}"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = cut(counted(docs))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"), (F.max("toxic") == 1).alias("toxic"))
    bad = labels.where("bad").select("doc_id")
    toxic = cut(labels.where("toxic and not coalesce(bad, false)").select("doc_id"))
    toxic = F.broadcast(toxic) if toxic.count() <= BROADCAST_IDS else toxic
    old = docs.join(toxic, "doc_id", "left_semi").withColumn("old", F.col("text"))
    both = measured(pii.redact(old), versions(), ("old", "text")).withColumnRenamed("n_old", "tokens")
    batches = {"load": inserts(counts), "bad": deletes(counts.join(bad, "doc_id", "left_semi")), "toxic": revisions(both, F.col("n_text"))}
    for name, changes in [*batches.items(), ("load", batches["load"])]:
        store.commit(name, changes)
    return store.totals()


#: DuckDB SQL of the totals for a tokenizer version that is a pattern, without revisions; tests/llm uses it. The public vocabulary's tokens aren't SQL.
PATTERN_ORACLE = r"""with l as (select doc_id, min(quality) as quality from labels group by doc_id),
d as (select d.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w from documents d left join l using (doc_id) where coalesce(quality, 1) <> 0)
select source, lang, 'words-1' as tokenizer, count(*) as n_docs, cast(sum(w) as bigint) as n_tokens from d group by all"""
