"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters between words: space, and the control characters 9 to 13. bytes.split() splits at exactly these.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1_000
#: A run of anything else is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one under the warehouse if that is unset (tests, notebooks)."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        have = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(have)
    return have


def cut(df: DataFrame, share: int = 1) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and a lost executor costs nothing that was written.

    share: for what is a small part of the corpus, such as links, one file for so many shuffle partitions; a file costs
    several calls to the file system, and at least 16 tasks remain.
    """
    shared_dir(df.sparkSession)
    if share > 1:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(16, partitions // share))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a compressed columnar table in the shared folder. Unlike cut(), columns can be pruned when it is read."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Tables of one computation in a folder of their own under the shared one, and their removal once a later table rests on none of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.made = spark, os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}"), 0

    def put(self, df: DataFrame) -> DataFrame:
        """df, written and read back."""
        self.made += 1
        at = f"{self.path}/{self.made}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def in_order(df: DataFrame, keys: list[str], folder: Folder, sums: tuple[str, ...] = (), named: tuple[str, ...] = ()) -> DataFrame:
    """df with at, the number of a row (from 0) in the order of keys; name, the dense rank (from 1) of its first keys, those in named; and, in place of each of sums, its running total up to and with that row.

    Rows are dealt by ranges of keys and sorted within; each task numbers its own, and what lies before a task comes from
    one row a task, which alone reaches the driver and is broadcast. No task sees more than its range, and rows of equal
    named keys may lie in several: the keys together should tell rows apart.
    """
    taken = [f for f in df.schema.fields if f.name not in sums]
    schema = T.StructType([*taken, *(T.StructField(n, T.LongType()) for n in ("_task", "at", "_rank", *sums))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, rank, last, totals = TaskContext.get().partitionId(), 0, 0, None, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            of = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            columns = [of(f.name) for f in taken]
            new = np.zeros(n, np.int64)
            for k in named:
                new[1:] |= pc.not_equal(of(k)[1:], of(k)[:-1]).to_numpy(zero_copy_only=False)
            new[0] = [of(k)[0] for k in named] != last
            ranks, last = rank + np.cumsum(new), [of(k)[n - 1] for k in named]
            rank = int(ranks[-1])
            columns += [pa.array(np.full(n, task, np.int64)), pa.array(np.arange(seen, seen + n)), pa.array(ranks)]
            for s in sums:
                got = totals[s] + np.cumsum(of(s).to_numpy(zero_copy_only=False).astype(np.int64))
                totals[s] = int(got[-1])
                columns.append(pa.array(got))
            seen += n
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    made = folder.put(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    ends = F.struct(*named) if named else F.lit(0)
    tasks = made.groupBy("_task").agg(F.max("at").alias("at"), F.max("_rank").alias("_rank"), F.min_by(ends, "at").alias("first"), F.max_by(ends, "at").alias("last"), *(F.max(s).alias(s) for s in sums)).orderBy("_task").collect()
    before, last, rows = dict.fromkeys(("at", "_rank", *sums), 0), None, []
    for t in tasks:
        before["_rank"] -= t["first"] == last  # a key that goes on from the task before
        rows.append((t._task, *before.values()))
        before = {"at": before["at"] + t["at"] + 1, **{s: before[s] + t[s] for s in ("_rank", *sums)}}
        last = t["last"]
    offsets = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in ("_task", *(f"_{n}" for n in before))]))
    joined = made.join(F.broadcast(offsets), "_task")
    return joined.select(*[f"`{f.name}`" for f in taken], *((F.col(n) + F.col(f"_{n}")).alias("name" if n == "_rank" else n) for n in before if named or n != "_rank"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate that sends a single number to the driver. It sizes partitions, never cuts data."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows in an Arrow batch to BATCH_ROWS: of texts, Spark's 10,000 rows are tens of MB in the JVM and again in Python, for each running task."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def trim_memory() -> None:
    """Gives a Python worker's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def hex_fraction(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a key: the same on every engine and in every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
