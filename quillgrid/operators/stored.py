"""Tables in files of the shared folder: JSON rows that are scanned and looked up, and facts that are appended and deleted by predicate.

Both are Spark's own text and Parquet files in partitions; there is no table format
beside them. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class JsonRows:
    """Rows as lines of JSON, one row for each key, in partitions by a hash of the key.

    A row that can't be read as JSON of the schema is a row of nulls; rows without a key are left out; of rows that
    repeat a key any one is kept; null fields come back as nulls, and columns that the schema doesn't name are not stored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", parts: int = 16):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path, schema, key, parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.parts)).cast("int").alias("part")

    def replace(self, df: DataFrame) -> None:
        """Writes all rows anew; partitions that get none keep none."""
        rows = df.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        lines = rows.select(self._part(F.col(self.key)), F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])).alias("value"))
        lines.repartition("part").write.mode("overwrite").partitionBy("part").text(self.path)

    def _lines(self) -> DataFrame:
        return self.spark.read.schema("value string, part int").text(self.path)

    def scan(self) -> DataFrame:
        """All rows."""
        return self._lines().select(F.from_json("value", self.schema).alias("row")).select("row.*")

    def lookup(self, value) -> DataFrame:
        """The row of a key. Only its partition is read."""
        return self._lines().where(F.col("part") == self._part(F.lit(value))).select(F.from_json("value", self.schema).alias("row")).select("row.*").where(F.col(self.key) == value)

    def lookups(self, keys: DataFrame) -> DataFrame:
        """The rows of all keys (a column of the same name), each once; partitions that hold none are not read where Spark can tell in time."""
        asked = keys.select(F.col(self.key).alias("_key")).where("_key is not null").distinct().withColumn("_part", self._part(F.col("_key")))
        rows = self._lines().select("part", F.from_json("value", self.schema).alias("row"))
        return rows.join(asked, (F.col("part") == F.col("_part")) & (F.col(f"row.{self.key}") == F.col("_key"))).select("row.*")


class Facts:
    """An append-only table, partitioned by a column of few values (a kind, a day), from which predicates delete."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str):
        self.spark, self.path, self.by = spark, path, by
        self.schema = T.StructType([*[f for f in schema.fields if f.name != by], schema[by]])  # partitions come last

    def rows(self) -> DataFrame:
        at, fs = _hadoop(self.spark, self.path)
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(at) else self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame) -> None:
        """Adds rows, repeated ones too."""
        df.select(*self.schema.names).write.mode("append").partitionBy(self.by).parquet(self.path)

    def delete(self, predicate: Column) -> int:
        """Removes the rows for which predicate is true (not those for which it is null) and returns how many. Partitions without such rows are left as they are.

        The touched partitions' values and counts reach the driver, a row each.
        """
        hit = F.coalesce(predicate, F.lit(False))
        counts = self.rows().groupBy(self.by).agg(F.count_if(hit).alias("gone"), F.count_if(~hit).alias("left")).where("gone > 0").collect()
        if not counts:
            return 0
        some = [c[self.by] for c in counts if c.left]
        if some:
            kept = self.rows().where(F.col(self.by).isin([v for v in some if v is not None]) | (F.col(self.by).isNull() if None in some else F.lit(False))).where(~hit)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
        empty = {str(c[self.by]) for c in counts if not c.left}
        if empty:
            at, fs = _hadoop(self.spark, self.path)
            for status in fs.listStatus(at):
                name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(status.getPath().getName().partition("=")[2])
                if status.isDirectory() and (name in empty or (name == "__HIVE_DEFAULT_PARTITION__" and "None" in empty)):
                    fs.delete(status.getPath(), True)
        return sum(c.gone for c in counts)

    def remove(self) -> None:
        at, fs = _hadoop(self.spark, self.path)
        fs.delete(at, True)


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts with ord, the number of their part: earlier parts go first wherever rows are merged by (ord, id). Columns that a part lacks are null."""
    out = None
    for k, part in enumerate(parts):
        one = part.withColumn("ord", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
