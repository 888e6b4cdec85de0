"""Keyed tables: upserts, replacements, merges and lookups. Plain parquet has no MERGE, so each is a join or a window, written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of keys that new has, and all rows of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def coalesce_upsert(old: DataFrame, new: DataFrame, keys: list[str], sticky: list[str]) -> DataFrame:
    """new over old by key; a null in a sticky column leaves what was there, others are taken as they are."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full")
    taken = F.col("b._new").isNotNull()
    values = [c for c in old.columns if c not in keys]
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in sticky else F.when(taken, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def last_writer(rows: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The last row of each key by arrival, ties by other columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(t) for t in ties]))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first part that has it."""
    both = None
    for k, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(k))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_part"))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_part")


def library_view(items: DataFrame, docs: DataFrame) -> DataFrame:
    """items (item_id, canonical_id) with the document of that id, else of the id without its type; nulls if there is none.

    An OR in the condition would be a nested loop: each form of the key is an equi join of its own, and the full form wins.
    """
    fields = [c for c in docs.columns if c != "id"]
    side = lambda p: docs.select(F.col("id").alias(f"_{p}"), *[F.col(c).alias(f"_{p}_{c}") for c in fields])
    bare = F.regexp_replace("canonical_id", "^[^:]*:", "")
    both = items.join(side("a"), F.col("canonical_id") == F.col("_a"), "left").join(side("b"), (bare == F.col("_b")) & F.col("_a").isNull(), "left")
    pick = lambda c: F.when(F.col("_a").isNotNull(), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c)
    return both.select("item_id", "canonical_id", F.coalesce("_a", "_b").alias("document_id"), *map(pick, fields))


def library_with_seed(items: DataFrame, docs: DataFrame, seed: DataFrame) -> DataFrame:
    """library_view() with every field that the stored document lacks (null) taken from the seed catalogue's document of that id, in either form. Ids of documents are told apart; items may repeat."""
    fields = [c for c in docs.columns if c != "id"]
    side = lambda p: seed.select(F.col("id").alias(f"_{p}"), *[F.col(c).alias(f"_{p}_{c}") for c in fields])
    bare = F.regexp_replace("canonical_id", "^[^:]*:", "")
    both = library_view(items, docs).join(side("s"), F.col("canonical_id") == F.col("_s"), "left").join(side("t"), (bare == F.col("_t")) & F.col("_s").isNull(), "left")
    return both.select("item_id", "canonical_id", F.coalesce("document_id", "_s", "_t").alias("document_id"), *[F.coalesce(c, f"_s_{c}", f"_t_{c}").alias(c) for c in fields])


def override_status(defaults: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """All rows of either; live values where there are any."""
    a, b = defaults.alias("a"), live.alias("b")
    return a.join(b, key, "full").select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in defaults.columns if c != key])


def source_records(docs: DataFrame, id: str = "id") -> DataFrame:
    """id and source_key: one row for each source of a document."""
    others = F.coalesce("alternateSources", F.array().cast("array<string>")) if "alternateSources" in docs.columns else F.array().cast("array<string>")
    return docs.select(id, F.explode(F.array_distinct(F.concat(F.array("source"), others))).alias("source_key"))


def _sql_literal(c: Column, kind: str) -> Column:
    text = c.cast("string") if kind in ("int", "bigint", "double", "smallint") else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """statement: an INSERT of each row, to be written as text."""
    values = F.concat_ws(", ", *[_sql_literal(F.col(n), t) for n, t in df.dtypes])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


def fingerprint(df: DataFrame, id: str, version: str) -> DataFrame:
    """One row: a digest of all ids and versions, without order or collection. It is equal for equal sets of rows."""
    marked = F.concat_ws(":", F.col(id).cast("string"), F.coalesce(F.col(version).cast("string"), F.lit("")))
    each = F.conv(F.substring(F.md5(marked), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(each).alias("digest"))


def diagnostics(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table, in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
