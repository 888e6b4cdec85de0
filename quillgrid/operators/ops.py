"""Operational aggregates: caches, logs, alerts, detail health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_queries(lookups: DataFrame, most: int | None = None) -> DataFrame:
    """For each query (trimmed, lower case) of lookups (query, source, kind, at) its hits, misses, sets, sources and last time; the most looked up first."""
    is_ = lambda kind: F.count_if(F.col("kind") == kind)
    out = lookups.groupBy(F.lower(F.trim("query")).alias("query")).agg(
        F.count_if(F.col("kind").isin("hit", "miss")).alias("lookups"), is_("hit").alias("hits"), is_("miss").alias("misses"), is_("set").alias("sets"), F.countDistinct("source").alias("sources"), F.max("at").alias("last_seen")
    )
    out = out.orderBy(F.desc("lookups"), F.desc("hits"), "query")
    return out.limit(most) if most else out


def cache_state(lookups: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """key, set_at and state (fresh or stale) of the latest entry of each key."""
    sets = lookups.where(F.col("kind") == "set").groupBy(F.concat_ws("::", "source", "query").alias("key")).agg(F.max("at").alias("set_at"))
    age = F.unix_timestamp(now) - F.unix_timestamp("set_at")
    return sets.withColumn("state", F.when(age > ttl_seconds, "stale").otherwise("fresh"))


def request_alerts(log: DataFrame, last: int = 20) -> DataFrame:
    """One row: server errors in the last requests (id, status), and a level: critical from three, warning from one."""
    recent = log.orderBy(F.desc("id")).limit(last)
    errors = F.count_if(F.col("status") >= 500)
    return recent.agg(F.count("*").alias("requests"), errors.alias("errors")).withColumn("level", F.when(F.col("errors") >= 3, "critical").when(F.col("errors") > 0, "warning").otherwise("clear"))


def grade(count: Column, total: Column, healthy: float = 0.75) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), count / F.greatest(total, F.lit(1))))
    return F.when(ratio >= healthy, "healthy").when(count > 0, "degraded").otherwise("unavailable")


def metadata_availability(docs: DataFrame, fields: list[str]) -> Column:
    """How many fields of a document are there: not null, not blank, not an empty list."""
    kinds = dict(docs.dtypes)
    there = lambda f: (F.size(f) > 0) if kinds[f].startswith("array") else (F.trim(F.col(f).cast("string")) != "")
    return sum((F.coalesce(there(f), F.lit(False)).cast("int") for f in fields), F.lit(0))


def impact(citations: Column, links: Column, year: Column) -> Column:
    """At most 99: citations, edges of citation, and a recent year."""
    return F.least(F.lit(99), F.floor(0.35 * citations + 4 * links + F.when(year >= 2024, 10).otherwise(0) + 0.5)).cast("int")


def severity(df: DataFrame, *candidates: str) -> Column:
    """The first severity there is."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit("UNKNOWN"))
