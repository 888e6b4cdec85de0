"""The background job queue as tables: enqueue, lease, complete, fail, requeue, and the state that a log of transitions leads to.

States go queued, leased, completed or failed. An expired lease returns to the queue if
reclaim() is called; leasing itself never takes one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS, REQUEUE_SECONDS = 15, 5
NEXT = {"enqueue": "queued", "lease": "leased", "complete": "completed", "fail": "failed", "requeue": "queued"}


def lease_order(jobs: DataFrame, now, most: int | None = None) -> DataFrame:
    """Queued jobs that may run, in the order they are leased: priority, then id."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now)).orderBy(F.desc("priority"), "id")
    return ready.limit(most) if most else ready


def lease(jobs: DataFrame, now, most: int = 1) -> DataFrame:
    """jobs with the next ones leased."""
    chosen = lease_order(jobs, now, most).select(F.col("id").alias("_id"))
    hit = F.col("_id").isNotNull()
    until = now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))
    out = jobs.join(F.broadcast(chosen), F.col("id") == F.col("_id"), "left")
    return out.withColumns({"status": F.when(hit, "leased").otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("int"), "leased_until": F.when(hit, until).otherwise(F.col("leased_until"))}).drop("_id")


def reclaim(jobs: DataFrame, now) -> DataFrame:
    """jobs with expired leases queued again, to run after a pause."""
    late = (F.col("status") == "leased") & (F.col("leased_until") < now)
    return jobs.withColumns({"run_after": F.when(late, now + F.make_dt_interval(secs=F.lit(REQUEUE_SECONDS))).otherwise(F.col("run_after")), "status": F.when(late, "queued").otherwise(F.col("status"))})


def states(log: DataFrame) -> DataFrame:
    """id, status, attempts, updated_at of each job from its transitions (id, seq, at, action): the last one decides."""
    status = F.element_at(F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv]), F.col("action"))
    return log.groupBy("id").agg(F.max_by(status, F.struct("at", "seq")).alias("status"), F.count_if(F.col("action") == "lease").alias("attempts"), F.max("at").alias("updated_at"))


def state_counts(jobs: DataFrame) -> DataFrame:
    """For each type its jobs by state, failures, and the latest job's state."""
    return jobs.groupBy("job_type").agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status").isin("queued", "leased", "running")).alias("pending"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by("status", F.struct("updated_at", "id")).alias("latest"),
    )


def recurring(hot: DataFrame, most: int = 3) -> DataFrame:
    """Jobs to enqueue in each round: a prewarm of the hottest queries (query, lookups), and the fixed ones."""
    rank = F.row_number().over(Window.orderBy(F.desc("lookups"), "query"))
    top = hot.orderBy(F.desc("lookups"), "query").limit(most)
    warm = top.select(F.lit("cache-prewarm").alias("job_type"), F.col("query").alias("payload"), (10 - rank).cast("int").alias("priority"))
    fixed = [("graph-refresh", "", 5), ("source-health-check", "", 4), *(("live-search-sync", s, 3) for s in ("arxiv", "pubmed", "kci", "riss"))]
    return warm.unionByName(hot.sparkSession.createDataFrame(fixed, "job_type string, payload string, priority int"))
