"""Retrieval quality: verdicts of cases against ranked results, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as tx


def verdicts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, total, matched_rank, verdict of cases (case_id, query, min_total, max_rank, source, type, fragments) over results (case_id, rank, source, type, title, text).

    A result meets a case if each expectation that is given holds; without any, the first
    result has to match the query and be clean.
    """
    given = F.col("c_source").isNotNull() | F.col("c_type").isNotNull() | (F.size(F.coalesce("fragments", F.array().cast("array<string>"))) > 0)
    mine = cases.select("case_id", "query", "min_total", "max_rank", F.col("source").alias("c_source"), F.col("type").alias("c_type"), "fragments")
    both = mine.join(results, "case_id", "left")
    title = tx.normalize_text(F.col("title"))
    meets = F.coalesce(F.col("source") == F.col("c_source"), F.col("c_source").isNull()) & F.coalesce(F.col("type") == F.col("c_type"), F.col("c_type").isNull())
    meets = meets & F.coalesce(F.forall("fragments", lambda f: F.contains(title, tx.normalize_text(f))), F.lit(True)) & F.col("rank").isNotNull()
    plain = tx.matches_query(F.col("text"), F.col("query")) & ~tx.has_broken_encoding(F.col("text"))
    marked = both.withColumns({"_meets": meets, "_plain": plain, "_given": given})
    sums = marked.groupBy("case_id").agg(
        F.count("rank").alias("total"), F.min(F.when(F.col("_meets"), F.col("rank"))).alias("matched_rank"), F.max(F.when(F.col("rank") == 1, F.col("_plain"))).alias("_first"),
        F.first("_given").alias("_given"), F.first("min_total").alias("min_total"), F.first("max_rank").alias("max_rank"),
    )
    right = F.when(F.col("_given"), F.col("matched_rank") <= F.greatest("max_rank", F.lit(1))).otherwise(F.col("_first"))
    verdict = F.when(F.col("total") < F.greatest("min_total", F.lit(1)), "no_result").when(F.coalesce(right, F.lit(False)), "relevant").otherwise("suspect")
    return sums.select("case_id", "total", F.when(F.col("_given"), F.col("matched_rank")).alias("matched_rank"), verdict.alias("verdict"))


def summary(judged: DataFrame, labels: str = "labels") -> DataFrame:
    """label, cases and each verdict's count; the label "all" is of every case once."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    parts = [F.count("*").alias("cases"), count("relevant"), count("suspect"), count("no_result")]
    each = judged.withColumn("label", F.explode(labels)).groupBy("label").agg(*parts)
    return each.unionByName(judged.agg(*parts).withColumn("label", F.lit("all")))


def round_robin(pool: DataFrame, by: str, id: str) -> DataFrame:
    """pool with turn: the first of each group, then the second, and so on."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(id))
    return pool.withColumn("place", place)


def case_plan(fixed: DataFrame, topics: DataFrame, runs: int) -> DataFrame:
    """case_id, query, kind: the fixed cases (case_id, query) and as many of the distinct topics (query) as make up runs, those of the smallest MD5: the same on every run."""
    left = runs - fixed.count()
    own = fixed.select("case_id", "query", F.lit("fixed").alias("kind"))
    if left <= 0:
        return own
    drawn = topics.select(F.trim("query").alias("query")).where(F.length("query") > 0).distinct().orderBy(F.md5("query"), "query").limit(left)
    number = F.row_number().over(Window.orderBy(F.md5("query"), "query"))  # of at most runs rows
    return own.unionByName(drawn.select(F.concat(F.lit("random-"), number.cast("string")).alias("case_id"), "query", F.lit("random").alias("kind")))


def scenarios(cases: DataFrame, results: DataFrame, most: int) -> DataFrame:
    """case_id, total, matched_rank, reason of cases (case_id, id, source, type, fragments; null: any) over results (case_id, rank, id, source, type, title): the first of the best most results that has the
    id, source and type asked for and any of the fragments in its title."""
    mine = cases.select("case_id", *[F.col(c).alias(f"c_{c}") for c in ("id", "source", "type")], F.filter("fragments", lambda f: F.length(f) > 0).alias("fragments"))
    title = tx.normalize_text(F.col("title"))
    same = lambda c: F.col(f"c_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"c_{c}"), F.lit(False))
    some = F.coalesce(F.size("fragments") <= 0, F.lit(True)) | F.exists("fragments", lambda f: F.contains(title, tx.normalize_text(f)))
    meets = same("id") & same("source") & same("type") & F.coalesce(some, F.lit(False)) & (F.col("rank") <= most)
    sums = mine.join(results, "case_id", "left").groupBy("case_id").agg(F.count("rank").alias("total"), F.min(F.when(meets, F.col("rank"))).alias("matched_rank"))
    reason = F.when(F.col("total") == 0, "no-result").when(F.col("matched_rank").isNotNull(), F.concat(F.lit("matched-top-"), F.col("matched_rank").cast("string"))).otherwise("not-in-top")
    return sums.withColumn("reason", reason)


def rises(results: DataFrame, by: str, rank: str, score: str) -> DataFrame:
    """Rows whose score is above the one before them in their list: none, if each list falls. Rows of one rank are in order of score."""
    before = F.lag(score).over(Window.partitionBy(by).orderBy(rank, score))
    return results.withColumn("before", before).where(F.col(score) > F.col("before"))
