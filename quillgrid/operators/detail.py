"""One document's page: neighbours, health of its sections, insights and a comparison matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators import graph, ops

#: Sections of a page, with how many entries make them whole.
SECTIONS = {"references": 4, "cited_by": 4, "similar": 3, "author_affinity": 2, "topic_bridge": 2, "paths": 4}


def section_health(edges: DataFrame, id: str, most: int = 8) -> DataFrame:
    """section, entries, total, ratio, status of a document's page, and a last row "all" with the mean ratio."""
    kinds = graph.neighbourhood(edges, id, most).where("direction = 'out'").groupBy(F.col("edge_type").alias("section")).agg(F.count("*").alias("entries"))
    paths = graph.traversal(edges, id, most).where("hops = 2").agg(F.count("*").alias("entries")).select(F.lit("paths").alias("section"), "entries")
    wanted = edges.sparkSession.createDataFrame(list(SECTIONS.items()), "section string, total int")
    found = wanted.join(F.broadcast(kinds.unionByName(paths)), "section", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    graded = found.withColumns({"ratio": F.round(F.least(F.lit(1.0), F.col("entries") / F.col("total")), 4), "status": ops.grade(F.col("entries"), F.col("total"))})
    whole = graded.agg(F.sum("entries").alias("entries"), F.sum("total").alias("total"), F.round(F.avg("ratio"), 4).alias("ratio"), F.bool_and(F.col("status") == "healthy").alias("ok"))
    return graded.select("section", "entries", "total", "ratio", "status").unionByName(whole.select(F.lit("all").alias("section"), "entries", F.col("total").cast("int").alias("total"), "ratio", F.when(F.col("ok"), "healthy").otherwise("degraded").alias("status")))


def comparison_matrix(docs: DataFrame, edges: DataFrame, id: str, most: int = 2) -> DataFrame:
    """For the heaviest neighbours of some kinds: shared keywords, and whether year, source and region agree."""
    kinds = ("references", "cited_by", "similar")
    near = graph.neighbourhood(edges, id, most).where(F.col("direction") == "out").where(F.col("edge_type").isin(*kinds))
    side = docs.select(F.col("id").cast("string").alias("neighbour"), "title", "keywords", "year", "source", "region")
    own = docs.where(F.col("id").cast("string") == id).select(*[F.col(c).alias(f"own_{c}") for c in ("keywords", "year", "source", "region")])
    both = near.join(side, "neighbour").join(F.broadcast(own), F.lit(True))
    same = lambda c: (F.col(c) == F.col(f"own_{c}")).alias(f"same_{c}")
    return both.select("edge_type", "neighbour", "title", "weight", F.array_intersect("keywords", "own_keywords").alias("shared"), same("source"), same("region"), (F.col("year") - F.col("own_year")).alias("years_apart"))


def merged_paths(stored: DataFrame, derived: DataFrame, most: int) -> DataFrame:
    """Paths (via, target, weight) of both, the stored ones first, one for each via and target."""
    both = stored.select("via", "target", "weight", F.lit(0).alias("p")).unionByName(derived.select("via", "target", "weight", F.lit(1).alias("p")))
    first = F.row_number().over(Window.partitionBy("via", "target").orderBy("p", F.desc("weight")))
    return both.withColumn("r", first).where("r = 1").orderBy("p", F.desc("weight"), "via", "target").limit(most).select("via", "target", "weight")


def graph_or_heuristic(stored: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Of edges by type: the stored ones where there are any, else the heuristic ones."""
    missing = heuristic.join(stored.select("edge_type").distinct(), "edge_type", "left_anti")
    return stored.unionByName(missing)


#: Points of citations, of neighbours and of a recent year, the most of them, and how many related documents a page shows.
CITED, NEIGHBOUR, RECENT, MOST_IMPACT, RELATED = 0.35, 4, 10, 99, 4


def lists_of(stored: DataFrame, heuristic: DataFrame, most: int = graph.NEIGHBOURS) -> DataFrame:
    """p_id, side, rank, id, kept (whether stored): each paper's references and citations. For each paper and side the stored edges' (source_id, target_id, edge_type references or cited_by, weight), the
    heaviest first, if there are any, else the heuristic neighbourhood's (p_id, side, rank, id). Which it is, is a join by counts, for all papers at once."""
    kind = F.when(F.col("edge_type") == "references", "references").when(F.col("edge_type") == "cited_by", "citations")
    own = stored.select(F.col("source_id").alias("p_id"), kind.alias("side"), F.col("target_id").alias("id"), "weight").where("side is not null").groupBy("p_id", "side", "id").agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("p_id", "side").orderBy(F.desc("weight"), "id"))
    own = own.withColumn("rank", rank).where(F.col("rank") <= most).select("p_id", "side", "rank", "id", F.lit(True).alias("kept"))
    counts = own.groupBy("p_id", "side").agg(F.count("*").alias("n"))
    other = heuristic.join(counts, ["p_id", "side"], "left_anti").select("p_id", "side", "rank", "id", F.lit(False).alias("kept"))
    return own.unionByName(other)


def pages(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """One row for each document: its references and citations in order (lists of at most a page's length), whether they are stored, related documents (the first of citations, then references), impact and freshness.
    A document without either has empty lists; one without year or citations is not recent and has none."""
    ordered = lambda side, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", what)))), lambda x: x[what])
    kept = lambda side: F.coalesce(F.bool_or(F.when(F.col("side") == side, F.col("kept"))), F.lit(False))
    sides = ("references", "citations")
    per = lists.groupBy("p_id").agg(*[ordered(s, "id").alias(s) for s in sides], *[kept(s).alias(f"{s}_stored") for s in sides]).withColumnRenamed("p_id", "id")
    empty = F.array().cast(per.schema["references"].dataType)
    out = docs.select("id", F.coalesce("citations", F.lit(0)).alias("cited"), F.coalesce("year", F.lit(0)).alias("year")).join(per, "id", "left")
    out = out.withColumns({**{s: F.coalesce(s, empty) for s in sides}, **{f"{s}_stored": F.coalesce(f"{s}_stored", F.lit(False)) for s in sides}})
    size = F.size("references") + F.size("citations")
    impact = F.least(F.lit(MOST_IMPACT), F.floor(F.col("cited") * CITED + size * NEIGHBOUR + F.when(F.col("year") >= 2024, RECENT).otherwise(0) + 0.5)).cast("int")
    related = F.slice(F.array_distinct(F.concat("citations", "references")), 1, RELATED)
    return out.select("id", *sides, *[f"{s}_stored" for s in sides], related.alias("related"), impact.alias("impact"), (F.col("year") >= 2024).alias("fresh"))
