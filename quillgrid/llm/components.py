"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut


#: Links are a small part of a corpus: shuffle partitions to a file.
SHARE = 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (the smallest node of its component) of every node that a link touches.

    Alternates the large-star and small-star steps until the links are a star for each
    component, which takes a number of rounds that is logarithmic in the longest path in
    practice. Each step takes the smallest neighbour by a pre-aggregated minimum, so a
    node with very many links is no hot spot, and its result is written to the shared
    folder. Links with a null end are ignored.
    """
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = cut(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), SHARE)
    before = None
    while True:
        # Large star: the larger neighbours of each node move to its smallest neighbour, or itself.
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("least").alias("v"))
        # Small star: the smaller neighbours of each node, and itself, move to the smallest.
        large = cut(large.where(F.col("u") != F.col("v")).distinct(), SHARE)
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut(small.union(least.select("u", F.col("least").alias("v"))).distinct(), SHARE)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())
