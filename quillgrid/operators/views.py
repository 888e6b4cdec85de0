"""Rows as results and pages show them: selections with defaults, rounding and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators import scoring
from quillgrid.schema import TYPES

#: Decimals of each part of a score.
DECIMALS = {"lexical": 2, "dense": 4, "sparse": 4, "bm25": 4, "title_coverage": 4, "keyword_coverage": 4, "semantic_title_coverage": 4, "phrase_coverage": 4, "passage": 4}
SORTS = {"latest": "newest", "citation": "most cited"}


def rounded(c: Column, decimals: int) -> Column:
    """c to so many decimals, of the halves of its binary value: F.round() rounds what it prints as, so 7.975, which is less, would go up."""
    return F.round(c * 10**decimals) / 10**decimals


def kind_of(type: Column) -> Column:
    """A known type, else paper."""
    return F.when(type.isin(*TYPES), type).otherwise("paper")


def origin(region: Column, language: Column) -> Column:
    """The country that a region or language suggests: KR, INTL or nothing."""
    region, language = F.lower(F.coalesce(region, F.lit(""))), F.lower(F.coalesce(language, F.lit("")))
    return F.when((region == "domestic") | (language == "ko"), "KR").when(region == "global", "INTL").otherwise("")


def search_rows(found: DataFrame, sort: str = "relevance") -> DataFrame:
    """Scored documents as search results: rank, id, score, parts rounded to DECIMALS, match, and the document's own columns. found is a page of results: a single task ranks it."""
    have = found.columns
    ranked = found.withColumn("match", scoring.match_sort_score(found)).withColumn("rank", F.row_number().over(Window.orderBy(*scoring._keys(sort), F.asc("id"))))
    parts = [rounded(F.coalesce(F.col(n), F.lit(0.0)), d).alias(n) if n in have else F.lit(0.0).alias(n) for n, d in DECIMALS.items()]
    own = [F.col(c) for c in ("title", "year", "region", "source", "citations", "organization") if c in have]
    sources = F.col("alternateSources") if "alternateSources" in have else F.array("source")
    language = F.col("language") if "language" in have else F.lit("")
    return ranked.select("rank", "id", rounded(F.col("total"), 2).alias("score"), *parts, "match", kind_of(F.col("type")).alias("type"), *own, F.coalesce(language, F.lit("")).alias("language"), F.upper(F.coalesce(language, F.lit(""))).alias("language_label"), origin(F.col("region"), language).alias("country"), sources.alias("sources"))


def detail_rows(docs: DataFrame) -> DataFrame:
    """Documents as a page's head shows them: every field with its default, which is an empty text, list or map, 0 citations, no open access, region "all", and the document's own source as the only one; a year of 0 is none."""
    have = docs.columns
    texts = ("title", "englishTitle", "organization", "language", "summary", "abstract", "novelty")
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c)
    lists = lambda c: (F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")).alias(c)
    only = F.array("source")
    return docs.select(
        F.coalesce(F.col("canonicalId"), F.col("id").cast("string")).alias("id") if "canonicalId" in have else F.col("id").cast("string").alias("id"), kind_of(F.col("type")).alias("type"),
        (F.coalesce("sourceLabel", "source") if "sourceLabel" in have else F.col("source")).alias("source"), F.col("source").alias("source_key"), *map(text, texts), F.nullif(F.col("year"), F.lit(0)).alias("year"),
        F.coalesce("citations", F.lit(0)).alias("citations"), (F.coalesce("openAccess", F.lit(False)) if "openAccess" in have else F.lit(False)).alias("open_access"), F.coalesce(F.nullif(F.col("region"), F.lit("")), F.lit("all")).alias("region"),
        *map(lists, ("authors", "keywords", "methods", "highlights")), (F.coalesce("alternateSources", only) if "alternateSources" in have else only).alias("sources"),
        (F.coalesce("links", F.create_map().cast("map<string,string>")) if "links" in have else F.create_map().cast("map<string,string>")).alias("links"),
    )


def filters(region: str = "all", kind: str = "all", sort: str = "relevance") -> str:
    """Filters in words, for the head of a list of results."""
    return " · ".join(("every region" if region == "all" else region, "every type" if kind == "all" else kind, SORTS.get(sort, "most relevant")))
