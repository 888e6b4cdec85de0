"""Term tables, BM25, sparse overlap and dense projections, in long form: one row for each document and term."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import projection
from quillgrid.functions import text as tx
from quillgrid.functions import vectors as vx

#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Rows of the left side of sparse_overlap() that are broadcast, at most.
BROADCAST_TERMS = 200_000


def term_table(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, term, tf of every document's tokens. A pre-aggregated count; documents without tokens have no rows."""
    return docs.select(F.col(id).alias("id"), F.explode(tx.tokenize(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("tf"))


def sparse_table(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """id, term, tf with the weights of the sparse vector: words, pairs, triples and character n-grams."""
    each = docs.select(F.col(id).alias("id"), F.inline(vx.sparse_features(F.col(text))))
    return each.groupBy("id", "term").agg(F.round(F.sum("weight"), 6).alias("tf"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: documents, their mean length, distinct terms. Over all rows given: filters belong after it."""
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("length"))
    vocabulary = terms.agg(F.countDistinct("term").alias("n_terms"))
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")).crossJoin(F.broadcast(vocabulary))


def text_stats(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """corpus_stats() of the documents' tokens from one pass: a row for each distinct token of a text, and one with its length. Nothing is kept by document and term."""
    tokens = docs.select(F.col(id).alias("id"), tx.tokenize(F.col(text)).alias("tokens"))
    # Tokens have two characters at least, so the empty one is free.
    each = tokens.select("id", F.size("tokens").alias("n"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term")).where("term <> '' or n > 0")
    own = lambda c: F.when(F.col("term") == "", F.col(c))
    rows = each.groupBy("term", own("id").alias("id")).agg(F.sum(own("n")).cast("double").alias("length"))
    return rows.agg(F.count_if(F.col("term") == "").alias("n_docs"), F.avg("length").alias("avg_length"), F.count_if(F.col("term") != "").alias("n_terms"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """term, df and cf of every term: rows are distinct by document already, so a count will do."""
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(terms: DataFrame, query: list[str]) -> DataFrame:
    """id and bm25 of the documents that hold a query term.

    One aggregate gives each document's length and its frequencies of the query's terms;
    the corpus statistics are one row over the same exchange.
    """
    wanted = list(dict.fromkeys(query))
    per = terms.groupBy("id").agg(F.sum("tf").alias("length"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"q{i}") for i, t in enumerate(wanted)])
    stats = per.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *[F.count(f"q{i}").alias(f"df{i}") for i in range(len(wanted))])
    score, found = F.lit(0.0), F.lit(False)
    for i in range(len(wanted)):
        tf, df = F.col(f"q{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.coalesce(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg"))), F.lit(0.0))
        found = found | tf.isNotNull()
    return per.where(found).crossJoin(F.broadcast(stats)).select("id", score.alias("bm25"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by an order: planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def sparse_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b and overlap (weighted Jaccard) of all pairs that share a term.

    The minima come from an equi join on the term; the maxima are both totals less the minima. If right's rows lie by id and left is small,
    nothing is shuffled.
    """
    if left.count() <= BROADCAST_TERMS:
        left = F.broadcast(left)
    total = lambda t, n, s: t.groupBy("id").agg(F.sum("tf").alias(s)).withColumnRenamed("id", n)
    pairs = left.select(F.col("id").alias("a"), "term", F.col("tf").alias("x")).join(right.select(F.col("id").alias("b"), "term", F.col("tf").alias("y")), "term")
    least = pairs.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("least"))
    both = least.join(total(left, "a", "ta"), "a").join(total(right, "b", "tb"), "b")
    return both.select("a", "b", (F.col("least") / (F.col("ta") + F.col("tb") - F.col("least"))).alias("overlap"))


def dense_projection(docs: DataFrame, dims: int, id: str = "id", text: str = "text") -> DataFrame:
    """id, bucket, value of each text's hashed projection at length 1, zeros left out. One pass, no shuffle."""

    @F.pandas_udf("array<struct<bucket:long,value:double>>")
    def buckets(normal: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            v = projection.dense_vector(t, dims)
            return [{"bucket": int(i), "value": float(v[i])} for i in np.flatnonzero(v)]

        return normal.map(one)

    return docs.select(F.col(id).alias("id"), F.inline(buckets(tx.normalize_text(F.col(text)))))


def _expandable(term: str, least: int) -> Column:
    """Whether a term may stand for what holds it, or what it is held by: a phrase, Hangul of two characters, or a long word."""
    return F.contains(term, F.lit(" ")) | (F.col(term).rlike(tx.HANGUL) & (F.length(term) >= 2)) | (F.length(term) >= least)


def _pieces(c: str) -> Column:
    """All substrings of two to four characters, each once."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3), of(4)))


def expand_terms(terms: DataFrame, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """term and expansion: itself, and the groups of lexicon keys that it is, holds or is held by.

    lexicon: key, words (its group) and blocked (neither a blocked key nor a term that is one holds or is held).
    Containment is an equi join: whatever holds a text has its first characters, four at most, among its own
    substrings of that length, and only such pairs are compared. So either side may be large. Null and empty terms are left out;
    repeated terms and keys count once, a key's groups together.
    """
    left = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    keys = lexicon.where(F.length("key") > 0).groupBy("key").agg(F.max("blocked").alias("blocked"))
    held = left.join(keys.where("blocked").select(F.col("key").alias("term")), "term", "left_anti").where(_expandable("term", 10))
    holding = keys.where("not blocked").where(_expandable("key", 4)).select("key")
    head = lambda c: F.substring(F.col(c), F.lit(1), F.least(F.length(c), F.lit(4)))
    long = lambda df, c: df.where(F.length(c) >= 2)
    wide = left.select("term", F.explode(_pieces("term")).alias("piece")).join(long(holding, "key").select("key", head("key").alias("piece")), "piece").where(F.contains("term", F.col("key")))
    narrow = long(held, "term").select("term", head("term").alias("piece")).join(keys.select("key", F.explode(_pieces("key")).alias("piece")), "piece").where(F.contains("key", F.col("term")))
    same = left.join(keys.select(F.col("key").alias("term"), "key"), "term")
    pairs = wide.select("term", "key").unionByName(narrow.select("term", "key")).unionByName(same.select("term", "key")).distinct()
    found = pairs.join(lexicon.select("key", F.explode("words").alias("expansion")), "key").select("term", "expansion")
    return found.unionByName(left.select("term", F.col("term").alias("expansion"))).distinct()
