"""Hashes, feature weights and vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import text as tx

#: Offset and prime of 32-bit FNV-1a, and the modulus.
FNV_OFFSET, FNV_PRIME, WORD32 = 2166136261, 16777619, 4294967296


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code points of a text without astral characters."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.when(c == "", F.lit(FNV_OFFSET).cast("long")).otherwise(
        F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(FNV_PRIME), F.lit(WORD32)))
    )


def bucket(c: Column, dims: int) -> Column:
    """The hash as a signed number, without its sign, modulo dims."""
    h = fnv1a(c)
    return F.pmod(F.least(h, F.lit(WORD32) - h), F.lit(dims))


def sparse_features(c: Column) -> Column:
    """(term, weight): words 1, pairs 1.75, triples 2.2, and character n-grams 0.2 if the compact text has four characters."""
    tokens = tx.tokenize(c)
    weight = lambda items, w, p="": F.transform(items, lambda t: F.struct(F.concat(F.lit(p), t).alias("term"), F.lit(w).alias("weight")))
    none = F.array().cast("array<struct<term:string,weight:double>>")
    chars = F.when(F.length(tx.compact_text(c)) >= 4, weight(tx.char_ngrams(c), 0.2, "char:")).otherwise(none)
    return F.concat(weight(tokens, 1.0), weight(tx.ngrams(tokens, 2), 1.75), weight(tx.ngrams(tokens, 3), 2.2), chars)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def _each(a: Column, value: Column, f) -> Column:
    """f(x, value) for each x: zipped, so that value is evaluated once."""
    return F.zip_with(a, F.array_repeat(value, F.size(a)), f)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return _each(a, norm(a), lambda x, s: F.when(s > 0, x.cast("double") / s).otherwise(0.0))


def fit_dimensions(a: Column, dims: int) -> Column:
    """A unit vector of dims numbers: means of buckets of a longer one, zeros after a shorter one."""
    n, u = F.size(a), unit(a)
    edge = lambda i: F.floor(i * n / dims).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.struct(edge(i).alias("s"), F.greatest(edge(i + 1) - edge(i), F.lit(1)).alias("k")))
    pooled = F.zip_with(starts, F.array_repeat(u, dims), lambda at, v: F.aggregate(F.slice(v, at["s"] + 1, at["k"]), F.lit(0.0), lambda s, x: s + x) / at["k"])
    padded = F.concat(u, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dims) - n, F.lit(0))))
    return unit(F.when(n > dims, pooled).otherwise(padded))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def max_overlap(a: Column, b: Column) -> Column:
    """Shared items, without case, over the longer list; 0 if either is empty."""
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x)))
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(low(a), low(b))) / most).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.round(1 / (1 + F.exp(-x)), 6)


def vector_literal(a: Column) -> Column:
    """[x,y,...] with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def token_weight(token: Column, stopwords: list[str], identity: list[str]) -> Column:
    """1, more for phrases and long compact tokens; little if all its words are source names, less if all are stop words."""
    words = F.split(token, " ")
    base = 1 + F.when(F.contains(token, F.lit(" ")), 0.45).otherwise(0.0) + F.when(F.length(F.replace(token, F.lit(" "), F.lit(""))) >= 8, 0.25).otherwise(0.0)
    all_in = lambda values: F.forall(words, lambda w: w.isin(values))
    return F.round(base * F.when(all_in(identity), 0.08).when(all_in(stopwords), 0.35).otherwise(1.0), 6)
