"""Quality classifier: nearest labelled neighbours among latent-semantic vectors.

A text is a bag of hashed terms: its words, the endings of its words, and forms, which
are rates of the whole text (repeats, symbols, line copies, capitals and others of the
quality rules, and its length) dealt to two adjoining bins each. Terms are damped, weighed
by rarity and scaled to length 1; the directions of the largest singular values among the
labelled texts make latent vectors of them. The labelled vectors go to all executors once,
a few MB. Each document meets every one of them in blocks of exact cosine products, and
its nearest NEIGHBOURS vote, weighed by similarity.

Labels are learned from at most FIT_ROWS rows whose crc32(doc_id as text) mod 5 is not 0,
those with the smallest hashes of their ids; remainder 0 is held out. Labels, language,
source and id are no features.

Cases: null and empty texts have the forms of an empty text; rows as near as the last
neighbour vote too, so ties need no order; a text without a direction in common with any
labelled one gets the share of label 1; without labelled rows that share is 0; a null
doc_id is not held out; repeated rows are scored each; of repeated labels the largest
counts; other columns pass through score() unless they have the names it adds. Whole texts
are counted, in one pass each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, table
from quillgrid.llm.quality import labelled, statistics

#: The most labelled rows that are learned from; they and their vectors of RANK numbers of 4 bytes bound what is broadcast.
FIT_ROWS, RANK = 8_000, 48
#: Hashed terms of words and of endings; bins of a form, and the share of a text's length that forms have.
WORD_TERMS, ENDING_TERMS, BINS, FORM_SHARE = 2_048, 1_024, 12, 0.8
NEIGHBOURS, SHARPNESS, THRESHOLD = 15, 8, 0.3
#: Texts that meet the labelled vectors at once.
ROWS = 256
FOLDS, HELD_OUT = 5, 0
WORDS = re.compile(r"[^\W\d_]+")
#: Where the last bin of each rate of quality.RATES begins, and of the logarithm of the number of words.
TOPS = np.array([10.0, 1.0, 0.5, 0.6, 0.3, 0.2, 1.0, 0.3, 0.3, 0.5, 12.0])
FORM_TERMS = BINS * len(TOPS)
TERMS = WORD_TERMS + ENDING_TERMS + FORM_TERMS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def bag(text: str | None) -> np.ndarray:
    """The terms of a text: damped counts of words and endings, and forms."""
    text = text or ""
    counts, rates = statistics(text)
    out = np.zeros(TERMS, np.float32)
    words = Counter(WORDS.findall(text.lower()))
    for w, n in words.items():
        raw = w.encode("utf-8", "surrogatepass")
        out[zlib.crc32(raw) % WORD_TERMS] += n
        out[WORD_TERMS + zlib.crc32(raw[-3:]) % ENDING_TERMS] += n
    np.log1p(out, out=out)
    at = np.clip(np.array([*rates, np.log2(1 + counts[0])]) / TOPS, 0, 1) * (BINS - 1)
    low = np.minimum(at.astype(int), BINS - 2)
    places = WORD_TERMS + ENDING_TERMS + BINS * np.arange(len(TOPS)) + low
    out[places], out[places + 1] = 1 - (at - low), at - low
    return out


@dataclass
class Latent:
    """Weights of terms, directions (terms by RANK), and the labelled vectors with their labels."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scaled(self, bags: np.ndarray) -> np.ndarray:
        """Rows of length 1 of weighed terms; forms have FORM_SHARE of the square of it."""
        x = bags * self.rarity
        for part, share in ((slice(0, TERMS - FORM_TERMS), 1 - FORM_SHARE), (slice(TERMS - FORM_TERMS, TERMS), FORM_SHARE)):
            x[:, part] *= np.sqrt(share) / np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    def latent(self, bags: np.ndarray) -> np.ndarray:
        x = self.scaled(bags) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def fit(bags: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 3) -> Latent:
        """By a randomised range finder with four power steps. The order of rows must not depend on Spark."""
        rarity = np.log((1 + len(bags)) / (1 + (bags > 0).sum(0))).astype(np.float32) + 1
        rarity[TERMS - FORM_TERMS :] = 1
        model = Latent(rarity, np.empty((TERMS, 0), np.float32), np.empty((0, rank), np.float32), labels.astype(np.float32))
        x = model.scaled(bags)
        basis = np.random.default_rng(seed).normal(size=(TERMS, rank + 16)).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
        model.directions = np.ascontiguousarray((basis @ right.T)[:, :rank])
        model.vectors = model.latent(bags)
        return model

    def score(self, bags: np.ndarray) -> np.ndarray:
        """The weighed share of label 1 among the neighbours, with one vote of a hundredth for the share among all."""
        usual, out = float(self.labels.mean()), np.empty(len(bags))
        for start in range(0, len(bags), ROWS):
            near = np.maximum(self.latent(bags[start : start + ROWS]) @ self.vectors.T, 0).astype(np.float64)
            k = min(NEIGHBOURS, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
            weight = np.where(near >= last, near, 0) ** SHARPNESS
            out[start : start + ROWS] = (weight @ self.labels + 0.01 * usual) / (weight.sum(1) + 0.01)
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Latent | None:
    """The labelled vectors; None without labelled rows. The bags of at most rows texts reach the driver, sparse."""
    sample = labelled(docs, labels, "quality", rows, ~held_out(F.col("doc_id"))).select("label", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [bag(t if isinstance(t, str) else None) for t in batch["text"]]
            at = [np.flatnonzero(g) for g in got]
            yield pd.DataFrame({"label": batch["label"], "at": [a.astype("<u2").tobytes() for a in at], "value": [g[a].tobytes() for g, a in zip(got, at, strict=True)]})

    got = sorted((bytes(r["at"]), bytes(r.value), r.label) for r in sample.mapInPandas(run, "label int, at binary, value binary").collect())
    if not got:
        return None
    bags = np.zeros((len(got), TERMS), np.float32)
    for row, (at, value, _) in zip(bags, got, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(value, np.float32)
    return Latent.fit(bags, np.array([g[2] for g in got]))


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with held_out, score and predicted. Rows stay where they are."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(bounded_batches(docs), labels, rows))
    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, scores = batch.copy(), np.zeros(len(batch))
            for start in range(0, len(batch) if model.value else 0, ROWS):
                texts = batch["text"].iloc[start : start + ROWS]
                scores[start : start + ROWS] = model.value.score(np.stack([bag(t if isinstance(t, str) else None) for t in texts]))
            out["score"] = np.round(np.clip(scores, 0, 1), 6)
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            yield out

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, T.StructType([*kept, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_neighbours: a quality score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
