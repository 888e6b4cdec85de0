"""Quality rules: rule statistics of each text, and an isolation forest over them.

Base rules on counts reject a text at once. The forest judges the others by their raw
rates. Its trees cut at random: a feature by its range among a node's rows, in units of
the good documents' spread, and a place in that range, until no two good rows are left
together. A tree sees many good labelled rows and few bad ones, which only widen the
ranges; a text that rates unlike the good ones parts from them after few cuts, and its
short mean path tells. Labelled rows are
dealt by crc32(doc_id as text) mod 4: the trees see remainders 0 and 1; the threshold is
calibrated on 3, so that at most a stated share of its good documents is lost; 2 is left
for measuring.

Cases: null and empty texts have no words and fail the base rules; without two good and
a bad labelled row in 0 and 1, or a good one in 3, there is no forest and the base rules
decide alone; repeated rows are judged each; a label counts once per doc_id, bad if any
of its rows is; other columns pass through judge() unless they have the names it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, fold, table

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: The most labelled rows that the forest and its threshold are fitted on: those with the smallest hashes of their ids.
FIT_ROWS = 8_000
TREES, GOOD_ROWS, BAD_ROWS, DEEPEST = 200, 500, 12, 12
#: Added to the spread of a rate among the good documents.
LEAST_SPREAD = 0.01
#: Remainders of the rows that the trees and the threshold are fitted on.
TREE_FOLDS, THRESHOLD_FOLD, HELD_OUT = (0, 1), 3, 2
#: Share of the good calibration rows that may score beyond the threshold.
LOST_GOOD = 0.001
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("chars", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "loud", "bars", "ends")


def repeated_cover(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of size words that the text holds twice or more."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    keys = first[: n - size + 1]
    for k in range(1, size):  # numbers below n each, so that a pair fits into 64 bits
        keys = np.unique(keys * (n + 1) + first[k : n - size + 1 + k], return_inverse=True)[1]
    covered = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(np.bincount(keys)[keys] > 1)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + size, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and RATES of a text. Rates are shrunk towards ordinary prose, as if twenty plain words were added."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_cover(words)
    letters = sum(map(str.isupper, text)) if not text.islower() else 0
    digits = sum(map(text.count, "0123456789"))
    ends = sum(map(text.count, ".!?"))
    share = lambda x, total, usual, weight: (x + usual * weight) / (total + weight)
    rates = [
        share(chars, n, 5.0, 20), share(symbols, n, 0.0, 20), share(dup, len(lines), 0.0, 4), share(repeats, n, 0.0, 20), share(letters, chars, 0.03, 100),
        share(digits, chars, 0.0, 100), share(sum(map(text.count, ",;:-()\"")), n, 0.1, 20), share(text.count("!"), n, 0.0, 20), share(text.count("|"), n, 0.0, 20), share(ends, n, 0.12, 20),
    ]
    return [n, chars, symbols, dup, repeats], rates


def usual_path(n: int) -> float:
    """The mean path length in a random tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees of random cuts as arrays: feature (-1 at a leaf), cut, left child (the right one follows), and the path length that a leaf stands for."""

    unit: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    usual: float

    @staticmethod
    def fit(good: np.ndarray, bad: np.ndarray, trees: int = TREES, seed: int = 7) -> IsolationForest:
        rng, unit = np.random.default_rng(seed), good.std(0) + LEAST_SPREAD
        take = [(x / unit, min(n, len(x))) for x, n in ((good, GOOD_ROWS), (bad, BAD_ROWS))]
        rows, most = sum(n for _, n in take), take[0][1]
        feature, cut, left, length = (np.full((trees, 2 * rows), v, t) for v, t in ((-1, np.int16), (0.0, float), (0, np.int32), (0.0, float)))
        for t in range(trees):
            sample, free = np.concatenate([x[rng.choice(len(x), n, replace=False)] for x, n in take]), 1
            todo = [(0, sample, np.arange(rows) < most, 0)]
            while todo:
                node, part, fine, depth = todo.pop()
                reach = part.max(0) - part.min(0)
                if not fine.any() or len(part) < 2 or depth == DEEPEST or reach.max() <= 0:
                    length[t, node] = depth + usual_path(int(fine.sum()))
                    continue
                f = int(rng.choice(len(reach), p=reach / reach.sum()))
                at = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[t, node], cut[t, node], left[t, node] = f, at, free
                low = part[:, f] <= at
                todo += [(free, part[low], fine[low], depth + 1), (free + 1, part[~low], fine[~low], depth + 1)]
                free += 2
        return IsolationForest(unit, feature, cut, left, length, usual_path(most))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        x, total, at = x / self.unit, np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, node]
                if (f < 0).all():
                    break
                node = np.where(f < 0, node, self.left[t, node] + (x[at, np.maximum(f, 0)] > self.cut[t, node]))
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, where=None) -> DataFrame:
    """doc_id, text and label (the largest of column) of at most rows labelled documents, by the smallest hashes of their ids.

    rows bounds what is broadcast: ids and labels alone.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    ids = (ids if where is None else ids.where(where)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def _measured(docs: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """kept columns, COUNTS, and RATES as an array."""
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("rates", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in kept]
    docs = bounded_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [statistics(x if isinstance(x, str) else None) for x in batch["text"]]
            out = batch[names].copy()
            for k, c in enumerate(COUNTS):
                out[c] = np.array([g[0][k] for g in got], np.int64)
            out["rates"] = [g[1] for g in got]
            yield out

    return docs.mapInPandas(run, schema)


@dataclass
class Verdict:
    """Forest and threshold."""

    forest: IsolationForest
    threshold: float

    def score(self, rates: np.ndarray) -> np.ndarray:
        return self.forest.score(rates)


def calibrate(rates: np.ndarray, bad: np.ndarray, folds: np.ndarray) -> Verdict | None:
    """The verdict from labelled rates. The order of the rows doesn't matter."""
    order = np.lexsort((*rates.T, bad, folds)) if len(rates) else []
    rates, bad, folds = rates[order], bad[order] == 1, folds[order]
    seen, judged = np.isin(folds, TREE_FOLDS), folds == THRESHOLD_FOLD
    if (seen & ~bad).sum() < 2 or not (seen & bad).any() or not (judged & ~bad).any():
        return None
    forest = IsolationForest.fit(rates[seen & ~bad], rates[seen & bad])
    scores = np.sort(forest.score(rates[judged & ~bad]))
    edge = float(scores[len(scores) - 1 - int(LOST_GOOD * len(scores))])
    beyond = [float(s) for s in forest.score(rates[judged & bad]) if s > edge] if (judged & bad).any() else []
    return Verdict(forest, (edge + min(beyond)) / 2 if beyond else edge + 0.02)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Verdict | None:
    """The verdict from at most rows labelled rows, of which those count that pass the base rules."""
    marked = labels.withColumn("bad", F.lit(1) - F.col("quality"))
    sample = labelled(docs, marked, "bad", rows, fold(F.col("doc_id")) != HELD_OUT).withColumn("fold", fold(F.col("doc_id")).cast("int"))
    got = _measured(sample.select("label", "fold", "text"), [T.StructField(n, T.IntegerType()) for n in ("label", "fold")]).collect()
    got = [r for r in got if not base_failed(r.n_words, r.n_repeat_words)]
    return calibrate(np.array([r.rates for r in got], float).reshape(len(got), len(RATES)), np.array([r.label for r in got]), np.array([r.fold for r in got]))


def judge(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with COUNTS, base_failed, score and kept. Rows stay where they are; the model is a few hundred kB."""
    model = fit(bounded_batches(docs), labels, rows)
    added = {*COUNTS, "base_failed", "score", "kept", "rates"}
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [statistics(x if isinstance(x, str) else None) for x in batch["text"]]
            counts = np.array([g[0] for g in got], np.int64).reshape(len(got), len(COUNTS))
            failed = base_failed(counts[:, 0], counts[:, 4])
            score = model.score(np.array([g[1] for g in got])) if model and got else np.zeros(len(got))
            out = batch.copy()
            for k, c in enumerate(COUNTS):
                out[c] = counts[:, k]
            out["base_failed"], out["score"], out["kept"] = failed, score, ~failed & (score <= model.threshold if model else True)
            yield out

    return docs.select(*[f"`{n}`" for n in [f.name for f in kept]]).mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_quality: counts and verdicts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.round("score", 6).alias("score"))
