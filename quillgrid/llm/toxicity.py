"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of learned lexicons (words, and word stems by their first
letters), the lexicon hits near second-person words, capitals, punctuation, and
signs of obfuscation. Labelled rows are dealt by crc32(doc_id as text) mod 4: the
lexicon is learned from remainder 0, the trees from 1 and the calibration from 3;
remainder 2 is held out and never read for fitting. Labels, language, source and id
are no features.

Cases: null and empty texts get the features of an empty text; without labelled rows
of both kinds in a fold every score is the prior 0 (or the plain tree score, if only
the calibration fold lacks them); a null doc_id is not held out; repeated rows are
scored each; of repeated labels the largest counts; other columns pass through
score() unless they have the names it adds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, fold, table
from quillgrid.llm.quality import labelled

#: The most labelled rows that each of the three fits uses: those with the smallest hashes of their ids.
FIT_ROWS = 8_000
#: Lexicon entries: in at least so many labelled toxic documents and this share of them, this log odds ratio, and at most so many of either kind.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, MOST_ENTRIES = 3, 0.01, 2.5, 2_000
STEMS = (4, 5, 6)
HELD_OUT, THRESHOLD = 2, 0.3
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tú usted ustedes vosotros vuestro".split())
#: Characters that stand in for letters.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
WORDS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"[^\W\d_]+[0-9@$!*][0-9@$!*]*[^\W\d_]+")
NEAR = 5
NAMES = ("word_density", "stem_density", "word_hits", "stem_hits", "hidden_hits", "near_second", "second_person", "capitals", "shouted", "loud", "question", "marks", "hidden", "words")


def features(text: str | None, words: frozenset[str], stems: frozenset[str]) -> list[float]:
    """NAMES of a text. Densities are per word, with ten plain words added."""
    text = text or ""
    low = text.lower()
    got = WORDS.findall(low)
    n = len(got)
    distinct = set(got)
    bad = distinct & words
    stemmed = {w for w in distinct if any(w[:k] in stems for k in STEMS if len(w) >= k)}
    count = Counter(w for w in got if w in bad or w in stemmed) if bad or stemmed else {}
    second = [i for i, w in enumerate(got) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
    near = 0
    if second and count:
        at = np.array(second)
        hits = np.array([i for i, w in enumerate(got) if w in count])
        near = int((np.searchsorted(at, hits + NEAR, "right") > np.searchsorted(at, hits - NEAR, "left")).sum())
    hidden = HIDDEN.findall(low) if not low.isalpha() else []
    clear = [h.translate(LOOKALIKE).replace("*", "") for h in hidden]
    found = sum(h in words or any(h[:k] in stems for k in STEMS if len(h) >= k) for h in clear)
    upper = sum(map(str.isupper, text))
    total, chars = n + 10.0, len(text) + 50.0
    return [
        sum(count.get(w, 0) for w in bad) / total, sum(count.get(w, 0) for w in stemmed) / total, float(len(bad)), float(len(stemmed)), float(found), near / total, len(second) / total,
        upper / chars, sum(map(str.isupper, text.split())) / total, text.count("!") / total, text.count("?") / total, sum(map(text.count, ",.;:")) / total, len(hidden) / total, float(np.log1p(n)),
    ]


def learn_lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems that labelled toxic documents hold far oftener. Counts are summed on the executors; at most MOST_ENTRIES of each kind reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = set(WORDS.findall(text.lower())) if isinstance(text, str) else set()
                entries = [*(("word", w) for w in words), *{("stem", w[:k]) for w in words for k in STEMS if len(w) >= k}]
                for e in [("all", ""), *entries]:
                    seen.setdefault(e, [0, 0])[label] += 1
            yield pd.DataFrame([(k, e, a, b) for (k, e), (a, b) in seen.items()], columns=["kind", "entry", "clean", "toxic"])

    sums = sample.select("text", "label").mapInPandas(count, "kind string, entry string, clean long, toxic long")
    sums = sums.groupBy("kind", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Only entries of some toxic documents can qualify; the totals are the row of kind "all".
    total = sample.agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    if not total.clean or not total.toxic:
        return frozenset(), frozenset()
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (total.clean + 1.0))
    best = sums.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * total.toxic)) & (odds >= LEAST_ODDS) & (F.col("kind") != "all"))
    return tuple(  # type: ignore[return-value]
        frozenset(r.entry for r in best.where(F.col("kind") == kind).orderBy(F.desc("toxic"), "entry").limit(MOST_ENTRIES).select("entry").collect()) for kind in ("word", "stem")
    )


@dataclass
class BoostedTrees:
    """Logistic gradient boosting with trees of fixed depth over quantile cuts: arrays of features, cuts and leaf values."""

    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    depth: int = 3
    rate: float = 0.2

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, bins: int = 32, smooth: float = 1.0) -> BoostedTrees:
        model = BoostedTrees(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        raw, inner = np.full(len(y), model.base), 2**model.depth - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for at in range(inner):
                rows = node == at
                best = 1e-9
                for f, c in enumerate(cuts):
                    gs = np.bincount(binned[rows, f], g[rows], len(c) + 1).cumsum()
                    hs = np.bincount(binned[rows, f], h[rows], len(c) + 1).cumsum()
                    gain = (gs**2 / (hs + smooth) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + smooth) - gs[-1] ** 2 / (hs[-1] + smooth))[:-1]
                    if len(gain) and gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), f, c[int(gain.argmax())]
                node = np.where(rows, 2 * at + 1 + (x[:, feature[at]] > cut[at]), node)
            sums = [np.bincount(node - inner, v, inner + 1) for v in (g, h)]
            leaf = -model.rate * sums[0] / (sums[1] + smooth)
            raw = raw + leaf[node - inner]
            model.feature.append(feature), model.cut.append(cut), model.leaf.append(leaf)
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising function of raw closest to y, by pooling adjacent violators: knots and their values. Equal raw scores share a knot."""
    at, where = np.unique(raw, return_inverse=True)
    pools: list[list[float]] = []
    for x, s, n in zip(at, np.bincount(where, y), np.bincount(where), strict=True):
        pools.append([x, x, s, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, end, s2, n2 = pools.pop()
            pools[-1][1:] = [end, pools[-1][2] + s2, pools[-1][3] + n2]
    return np.array([x for p in pools for x in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in range(2)])


@dataclass
class Model:
    words: frozenset[str]
    stems: frozenset[str]
    trees: BoostedTrees
    knots: tuple[np.ndarray, np.ndarray] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the tree score keeps the order within a pool."""
        raw = self.trees.raw(x)
        plain = 1 / (1 + np.exp(-raw))
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * plain if self.knots else plain


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    of = lambda k: labelled(docs, labels, "toxic", rows, fold(F.col("doc_id")) == k)
    words, stems = learn_lexicon(of(0))

    def measured(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"label": batch["label"], "x": [features(t if isinstance(t, str) else None, words, stems) for t in batch["text"]]})

        got = sorted((list(r.x), r.label) for r in sample.select("label", "text").mapInPandas(run, "label int, x array<double>").collect())
        return np.array([g[0] for g in got]).reshape(len(got), len(NAMES)), np.array([g[1] for g in got], float)

    x, y = measured(of(1))
    if not 0 < y.sum() < len(y):
        return None
    trees = BoostedTrees.fit(x, y)
    x, y = measured(of(3))
    return Model(words, stems, trees, isotonic(trees.raw(x), y) if 0 < y.sum() < len(y) else None)


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with held_out, score and predicted. Rows stay where they are; the model is at most a few hundred kB."""
    model = fit(bounded_batches(docs), labels, rows)
    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            x = np.array([features(t if isinstance(t, str) else None, model.words, model.stems) for t in batch["text"]] if model else []).reshape(-1, len(NAMES))
            out["score"] = np.clip(model.scores(x), 0, 1) if model else 0.0
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            yield out

    held = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"))
    return held.mapInPandas(run, T.StructType([*kept, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_toxicity: a score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
