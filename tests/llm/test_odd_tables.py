"""Every operator over documents on an empty table, on columns whose names clash with its own, on null ids, and on a very long text; and what the signatures of near copies miss."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bpe, minhash, mixing, pii, quality, substring, token_counts, toxicity

BASE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators add themselves, all of another type.
CLASH = ("n_words", "n_removed", "kept_sha256", "kept", "score", "spans", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "component_id", "n_shingles", "cls", "bands", "base_failed", "rates", "held_out", "predicted", "weight", "prob", "topic", "tokenizer", "batch", "part", "label", "fold")
LABELS = [(k, 1 - k % 2, k % 3 == 0 and 1 or 0) for k in range(40)]


def frame(spark, rows, clash=True):
    names = CLASH if clash else ()
    return spark.createDataFrame([(d, t, lang, s, None, *["clash"] * len(names)) for d, t, lang, s in rows], ", ".join([BASE, *(f"{n} string" for n in names)]))


def rows():
    texts = [None, "", " \n", "mail me at a.b@mail1.example.com or +44 20 7946 0958 today", " ".join(f"word{k}" for k in range(60)), " ".join(f"word{k}" for k in range(60)), "bad stupid text! " * 30]
    return [(k if k != 3 else None, t, "en" if k % 2 else None, "s" if k % 3 else None) for k, t in enumerate(texts)] + [(None, "no id either", None, None), (5, "the same id again", "en", "s")]


def labels(spark, some=True):
    return spark.createDataFrame(LABELS if some else [], "doc_id long, quality int, toxic int")


OPERATORS = {
    "substring": lambda s, d: substring.dedup(d, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256"),
    "pii": lambda s, d: pii.redact(d).select("doc_id", "text"),
    "bpe": lambda s, d: bpe.encode_documents(d, ids=False).select("doc_id", "n_tokens", "ids_sha256"),
    "tokens": lambda s, d: token_counts.counted(d, {"w": token_counts.WORD}),
    "minhash": lambda s, d: minhash.groups(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "quality": lambda s, d: quality.judge(d, labels(s)).select("doc_id", *quality.COUNTS, "base_failed", "kept"),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)).select("doc_id", "held_out", F.round("score", 9).alias("score"), "predicted"),
    "mixing": lambda s, d: mixing.mix(d).select("doc_id", "n_tokens", "kept"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_and_null_ids_change_nothing(spark, name):
    plain = sorted((tuple(r) for r in OPERATORS[name](spark, frame(spark, rows(), clash=False)).collect()), key=repr)
    assert sorted((tuple(r) for r in OPERATORS[name](spark, frame(spark, rows())).collect()), key=repr) == plain
    assert len(plain) == len(rows()) and sum(r[0] is None for r in plain) == 2


def test_a_very_long_text(spark):
    words = [f"w{k % 5000}x{k}" for k in range(200_000)]
    text = " ".join(words[:150_000] + words[:40] + words[150_000:])
    got = {r.doc_id: r for r in substring.dedup(frame(spark, [(1, text, "en", "s"), (2, "short text", "en", "s")]), keep_text=False).collect()}
    assert (got[1].n_words, got[1].n_removed) == (200_040, 80)
    left = words[40:150_000] + words[150_000:]
    assert got[1].kept_sha256 == hashlib.sha256(" ".join(left).encode()).hexdigest()
    mixed = {r.doc_id: r.n_tokens for r in mixing.mix(frame(spark, [(1, text, "en", "s"), (2, "short text", "en", "s")])).collect()}
    assert mixed[1] >= 200_040 and mixed[2] == 2


def test_signatures_miss_no_pair_at_the_threshold():
    """Random pairs of sets at exactly 0.75 agree in AGREE coordinates and share a band: none of 4,000 is missed, so that at most one in a thousand is, with a confidence of 0.98."""
    r = np.random.default_rng(11)
    missed = 0
    for _ in range(4_000):
        n = 4 * int(r.integers(1, 33))
        every = r.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(every[k : n - n // 4 + k]) for k in (0, n // 8))  # 3/4 of the union, and 3/4 of it again
        both = len(np.intersect1d(a, b))
        extra = np.setdiff1d(every, np.union1d(a, b))
        a, b = np.union1d(a, extra[: len(extra) // 2]), np.union1d(b, extra[len(extra) // 2 :])
        if 100 * both < 75 * len(np.union1d(a, b)):  # grow what they share until they are at 0.75
            more = r.integers(0, 2**63, 3 * len(np.union1d(a, b)) - 4 * both, dtype=np.uint64)
            a, b = np.union1d(a, more), np.union1d(b, more)
        x, y = minhash.signature(a), minhash.signature(b)
        agree = int((x == y).sum())
        missed += agree < minhash.AGREE or not (minhash.band_keys(x) == minhash.band_keys(y)).any()
    assert missed == 0
