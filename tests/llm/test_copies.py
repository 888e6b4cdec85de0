"""Near-duplicates and repeated substrings, against brute force."""

import hashlib
import random
from collections import Counter

from quillgrid.llm import minhash, substring
from quillgrid.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_groups(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()

    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), (least.get(root(i), -1) if sets[i] else (d if d is not None else -1))) for i, (d, _) in enumerate(rows))


def test_groups_are_exact(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "a b", "A b", "a b c", "x " * 5000, "X  " * 5000, "y z " * 30_000]
    for size in (12, 40, 120, 400):
        for _ in range(6):
            base = [r.choice(words) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 4, 6, 8, 10):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(size)] = r.choice(words)
                texts.append(" ".join(copy))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, texts[9]), (None, texts[9]), (None, "alone in this text and null")]
    got = minhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id if x.component_id is not None else -1) for x in got) == brute_groups(rows)
    assert all(x.kept == (x.component_id is None or x.doc_id == x.component_id) for x in got)


def test_null_ids_are_told_apart_by_their_texts(spark, monkeypatch):
    """Near copies among rows without ids, by the shuffled join too."""
    base = [f"n{i}" for i in range(80)]
    near = [" ".join([*base[:79], f"end{k}"]) for k in range(6)]
    rows = [(None, t) for t in near] + [(None, " ".join(f"lone{k}x{i}" for i in range(30))) for k in range(20)] + [(7, near[0]), (None, None)]
    for most in (minhash.BROADCAST_IDS, 0):
        monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
        got = minhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()
        assert Counter(x.component_id for x in got) == {7: 7, None: 21}


def test_groups_of_an_empty_table(spark):
    assert minhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_agrees_as_similar_sets_do():
    import numpy as np

    r = np.random.default_rng(1)
    both, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (3000, 500, 500))
    share = (minhash.signature(np.union1d(both, a)) == minhash.signature(np.union1d(both, b))).mean()
    assert abs(share - 0.75) < 0.15


def test_components_of_paths_and_stars(spark):
    links = [(f"a{i:03}", f"a{i + 1:03}") for i in range(60)] + [("b0", f"b{i}") for i in range(1, 50)] + [("c", "c"), ("d", None)]
    got = {x.node: x.comp for x in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert all(got[f"a{i:03}"] == "a000" for i in range(61)) and all(got[f"b{i}"] == "b0" for i in range(50)) and len(got) == 111


def brute_removed(texts, size=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_repeated_windows_are_removed(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_BYTES", 5_000)  # many batches and ranges
    monkeypatch.setattr(substring, "RANGE_BYTES", 9_000)
    r = random.Random(2)
    p = [f"w{r.randint(0, 400)}" for _ in range(70)]
    texts = [None, "", "a b", "x " * 100, " ".join(p), " ".join(p), "q " + " ".join(p) + " z", " ".join(p[:34]), " ".join(p[:35]), " ".join(p[7:50] + ["tail"] + p[3:45]), " ".join(p).upper(), "\x85".join(p)]
    texts += [" ".join(f"v{r.randint(0, 3)}" for _ in range(r.randint(0, 200))) for _ in range(40)]
    got = {x.doc_id: x for x in substring.dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    want = brute_removed(texts)
    for i, w in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == w
        assert hashlib.sha256(got[i].kept_text.encode()).hexdigest() == w[2]
    assert substring.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
