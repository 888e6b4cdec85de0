"""The divergence audit against a plain one with unbounded whole numbers, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from quillgrid.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in held:
        kept = {t for t, n in held[lang].items() if n >= least}
        counts = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares({t: sum(c[t] for c in counts.values()) for t in kept})
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def built(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], "lang string, source string, text string, n long, term string")
    return sorted(tuple(r) for r in divergence.audit(frame).select(*COLUMNS).collect())


def corpus(r, sources):
    words = [*"Alpha beta GAMMA été Élan ключ 漢字 don't a-b x1y".split(), *(f"w{chr(97 + k)}" for k in range(26))]
    rows = []
    for k in range(240):
        lang = r.choice(["en", "en", "fr", None])
        rows.append((lang, r.choice([*sources, None]), " ".join(r.choice(words[: 8 + k % 28]) for _ in range(r.randint(0, 40)))))
    return rows + [("en", "empty", None), ("en", "blank", " 12 !? "), ("xx", "one", "few words"), ("xx", "two", "few words"), ("yy", "alone", "z")] + 5 * [rows[0]]


def test_audit_is_the_plain_one(spark, monkeypatch):
    # Small blocks, cells and jobs: several blocks, even and odd numbers of cells, several jobs of rounds.
    monkeypatch.setattr(divergence, "ROUNDS", 2)
    monkeypatch.setattr(divergence, "LEAST_DOCS", 4)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    for cell, block, sources in ((1, 7, [f"s{k}" for k in range(7)]), (2, 5, [f"ß{k}" for k in range(3)])):
        monkeypatch.setattr(divergence, "CELL", cell)
        monkeypatch.setattr(divergence, "BLOCK", block)
        rows = corpus(random.Random(cell), sources)
        assert built(spark, rows) == plain(rows, 4)


def test_no_rows(spark):
    assert built(spark, []) == []


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    monkeypatch.setattr(divergence, "LEAST_DOCS", 1)
    rows = [("en", "a", "Some words " * 300 + "tail"), ("en", "b", "x" * 500 + " tail"), ("en", "c", "")]
    assert built(spark, rows) == plain(rows, 1)


def test_shares_are_exact():
    r = random.Random(3)
    for _ in range(200):
        total, terms = r.randint(1, 10 ** r.randint(1, 15)), r.randint(1, 10**6)
        counts = [r.randint(0, total) for _ in range(5)]
        assert divergence.share(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    theirs = con.execute(divergence.ORACLE)
    at = [[c[0] for c in theirs.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in theirs.fetchall()) == sorted(tuple(r) for r in divergence.query(spark, sf_dir).select(*COLUMNS).collect())
