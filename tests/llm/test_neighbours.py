"""The quality classifier: its vote against a plain one, held-out accuracy, and edge cases."""

import random
import zlib

import numpy as np
import pytest

from quillgrid.llm import neighbours

SCHEMA = "doc_id long, text string, score string, lang string"


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        text = " ".join(r.choice(words).capitalize() if k % 11 == 0 else r.choice(words) for k in range(r.randint(60, 200))) + "."
        if bad:
            text = r.choice([" ".join([r.choice(words)] * 90), text.replace("a", "### "), "\n".join([text[:80]] * 9)])
        rows.append((d, text, "clash", "en"))
        labels.append((d, 0 if bad else 1, 0))
    return rows, labels


def scored(spark, docs, labels, **more):
    out = neighbours.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    return [(r.doc_id, r.text, r.held_out, r.score, r.predicted) for r in out.collect()]


@pytest.fixture(scope="module")
def data():
    return corpus(400)


def test_vote_is_the_plain_one_and_right_on_held_out_rows(spark, data):
    rows, labels = data
    got = {r[0]: r for r in scored(spark, rows, labels)}
    assert len(got) == 400 and all(got[d][2] == held(d) for d in got)
    seen = sorted(d for d in got if not held(d))
    bags = {d: neighbours.bag(text) for d, text, *_ in rows}
    order = sorted(seen, key=lambda d: (np.flatnonzero(bags[d]).astype("<u2").tobytes(), bags[d][np.flatnonzero(bags[d])].tobytes(), labels[d][1]))
    model = neighbours.Latent.fit(np.stack([bags[d] for d in order]), np.array([labels[d][1] for d in order]))
    usual = sum(labels[d][1] for d in seen) / len(seen)
    for d in list(got)[::7]:
        mine = model.latent(bags[d][None])[0].astype(float)
        near = sorted(((max(0.0, float(mine @ v.astype(float))), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        near = [(s**8, y) for s, y in near if s >= near[14][0] - 1e-9]
        want = (sum(s * y for s, y in near) + 0.01 * usual) / (sum(s for s, _ in near) + 0.01)
        assert abs(got[d][3] - want) < 1e-3, d
    test = [d for d in got if held(d)]
    assert np.mean([got[d][4] == labels[d][1] for d in test]) > 0.97
    assert all(got[d][4] == int(got[d][3] >= 0.3) for d in got)


def test_held_out_labels_other_columns_and_order_change_nothing(spark, data):
    rows, labels = data
    plain = sorted(scored(spark, rows, labels), key=repr)
    other = [(d, 1 - q if held(d) else q, 1 - t) for d, q, t in labels]
    assert plain == sorted(scored(spark, [(d, t, "x", "de") for d, t, *_ in rows][::-1], other[::-1]), key=repr)


def test_nulls_empty_long_and_repeated_rows(spark, data):
    rows, labels = data
    long = " ".join(rows[1][1] for _ in range(400))
    odd = [(None, None, None, None), (1000, "", None, None), (1001, None, None, None), (1, rows[1][1], None, None), (1002, long, None, None), (1003, "🙂 ключ", None, None)]
    got = scored(spark, rows + odd, labels + [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0)])
    assert len(got) == len(rows) + len(odd) and all(0 <= r[3] <= 1 for r in got)
    assert next(r for r in got if r[0] is None)[2] is False
    assert len({r[3] for r in got if r[0] in (1000, 1001, None)}) == 1 and len({r[3] for r in got if r[0] == 1}) == 1
    assert next(r for r in got if r[0] == 1002)[1] == long


def test_without_labels_or_rows(spark, data):
    rows, labels = data
    assert {(r[3], r[4]) for r in scored(spark, rows[:3], [])} == {(0.0, 0)}
    assert scored(spark, [], labels) == []
    one = next(x for x in labels if not held(x[0]) and x[1] == 1)
    assert {r[4] for r in scored(spark, rows[:20], [one])} == {1}
    assert len(scored(spark, rows[:20], labels, rows=3)) == 20
