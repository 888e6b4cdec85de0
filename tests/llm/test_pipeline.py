"""The pipeline against a plain version of each decision, and its registration."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillgrid.llm import quality


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_stages_follow_one_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen = [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs = docs.persist()
        seen.append({r.doc_id: r.text for r in docs.collect()})
    judged, unique, clear, mixed = seen[1:]
    assert all(not quality.base_failed(c[0], c[4]) for c in (quality.statistics(t)[0] for t in judged.values()))

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in judged.items()}
    root = {d: d for d in sets}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = of(a), of(b)
                root[max(x, y)] = min(x, y)
    assert set(unique) == {d for d in ids if of(d) == d}
    assert set(clear) == set(unique) and not any(re.search(r"[a-z]@mail\d\.example\.com", t) for t in clear.values())
    assert set(mixed) < set(clear) and len(mixed) > 0.2 * len(clear)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(mixed) and last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def plain_run(spark, folder):
    """Every decision by plain means: rows in, rows out. The forest, the spans and the probabilities are the operators' own, which have brute-force tests."""
    import hashlib

    from tokenizers import Tokenizer

    from quillgrid.llm import bpe, mixing, pii

    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdict = quality.fit(docs, labels)
    rows = []
    for r in docs.collect():
        counts, rates = quality.statistics(r.text)
        if not quality.base_failed(counts[0], counts[4]) and (verdict is None or verdict.score(quality.np.array([rates]))[0] <= verdict.threshold):
            rows.append(r)
    sets, root = [], list(range(len(rows)))
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[of(a)] = of(b)
    least = {}
    for k, r in enumerate(rows):
        least[of(k)] = min(least.get(of(k), r.doc_id), r.doc_id)
    rows = {(r.doc_id, r.text): r for k, r in enumerate(rows) if least[of(k)] == r.doc_id}.values()
    clear = []
    for r in pii.detect(spark.createDataFrame(list(rows), docs.schema)).collect():
        out, at = [], 0
        for start, end, kind in sorted((s.start, -s.end, s.kind) for s in r.spans):
            if start >= at:
                out += [r.text[at:start], f"<{kind.upper()}>"]
            at = max(at, -end)
        text = "".join(out) + r.text[at:]
        clear.append((r.doc_id, text, r.lang, r.source, len(text)))
    tok = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in mixing.mix(spark.createDataFrame(clear, docs.schema)).collect():
        if int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < r.prob:
            ids = tok.encode(r.text, add_special_tokens=False).ids
            want.append((r.doc_id, r.source, r.lang, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(want, key=str)


def test_run_is_the_plain_version(spark, sf_dir):
    import os

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) if os.path.isdir(spark.conf.get("spark.checkpoint.dir")) else set()
    out = corpus_pipeline.run(spark, sf_dir)
    got = [(r.doc_id, r.source, r.lang, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()]
    assert sorted(got, key=str) == plain_run(spark, sf_dir) and len(got) > 20
    new = [x for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if x.startswith("pipeline-")]
    assert [os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/{x}") for x in new] == [["bpe"]]


def test_run_with_nulls_repeats_and_without_rows(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80)) + "."
    rows = [(1, text(1), "en", "s", 1, "x"), (1, text(1), "en", "s", 1, "x"), (None, text(2), None, None, None, None), (3, None, "en", "s", 0, None), (4, "", "en", "s", 0, None), (5, text(5) + " mail a@b.cd", "de", None, 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= {1, None, 5}
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, f"{tmp_path}/some").persist()
        sizes.append(docs.count())
    assert sizes == [4, 3, 3] and sorted(r.text[-12:] for r in docs.collect() if r.doc_id == 5) == ["mail <EMAIL>"]


def test_repeated_ids_keep_one_row_a_text(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (None, "some other text of six words here"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((x.doc_id or 0, x.text or "") for x in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert kept == sorted([(0, rows[3][1]), (1, text), (3, ""), (4, "")])
