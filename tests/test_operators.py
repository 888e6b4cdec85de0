"""Operators against plain Python models and planted cases."""

import io
import random
import zipfile
import zlib

from pyspark.sql import functions as F

from quillgrid.functions import text as tx
from quillgrid.functions import vectors as vx
from quillgrid.operators import dedupe, evaluate, jobs, ops, passages, scoring, similarity, store
from quillgrid.operators import query as qu
from quillgrid.schema import with_defaults
from quillgrid.sources import connectors, files
from quillgrid.streaming import jobs as stream_jobs


def one(spark, text, **columns):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    c = F.col("t")
    row = one(spark, "Éa, B2!  x 가나다라 é", n=tx.normalize_text(c), k=tx.tokenize(c), w=tx.token_windows(tx.tokenize(c)), lang=tx.detect_language(c), g=tx.char_ngrams(F.lit("가나 다")))
    assert row.n == "éa b2 x 가나다라 é" and row.k == ["éa", "b2", "가나다라"] and row.w == ["éa b2", "b2 가나다라", "éa b2 가나다라"] and row.lang == "mixed" and row.g == ["가나", "나다", "가나다"]
    row = one(spark, None, n=tx.normalize_text(c), k=tx.tokenize(c), y=tx.safe_year(c), noise=tx.looks_like_noise(c), s=tx.strip_tags(c), b=tx.text_between(c, "<", ">"), a=tx.normalize_authors(c))
    assert row.n == "" and row.k == [] and row.y is None and row.noise and row.s == "" and row.b == "" and row.a == []
    row = one(spark, "<b>A &amp;gt; B</b> in 1899 or 2021x", s=tx.strip_tags(c), y=tx.safe_year(c), m=tx.matches_query(c, F.lit("or zz")), u=tx.hangul_chunks(F.lit("가나다라")), nf=tx.nfkc(F.lit("ﬁ①")))
    assert row.s == "A > B in 1899 or 2021x" and row.y == 2021 and row.m and row.u == ["가나", "나다", "다라", "가나다", "나다라"] and row.nf == "fi1"


def test_keys(spark):
    c = F.col("t")
    row = one(spark, "Arxiv preprint: Deep Joins!", k=tx.title_key(c), i=tx.canonical_id(F.lit("paper"), F.lit(""), c), j=tx.canonical_id(F.lit("paper"), F.lit("paper:x-1")), s=tx.slug(c, 6))
    assert row.k == "deepjoins" and row.i == "paper:arxiv-preprint-deep-joins" and row.j == "paper:x-1" and row.s == "arxiv-"


def fnv(text):
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) % 2**32
    return h


def test_fnv_and_vectors(spark):
    words = ["", "a", "tok:배터리:3", "hello world"]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", vx.fnv1a(F.col("t")).alias("h"), vx.bucket(F.col("t"), 97).alias("b"))
    for r in df.collect():
        signed = fnv(r.t) if fnv(r.t) < 2**31 else fnv(r.t) - 2**32
        assert r.h == fnv(r.t) and r.b == abs(signed) % 97
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = v.select(vx.cosine(F.col("a"), F.col("a")).alias("s"), vx.cosine(F.col("a"), F.col("z")).alias("z"), vx.fit_dimensions(F.col("a"), 4).alias("p"), vx.fit_dimensions(F.col("b"), 1).alias("m"), vx.vector_literal(F.col("a")).alias("l")).first()
    assert abs(r.s - 1) < 1e-12 and r.z == 0 and r.p == [0.6, 0.8, 0, 0] and r.m == [1.0] and r.l == "[3.000000,4.000000]"


def test_query_understanding():
    q = qu.Query.of("climate change wildfire")
    assert "기후 변화" in q.translations and "climate change" in q.tokens and q.profile.domains == ["earth_space"] and q.compound
    assert qu.profile("특허 배터리").types == ["patent"] and qu.profile("특허 배터리").sources[0] == "kipris"
    assert qu.profile("R&E 진자").types == ["report", "fair_entry"] and qu.profile("joins").types == ["paper"]
    variants = qu.reformulations(q)
    assert "climatechangewildfire" in variants and "climate change" in variants and len(variants) == len(set(variants)) and "climate change wildfire" not in variants
    assert qu.token_weight("science fair") < 0.2 < qu.token_weight("analysis") < 1 <= qu.token_weight("pendulum")
    ranked = qu.rank_sources({k: c.kind for k, c in connectors.REGISTRY.items()}, qu.profile("cyber exploit"))
    assert ranked[:3] == ["cve", "blackhat", "defcon"]
    assert qu.split_sources(["arxiv", "kci"], "ko-to-en") == (["kci"], ["arxiv"])
    assert qu.coerce_bool(" Yes", False) and qu.coerce_list("a, b,,a") == ["a", "b"] and qu.relaxed_terms(q)


def test_scoring_ranks_the_exact_title_first(spark):
    rows = [(1, "Deep joins on graphs", "We study joins.", "paper", "arxiv", 2020, 10), (2, "Graphs", "Deep things and joins on graphs are studied.", "paper", "kci", 2023, 400), (3, "Cooking rice", "Rice and beans.", "paper", "kci", None, 0)]
    docs = spark.createDataFrame(rows, "id long, title string, abstract string, type string, source string, year int, citations int").withColumn("keywords", F.array(F.lit("joins"))).withColumn("language", F.lit("en"))
    q = qu.Query.of("deep joins on graphs")
    scored = scoring.hybrid_score(scoring.with_fields(docs), q)
    kept = scoring.ordered(scored.where(scoring.has_evidence(q) & ~scoring.is_collision(q))).collect()
    assert [r.id for r in kept] == [1, 2] and kept[0].match >= kept[1].match and kept[0].exact_title > 0
    assert scoring.is_strong(kept[0]) and scoring.wants_live(False, True, q, 1, kept[0]) and not scoring.wants_live(False, False, q, 1, kept[0])
    assert scoring.ordered(scored, "latest").first().id == 2 and scoring.ordered(scored, "citation").first().id == 2


def test_passages_sections_references():
    text = "First sentence here. " * 30
    parts = passages.split_passages(text, 100)
    assert all(len(p) <= 100 for p in parts) and passages.split_passages("x" * 250, 100) == ["x" * 100, "x" * 50] and passages.split_passages(None) == []
    got = passages.split_sections("1. Introduction\nWe begin.\nMethod\nWe do.\nAnd do.\nOdd Title:\nrest.")
    assert [(k, c) for k, _, c in got] == [("introduction", "We begin."), ("method", "We do. And do."), ("odd title", "rest.")]
    assert [k for k, _, _ in passages.split_sections("one long line with a stop.\n\ntwo, also.")] == ["body"]
    refs = passages.extract_references('x\nReferences\n1. Kim, A., Lee, B. 2020. Joining very large tables. J. Data.\n2. "Quoted titles in many lists" 2019 and\nmore words here\n3. Kim, A. 2020. Joining very large tables. J. Data.')
    assert [(t, y) for t, y, _ in refs] == [("Joining very large tables", "2020"), ("Quoted titles in many lists", "2019")]
    assert passages.extract_references(None) == []


def test_all_references_of_a_list_are_extracted(spark):
    text = "x\nReferences\n" + "\n".join(f"[{k}] Kim, A., Lee, B. {1980 + k}. A study of number{k} tables. J. Data." for k in range(1, 31))
    assert [(t, y) for t, y, _ in passages.extract_references(text)] == [(f"A study of number{k} tables", str(1980 + k)) for k in range(1, 31)]
    rows = passages.references(spark.createDataFrame([(1, text)], "id long, abstract string")).collect()
    assert sorted(r.ord for r in rows) == list(range(1, 31))


def test_duplicates_merge_as_a_sequential_scan(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(12)]
    rows = []
    for i in range(150):
        title = " ".join(r.sample(words, r.randint(2, 5)))
        rows.append((i, r.choice(["paper", "thesis"]), title if r.random() > 0.05 else "", [f"author {r.randint(0, 40)}"] if r.random() > 0.3 else [], r.choice([2000, 2001, 2004, None])))
    docs = spark.createDataFrame(rows, "id long, type string, title string, authors array<string>, year int")
    got = {x.id: x.leader for x in dedupe.leaders(docs).collect()}
    heads, by_key, want = [], {}, {}
    for i, kind, title, authors, year in rows:
        key, tokens = title.replace(" ", ""), set(title.split())
        names = "|".join(authors)
        hit = by_key.get(key) if key else None
        if hit is None:
            for h in heads:
                near = year is None or h[4] is None or abs(year - h[4]) <= 1
                union = tokens | h[5]
                if h[1] == kind and near and ((union and len(tokens & h[5]) / len(union) >= dedupe.JACCARD) or (names and names == h[3])):
                    hit = h[0]
                    break
        if hit is None:
            heads.append((i, kind, title, names, year, tokens))
            hit = i
        if key:
            by_key.setdefault(key, hit)
        want[i] = hit
    assert got == want


def test_similar_titles_are_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"t{r.randint(0, 9)}x" for _ in range(r.randint(0, 7)))) for i in range(120)]
    got = {(x.a, x.b) for x in dedupe.similar_titles(spark.createDataFrame(rows, "id long, title string")).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= dedupe.JACCARD}


def test_store_operators(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, ver int")
    new = spark.createDataFrame([(1, None, 1), (3, "c", 1), (2, "z", 4)], "k int, v string, ver int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(store.upsert_latest(old, new, ["k"], "ver")) == [(1, None, 1), (2, "b", 5), (3, "c", 1)]
    assert rows(store.replace_by_key(old, new, ["k"])) == [(1, None, 1), (2, "z", 4), (3, "c", 1)]
    assert rows(store.coalesce_upsert(old, new, ["k"], ["v"])) == [(1, "a", 1), (2, "z", 4), (3, "c", 1)]
    items = spark.createDataFrame([(1, "paper:7"), (1, "paper:7"), (2, "7"), (3, "paper:8"), (4, None)], "item_id int, canonical_id string")
    docs = spark.createDataFrame([("7", "seven"), ("paper:8", "eight")], "id string, title string")
    assert rows(store.library_view(items, docs)) == [(1, "paper:7", "7", "seven")] * 2 + [(2, "7", "7", "seven"), (3, "paper:8", "paper:8", "eight"), (4, None, None, None)]
    assert store.insert_statements(spark.createDataFrame([(1, "O'x", None)], "a int, b string, c double"), "t").first()[0] == "INSERT INTO t (a, b, c) VALUES (1, 'O''x', NULL);"
    assert store.fingerprint(old, "k", "ver").first() == store.fingerprint(old.orderBy(F.desc("k")), "k", "ver").first() != store.fingerprint(new, "k", "ver").first()


def test_job_queue(spark):
    now = F.lit("2024-01-01 00:00:30").cast("timestamp")
    rows = [(1, "queued", 1, 0, "2024-01-01 00:00:00", None), (2, "queued", 9, 0, "2024-01-01 00:00:00", None), (3, "queued", 9, 0, "2024-01-02 00:00:00", None), (4, "leased", 9, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:10")]
    j = spark.createDataFrame(rows, "id int, status string, priority int, attempts int, run_after string, leased_until string").withColumns({c: F.col(c).cast("timestamp") for c in ("run_after", "leased_until")})
    leased = {r.id: (r.status, r.attempts) for r in jobs.lease(j, now).collect()}
    assert leased == {1: ("queued", 0), 2: ("leased", 1), 3: ("queued", 0), 4: ("leased", 1)}
    assert {r.id: r.status for r in jobs.reclaim(j, now).collect()}[4] == "queued"
    hot = spark.createDataFrame([("a", 5), ("b", 9)], "query string, lookups int")
    assert [r.payload for r in jobs.recurring(hot).collect()][:2] == ["b", "a"]


def test_job_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(0, 5), i, f"2024-01-01 00:{i % 60:02}:00", r.choice(list(jobs.NEXT))) for i in range(60)]
    schema = "id long, seq long, at string, action string"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    query = stream_jobs.job_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {x.id: (x.status, x.attempts) for x in jobs.states(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (s, a) for i, s, a in out} == batch


def test_files(tmp_path, spark):
    def zipped(parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return b.getvalue()

    w = "http://w"
    docx = zipped({"word/document.xml": f"<w:document xmlns:w='{w}'><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    hwpx = zipped({"Contents/section0.xml": "<s><p><run><t>한글 문서</t></run></p><p><run><tbl><tr><tc><p><t>셀</t></p></tc></tr></tbl></run></p></s>"})
    stream = zlib.compress(b"BT (Hello \\(PDF\\)) Tj [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj"
    for name, data in {"a.docx": docx, "b.hwpx": hwpx, "c.pdf": pdf, "d.txt": " plain é ".encode(), "e.hwp": "한글 본문 내용입니다".encode("utf-16-le"), "f.docx": b"broken", "g.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hello\na | b" and got["b.hwpx"].text == "한글 문서\n[TABLE]\n셀" and got["c.pdf"].text == "Hello (PDF)\nworld" and got["c.pdf"].method == "pdf-streams"
    assert got["d.txt"].text == "plain é" and "한글 본문" in got["e.hwp"].text and got["f.docx"].warnings == ["BadZipFile"] and got["g.pdf"].method == "none"


def test_every_source_has_a_connector(spark):
    assert len(connectors.REGISTRY) == 20 and set(connectors.REGISTRY) == set(qu.GLOBAL_SOURCES) | set(qu.DOMESTIC_SOURCES)
    bad = spark.createDataFrame([(s, "q", "<<not a payload") for s in connectors.REGISTRY], "source string, query string, payload string")
    assert connectors.fan_out(bad).count() == 0


def test_defaults_evaluation_and_ops(spark):
    d = with_defaults(spark.createDataFrame([("1", "odd", None)], "id string, type string, title string")).first()
    assert d.type == "paper" and d.title == "" and d.authors == [] and d.citations == 0 and d.year is None and d.links == {}
    cases = spark.createDataFrame([(1, "deep joins", 1, 1, None, None, None), (2, "x", 1, 1, "kci", None, ["rice"]), (3, "y", 1, 1, None, None, None)], "case_id int, query string, min_total int, max_rank int, source string, type string, fragments array<string>")
    results = spark.createDataFrame([(1, 1, "arxiv", "paper", "t", "deep joins here"), (2, 1, "kci", "paper", "Beans", "b"), (2, 2, "kci", "paper", "Rice!", "b")], "case_id int, rank int, source string, type string, title string, text string")
    assert {r.case_id: (r.verdict, r.matched_rank) for r in evaluate.verdicts(cases, results).collect()} == {1: ("relevant", None), 2: ("suspect", 2), 3: ("no_result", None)}
    log = spark.createDataFrame([(i, 500 if i in (1, 28, 29, 30) else 200) for i in range(1, 31)], "id int, status int")
    assert tuple(ops.request_alerts(log).first()) == (20, 3, "critical")
    c = similarity.confidence(*[F.lit(x) for x in (90, 2400, 160, 3, 2, 1, 80, 4)])
    assert spark.range(1).select(c).first()[0] == int(90 * 0.34 + 18 + 16 + 89 * 0.18 + 78 * 0.14 + 0.5)


def test_search_cascade(spark):
    from quillgrid.operators.search import Index, search

    rows = [(i, f"Wildfire spread model {i}" if i < 10 else f"Rice cooking {i}", "Fire and wind." if i < 10 else "Water and rice.", "paper", ("arxiv", "kci")[i % 2], 2000 + i, i, "global") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, title string, abstract string, type string, source string, year int, citations int, region string").withColumn("keywords", F.array(F.lit("forest"))).withColumn("language", F.lit("en"))
    index, events = Index.of(docs), []
    got = search(index, "wildfire spread", on_event=lambda n, e: events.append(n)).collect()
    assert len(got) == 10 and {r["mode"] for r in got} == {"strict"} and all("Wildfire" in r.title for r in got)
    assert [r.match for r in got] == sorted((r.match for r in got), reverse=True) and events[0] == "summary" and events[-1] == "done"
    assert [r.id for r in search(index, "wildfire spread", sort="latest", k=3).collect()] == [9, 8, 7]
    few = search(index, "rice cooking 13").collect()
    assert few[0].id == 13
    assert search(index, "산불").count() > 0  # by the lexicon
    assert search(index, "zzzz qqqq").count() == 0


def test_detail(spark):
    from quillgrid.operators import detail

    edges = spark.createDataFrame([("1", str(i), "references", 1.0 - i / 10) for i in range(2, 6)] + [("2", "9", "similar", 0.5), ("1", "3", "similar", 0.4)], "source_id string, target_id string, edge_type string, weight double")
    health = {r.section: (r.entries, r.status) for r in detail.section_health(edges, "1").collect()}
    assert health["references"] == (4, "healthy") and health["similar"] == (1, "degraded") and health["cited_by"] == (0, "unavailable") and health["all"][1] == "degraded"
    docs = spark.createDataFrame([(1, "a", ["x", "y"], 2020, "s", "r"), (2, "b", ["y"], 2022, "s", "q"), (3, "c", [], 2019, "t", "r")], "id long, title string, keywords array<string>, year int, source string, region string")
    rows = {r.neighbour: r for r in detail.comparison_matrix(docs, edges, "1").collect() if r.edge_type == "references"}
    assert rows["2"].shared == ["y"] and rows["2"].same_source and not rows["2"].same_region and rows["2"].years_apart == 2 and set(rows) == {"2", "3"}
    a, b = (spark.createDataFrame(x, "via string, target string, weight double") for x in ([("v", "t", 0.1)], [("v", "t", 0.9), ("w", "t", 0.2)]))
    assert [tuple(r) for r in detail.merged_paths(a, b, 5).collect()] == [("v", "t", 0.1), ("w", "t", 0.2)]


def test_components_of_long_chains_are_whole(spark):
    """0-100-99-...-1: the least label is at the far end of an unlucky order."""
    links = [(0, 100), *((k, k + 1) for k in range(1, 100)), (200, 201)]
    nodes = spark.createDataFrame([(k,) for k in [*range(101), 200, 201, 300]], "id long")
    got = {x.id: x.cluster for x in dedupe.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 201: 200, 300: 300}
