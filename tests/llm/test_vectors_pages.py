"""Exact search and page extraction, against brute force and planted pages."""

import random

import numpy as np

from quillgrid.llm import dualtree, wrappers


def test_search_is_exact(spark, monkeypatch):
    for name, n in (("DATA_ROWS", 64), ("QUERY_ROWS", 8), ("LEAF", 8), ("CHUNK", 2), ("PIVOTS", 4)):
        monkeypatch.setattr(dualtree, name, n)
    r = np.random.default_rng(1)
    centers = r.normal(size=(5, 6))
    vectors = [(centers[i % 5] + 0.2 * r.normal(size=6)).astype(np.float32).tolist() for i in range(500)]
    vectors += [vectors[0]] * 150  # copies, and so ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[1]), (900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (20, vectors[3]), (905, [0.5]), (906, [])]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, score string")
    best, met = dualtree.found(frame)
    got = {}
    for x in best.collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    part = [(i, np.floor(64 * np.array(v + [0.0] * (6 - len(v))))) for i, v in rows if i is not None and i not in (900, 901, 902, 903, 906)]
    asked = [p for p in part if p[0] % 20 == 0]
    for q in {i for i, _ in asked}:
        best = sorted((-int(a @ v), i) for j, a in asked if j == q for i, v in part if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(got) == len({i for i, _ in asked})
    assert 0 < met.agg({"compared": "sum"}).first()[0] < 0.7 * len(asked) * len(part)


def test_cover_trees_cover_and_separate():
    r = np.random.default_rng(6)
    for points in (r.normal(size=(900, 3)), r.normal(size=(300, 40)), np.repeat(r.normal(size=(20, 4)), 40, 0), np.zeros((100, 3)), r.normal(size=(1, 5))):
        points = np.floor(64 * points)
        t = dualtree.CoverTree.build(points, np.arange(len(points)))
        assert sorted(t.ids) == list(range(len(points))) and (t.points == points[t.ids]).all()
        for n, below in enumerate(t.below):
            mine = t.points[t.starts[n] : t.ends[n]]
            assert np.linalg.norm(mine - t.centers[n], axis=1).max() <= t.radii[n] * (1 + 1e-12)
            if not len(below):
                assert len(mine) <= dualtree.LEAF or t.radii[n] == 0
                continue
            assert [*t.starts[below], t.ends[n]] == [t.starts[n], *t.ends[below]]
            assert (t.radii[below] <= t.radii[n] / 2 * (1 + 1e-9)).all()
            apart = np.linalg.norm(t.centers[below][:, None] - t.centers[below][None], axis=2)
            assert (apart + 1e9 * np.eye(len(below)) > t.radii[n] / 2 * (1 - 1e-9)).all()


def test_repeated_rows_count_each(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "DATA_ROWS", 64)
    monkeypatch.setattr(dualtree, "QUERY_ROWS", 8)
    monkeypatch.setattr(dualtree, "LEAF", 8)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += 12 * [(1, [9.0] * 6)] + 30 * [(2, [-8.0, 8.0] * 3)] + 2 * [rows[20]] + [(40, rows[7][1])]
    got = {}
    for x in dualtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    part = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    for q in range(0, 300, 20):
        best = sorted((-int(a @ b), j) for i, a in part if i == q for j, b in part if j != q)[:20]
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_search_with_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted(map(tuple, dualtree.top_k(few).collect()))
    assert rows == [(0, 1, 20, 4096), (0, 2, 7, 2048), (20, 1, 0, 4096), (20, 2, 7, 2048)]
    assert dualtree.top_k(few.limit(0)).count() == 0


def test_trees_prune(monkeypatch):
    r = np.random.default_rng(2)
    data = np.concatenate([100 * np.eye(8)[i % 8] + r.normal(size=(1, 8)) for i in range(4000)]).round()
    top = dualtree.TopK(np.arange(10), 5)
    queries = dualtree.CoverTree.build(data[:80:8], np.arange(10))
    top.ids = queries.ids
    compared = dualtree.search(queries, dualtree.CoverTree.build(data, np.arange(1000, 5000)), top)
    assert compared < 0.3 * 10 * 4000


def page(title, paragraphs, extra="", nav=3):
    menu = "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(nav))
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><header>Site head</header><nav><ul>{menu}</ul></nav><div class='ad'>buy</div><article><h1>{title}</h1>{''.join(f'<p>{p}' for p in paragraphs)}{extra}</article><div class='comments'><article class='comment'><p>I disagree</p></article></div><aside>side</aside><footer>&copy; foot</footer><script>var x = '<p>no</p>';</script>"


def test_wrappers_find_the_article(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        parts = [" ".join(r.choice(["alpha", "beta &amp; co", "<b>gamma</b>", "a\n\t  b"]) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))]
        notice = "<p class='x'><form><input>ask</form></p>" if i % 2 else "<div class='cookie-notice'>we use cookies</div>"
        clean = lambda s: " ".join(s.replace("&amp;", "&").replace("<b>", "").replace("</b>", "").split())
        rows.append((i, "http://h.example/p" if i % 3 else f"https://u:1@k{i}.example", page(f"Title {i}", parts, notice, i % 5)))
        want[i] = "\n".join([f"Title {i}", *map(clean, parts)])
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://h.example/q", "plain & text"), (103, "http://h.example", "<div>" * 5000 + "deep"), (104, "http://h.example/z", "<p"), (105, "http://z.example", "<article><p>cut &am")]
    want |= {100: "", 101: "", 102: "plain & text", 103: "deep", 104: "", 105: "cut &am"}
    pages = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, text string")
    got = {x.page_id: x for x in wrappers.extract(pages).collect()}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(want[i]) for i, x in got.items())
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_alignment_makes_groups_slots_and_options():
    a, b = (wrappers.page_wrapper(wrappers.blocks(h)) for h in ("<body><h1>A</h1><p>x</p><p>y</p>", "<body><h1>B</h1><div>extra</div><p>z</p>"))
    assert wrappers.align(a, b)[0] == "<><body><h1>#</>(<div>#</>)?(<p>#</>)+</></>"
    told = wrappers.Rules(wrappers.rules(wrappers.align(a, b)))
    assert wrappers.main_text("<body><h1>C</h1><p>only", told) == "C\nonly"


def wrapper_of(pages):
    whole = None
    for html in pages:
        one = wrappers.page_wrapper(wrappers.blocks(html))
        whole = one if whole is None else wrappers.align(whole, one)
    return wrappers.Rules(wrappers.rules(whole))


def test_without_an_article_the_running_text_wins():
    html = "<body><div id=nav><a href=x>one</a> <a href=y>two</a></div><div id=wrap><div><h1>t</h1><p>much more running text than anything else here</p></div><div class=related>see</div></div>"
    assert wrappers.main_text(html, None) == "t\nmuch more running text than anything else here"


def test_deep_markup_and_late_heads_lose_no_text():
    deep = "<div>" * 150 + "inner<nav>deep menu</nav><p>last" + "</div>" * 150
    html = f"<html><body><div><article><p>first</p>{deep}<p>after</p></article><p>outside</p></div></body></html>"
    assert wrappers.main_text(html, None) == "first\ninner\nlast\nafter"
    late = "<!--" + "x" * 3000 + "--><html><head><title>t</title><meta name=a><body><article><p>text</article>"
    assert wrappers.main_text(late, None) == "text"
    assert wrappers.blocks("<head><title>t</title></head>a<!-- <head> -->b")[0][2] == "ab"
    for n in (50, 120, 300):
        for one in (lambda k: "<div>", lambda k: f"<div class={'ab'[k % 2]}>"):
            nest = "".join(map(one, range(n)))
            html = f"<body>{nest}<article><p>the text</p><div class=comments><p>I disagree</p></div></article>{'</div>' * n}<footer>f</footer>"
            assert wrappers.main_text(html, None) == "the text"


def test_markup_that_misleads_loses_no_text():
    cases = {
        '<article><p>a<svg class="i"/>b</p><p>c</article>': "ab\nc",
        '<article><p>a<svg><title>no</title></svg>b</p></article>': "a b",
        '<article><p>x <img alt="a > b"> y <span title=\'p > q\'>z</span> don\'t</p></article>': "x y z don't",
        '<article class="post share-enabled"><p>kept</article><footer>f</footer>': "kept",
        '<body class="has-sidebar"><article><p class="login-tip">tip</p><p class="cookie-notice">no</p><p>on</article>': "tip\non",
        "<article><p>before<object data=x><p>after</article>": "before\nafter",
        "<article><p>press <button>Start</button> now</p><button>Buy</button></article>": "press Start now",
        "<article><p>a</p><p>5 < 6 & 7 > 2</p></article>": "a\n5 < 6 & 7 > 2",
        "<div class='widget'><article class='promo'><p>only text</article></div>": "only text",
    }
    for html, want in cases.items():
        assert wrappers.main_text(html, None) == want, html


def test_copies_of_an_article_lose_no_text():
    for tag in ("article", "main", "div"):
        pages = [f"<body><{tag}><h1>h{i}</h1><p>own words {i}</{tag}>" for i in range(5)] + 12 * [f"<body><{tag}><h1>copied</h1><p>same<blockquote>quoted words</blockquote></{tag}>"]
        assert wrappers.main_text(pages[-1], wrapper_of(pages)) == "copied\nsame\nquoted words"


def templated(spark):
    """Pages whose main text only the wrapper tells apart: a constant note, and a container that holds less than a side column on one page."""
    r = random.Random(9)
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randint(2, 6) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body, side = words(4 if i == 7 else 60), words(30)
        extra = f"<figure><figcaption>fig {i}</figcaption></figure>" if i % 3 == 0 else ""
        rows.append((i, "http://t.example/" + str(i), f"<body><div class=left><p>{side}</p></div><div class=right><h1>T{i}</h1><p>{body}</p>{extra}<section><p>Made by the editors of this site.</p></section></div>"))
        want[i] = "\n".join([f"T{i}", body, *([f"fig {i}"] if extra else [])])
    return rows, want


def test_the_wrapper_decides(spark):
    rows, want = templated(spark)
    schema = "page_id long, url string, html string"
    told = {x.page_id: x.text for x in wrappers.extract(spark.createDataFrame(rows, schema)).collect()}
    assert told == want
    alone = {i: wrappers.main_text(html, None) for i, _, html in rows}
    assert all(alone[i] != want[i] for i in want) and "editors" in alone[0] and not alone[7].startswith("T7")


def test_the_wrapper_does_not_depend_on_the_partitioning(spark):
    rows, _ = templated(spark)
    rows += [(100 + i, "http://u.example/", page(f"T{i}", ["p"] * (i % 4), "<ul><li>x</ul>" if i % 3 else "<table><tr><td>y</table>", i % 5)) for i in range(50)]
    random.Random(2).shuffle(rows)
    frames = [spark.createDataFrame(rows[::k], "page_id long, url string, html string").repartition(n) for k, n in ((1, 1), (-1, 13))]
    one, two = ({(x.host, x.rules) for x in wrappers.infer(f).collect()} for f in frames)
    assert one == two and len(one) == 2


def test_alignment_of_long_lists_is_a_longest_one(monkeypatch):
    r = random.Random(4)

    def best(a, b):
        row = [0] * (len(b) + 1)
        for x in reversed(a):
            new = [0] * (len(b) + 1)
            for j in range(len(b) - 1, -1, -1):
                new[j] = max(row[j], new[j + 1], row[j + 1] + 2 + (x[1] == b[j][1]) if x[0] == b[j][0] else 0)
            row = new
        return row[0]

    for cells in (4, 1000):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(200):
            a, b = ([(r.randrange(3), r.randrange(2)) for _ in range(r.randint(0, 9))] for _ in range(2))
            columns = [np.array([x[k] for x in of], np.int64) for k in (0, 1) for of in (a, b)]
            got = wrappers._pairs(*columns)
            assert got == sorted(got) and all(p < q for p, q in zip(got, got[1:])) and all(a[i][0] == b[j][0] for i, j in got)
            assert sum(2 + (a[i][1] == b[j][1]) for i, j in got) == best(a, b)
