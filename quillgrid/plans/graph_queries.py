"""Edges derived from documents, and expansions over the edges of the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.functions import text as tx
from quillgrid.operators import dedupe, detail, graph, stored
from quillgrid.operators.document_index import shared_path
from quillgrid.plans import sql
from quillgrid.plans.retrieval import _BM_SPARSE, _BUNDLE
from quillgrid.schema import DOCUMENTS_VIEW_SQL, documents_view, table


def star_edges(spark, d):
    """Customers and suppliers to nations, nations to regions; a weight by the balance's last digit."""
    edge = lambda df, s, t, a, b, kind, w: df.select(F.concat(F.lit(s), a.cast("string")).alias("source_id"), F.concat(F.lit(t), b.cast("string")).alias("target_id"), F.lit(kind).alias("edge_type"), w.alias("weight"))
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    part = lambda k: (F.pmod(k, F.lit(10)) + 1) / 10.0
    out = edge(c, "c:", "n:", F.col("c_custkey"), F.col("c_nationkey"), "similar", part(F.col("c_custkey")))
    out = out.unionByName(edge(s, "s:", "n:", F.col("s_suppkey"), F.col("s_nationkey"), "references", part(F.col("s_suppkey"))))
    return out.unionByName(edge(n, "n:", "r:", F.col("n_nationkey"), F.col("n_regionkey"), "topic_bridge", part(F.col("n_nationkey"))))


def similar_edges(spark, d):
    """Edges by the stored vectors of all documents and their keywords."""
    from quillgrid.plans.retrieval import indexed

    vectors = indexed(spark, d).vectors()
    return graph.similar(documents_view(spark, d).select("id", "keywords").join(vectors, "id"))


def semantic_edges(spark, d):
    """References, affinity and topic edges of all documents with the cosines of their stored vectors."""
    from quillgrid.plans.retrieval import indexed

    return graph.semantic_edges(documents_view(spark, d).join(indexed(spark, d).vectors(), "id"))


def author_edges(spark, d):
    return graph.author_edges(documents_view(spark, d))


def reference_edges(spark, d):
    return graph.reference_edges(documents_view(spark, d))


def affinity_edges(spark, d):
    return graph.affinity_edges(documents_view(spark, d))


def topic_edges(spark, d):
    return graph.topic_edges(documents_view(spark, d))


def edge_scan(spark, d):
    return graph.scan(star_edges(spark, d), target="n:3", kind="similar")


def neighbourhood(spark, d):
    return graph.neighbourhood(star_edges(spark, d), "n:5", 4)


def two_hop_paths(spark, d):
    return graph.two_hop_paths(star_edges(spark, d))


def traversal(spark, d):
    return graph.traversal(star_edges(spark, d), "n:7", 12)


def distinct_edges(spark, d):
    """Edges of orders' customers to their priorities: many repeats, the heaviest of each."""
    o = table(spark, d, "orders")
    return graph.distinct_edges(o.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderpriority").alias("target_id"), F.col("o_orderstatus").alias("edge_type"), F.col("o_totalprice").alias("weight")))


def citation_neighbourhood(spark, d):
    docs = documents_view(spark, d)
    return graph.heuristic_neighbourhood(docs, docs)


def semantic_neighbourhood(spark, d):
    from quillgrid.plans.retrieval import indexed

    return graph.semantic_neighbourhood(documents_view(spark, d).join(indexed(spark, d).vectors(), "id"))


def detail_pages(spark, d):
    """Pages of all documents. Stored references lead from each labelled document to the next of its quality; documents without such get heuristic ones."""
    docs = documents_view(spark, d)
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    later = F.lead("doc_id").over(Window.partitionBy("quality").orderBy("doc_id"))
    stored = marks.select(F.col("doc_id").alias("source_id"), later.alias("target_id"), F.lit("references").alias("edge_type"), F.lit(0.9).alias("weight")).where("target_id is not null")
    out = detail.pages(docs, detail.lists_of(stored, graph.heuristic_neighbourhood(docs, docs)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("id", text("references"), text("citations"), "references_stored", "citations_stored", text("related"), "impact", "fresh")


def stored_facts(spark, d):
    """The star's edges, appended as they are and those of suppliers once more, less the light ones of similar kind and all of topics; then the kinds of events by day, less those of errors."""
    edges = star_edges(spark, d)
    facts = stored.Facts(spark, shared_path(spark, f"edges-{uuid.uuid4().hex}"), edges.schema, "edge_type")
    facts.append(edges)
    facts.append(edges.where("edge_type = 'references'"))
    facts.delete((F.col("edge_type") == "similar") & (F.col("weight") < 0.3))
    facts.delete(F.col("edge_type") == "topic_bridge")
    day = table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    logs = stored.Facts(spark, shared_path(spark, f"logs-{uuid.uuid4().hex}"), day.schema, "day")
    logs.append(day)
    logs.delete(F.col("event_type") == "error")
    both = facts.rows().select(F.lit("edge").alias("fact"), "source_id", "target_id", F.col("edge_type").alias("kind"), "weight")
    return both.unionByName(logs.rows().select(F.lit("log").alias("fact"), F.col("event_id").cast("string").alias("source_id"), "day", F.col("event_type").alias("kind")).select("fact", "source_id", F.col("day").alias("target_id"), "kind", F.lit(None).cast("double").alias("weight")))


def stored_documents(spark, d):
    """The documents as stored JSON rows: all of them scanned, those that labels call toxic looked up."""
    view = documents_view(spark, d)
    rows = stored.JsonRows(spark, shared_path(spark, f"rows-{uuid.uuid4().hex}"), view.schema)
    rows.replace(view)
    marked = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    cut = lambda df, how: df.select(F.lit(how).alias("how"), "id", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"), F.array_join("keywords", "|").alias("keywords"), "year", "citations")
    return cut(rows.scan(), "scan").unionByName(cut(rows.lookups(marked), "lookup"))


def ordered_merge(spark, d):
    """Good labelled documents as a catalogue, all documents as the stored ones, benchmark texts as live ones, merged by title in that order."""
    view = documents_view(spark, d)
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    live = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.lit("live").alias("source"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.lit(1_000).alias("citations"))
    every = stored.ordered_union([view.join(good, "id", "left_semi"), view, live]).withColumn("title_key", tx.title_key(F.col("title")))
    out = dedupe.canonical_merge(every.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keywords", "methods")}), "title_key", ("ord", "id"))
    return out.select("title_key", "id", "records", "source", F.array_join("sources", "|").alias("sources"), "citations", F.md5("abstract").alias("abstract_md5"), F.array_join("keywords", "|").alias("keywords"), "organization")


def result_edges(spark, d):
    from quillgrid.plans.retrieval import bm25_topk

    top = bm25_topk(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return graph.result_edges(top.select("rank", F.col("doc_id").alias("id"), "score"))


QUERIES = {f.__name__: f for f in (star_edges, similar_edges, semantic_edges, author_edges, reference_edges, affinity_edges, topic_edges, edge_scan, neighbourhood, two_hop_paths, traversal, distinct_edges, citation_neighbourhood, semantic_neighbourhood, detail_pages, stored_facts, stored_documents, ordered_merge, result_edges)}

_STAR = """e as (select 'c:' || c_custkey as source_id, 'n:' || c_nationkey as target_id, 'similar' as edge_type, (c_custkey % 10 + 1) / 10.0 as weight from customer
 union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'references', (s_suppkey % 10 + 1) / 10.0 from supplier union all select 'n:' || n_nationkey, 'r:' || n_regionkey, 'topic_bridge', (n_nationkey % 10 + 1) / 10.0 from nation)"""


#: All pairs of documents: what the best of them are compared with.
_EVERY = "p as (select a.id as x, b.id as y from docs a join docs b on a.id <> b.id)"


def _overlap(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / greatest(len({a}), len({b})) else 0 end"


def _best(kind: str, weight: str, where: str = "true", extra: str = "") -> str:
    return f"""{extra} w as (select x, y, round({weight} + 1e-9, 4) as weight, {weight} as raw from p join docs a on a.id = x join docs b on b.id = y where {where}),
r as (select *, row_number() over (partition by x order by weight desc, y) as r from w where {f"raw > {graph.LEAST[kind]} + 1e-9" if kind in graph.ABOVE else f"weight >= {graph.LEAST[kind]}"}),
o as (select cast(x as varchar) as source_id, cast(y as varchar) as target_id, '{kind}' as edge_type, weight from r where r <= {graph.MOST[kind]})"""


_REF = _best("references", f"0.55 * {_overlap('a.keywords', 'b.keywords')} + least(b.citations / 300.0, 0.2)", "b.year <= a.year")
_AFF = _best("author_affinity", f"0.55 * case when a.organization = b.organization then len(list_intersect(a.authors, b.authors)) else 0 end + case when a.organization = b.organization then 0.18 else 0 end + 0.17 * {_overlap('a.keywords', 'b.keywords')}")
_TOP = _best("topic_bridge", f"0.42 * {_overlap('a.keywords', 'b.keywords')} + 0.3 * {_overlap('a.words', 'b.words')} + case when a.region = b.region then 0.06 else 0 end").replace("join docs ", "join dw ")
_V = DOCUMENTS_VIEW_SQL
_NEAR = f"""dw as (select *, list_distinct({sql.tokens("concat_ws(' ', title, array_to_string(keywords, ' '))")}) as words from docs), m as (select a.id as p_id, b.id, a.year as p_year, b.year, b.citations from dw a join dw b on a.id <> b.id and list_has_any(a.words, b.words)),
s as (select p_id, 'references' as side, id, citations, 0.62 as weight from m where year <= p_year union all select p_id, 'citations', id, citations, 0.58 from m where year >= p_year),
r as (select *, cast(row_number() over (partition by p_id, side order by citations desc, id) as int) as rank from s)"""


#: All pairs of documents (pr) with the cosines of their vectors and what else rates them.
_VECTORS = f"""{_BUNDLE}, {sql.dense('b', 'bu', 1024)}, bl as (select id, list(value order by bucket) as x, list(bucket order by bucket) as places, sqrt(sum(value * value)) as z from bv group by id),
dv as (select id, list_transform(range(1024), lambda i: coalesce(x[nullif(list_position(places, i), 0)], 0.0)) as v, z from bl), kd as (select docs.*, list_distinct({sql.tokens('title')}) as words, v, z from docs left join dv using (id)),
pr as (select a.id as x, b.id as y, coalesce(list_inner_product(a.v, b.v) / (a.z * b.z), 0.0) as cos, {_overlap('a.keywords', 'b.keywords')} as keys, {_overlap('a.words', 'b.words')} as title, a.region = b.region as place, a.organization = b.organization as house,
 case when a.organization = b.organization then len(list_intersect(a.authors, b.authors)) else 0 end as people, a.year as x_year, b.year, b.citations from kd a join kd b on a.id <> b.id)"""


def _traversal(most: int) -> str:
    """Common tables up to tv: paths from n:7 over the star's edges."""
    return f"""v as (select * from e union all select target_id, source_id, edge_type, weight from e), f0 as (select target_id, max(weight) as weight from v where source_id = 'n:7' and target_id <> 'n:7' group by all),
f as (select *, row_number() over (order by weight desc, target_id) as r from f0), s as (select p.target_id as via, p.weight as w1, v.target_id, v.weight, row_number() over (partition by p.target_id, v.edge_type order by v.weight desc, v.target_id) as r from v join f p on p.r <= {min(most, 4)} and v.source_id = p.target_id where v.target_id not in ('n:7', p.target_id)),
u as (select '' as via, target_id as target, round(weight, 4) as weight, 1 as hops from f where r <= {most} union all select via, target_id, round(max(0.55 * w1 + 0.45 * weight), 4), 2 from s where r <= 4 group by all),
tv as (select * from u order by weight desc, hops, via, target limit {most})"""


ORACLES = {
    "citation_neighbourhood": f"with {_V}, {_NEAR} select p_id, side, rank, id, cast(weight as double) as weight from r where rank <= 8",
    "semantic_neighbourhood": f"""with {_V}, {_VECTORS}, tw as (select id, list_distinct({sql.tokens("concat_ws(' ', title, array_to_string(keywords, ' '))")}) as ws from docs),
m as (select x as p_id, y as id, x_year, year, citations from pr join tw a on a.id = x join tw b on b.id = y where list_has_any(a.ws, b.ws) or cos >= 0.32),
s as (select p_id, 'references' as side, id, citations, 0.62 as weight from m where year <= x_year union all select p_id, 'citations', id, citations, 0.58 from m where year >= x_year),
r as (select *, cast(row_number() over (partition by p_id, side order by citations desc, id) as int) as rank from s) select p_id, side, rank, id, cast(weight as double) as weight from r where rank <= 8""",
    "detail_pages": f"""with {_V}, {_NEAR}, lm as (select doc_id, max(quality) as quality from labels group by doc_id), le as (select doc_id as p_id, lead(doc_id) over (partition by quality order by doc_id) as id from lm),
ls as (select p_id, 'references' as side, 1 as rank, id, true as kept from le where id is not null union all select p_id, side, rank, id, false from r where rank <= 8 and not (side = 'references' and p_id in (select p_id from le where id is not null))),
pg as (select p_id as id, coalesce(list(id order by rank) filter (where side = 'references'), []) as refs, coalesce(list(id order by rank) filter (where side = 'citations'), []) as cits, coalesce(bool_or(kept) filter (where side = 'references'), false) as rs from ls group by p_id),
al as (select docs.id, citations, year, coalesce(refs, []) as refs, coalesce(cits, []) as cits, coalesce(rs, false) as rs from docs left join pg using (id)), rl as (select *, list_concat(cits, refs) as b from al)
select id, array_to_string(refs, ',') as references, array_to_string(cits, ',') as citations, rs as references_stored, false as citations_stored, array_to_string(({sql.unique('b')})[1:4], ',') as related,
 cast(least(99, floor(citations * 0.35 + (len(refs) + len(cits)) * 4 + case when year >= 2024 then 10 else 0 end + 0.5)) as int) as impact, year >= 2024 as fresh from rl""",
    "stored_facts": f"""with {_STAR}, f as (select * from e union all select * from e where edge_type = 'references')
select 'edge' as fact, source_id, target_id, edge_type as kind, cast(weight as double) as weight from f where edge_type <> 'topic_bridge' and not (edge_type = 'similar' and weight < 0.3)
union all select 'log', cast(event_id as varchar), strftime(ts, '%Y-%m-%d'), event_type, null from events where event_type <> 'error'""",
    "stored_documents": f"""with {_V}, s as (select id, md5(title) as title_md5, md5(abstract) as abstract_md5, array_to_string(keywords, '|') as keywords, year, citations from docs)
select 'scan' as how, * from s union all select 'lookup', * from s where id in (select doc_id from labels where toxic = 1)""",
    "ordered_merge": f"""with {_V}, u as (select 0 as ord, id, source, title, abstract, citations, keywords, organization from docs where id in (select doc_id from labels where quality = 1) union all select 1, id, source, title, abstract, citations, keywords, organization from docs
 union all select 2, item_id, 'live', split_part(text, chr(10), 1), text, 1000, [], null from benchmark), k as (select *, regexp_replace(regexp_replace({sql.norm('title')}, '{tx.VENUE_WORDS}', ' ', 'g'), '\\s+', '', 'g') as title_key from u),
m as (select title_key, first(id order by ord, id) as id, count(*) as records, first(source order by ord, id) as source, array_to_string(list_sort(list(distinct source)), '|') as sources, max(citations) as citations, md5(first(abstract order by length(abstract) desc, ord, id)) as abstract_md5,
 flatten(list(keywords order by ord, id)) as ks, first(organization order by ord, id) filter (where organization <> '') as organization from k group by title_key)
select title_key, id, records, source, sources, citations, abstract_md5, coalesce(array_to_string({sql.unique('ks')}[1:12], '|'), '') as keywords, organization from m""",
    "star_edges": f"with {_STAR} select * from e",
    "author_edges": f"""with {_V}, a as (select id, organization, unnest(authors) as author from docs), t as (select cast(id as varchar) as d, 'author:' || {sql.norm('author')} || '::' || array_to_string(list_filter(string_split({sql.norm('organization')}, ' '), lambda t: length(t) >= 2)[1:3], ':') as a from a)
select d as source_id, a as target_id, 'authored_by' as edge_type, 1.0 as weight from t union all select a, d, 'author_document', 1.0 from t""",
    "reference_edges": f"with {_V}, {_EVERY}, {_REF} select * from o union all select target_id, source_id, 'cited_by', weight from o",
    "affinity_edges": f"with {_V}, {_EVERY}, {_AFF} select * from o",
    "topic_edges": f"with {_V}, dw as (select *, list_distinct({sql.tokens('title')}) as words from docs), {_EVERY}, {_TOP} select * from o",
    "edge_scan": f"with {_STAR} select * from e where target_id = 'n:3' and edge_type = 'similar'",
    "neighbourhood": f"""with {_STAR}, b as (select 'out' as direction, target_id as neighbour, edge_type, weight from e where source_id = 'n:5' union all select 'in', source_id, edge_type, weight from e where target_id = 'n:5'),
r as (select *, row_number() over (partition by direction, edge_type order by weight desc, neighbour) as r from b) select direction, neighbour, edge_type, weight from r where r <= 4""",
    "two_hop_paths": f"""with {_STAR} select a.source_id as start, a.target_id as via, b.target_id as target, a.edge_type as first, b.edge_type as second, round(max(a.weight * b.weight), 4) as weight
from e a join e b on a.target_id = b.source_id where b.target_id <> a.source_id group by all""",
    "traversal": f"with {_STAR}, {_traversal(12)} select via, target, weight, cast(hops as int) as hops from tv",
    "similar_edges": f"""with {_V}, {_VECTORS},
w as (select x, y, round(0.72 * cos + 0.28 * keys, 6) as s from pr), r as (select *, row_number() over (partition by x order by s desc, y) as r from w where s >= 0.33)
select cast(x as varchar) as source_id, cast(y as varchar) as target_id, 'similar' as edge_type, round(s, 4) as weight from r where r <= 4""",
    "semantic_edges": f"""with {_V}, {_VECTORS},
w as (select 'references' as kind, 8 as most, x, y, 0.55 * keys + 0.45 * cos + least(citations / 300.0, 0.2) as raw from pr where year <= x_year
 union all select 'author_affinity', 4, x, y, 0.55 * people + case when house then 0.18 else 0 end + 0.17 * keys + 0.1 * cos from pr
 union all select 'topic_bridge', 4, x, y, 0.42 * keys + 0.3 * title + 0.22 * cos + case when place then 0.06 else 0 end from pr where keys > 0 or title > 0 or cos >= 0.46),
k as (select *, round(raw + 1e-9, 4) as weight from w), r as (select *, row_number() over (partition by kind, x order by weight desc, y) as r from k where case kind when 'references' then raw > 0.18 + 1e-9 when 'author_affinity' then raw > 0.2 + 1e-9 else weight >= 0.22 end),
o as (select cast(x as varchar) as source_id, cast(y as varchar) as target_id, kind as edge_type, weight from r where r <= most) select * from o union all select target_id, source_id, 'cited_by', weight from o where edge_type = 'references'""",
    "result_edges": f"""with {_V}, {_BUNDLE}, {sql.sparse20('b', 'bu')}, {_BM_SPARSE}, tp as (select id, round(bm25, 6) as score, row_number() over (order by round(bm25, 6) desc, id) as r from bm)
select (select cast(id as varchar) from tp where r = 1) as source_id, cast(id as varchar) as target_id, 'similar' as edge_type, score as weight from tp where r between 2 and 20""",
    "section_health": f"""with {_STAR}, {_traversal(8)}, b as (select edge_type as section, least(count(*), 8) as entries from e where source_id = 'n:7' group by all union all select 'paths', count(*) from tv where hops = 2),
sc as (select * from (values ('references', 4), ('cited_by', 4), ('similar', 3), ('author_affinity', 2), ('topic_bridge', 2), ('paths', 4)) t(section, total)),
g as (select section, coalesce(entries, 0) as entries, total, round(least(1.0, coalesce(entries, 0) / total), 4) as ratio, case when least(1.0, coalesce(entries, 0) / total) >= 0.75 then 'healthy' when coalesce(entries, 0) > 0 then 'degraded' else 'unavailable' end as status from sc left join b using (section))
select section, entries::bigint as entries, total::int as total, ratio, status from g union all select 'all', sum(entries)::bigint, sum(total)::int, round(avg(ratio), 4), case when bool_and(status = 'healthy') then 'healthy' else 'degraded' end from g""",
    "distinct_edges": "select 'c:' || o_custkey as source_id, o_orderpriority as target_id, o_orderstatus as edge_type, max(o_totalprice) as weight from orders group by all",
}


def section_health(spark, d):
    return detail.section_health(star_edges(spark, d), "n:7")


QUERIES["section_health"] = section_health
