"""Keyed tables, joins, jobs, logs, evaluation and streams over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.operators import evaluate, jobs, ops, store
from quillgrid.plans import sql
from quillgrid.schema import DOCUMENTS_VIEW_SQL, documents_view, table
from quillgrid.streaming import windows as streaming


def _orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", (F.unix_timestamp("o_orderdate") * 10**8 + F.col("o_orderkey")).alias("version"))


def upsert_latest(spark, d):
    o = _orders(spark, d)
    return store.upsert_latest(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey"], "version")


def replace_by_key(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return store.replace_by_key(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), ["l_orderkey"])


def coalesce_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    new = sums.select("c_custkey", F.when(F.col("n") > 10, F.lit("LARGE")).alias("c_mktsegment"), F.when(F.col("n") > 8, F.col("c_acctbal")).alias("c_acctbal"))
    return store.coalesce_upsert(old, new, ["c_custkey"], ["c_mktsegment"])


def last_writer(spark, d):
    return store.last_writer(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def insert_statements(spark, d):
    return store.insert_statements(table(spark, d, "nation"), "nation")


def library_view(spark, d):
    li = table(spark, d, "lineitem")
    items = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"), F.concat(F.when(F.col("l_linenumber") > 2, "paper:").otherwise(""), F.col("l_partkey").cast("string")).alias("canonical_id"))
    parts = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size")
    return store.library_view(items, parts)


def library_seeded(spark, d):
    """The library's items with large parts as stored documents and all parts as the seed catalogue."""
    li = table(spark, d, "lineitem")
    items = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"), F.concat(F.when(F.col("l_linenumber") > 2, "paper:").otherwise(""), F.col("l_partkey").cast("string")).alias("canonical_id"))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size")
    return store.library_with_seed(items, parts.where("p_size > 10").withColumn("p_name", F.when(F.col("p_size") > 20, F.col("p_name"))), parts)


def case_plan(spark, d):
    """The benchmark's items as fixed cases, and words of the documents' titles as topics, in 500 runs."""
    fixed = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.substring_index("text", " ", 3).alias("query"))
    return evaluate.case_plan(fixed, documents_view(spark, d).select(F.explode("keywords").alias("query")), 500)


def scenario_matches(spark, d):
    """For each source and language a case that asks for a type and two words; the results are its documents by citations."""
    v = documents_view(spark, d)
    key = F.concat_ws("/", "source", "language").alias("case_id")
    ranked = v.select(key, F.row_number().over(Window.partitionBy("source", "language").orderBy(F.desc("citations"), "id")).alias("rank"), F.col("id").cast("string").alias("id"), "source", "type", "title")
    cases = v.select(key, "source").distinct().select("case_id", F.lit(None).cast("string").alias("id"), "source", F.when(F.col("source") != "src0", "paper").alias("type"), F.array(F.lit("TION"), F.lit("en")).alias("fragments"))
    return evaluate.scenarios(cases, ranked, 5)


def score_rises(spark, d):
    """Lines of orders whose price is above that of the line before."""
    return evaluate.rises(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_linenumber", "l_extendedprice")


def session_users(spark, d):
    """Orders as sessions, customers as users, nations as preferences that some lack."""
    s = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    p = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return s.join(u, "o_custkey").join(F.broadcast(p), "c_nationkey", "left").select("o_orderkey", "c_name", "n_name")


def override_status(spark, d):
    n = table(spark, d, "nation")
    base = n.select(F.col("n_nationkey").alias("key"), F.lit("configured").alias("status"), F.lit(0).cast("long").alias("latency"))
    live = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.when(F.count("*") > 3, "online").alias("status"), F.count("*").alias("latency"))
    return store.override_status(base, live, "key")


def first_by_key(spark, d):
    c = table(spark, d, "customer")
    parts = [c.where(f"c_mktsegment = '{s}'").select("c_nationkey", F.lit(s).alias("segment")).distinct() for s in ("BUILDING", "MACHINERY", "AUTOMOBILE")]
    return store.first_by_key(parts, "c_nationkey")


def seen_and_unseen(spark, d):
    """Customers without orders, and those with orders of the first priority."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    never = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").withColumn("kind", F.lit("unseen"))
    urgent = c.join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").withColumn("kind", F.lit("urgent"))
    return never.unionByName(urgent)


def source_records(spark, d):
    return store.source_records(documents_view(spark, d))


def suggestions(spark, d):
    """Titles and keywords that hold a query word, by text, the first ten."""
    v = documents_view(spark, d)
    pool = v.select(F.col("title").alias("s")).unionByName(v.select(F.explode("keywords").alias("s"))).where("s <> ''").distinct()
    return pool.where(F.contains(F.lower("s"), F.lit("tion"))).orderBy("s").limit(10)


def table_counts(spark, d):
    return store.diagnostics({t: table(spark, d, t) for t in ("documents", "pages", "labels", "conversations", "events", "orders", "lineitem")})


def index_fingerprint(spark, d):
    return store.fingerprint(table(spark, d, "orders"), "o_orderkey", "o_orderdate")


def _jobs(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "completed").otherwise("queued")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), status.alias("status"), F.col("user_id").alias("priority"), F.lit(0).alias("attempts"), F.col("ts").alias("run_after"), F.lit(None).cast("timestamp").alias("leased_until"), F.col("ts").alias("updated_at"))


NOON = "2024-01-15 12:00:00"


def job_lease_order(spark, d):
    return jobs.lease_order(_jobs(spark, d), F.lit(NOON).cast("timestamp")).select("id", "priority")


def job_lease(spark, d):
    return jobs.lease(_jobs(spark, d), F.lit(NOON).cast("timestamp"), 3).select("id", "status", "attempts", "leased_until")


def job_counts(spark, d):
    return jobs.state_counts(_jobs(spark, d))


def job_states(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "lease").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("requeue")
    return jobs.states(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), action.alias("action"))).select("id", "status", "attempts")


def _lookups(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "miss").otherwise("set")
    return e.select(F.concat(F.lit(" Query "), (F.col("user_id") / 10).cast("int").cast("string")).alias("query"), F.col("event_type").alias("source"), kind.alias("kind"), F.col("ts").alias("at"))


def hot_queries(spark, d):
    return ops.hot_queries(_lookups(spark, d))


def cache_state(spark, d):
    return ops.cache_state(_lookups(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400 * 2)


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration_ms"))


def request_alerts(spark, d):
    return ops.request_alerts(_log(spark, d))


def recent_requests(spark, d):
    return _log(spark, d).orderBy(F.desc("id")).limit(50)


def detail_health(spark, d):
    v = documents_view(spark, d)
    n = ops.metadata_availability(v, ["title", "abstract", "authors", "organization", "keywords", "methods"])
    return v.select("id", n.alias("fields"), ops.grade(n, F.lit(6)).alias("grade"), ops.grade(F.size("methods"), F.lit(2)).alias("methods_grade"), ops.impact(F.col("citations"), F.size("keywords"), F.col("year")).alias("impact"))


def event_props(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", k.alias("k"), ops.severity(e, F.when(k > 90, F.lit("HIGH")), F.when(k > 50, F.lit(" MEDIUM ")), F.when(k > 10, F.lit(""))).alias("severity"))


def quality_verdicts(spark, d):
    """Conversations as cases: the first turn is the query, the turns after it are ranked results."""
    c = table(spark, d, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    r = c.withColumn("n", first)
    cases = r.where("n = 1").select(F.col("conv_id").alias("case_id"), F.col("text").alias("query"), F.lit(2).alias("min_total"), F.lit(2).alias("max_rank"), F.lit("assistant").alias("source"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("fragments"))
    results = r.where("n > 1").select(F.col("conv_id").alias("case_id"), (F.col("n") - 1).alias("rank"), F.col("role").alias("source"), F.lit("paper").alias("type"), F.col("text").alias("title"), "text")
    return evaluate.verdicts(cases, results)


def _judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    verdict = F.when(F.col("quality") == 0, "no_result").when(F.col("toxic") == 1, "suspect").otherwise("relevant")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.array("lang", "source").alias("labels"), verdict.alias("verdict"), "lang")


def quality_summary(spark, d):
    return evaluate.summary(_judged(spark, d))


def quality_pivot(spark, d):
    return _judged(spark, d).groupBy("lang").pivot("verdict", ["relevant", "suspect", "no_result"]).agg(F.count(F.lit(1))).na.fill(0)


def round_robin(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "lang")
    return evaluate.round_robin(pool, "lang", "doc_id")


def stream_event_windows(spark, d):
    return streaming.run_windows(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        upsert_latest, replace_by_key, coalesce_upsert, last_writer, insert_statements, library_view, library_seeded, case_plan, scenario_matches, score_rises, session_users, override_status, first_by_key, seen_and_unseen, source_records, suggestions, table_counts, index_fingerprint,
        job_lease_order, job_lease, job_counts, job_states, hot_queries, cache_state, request_alerts, recent_requests, detail_health, event_props, quality_verdicts, quality_summary, quality_pivot, round_robin, stream_event_windows,
    )
}

_V = DOCUMENTS_VIEW_SQL
_JOBS = "j as (select event_id as id, event_type as job_type, case when event_type = 'error' then 'failed' when value > 50 then 'completed' else 'queued' end as status, user_id as priority, ts from events)"
_LOOK = "l as (select lower(trim(' Query ' || cast(trunc(user_id / 10) as int))) as query, event_type as source, case when event_type = 'view' then 'hit' when event_type = 'click' then 'miss' else 'set' end as kind, ts from events)"
_JUDGED = "q as (select labels.doc_id, lang, source, case when quality = 0 then 'no_result' when toxic = 1 then 'suspect' else 'relevant' end as verdict from labels join documents using (doc_id))"
_SUMS = "count(*) as cases, count(*) filter (where verdict = 'relevant') as relevant, count(*) filter (where verdict = 'suspect') as suspect, count(*) filter (where verdict = 'no_result') as no_result"
ORACLES = {
    "index_fingerprint": "select count(*) as n, sum(('0x' || substr(md5(o_orderkey || ':' || cast(o_orderdate as varchar)), 1, 15))::bigint::hugeint)::decimal(38, 0) as digest from orders",
    "upsert_latest": "select o_custkey, o_orderkey, o_orderstatus, o_totalprice, v as version from (select *, cast(epoch(o_orderdate) as bigint) * 100000000 + o_orderkey as v from orders) qualify row_number() over (partition by o_custkey order by v desc) = 1",
    "replace_by_key": "with r as (select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'R') select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'N' and l_orderkey not in (select l_orderkey from r) union all select * from r",
    "coalesce_upsert": """with s as (select o_custkey as k, count(*) as n, round(sum(o_totalprice), 2) as t from orders group by all), n as (select k, case when n > 10 then 'LARGE' end as seg, case when n > 8 then t end as bal from s)
select coalesce(c_custkey, k) as c_custkey, coalesce(seg, c_mktsegment) as c_mktsegment, case when k is not null then bal else c_acctbal end as c_acctbal from customer full join n on c_custkey = k""",
    "last_writer": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "insert_statements": "select 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' as statement from nation",
    "library_view": """with i as (select l_orderkey || '-' || l_linenumber as item_id, case when l_linenumber > 2 then 'paper:' else '' end || l_partkey as canonical_id, cast(l_partkey as varchar) as k from lineitem)
select item_id, canonical_id, cast(p_partkey as varchar) as document_id, p_name, p_size from i left join (select * from part where p_size > 10) on cast(p_partkey as varchar) = k""",
    "library_seeded": """with i as (select l_orderkey || '-' || l_linenumber as item_id, case when l_linenumber > 2 then 'paper:' else '' end || l_partkey as canonical_id, l_partkey as k from lineitem)
select item_id, canonical_id, cast(p_partkey as varchar) as document_id, p_name, p_size from i left join part on p_partkey = k""",
    "case_plan": f"""with {_V}, f as (select item_id::varchar as case_id, array_to_string(string_split(text, ' ')[1:3], ' ') as query, 'fixed' as kind from benchmark), t as (select distinct trim(q) as query from (select unnest(keywords) as q from docs) where trim(q) <> ''),
r as (select query, row_number() over (order by md5(query), query) as r from t) select * from f union all select 'random-' || r, query, 'random' from r where r <= 500 - (select count(*) from f)""",
    "scenario_matches": f"""with {_V}, r as (select source || '/' || language as case_id, row_number() over (partition by source, language order by citations desc, id) as rank, type, source, {sql.norm('title')} as t from docs)
select case_id, count(*) as total, cast(m as int) as matched_rank, case when m is not null then 'matched-top-' || m else 'not-in-top' end as reason
from (select *, min(case when rank <= 5 and (source = 'src0' or type = 'paper') and (contains(t, 'tion') or contains(t, 'en')) then rank end) over (partition by case_id) as m from r) group by all""",
    "score_rises": "select * from (select l_orderkey, l_linenumber, l_extendedprice, lag(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_extendedprice) as before from lineitem) where l_extendedprice > before",
    "session_users": "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey left join (select * from nation where n_regionkey <> 2) on c_nationkey = n_nationkey where o_orderstatus = 'O'",
    "override_status": "with l as (select s_nationkey as k, case when count(*) > 3 then 'online' end as st, count(*) as n from supplier group by all) select coalesce(n_nationkey, k) as key, coalesce(st, case when n_nationkey is not null then 'configured' end) as status, coalesce(n, 0) as latency from nation full join l on n_nationkey = k",
    "first_by_key": "select c_nationkey, c_mktsegment as segment from (select distinct c_nationkey, c_mktsegment, list_position(['BUILDING', 'MACHINERY', 'AUTOMOBILE'], c_mktsegment) as p from customer) where p > 0 qualify row_number() over (partition by c_nationkey order by p) = 1",
    "seen_and_unseen": "select c_custkey, 'unseen' as kind from customer where c_custkey not in (select o_custkey from orders) union all select c_custkey, 'urgent' from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "source_records": "select doc_id as id, source as source_key from documents",
    "suggestions": f"with {_V}, p as (select title as s from docs union select unnest(keywords) from docs) select s from p where s <> '' and contains(lower(s), 'tion') order by s limit 10",
    "table_counts": " union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in ("documents", "pages", "labels", "conversations", "events", "orders", "lineitem")),
    "job_lease_order": f"with {_JOBS} select id, priority from j where status = 'queued' and ts <= timestamp '{NOON}'",
    "job_lease": f"""with {_JOBS}, c as (select id from j where status = 'queued' and ts <= timestamp '{NOON}' order by priority desc, id limit 3)
select j.id, case when c.id is not null then 'leased' else status end as status, cast(case when c.id is not null then 1 else 0 end as int) as attempts, case when c.id is not null then timestamp '{NOON}' + interval 15 second end as leased_until from j left join c on j.id = c.id""",
    "job_counts": f"with {_JOBS} select job_type, count(*) as jobs, count(*) filter (where status = 'queued') as pending, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, last(status order by ts, id) as latest from j group by job_type",
    "job_states": "select user_id as id, last(case event_type when 'signup' then 'queued' when 'view' then 'leased' when 'purchase' then 'completed' when 'error' then 'failed' else 'queued' end order by ts, event_id) as status, count(*) filter (where event_type = 'view') as attempts from events group by all",
    "hot_queries": f"with {_LOOK} select query, count(*) filter (where kind in ('hit', 'miss')) as lookups, count(*) filter (where kind = 'hit') as hits, count(*) filter (where kind = 'miss') as misses, count(*) filter (where kind = 'set') as sets, count(distinct source) as sources, max(ts) as last_seen from l group by query",
    "cache_state": f"with {_LOOK}, s as (select source || '::' || ' Query ' || split_part(query, ' ', 2) as key, max(ts) as set_at from l where kind = 'set' group by all) select key, set_at, case when cast(floor(epoch(timestamp '2024-01-30 00:00:00')) - floor(epoch(set_at)) as bigint) > 172800 then 'stale' else 'fresh' end as state from s",
    "request_alerts": "with r as (select event_type from events order by event_id desc limit 20) select count(*) as requests, count(*) filter (where event_type = 'error') as errors, case when count(*) filter (where event_type = 'error') >= 3 then 'critical' when count(*) filter (where event_type = 'error') > 0 then 'warning' else 'clear' end as level from r",
    "recent_requests": "select event_id as id, cast(case when event_type = 'error' then 500 else 200 end as int) as status, value as duration_ms from events order by event_id desc limit 50",
    "detail_health": f"""with {_V}, f as (select *, cast(trim(title) <> '' as int) + cast(trim(coalesce(abstract, '')) <> '' as int) + 1 + 1 + cast(len(keywords) > 0 as int) + cast(len(methods) > 0 as int) as n from docs)
select id, cast(n as int) as fields, case when n / 6.0 >= 0.75 then 'healthy' when n > 0 then 'degraded' else 'unavailable' end as grade, case when len(methods) / 2.0 >= 0.75 then 'healthy' when len(methods) > 0 then 'degraded' else 'unavailable' end as methods_grade,
 cast(least(99, floor(cast(0.35 as double) * citations + 4 * len(keywords) + case when year >= 2024 then 10 else 0 end + 0.5)) as int) as impact from f""",
    "event_props": "with e as (select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events) select event_id, k, case when k > 90 then 'HIGH' when k > 50 then 'MEDIUM' else 'UNKNOWN' end as severity from e",
    "quality_verdicts": """with r as (select *, row_number() over (partition by conv_id order by turn) as n from conversations), s as (select conv_id as case_id, count(*) filter (where n > 1) as total, min(n - 1) filter (where n > 1 and role = 'assistant') as m from r group by all)
select case_id, total, cast(m as int) as matched_rank, case when total < 2 then 'no_result' when m <= 2 then 'relevant' else 'suspect' end as verdict from s""",
    "quality_summary": f"with {_JUDGED}, u as (select lang as label, verdict from q union all select source, verdict from q) select label, {_SUMS} from u group by label union all select 'all', {_SUMS} from q",
    "quality_pivot": f"with {_JUDGED} select lang, count(*) filter (where verdict = 'relevant') as relevant, count(*) filter (where verdict = 'suspect') as suspect, count(*) filter (where verdict = 'no_result') as no_result from q group by lang",
    "round_robin": "select doc_id, lang, cast(row_number() over (partition by lang order by doc_id) as int) as place from documents",
    "stream_event_windows": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all",
}
