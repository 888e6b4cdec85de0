"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell holds its tokens.
Raking scales the cells to each target marginal in turn, a fixed number of rounds, and
never beyond the tokens a cell has: cells that are full stay so while a marginal has to
grow, and the others make up for them. The size asked for is the share KEEP of the
largest that every single marginal could meet; residuals() tells how far the result is
from its targets. A document is kept with its cell's raked share of its tokens, so the
kept tokens are expected to meet the targets. The draw is a hash of its id, the same in
every run. Everything is DataFrame work; only cells, which are sums, are raked.

Target shares are tables: stated for languages, and the corpus's own shares raised to a
power below 1 for sources and topics. A text's topic is the subject whose words it has
most of; without two such words it is the kind of its form.

Cases: null source or language is the value "(none)"; null and empty texts have no
tokens and the topic "empty", and as no weight is due to them their probability is 0;
a value without a target keeps its weight; targets are scaled to sum to 1; repeated rows
and equal ids get one draw, a null id the draw of the text "(none)"; an empty table
gives an empty result; other columns pass through mix() unless they have the names it
adds, or _source or _lang.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import WORD, cut, hex_fraction, table

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking; each fits the three marginals in turn.
ROUNDS = 6
#: The size asked for, as a share of the largest that each marginal could meet by itself.
KEEP = 0.8
#: Stated target shares of languages; others share what is left by their tokens.
LANGUAGES = {"en": 0.43, "de": 0.19, "fr": 0.19, "es": 0.14}
#: Target share of a source or topic: its share of the tokens to this power, scaled to sum to 1.
TEMPER = {"source": 0.7, "topic": 0.8}
#: Cells are broadcast up to this count (some 100 bytes each) and shuffled beyond it.
BROADCAST_CELLS = 100_000
#: Words of a subject, in any of the four languages; the first letter may be a capital.
SUBJECTS = {
    "law": "court courts judge law laws lawyer legal plaintiff statute gericht gesetz gesetze klage richter tribunal juez ley leyes abogado juge loi lois avocat",
    "finance": "bank banks budget debt invest investment market markets price shares stock tax aktie markt preis steuer banco mercado precio impuesto banque prix dette",
    "health": "clinical disease doctor drug health hospital medical patient patients therapy arzt gesundheit krankheit patienten enfermedad salud paciente pacientes maladie patientes",
    "science": "atom cell cells energy experiment gene hypothesis laboratory physics protein theory energie physik theorie zelle ciencia experimento gen teoria gène théorie",
    "computing": "algorithm code computer data database function network program server software computers netzwerk programm rechner datos programa red ordinateur logiciel réseau",
    "sport": "ball championship club coach football game goal league match player team tournament mannschaft spiel spieler tor equipo jugador partido joueur équipe",
    "politics": "election elections government minister parliament party policy president senate vote bundestag partei regierung wahl elecciones gobierno partido presidente gouvernement élection",
}
#: Subject words that a text needs to have that topic.
LEAST_WORDS = 2


def subject_pattern(words: str) -> str:
    """Any of the words between other characters than letters: the same matches in Java's and RE2's engine."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words.split())):
        by_first.setdefault(w[0], []).append(w[1:])
    # One branch a first letter, as Java's engine tries branches one after the other.
    either = "|".join(f"[{c.upper()}{c}](?:{'|'.join(rest)})" for c, rest in by_first.items())
    return rf"(?:^|[^\p{{L}}])(?:{either})(?:$|[^\p{{L}}])"


def _count(text: Column, what: str) -> Column:
    """Occurrences of one ASCII character."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))


def form(text: Column, tokens: Column) -> Column:
    """A text's kind by its form: rules in order, the first that holds."""
    return (
        F.when(tokens == 0, "empty")
        .when(_count(text, "|") * 5 > tokens, "table")
        .when(_count(text, "!") * 4 > tokens, "loud")
        .when(F.regexp_count(text, F.lit(r"[#*$%&<>]")) * 4 > tokens, "symbols")
        .when(_count(text, "\n") * 12 > tokens, "lines")
        .when(tokens < 200, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def topic(text: Column, tokens: Column) -> Column:
    """The subject with the most words, of equal ones the first listed; else the form."""
    counts = [F.struct(F.regexp_count(text, F.lit(subject_pattern(w))).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (s, w) in enumerate(SUBJECTS.items())]
    # Texts without any of the words are searched once.
    some = F.when(text.rlike(subject_pattern(" ".join(SUBJECTS.values()))), F.greatest(*counts))
    return F.when(some["n"] >= LEAST_WORDS, some["s"]).otherwise(form(text, tokens))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens (words), topic, and the cell's source and lang without nulls as _source and _lang."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop("weight", "prob", "kept").withColumn("n_tokens", F.regexp_count(body, F.lit(WORD)).cast("long"))
    out = out.withColumn("topic", topic(body, F.col("n_tokens")))
    return out.withColumn("_source", F.coalesce("source", F.lit("(none)"))).withColumn("_lang", F.coalesce("lang", F.lit("(none)")))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension's values: value, share."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    return sums.select("value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))


def stated(cells: DataFrame, dimension: str, shares: Mapping[str, float]) -> DataFrame:
    """Target shares of a dimension's values: as stated, and for others what is left, by their tokens."""
    sums = cut(cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("value"))
    rest = sums.where(named.isNull()).agg(F.sum("t")).first()[0] or 1
    return sums.select("value", F.coalesce(named, F.col("t") * F.lit(max(0.0, 1 - sum(shares.values())) / rest)).cast("double").alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """cells with w, raked to the targets (value, share) of each dimension and at most their tokens, and the shares aimed at as _<dimension>.

    A marginal is a window over its cells, as long as there are few in all; beyond that it is an aggregate that
    is joined back, so a value's cells need not fit into one task, and each step is cut, as the next reads it twice.
    """
    out = cells
    for name, shares in targets.items():
        shares = cut(shares.where("share > 0"))
        whole = shares.join(cells.where("tokens > 0").select(F.col(name).alias("value")).distinct(), "value").agg(F.sum("share")).first()[0] or 1.0
        out = out.join(shares.select(F.col("value").alias(name), (F.col("share") / F.lit(whole)).alias(f"_{name}")), name, "left")
    out = cut(out)
    few = out.count() <= BROADCAST_CELLS
    total = float(out.agg(F.sum("tokens")).first()[0] or 0)
    # The most that a marginal allows: that of the value that has the least for its share.
    most = [out.where(f"_{n} is not null").groupBy(n).agg((F.sum("tokens") / F.first(f"_{n}")).alias("m")).where("m > 0").agg(F.min("m")).first()[0] for n in targets]
    size = keep * min([total, *(m for m in most if m is not None)])
    out = out.withColumn("w", F.col("tokens") * F.lit(size / total if total else 0.0))
    full = F.col("w") >= F.col("tokens")
    sums = {"_have": F.sum("w"), "_full": F.sum(F.when(full, F.col("w")).otherwise(0.0))}
    steps = {}
    for name in targets:
        goal = F.col(f"_{name}") * F.lit(size)
        grown = F.when(full | (F.col("_have") <= F.col("_full")), F.col("w")).otherwise(F.least(F.col("tokens").cast("double"), F.col("w") * (goal - F.col("_full")) / (F.col("_have") - F.col("_full"))))
        w = F.when(goal.isNull() | (F.col("_have") <= 0), F.col("w")).when(goal >= F.col("_have"), grown).otherwise(F.col("w") * goal / F.col("_have"))
        steps[name] = [x.over(Window.partitionBy(name)).alias(c) for c, x in sums.items()], w.alias("w")
    columns = [c for c in out.columns if c != "w"]
    for _ in range(rounds):
        for name, (windows, w) in steps.items():
            if few:
                out = out.select("*", *windows).select(*columns, w)
            else:
                out = cut(out.join(out.groupBy(name).agg(*[x.alias(c) for c, x in sums.items()]), name).select(*columns, w))
        out = cut(out) if few else out
    return out


def residuals(raked: DataFrame, names: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """dimension, value, target and reached share of what rake() returned."""
    size = raked.agg(F.sum("w")).first()[0] or 1.0
    each = [raked.where(f"_{n} is not null").groupBy(F.lit(n).alias("dimension"), F.col(n).alias("value")).agg(F.first(f"_{n}").alias("target"), (F.sum("w") / F.lit(size)).alias("reached")) for n in names]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def cells_of(marks: DataFrame) -> DataFrame:
    """source, lang, topic and tokens of measured documents."""
    keys = {"source": "_source", "lang": "_lang", "topic": "topic"}
    return cut(marks.groupBy(*[F.col(c).alias(n) for n, c in keys.items()]).agg(F.sum("n_tokens").alias("tokens")))


def goals_of(cells: DataFrame) -> dict[str, DataFrame]:
    return {"source": tempered(cells, "source", TEMPER["source"]), "lang": stated(cells, "lang", LANGUAGES), "topic": tempered(cells, "topic", TEMPER["topic"])}


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, marks: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """docs with n_tokens, topic, weight (the raked share of its cell's tokens over that of all), prob and kept.

    marks: measured(docs) if it is at hand already.
    """
    marks = measured(docs) if marks is None else marks
    cells = cells_of(marks)
    rated = rake(cells, dict(targets) if targets else goals_of(cells), rounds, keep)
    sums = rated.agg(F.sum("w").alias("w"), F.sum("tokens").alias("t")).first()
    mean = sums.w / sums.t if sums.t and sums.w else 1.0
    share = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    rated = cut(rated.select(*[F.col(n).alias(f"_c_{n}") for n in DIMENSIONS], share.alias("prob"), (share / F.lit(mean)).alias("weight")))
    near = F.broadcast(rated) if rated.count() <= BROADCAST_CELLS else rated
    on = (F.col("_source") == F.col("_c_source")) & (F.col("_lang") == F.col("_c_lang")) & (F.col("topic") == F.col("_c_topic"))
    out = marks.join(near, on).withColumn("prob", F.round("prob", 6))
    draw = hex_fraction(F.coalesce(F.col("doc_id").cast("string"), F.lit("(none)")))
    return out.withColumn("kept", draw < F.col("prob")).drop("_source", "_lang", *[f"_c_{n}" for n in DIMENSIONS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_mixing: weight, probability and draw of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    marks = cut(measured(docs).drop("text"))
    mixed = mix(docs, marks=marks)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 5).alias("weight"), F.round("prob", 5).alias("prob"), "kept")


def oracle() -> str:
    """DuckDB SQL: the rounds of raking, one common table each."""
    many = lambda c: f"(strlen(t) - strlen(replace(t, {c}, '')))"
    hits = ", ".join(f"{{'n': len(regexp_extract_all(t, '{subject_pattern(w)}')), 'k': {-k}, 's': '{s}'}}" for k, (s, w) in enumerate(SUBJECTS.items()))
    named = " ".join(f"when '{k}' then {v}" for k, v in LANGUAGES.items())
    columns = ("s", "l", "topic")
    aims = [f"pow(x, {TEMPER['source']})", f"coalesce(case v {named} end, x * {1 - sum(LANGUAGES.values()):.12f} / sum(x) filter (where case v {named} end is null) over ())", f"pow(x, {TEMPER['topic']})"]
    parts = [
        "d as (select *, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n from documents)",
        f"""m as (select doc_id, source, lang, n as n_tokens, coalesce(source, '(none)') as s, coalesce(lang, '(none)') as l, coalesce(case when h.n >= {LEAST_WORDS} then h.s end, case when d.n = 0 then 'empty' when {many("'|'")} * 5 > d.n then 'table' when {many("'!'")} * 4 > d.n then 'loud'
  when len(regexp_extract_all(t, '[#*$%&<>]')) * 4 > d.n then 'symbols' when {many("chr(10)")} * 12 > d.n then 'lines' when d.n < 200 then 'note' when d.n < 1000 then 'article' else 'book' end) as topic from (select *, list_max([{hits}]) as h from d) d)""",
        "c as (select s, l, topic, cast(sum(n_tokens) as double) as tokens from m group by all)",
        *(f"g{k} as (select v, x, share / sum(share) over () as share from (select v, x, {aims[k]} as share from (select {c} as v, sum(tokens) as x from c group by all) where x > 0) where share > 0)" for k, c in enumerate(columns)),
        f"z as (select {KEEP} * least((select sum(tokens) from c), (select min(x / share) from g0), (select min(x / share) from g1), (select min(x / share) from g2)) as size, (select sum(tokens) from c) as total)",
        "r0 as (select c.*, case when total > 0 then tokens * size / total else 0 end as w, g0.share * size as h0, g1.share * size as h1, g2.share * size as h2 from c cross join z left join g0 on s = g0.v left join g1 on l = g1.v left join g2 on topic = g2.v)",
    ]
    for k in range(ROUNDS * 3):
        c, h = columns[k % 3], f"h{k % 3}"
        parts.append(
            f"r{k + 1} as (select * exclude (w, have, f), case when {h} is null or have <= 0 then w when {h} < have then w * {h} / have when w >= tokens or have <= f then w else least(tokens, w * ({h} - f) / (have - f)) end as w"
            f" from (select *, sum(w) over (partition by {c}) as have, sum(case when w >= tokens then w else 0 end) over (partition by {c}) as f from r{k}))"
        )
    parts.append(f"x as (select s, l, topic, case when tokens > 0 then w / tokens else 0 end as p, sum(w) over () / sum(tokens) over () as mean from r{ROUNDS * 3})")
    parts.append("y as (select m.doc_id, source, lang, topic, n_tokens, p / case when mean > 0 then mean else 1 end as weight, round(p, 6) as prob from m join x using (s, l, topic))")
    return "with " + ",\n".join(parts) + "\nselect doc_id, source, lang, topic, n_tokens, round(weight, 5) as weight, round(prob, 5) as prob, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '(none)')), 1, 8) as bigint) / 4294967296.0 < prob as kept from y"
