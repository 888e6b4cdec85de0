"""Source divergence audit: how the sources of a language differ in their use of terms.

Terms are counted where the texts lie. Each language keeps the terms of enough documents,
numbers them and cuts the numbers into blocks; a source's counts in a block are packed into
one compressed vector. Sources of a language are dealt to cells. For each block, the
sources of a cell stay in one place, unpacked, while the packed vectors of the other cells
pass by in the rounds of a tournament: in round r a cell meets the cell r places further,
round half the circle, so that any two sources meet once and both directions are taken.
What they differ by is summed over blocks. The terms that a source overuses are ranked in a
heap for each block, and the heaps are merged.

All arithmetic is in whole numbers: shares of 10**9 are long divisions in base 1,000, exact
below MOST occurrences in a group; beyond that ValueError is raised.

Cases: null text, lang and source are empty strings, which are a language and a source of
their own; each row is a document, repeated or not; a group without kept terms has the
smoothed share of each; a language without kept terms has pairs of value 0 and no terms; a
language of one source has no pairs; ties rank by item; an empty table gives no rows; other
columns are not read. Texts are counted in pieces, so a very long one needs no list of all
its words.

A task holds CELL vectors of BLOCK terms and one that passes by. Rounds are dealt to jobs,
each of which moves at most so many copies of all vectors (ROUNDS).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import Folder, bounded_batches, in_order, table

#: Documents of a language that a kept term is in, at least; ranks of terms; what is added to a count; units of a share.
LEAST_DOCS, TOP_TERMS, SMOOTH, UNITS = 30, 50, 5, 1_000_000_000
#: Terms of a block, sources of a cell, and rounds whose vectors one job moves.
BLOCK, CELL, ROUNDS = 4_096, 8, 8
#: Entries that a task counts before it passes them on, and bytes of a text that are split at once.
ENTRIES, PIECE = 200_000, 1 << 20
#: The largest denominator whose long division fits into 64 bits.
MOST = (2**63 - 1) // 1_000

#: A term's bytes as they are, A-Z in lower case, and a blank for any other.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it."""
    low, start = text.translate(TERM_BYTES), 0
    while start < len(low):
        end = low.find(b" ", start + PIECE)
        end = len(low) if end < 0 else end
        yield low[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it), summed over what a task counted in one go; an empty term marks a group."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*g, t, n, held[t]) for g, (total, held) in groups.items() for t, n in total.items()] + [(*g, b"", 0, 0) for g in groups]
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(),) * 3 + (pa.int64(),) * 2, strict=True)], ["lang", "source", "term", "n", "docs"])

        entries = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                total, held = groups.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(total), set()
                for terms in pieces(text):
                    total.update(terms)
                    seen.update(terms)
                held.update(seen)
                entries += len(total) - before
                if entries >= ENTRIES:
                    yield flush()
                    entries = 0
        if groups:
            yield flush()

    parts = bounded_batches(docs.select(*own)).mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNITS * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    over = total + SMOOTH * terms
    if over > MOST:
        raise ValueError(f"{over} is too large a denominator for exact shares")
    whole, rest = np.divmod(counts.astype(np.int64) + SMOOTH, over)
    for _ in range(3):
        more, rest = np.divmod(rest * 1_000, over)
        whole = whole * 1_000 + more
    return whole + 1


def packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts at rising slots, compressed."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<u2").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The counts of all slots of a block of size terms."""
    raw, out = zlib.decompress(data), np.zeros(size, np.int64)
    n = len(raw) // 10
    out[np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64))] = np.frombuffer(raw, "<i8", n, 2 * n)
    return out


VECTOR = T.StructType([
    *(T.StructField(n, T.BinaryType()) for n in ("lang", "source")), *(T.StructField(n, T.LongType()) for n in ("block", "i", "sources", "n", "terms")),
    T.StructField("data", T.BinaryType()), T.StructField("heap", T.ArrayType(T.StructType([T.StructField("term", T.BinaryType()), T.StructField("value", T.LongType())]))),
])
VECTOR_ARROW = pa.schema([(f.name, pa.binary() if f.dataType == T.BinaryType() else pa.int64()) for f in VECTOR.fields[:-1]] + [("heap", pa.list_(pa.struct([("term", pa.binary()), ("value", pa.int64())])))])


def vectors(counts: DataFrame, folder: Folder) -> DataFrame:
    """A row for each group and block of its language's kept terms: the group's number i among sources, its count n of all kept terms, the packed counts and a heap of the most overused terms."""
    kept = counts.where(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= LEAST_DOCS)
    kept = folder.put(in_order(kept, ["lang", "term"], folder))
    langs = kept.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("terms"), F.sum("all").alias("n_lang"))
    number = F.col("at") - F.col("first")
    kept = kept.join(langs.select("lang", "first"), "lang").select("lang", "term", "all", F.floor(number / BLOCK).alias("block"), (number % BLOCK).alias("slot"))
    found = folder.put(counts.join(kept, ["lang", "term"]).select("lang", "source", "block", "slot", "n", "all", "term"))

    groups = folder.put(in_order(counts.select("lang", "source").distinct(), ["lang", "source"], folder))
    of_lang = groups.groupBy("lang").agg(F.min("at").alias("zero"), F.count("*").alias("sources"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.join(of_lang, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", (F.col("at") - F.col("zero")).alias("i"), "sources", zero("terms"), zero("n"), zero("n_lang").alias("all"))
    # A row of slot -1 heads each vector, one without terms too.
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / BLOCK)))).withColumn("slot", F.lit(-1).cast("long"))
    dealt = heads.unionByName(found, allowMissingColumns=True).repartitionByRange("lang", "source", "block").sortWithinPartitions("lang", "source", "block", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, terms = None, []

        def close() -> dict:
            slots, own, everywhere = (np.array([t[k] for t in terms], np.int64) for k in ("slot", "n", "all"))
            more = share(own, head["n"], head["terms"]) - share(everywhere, head["all"], head["terms"]) if terms else own
            heap = heapq.nsmallest(TOP_TERMS, ((-v, t["term"]) for v, t in zip(more.tolist(), terms, strict=True) if v > 0 and t["n"] > 0))
            return head | {"data": packed(slots, own), "heap": [{"term": t, "value": -v} for v, t in heap]}

        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["slot"] < 0:
                    if head:
                        out.append(close())
                    head, terms = row, []
                else:
                    terms.append(row)
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in VECTOR_ARROW.names} for r in out], VECTOR_ARROW)
        if head:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in VECTOR_ARROW.names} for r in [close()]], VECTOR_ARROW)

    return dealt.mapInArrow(run, VECTOR)


def meetings(rows: DataFrame, first: int, last: int) -> DataFrame:
    """lang, source, item, value: what any two groups that meet in rounds first to last differ by, in both directions, in one block."""
    cells = F.ceil(F.col("sources") / CELL)
    home = rows.select("lang", "source", "block", "i", "n", "terms", "data", F.floor(F.col("i") / CELL).alias("cell"), cells.alias("cells"), F.lit(0).cast("long").alias("round"))
    away = home.where(F.expr(f"cells div 2 >= {max(first, 1)}")).withColumn("round", F.explode(F.expr(f"sequence({max(first, 1)}L, least({max(last, 1)}L, greatest(cells div 2, {max(first, 1)}L)))")))
    away = away.where(F.col("round") <= last).withColumn("cell", F.pmod(F.col("cell") - F.col("round"), F.col("cells")))
    away = away.where((2 * F.col("round") != F.col("cells")) | (F.col("cell") < F.col("round")))  # opposite cells meet once
    dealt = home.unionByName(away).drop("cells").repartition("lang", "block", "cell").sortWithinPartitions("lang", "block", "cell", "round", "i")
    own_cell = first == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, residents = None, []
        for b in batches:
            out: list[tuple[bytes, bytes, bytes, int]] = []
            for row in b.to_pylist():
                if place != (place := (row["lang"], row["block"], row["cell"])):
                    residents = []
                size = min(BLOCK, row["terms"] - row["block"] * BLOCK)
                p = share(unpacked(row["data"], size), row["n"], row["terms"]) if size > 0 else np.zeros(0, np.int64)
                if row["round"] or own_cell:
                    for source, q in residents:
                        value = int(np.abs(p - q).sum())
                        out += [(row["lang"], row["source"], source, value), (row["lang"], source, row["source"], value)]
                if not row["round"]:
                    residents.append((row["source"], p))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 3 else pa.binary()) for k in range(4)], ["lang", "source", "item", "value"])

    return dealt.mapInArrow(run, "lang binary, source binary, item binary, value long")


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """The rows of a part with their ranks, at most so many for a group."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    rows = rows if most is None else rows.where(F.col("rank") <= most)
    return rows.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), F.lit(part).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of all groups of documents."""
    spark = docs.sparkSession
    folder, kept = Folder(spark, "divergence"), Folder(spark, "divergence-rows")
    rows = kept.put(vectors(folder.put(term_counts(docs)), folder))
    most = rows.agg(F.coalesce(F.max("sources"), F.lit(0))).first()[0]
    rounds = -(-most // CELL) // 2
    met = [kept.put(meetings(rows, r, min(r + ROUNDS, rounds + 1) - 1).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))) for r in range(0, rounds + 1, ROUNDS)]
    folder.remove()
    pairs = met[0]
    for m in met[1:]:
        pairs = pairs.unionByName(m)
    terms = rows.select("lang", "source", F.explode("heap").alias("x")).select("lang", "source", F.col("x.term").alias("item"), F.col("x.value").alias("value"))
    return ranked(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair").unionByName(ranked(terms, "term", TOP_TERMS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_divergence: the audit of all documents."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total, s.v
         from groups g join kept k using (lang) join sizes s using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (select *, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as p from grid),
of_lang as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * any_value(v)) as q from grid group by lang, term),
met as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(m.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source),
terms as (select s.lang, s.source, s.term as item, s.p - o.q as value from shares s join of_lang o using (lang, term) where s.n > 0 and s.p > o.q),
every as (select 'pair' as part, * from pairs union all select 'term', * from terms)
select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from every qualify part = 'pair' or rank <= 50
"""
