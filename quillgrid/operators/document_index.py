"""The stored vector index: documents and their passages, hashed once and maintained by fingerprint.

A document row holds the vector and the sparse terms of the text that represents the
document in searches, those of its passages together (their vectors' weighted mean),
hashes of its words, and its title. A passage row holds its text and the vector of title
and passage. Vectors are whole millionths, so what is stored is what was
rounded; a term is its 64-bit hash, and its weight counts twentieths.

The table is plain Parquet (arrays of numbers are packed as bytes, which only a reader of them unpacks), partitioned by level (document, passage) and part, a hash of
the id. refresh() compares fingerprints by a join, hashes only documents that are new or
changed, and overwrites only the parts that hold such or removed ones, so without changes
nothing is written. Texts are dealt by part before they are hashed, and rows are written
where they are made or read: the index itself, many times as large, is never shuffled. A document's own row carries its fingerprint and is written together
with its passages; a refresh that was cut short is repeated by the next one.

Cases: rows without an id are left out; of rows that repeat an id the one of the smallest
fingerprint counts; null fields are empty; a document without text has a zero vector, no
terms and no passages; an empty table removes what was there; columns beyond the fields,
year and updatedAt don't matter. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import projection
from quillgrid.functions import text as tx
from quillgrid.operators.dedupe import checkpointed
from quillgrid.operators.features import K1, B
from quillgrid.operators.passages import packed_sentences, sentences
from quillgrid.operators.query import LEXICON, Lexicon

#: How often each field counts in the text that represents a document.
BUNDLE = {"title": 2, "englishTitle": 2, "abstract": 2, "summary": 1, "novelty": 1, "organization": 1, "keywords": 2, "methods": 1, "highlights": 1, "alternateSources": 1}
#: Fields of passages in order, their weights in a document's mean, and the most characters of a passage there and in searches.
PASSAGES = {"title": 2.8, "abstract": 1.9, "summary": 1.5, "novelty": 1.2, "methods": 1.1, "highlights": 1.0, "keywords": 1.35}
MEAN_SIZE, SIZE = 320, 360
#: Those whose words an input can share.
SHARED = ("title", "englishTitle", "abstract", "summary", "keywords", "methods")
#: Version of the layout, dimensions, partitions of a level, and texts and characters that are hashed together.
LAYOUT, DIMS, PARTS, TEXTS, CHARS = 5, 1024, 16, 512, 400_000
#: Characters of the documents that a task of a refresh hashes: at most, and at least if cores are left; ids that are broadcast at most.
TASK_CHARS, LEAST_CHARS, BROADCAST = 4_000_000, 200_000, 1_000_000
MICRO = 1_000_000
#: XXH64 with Spark's own seed, so that both sides name a word alike.
SEED = 42
_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
OTHER = regex.compile(r"[^\p{L}\p{N}]")


class _Kept(dict):
    """Code points as plain() keeps them: letters and numbers themselves, others as spaces. Those that came are kept, up to all of Unicode."""

    def __missing__(self, code: int) -> int:
        self[code] = 32 if OTHER.match(chr(code)) else code
        return self[code]


_KEPT = _Kept()


def plain(text: str) -> str:
    """The text as functions.text.normalize_text gives it."""
    return " ".join(text.lower().translate(_KEPT).split())


#: An odd factor: what the words before count in the hash of a run of words.
NEXT = 0x9E3779B97F4A7C15


def _word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in words), np.uint64, len(words))


def keys_of(terms) -> np.ndarray:
    """Hashes of terms as signed numbers: a word's is XXH64, that of a run of words follows from theirs."""
    out = _word_keys([t.partition(" ")[0] for t in terms])
    for k, t in enumerate(terms):
        if " " in t:
            h = int(out[k])
            for more in _word_keys(t.split(" ")[1:]).tolist():
                h = (h * NEXT + more) % 2**64
            out[k] = h
    return out.view(np.int64)


def _run_keys(runs: projection.Runs) -> np.ndarray:
    """keys_of() of all words, pairs and triples of runs, in order."""
    words = _word_keys(runs.words)
    pairs = words[runs.pairs[0]] * np.uint64(NEXT) + words[runs.pairs[1]]
    return np.concatenate([words, pairs, pairs[runs.triples[0]] * np.uint64(NEXT) + words[runs.triples[1]]]).view(np.int64)


def key_of(term: str) -> int:
    return int(keys_of([term])[0])


def term_arrays(normal: str, expand: projection.Expand | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a normalised text's sparse terms in rising order, and their weights in twentieths."""
    return terms_of([normal], expand)[0]


def terms_of(normals: list[str], expand: projection.Expand | None = None, tokens: list[list[str]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """term_arrays() of several texts: a term that they share is hashed once. tokens: their words, where they are known."""
    tokens = [projection.words(n) for n in normals] if tokens is None else tokens
    runs = projection.Runs(tokens)
    keys = _run_keys(runs)
    before = np.cumsum([0, *runs.sizes])
    weight = np.repeat(np.array([projection.WORD20, projection.PAIR20, projection.TRIPLE20], np.int32), runs.sizes)
    owner, item = np.concatenate(runs.owner), np.concatenate([i + at for i, at in zip(runs.item, before)])
    held, often = np.unique(owner * max(len(keys), 1) + item, return_counts=True)
    item = held % max(len(keys), 1)
    held_keys, held_weights = keys[item], often.astype(np.int32) * weight[item]
    begun = np.searchsorted(held, np.arange(len(normals) + 1) * max(len(keys), 1))
    wider = projection.touched(runs.words, expand) if expand else frozenset()
    out = []
    for k, normal in enumerate(normals):
        if wider and not wider.isdisjoint(tokens[k]):
            terms = projection.word_terms(normal, expand)
            own, weights = keys_of(terms), np.fromiter(terms.values(), np.int32, len(terms))
        else:
            own, weights = held_keys[begun[k] : begun[k + 1]], held_weights[begun[k] : begun[k + 1]]
        grams, counts = projection.gram_keys(normal)
        every = np.concatenate([own, grams])
        order = np.argsort(every, kind="stable")
        out.append((every[order], np.concatenate([weights, counts])[order]))
    return out


def micro(v: np.ndarray) -> np.ndarray:
    return np.rint(v * MICRO).astype(np.int32)


#: Sources of student research, those of them whose titles may announce guidance only, how such titles begin, and keywords of a document of theirs.
STUDENTS, GUIDED, GUIDANCE, BAG = ("science_fair", "student_invention_fair", "hanwha_science_challenge", "rne_report"), ("science_fair", "student_invention_fair"), r"^\(지도논문\)", 8


def sanitized(docs: DataFrame) -> DataFrame:
    """docs as they go into an index: without guidance of student fairs, and with the keywords of student research made from title, summary, organization and highlights."""
    have = docs.columns
    kept = docs.where(~(F.coalesce("source", F.lit("")).isin(*GUIDED) & F.coalesce(tx.strip_tags(F.col("title")).rlike(GUIDANCE), F.lit(False))))
    said = [F.array_join("highlights", " ") if n == "highlights" else F.nullif(F.col(n), F.lit("")) for n in ("title", "summary", "organization", "highlights") if n in have]
    return kept.withColumn("keywords", F.when(F.coalesce("source", F.lit("")).isin(*STUDENTS), tx.keyword_bag(F.concat_ws(" ", *said), BAG)).otherwise(F.col("keywords")))


def _fields(docs: DataFrame) -> dict[str, str]:
    """Names of the text fields that docs has, and whether each is a list."""
    return {n: kind for n, kind in docs.dtypes if n in {*BUNDLE, *PASSAGES}}


def prepared(docs: DataFrame, parts: int, mark: str = "") -> DataFrame:
    """id, part, fingerprint, and the texts to hash: bundle, said, done (normalised), title (normalised), year, and p_ columns of passages' fields."""
    have = _fields(docs)
    words = lambda n: F.array_join(n, " ") if have[n].startswith("array") else F.nullif(F.col(n), F.lit(""))
    dotted = lambda n: F.array_join(n, " · ") if have[n].startswith("array") else F.col(n)
    joined = lambda names: tx.normalize_text(F.concat_ws(" ", *[words(n) for n in names if n in have])) if any(n in have for n in names) else F.lit("")
    titles = [F.nullif(F.col(n), F.lit("")) for n in ("title", "englishTitle") if n in have]
    passages = [F.coalesce(F.concat_ws(" · ", *titles) if n == "title" else dotted(n), F.lit("")).alias(f"p_{n}") for n in PASSAGES if n in have]
    seen = [F.coalesce(F.to_json(F.struct(n)) if have[n].startswith("array") else F.col(n), F.lit("")) for n in sorted(have)]
    dated = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("updatedAt", "year") if c in docs.columns]
    year = F.col("year").cast("int") if "year" in docs.columns else F.lit(None).cast("int")
    return docs.where(F.col("id").isNotNull()).select(
        "id", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(parts)).cast("int").alias("part"), F.sha2(F.concat_ws("\x1f", F.lit(",".join(sorted(have))), *([F.lit(mark)] if mark else []), *dated, *seen), 256).alias("fingerprint"),
        joined([n for n in BUNDLE for _ in range(BUNDLE[n])]).alias("bundle"), joined(SHARED).alias("said"), joined(["methods"]).alias("done"), joined(["title", "englishTitle"]).alias("title"),
        F.coalesce(F.col("title"), F.lit("")).alias("raw_title") if "title" in have else F.lit("").alias("raw_title"), year.alias("year"), *passages,
    )


def schema_of(id_type: T.DataType) -> T.StructType:
    """Columns of the stored table; the last two are its partitions."""
    return T.StructType([
        T.StructField("id", id_type), T.StructField("ord", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("label", "passage", "fingerprint", "title")), T.StructField("year", T.IntegerType()),
        *(T.StructField(n, t) for p in ("", "body_") for n, t in ((f"{p}vector", _INTS), (f"{p}keys", _LONGS), (f"{p}weights", _INTS), (f"{p}total", T.LongType()))),
        *(T.StructField(n, _LONGS) for n in ("words", "methods")), T.StructField("version", T.LongType()), T.StructField("level", T.StringType()), T.StructField("part", T.IntegerType()),
    ])


def packed_schema(schema: T.StructType) -> T.StructType:
    """The schema as it is stored: Parquet's writers would take each number of an array by itself."""
    return T.StructType([T.StructField(f.name, T.BinaryType()) if isinstance(f.dataType, T.ArrayType) else f for f in schema])


def packed(v: np.ndarray) -> bytes:
    """The bytes of numbers, first bytes first: those of hashes in order, and those of small numbers, hardly differ."""
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_row(row: dict) -> dict:
    """A row as it is stored. Of body_keys only those that are no keys are kept: body_weights has the weights of keys (0: not in the body), then theirs."""
    if row.get("body_keys") is not None:
        keys, body, weights = row["keys"], row["body_keys"], row["body_weights"]
        at = np.searchsorted(keys, body)
        same = np.append(keys, 0)[at] == body
        same &= at < len(keys)
        shared = np.zeros(len(keys), np.int32)
        shared[at[same]] = weights[same]
        row = row | {"body_keys": body[~same], "body_weights": np.concatenate([shared, weights[~same]])}
    return {n: packed(v) if isinstance(v, np.ndarray) else v for n, v in row.items()}


def _unpacked_body(keys: bytes, more: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    every, w = np.concatenate([unpacked(keys, np.int64), unpacked(more, np.int64)]), unpacked(weights, np.int32)
    held = np.flatnonzero(w)
    order = held[np.argsort(every[held], kind="stable")]
    return every[order], w[order]


@F.pandas_udf(_LONGS)
def _longs(column: pd.Series) -> pd.Series:
    return column.map(lambda b: None if b is None else unpacked(b, np.int64))


@F.pandas_udf(_INTS)
def _ints(column: pd.Series) -> pd.Series:
    return column.map(lambda b: None if b is None else unpacked(b, np.int32))


@F.pandas_udf(_LONGS)
def _body_keys(keys: pd.Series, more: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else _unpacked_body(k, m, w)[0] for k, m, w in zip(keys, more, weights, strict=True)], dtype=object)


@F.pandas_udf(_INTS)
def _body_weights(keys: pd.Series, more: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else _unpacked_body(k, m, w)[1] for k, m, w in zip(keys, more, weights, strict=True)], dtype=object)


def passages_of(row: dict, size: int) -> list[tuple[str, str]]:
    """Label and text of a prepared row's passages, each once."""
    return passages_by(row, [size])[0]


def passages_by(row: dict, sizes: list[int]) -> list[list[tuple[str, str]]]:
    """passages_of() for several sizes; sentences are found once."""
    found = [(n, sentences(row[f"p_{n}"])) for n in PASSAGES if row.get(f"p_{n}")]
    return [list(dict.fromkeys((n, p) for n, s in found for p in packed_sentences(s, size))) for size in sizes]


class _Hasher:
    """Rows of the index for prepared rows, of the levels and columns asked for; the vectors of several documents' texts are made together."""

    def __init__(self, dims: int, version: int, names: list[str], lexicon: Lexicon | None, levels: tuple[str, ...] = ("document", "passage"), stored: bool = False):
        self.dims, self.version, self.names, self.levels, self.expand, self.stored = dims, version, names, levels, lexicon.expand_normal if lexicon else None, stored

    def rows(self, docs: list[dict]) -> list[dict]:
        """All texts of the documents are hashed in one go: what stands in bundles stands in passages again."""
        bases = [{"id": d["id"], "part": int(d.get("part", 0)), "version": self.version} for d in docs]
        asked = lambda *names: any(n in self.names for n in names)
        whole, by_passage = "document" in self.levels, "passage" in self.levels
        body_asked = whole and asked("body_vector", "body_keys", "body_weights", "body_total")
        split = [passages_by(d, [MEAN_SIZE, SIZE]) if body_asked and by_passage else [passages_of(d, MEAN_SIZE) if body_asked else [], passages_of(d, SIZE) if by_passage else []] for d in docs]
        mean, shown = [s[0] for s in split], [s[1] for s in split]
        bundles = [d["bundle"] if asked("vector") or not ps else "" for d, ps in zip(docs, mean, strict=True)] if whole and asked("vector", "body_vector") else []
        said = [[plain(p) for _, p in ps] for ps in mean]
        parts = [t for ts in said for t in ts] if asked("body_vector") else []
        titled = [plain(f"{d['raw_title']}\n{p}") for d, ps in zip(docs, shown, strict=True) for _, p in ps]
        tokens = [projection.words(t) for ts in (bundles, parts, titled) for t in ts]
        vectors = projection.dense_vectors([*bundles, *parts, *titled], self.dims, self.expand, tokens)
        known = dict(zip([*bundles, *parts], tokens))
        out = self._documents(docs, bases, mean, said, vectors[: len(bundles)], vectors[len(bundles) : len(bundles) + len(parts)], known) if whole else []
        far = len(bundles) + len(parts)
        for base, many in zip(bases, shown, strict=True):
            for k, (label, p) in enumerate(many):
                out.append(base | {"ord": k + 1, "label": label, "passage": p, "vector": micro(vectors[far + k]), "level": "passage"})
            far += len(many)
        return out

    def _documents(self, docs: list[dict], bases: list[dict], mean: list[list[tuple[str, str]]], said: list[list[str]], bundles: np.ndarray, parts: np.ndarray, known: dict[str, list[str]]) -> list[dict]:
        """mean: passages of each document; said: their normalised texts; bundles and parts: vectors of documents and of these passages; known: words of texts."""
        asked = lambda *names: any(n in self.names for n in names)
        texts: dict[str, list[list[str]]] = {}  # what makes up each text
        if asked("keys", "weights", "total"):
            texts[""] = [[d["bundle"]] for d in docs]
        if asked("body_keys", "body_weights", "body_total"):
            texts["body_"] = [[*filter(None, ts)] if ps else [d["bundle"]] for d, ps, ts in zip(docs, mean, said, strict=True)]
        every = [ts for many in texts.values() for ts in many]
        terms = terms_of([" ".join(ts) for ts in every], self.expand, [[w for t in ts for w in (known[t] if t in known else projection.words(t))] for ts in every])
        words = {n: [projection.words(d[c]) for d in docs] for n, c in (("words", "said"), ("methods", "done")) if asked(n)}
        distinct = list(dict.fromkeys(t for many in words.values() for ts in many for t in ts))
        key = dict(zip(distinct, keys_of(distinct).tolist(), strict=True))
        out, at = [], 0
        for k, (d, base, ps) in enumerate(zip(docs, bases, mean, strict=True)):
            row = base | {"ord": 0, "fingerprint": d.get("fingerprint"), "title": d.get("title"), "level": "document"}
            year = d.get("year")
            row["year"] = None if year is None or year != year else int(year)
            if asked("vector"):
                row["vector"] = micro(bundles[k])
            if asked("body_vector"):
                weights = np.array([PASSAGES[n] for n, _ in ps])
                v = weights @ parts[at : at + len(ps)] / weights.sum() if len(ps) else bundles[k]
                row["body_vector"] = micro(v / (np.linalg.norm(v) or 1))
            at += len(ps)
            for n, prefix in enumerate(texts):
                keys, w = terms[n * len(docs) + k]
                row |= {f"{prefix}keys": keys, f"{prefix}weights": w, f"{prefix}total": int(w.sum())}
            for n, many in words.items():
                row[n] = np.sort(np.array([key[t] for t in set(many[k])], np.int64))
            out.append(row)
        return out

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting, chars = [], 0
            fields = [n for n in batch.columns if n.startswith("p_")]
            for d in batch.to_dict("records"):
                waiting.append(d)
                chars += len(d["bundle"] if "bundle" in d else d["raw_title"]) + sum(len(d[n]) for n in fields)
                if chars >= CHARS:
                    yield from self._frames(waiting)
                    waiting, chars = [], 0
            yield from self._frames(waiting)

    def _frames(self, docs: list[dict]) -> Iterator[pd.DataFrame]:
        rows = list(map(packed_row, self.rows(docs))) if self.stored else self.rows(docs)
        for k in range(0, len(rows), TEXTS):
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows[k : k + TEXTS]], dtype=object) for n in self.names})


@dataclass
class Refreshed:
    """What a refresh found and did, in documents; parts says how many partitions were rewritten, of how many documents."""

    added: int
    changed: int
    removed: int
    same: int
    parts: int
    rewritten: int


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the folder of spark.checkpoint.dir; under the warehouse where that is unset."""
    have = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{have.rstrip('/')}/{name}"


class DocumentIndex:
    """An index at a path that all executors reach. Vectors and terms hold what the lexicon adds; another lexicon changes every document."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType | None = None, dims: int = DIMS, parts: int = PARTS, lexicon: Lexicon | None = LEXICON):
        self.spark, self.path, self.dims, self.parts, self.lexicon, self.schema = spark, path, dims, parts, lexicon, schema_of(id_type or T.LongType())

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self) -> DataFrame:
        """The table as it is now, packed."""
        (at, fs), schema = self._hadoop(self.path), packed_schema(self.schema)
        return self.spark.read.schema(schema).parquet(self.path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The table as it is now. Only columns that are used are unpacked."""
        body = ("keys", "body_keys", "body_weights")
        made = {f.name: (_longs if f.dataType == _LONGS else _ints)(f.name) for f in self.schema if isinstance(f.dataType, T.ArrayType)}
        return self._stored().withColumns(made | {"body_keys": _body_keys(*body), "body_weights": _body_weights(*body)})

    def _mark(self) -> str:
        return self.lexicon.digest if self.lexicon else ""

    def remove(self) -> None:
        at, fs = self._hadoop(self.path)
        fs.delete(at, True)

    def documents(self) -> DataFrame:
        """A row for each document."""
        return self.rows().where("level = 'document'").drop("level", "part", "ord", "label", "passage", "version")

    def passages(self) -> DataFrame:
        """id, ord, label, passage, vector."""
        return self.rows().where("level = 'passage'").select("id", "ord", "label", "passage", "vector")

    def parts_of(self, text: str, terms: list[str]) -> DataFrame:
        """query_parts() of this index."""
        return query_parts(self.documents(), text, terms, self.dims, self.lexicon)

    def best_passages(self, head: DataFrame, text: str) -> DataFrame:
        """best_passages() of this index."""
        return best_passages(self.passages(), head, text, self.dims, self.lexicon)

    def changes(self, docs: DataFrame) -> DataFrame:
        """id, part, fingerprint (null: removed), kind, copies and characters of the documents that differ from the index, and of same ones (kind same)."""
        made = prepared(docs, self.parts, self._mark())
        chars = sum((F.length(c).cast("long") for c in made.columns if c.startswith("p_")), F.lit(0).cast("long"))
        marks = made.withColumn("chars", chars).groupBy("id", "part").agg(F.min("fingerprint").alias("fingerprint"), F.count("*").alias("copies"), F.max("chars").alias("chars"))
        old = self.rows().where("level = 'document'").select("id", F.col("fingerprint").alias("was"))
        kind = F.when(F.col("was").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("same")
        part = F.coalesce("part", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.parts)).cast("int"))
        return marks.join(old, "id", "full").select("id", part.alias("part"), "fingerprint", kind.alias("kind"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("chars", F.lit(0)).alias("chars"))

    def _dealt(self, docs: DataFrame, chars: int) -> DataFrame:
        """docs by part, each part in so many slots that a task has TASK_CHARS of so many characters at most."""
        cores = self.spark.sparkContext.defaultParallelism
        slots = max(-(-chars // (self.parts * TASK_CHARS)), min(-(-3 * cores // self.parts), chars // (self.parts * LEAST_CHARS)), 1)
        hashed = F.xxhash64(F.col("id").cast("string"))
        slot = F.pmod(hashed, F.lit(self.parts)) * slots + F.pmod(F.shiftright(hashed, 20), F.lit(slots))
        return docs.where(F.col("id").isNotNull()).repartitionById(self.parts * slots, slot.cast("int"))

    def _fresh(self, docs: DataFrame, found: DataFrame, counts: list) -> DataFrame:
        """Prepared rows of what is added or changed, dealt by part."""
        new = [c for c in counts if c.kind in ("added", "changed")]
        chars, ids = sum(c.chars for c in new), found.where("kind in ('added', 'changed')")
        few = F.broadcast if sum(c.n for c in new) <= BROADCAST else lambda df: df
        if any(c.copies > 1 for c in new):
            first = prepared(docs, self.parts, self._mark()).join(few(ids.select("id", "part", "fingerprint")), ["id", "part", "fingerprint"], "left_semi")
            return self._dealt(first.dropDuplicates(["id"]), chars)
        if any(c.kind == "same" for c in counts):
            docs = docs.join(few(ids.select("id")), "id", "left_semi")
        return prepared(self._dealt(docs, chars), self.parts, self._mark())

    def refresh(self, docs: DataFrame) -> Refreshed:
        """Brings the index up to docs. One row for each part and kind reaches the driver."""
        found = checkpointed(self.changes(docs))
        counts = found.groupBy("part", "kind").agg(F.count("*").alias("n"), F.max("copies").alias("copies"), F.sum("chars").alias("chars")).collect()
        total = lambda kind: sum(c.n for c in counts if c.kind == kind)
        touched = sorted({c.part for c in counts if c.kind != "same"})
        rewritten = sum(c.n for c in counts if c.part in touched and c.kind != "removed")
        done = Refreshed(total("added"), total("changed"), total("removed"), total("same"), len(touched), rewritten)
        if not touched:
            return done
        rows, names = self._stored(), self.schema.names
        version = rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        out = self._fresh(docs, found, counts).mapInPandas(_Hasher(self.dims, version, names, self.lexicon, ("document", "passage"), True).__call__, packed_schema(self.schema))
        if any(c.kind == "same" and c.part in touched for c in counts):
            gone = found.where("kind in ('changed', 'removed')").select("id")
            kept = rows.where(F.col("part").isin(touched))
            if done.changed + done.removed:
                kept = kept.join(F.broadcast(gone) if done.changed + done.removed <= BROADCAST else gone, "id", "left_anti")
            kept = kept.withColumn("version", F.lit(version)).select(*names)
            out = kept.unionByName(out) if done.added + done.changed else kept
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("level", "part").parquet(self.path)
        # A level of a part that has no rows any more was not overwritten.
        for r in self.rows().where(F.col("part").isin(touched)).groupBy("level", "part").agg(F.max("version").alias("version")).where(F.col("version") < version).collect():
            at, fs = self._hadoop(f"{self.path}/level={r.level}/part={r.part}")
            fs.delete(at, True)
        return done


#: Columns of prepared() that each column of a document row is made from.
MADE_OF = {
    "vector": ["bundle"], **{n: ["bundle"] for n in ("keys", "weights", "total")}, **{f"body_{n}": ["bundle", *(f"p_{f}" for f in PASSAGES)] for n in ("vector", "keys", "weights", "total")},
    "words": ["said"], "methods": ["done"], "title": ["title"], "year": ["year"], "fingerprint": ["fingerprint"],
}


class TextIndex:
    """What a DocumentIndex of docs holds, made from the texts as they are read and stored nowhere: for questions that come once.

    A stored index takes many times the bytes of its texts (vectors of all passages, hashes of all n-grams). One pass that
    answers some questions reads each text once, as making the index would, and keeps a row of numbers for each document.
    Only the passages of a search's head are made. Of rows that repeat an id the one of the smallest fingerprint counts.
    """

    def __init__(self, docs: DataFrame, dims: int = DIMS, lexicon: Lexicon | None = LEXICON):
        self.dims, self.lexicon = dims, lexicon
        self.id_type = docs.schema["id"].dataType
        self._made = prepared(docs, 1, lexicon.digest if lexicon else "")
        self._kept: dict[tuple, tuple[DataFrame, int]] = {}
        self._vectors: DataFrame | None = None
        if docs.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
            first = self._made.groupBy("id").agg(F.min("fingerprint").alias("fingerprint"))
            self._made = self._made.join(first, ["id", "fingerprint"], "left_semi").dropDuplicates(["id"])

    def _hashed(self, texts: DataFrame, names: list[str], level: str) -> DataFrame:
        schema = T.StructType([f for f in schema_of(self.id_type) if f.name in names])
        return texts.mapInPandas(_Hasher(self.dims, 0, schema.names, self.lexicon, (level,)).__call__, schema)

    def documents(self, *names: str) -> DataFrame:
        """A row for each document, of the columns named (of all without names)."""
        names = names or tuple(n for n in schema_of(self.id_type).names if n in MADE_OF)
        need = {"id", *(c for n in names if n in MADE_OF for c in MADE_OF[n])}
        return self._hashed(self._made.select(*[c for c in self._made.columns if c in need]), ["id", *names], "document")

    def vectors(self) -> DataFrame:
        """id and vector of each document, made once and kept: the only thing here that takes disk, 4 kB a document."""
        if self._vectors is None:
            self._vectors = checkpointed(self.documents("vector"))
        return self._vectors

    def passages(self, *names: str) -> DataFrame:
        """id, ord, label, passage, vector."""
        return self._passages(self._made)

    def _passages(self, made: DataFrame) -> DataFrame:
        texts = made.select("id", "raw_title", *[c for c in made.columns if c.startswith("p_")])
        return self._hashed(texts, ["id", "ord", "label", "passage", "vector"], "passage")

    def ask(self, questions: list[tuple[str, list[str]]], dense: bool = True) -> None:
        """Prepares parts_of() of several questions (text, terms) in one pass over the texts; without dense, which takes most of the work, if it isn't asked for."""
        new = list(dict.fromkeys((text, tuple(dict.fromkeys(terms))) for text, terms in questions))
        new = [q for q in new if (*q, True) not in self._kept and (*q, dense) not in self._kept]
        if not new:
            return
        lexicon, dims = self.lexicon, self.dims
        columns = [c for q, (_, terms) in enumerate(new) for c in (*([f"dense{q} double"] if dense else []), f"least{q} long", *(f"q{q}t{k} long" for k in range(len(terms))))]

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            expand = lexicon.expand_normal if lexicon else None
            normals = [plain(text) for text, _ in new]
            vectors = projection.dense_vectors(normals, dims, expand) if dense else None
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300) if dense else None
            asked = [projection.Asked(normal, terms, expand) for normal, (_, terms) in zip(normals, new, strict=True)]
            for batch in batches:
                for rows in _chunks(batch, "bundle"):
                    texts = [*rows["bundle"]]
                    tokens = [projection.words(t) for t in texts]
                    out: dict[str, list] = {"total": []}
                    if dense:
                        x = micro(projection.dense_vectors(texts, dims, expand, tokens)).astype(np.float64)
                        cosines = x @ vectors.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                        out |= {f"dense{q}": cosines[:, q] for q in range(len(new))}
                    out |= {c: [] for q, a in enumerate(asked) for c in (f"least{q}", *(f"q{q}t{k}" for k in range(len(a.wanted))))}
                    wider = projection.touched((w for ts in tokens for w in ts), expand) if expand else frozenset()
                    for text, ws in zip(texts, tokens, strict=True):
                        held = projection.Held(text, ws, expand if wider and not wider.isdisjoint(ws) else None)
                        out["total"].append(held.total)
                        for q, a in enumerate(asked):
                            out[f"least{q}"].append(held.least(a))
                            for n, t in enumerate(a.wanted):
                                out[f"q{q}t{n}"].append(held.weight(t))
                    yield pd.DataFrame({"id": rows["id"].to_numpy(), **out})

        kind = self._made.schema["id"].dataType.simpleString()
        found = checkpointed(self._made.select("id", "bundle").mapInPandas(answer, ", ".join([f"id {kind}", "total long", *columns])))
        for q, (text, terms) in enumerate(new):
            self._kept[text, terms, dense] = (found, q)

    def parts_of(self, text: str, terms: list[str], dense: bool = True) -> DataFrame:
        """What query_parts() gives: id, dense (null without it), sparse, bm25."""
        key = (text, tuple(dict.fromkeys(terms)))
        self.ask([key], dense)
        found, q = self._kept.get((*key, True)) or self._kept[*key, dense]
        near = F.col(f"dense{q}") if f"dense{q}" in found.columns else F.lit(None).cast("double")
        rows = found.select("id", near.alias("dense"), F.col(f"least{q}").alias("least"), "total", *[F.col(f"q{q}t{k}").alias(f"t{k}") for k in range(len(key[1]))])
        return _rated(rows, text, len(key[1]), self.lexicon)

    def best_passages(self, head: DataFrame, text: str) -> DataFrame:
        """What best_passages() gives; only the head's passages are made. head's ids, a page, come by the driver."""
        ids = [r.id for r in head.select("id").distinct().collect()]
        return best_passages(self._passages(self._made.where(F.col("id").isin(ids))), head, text, self.dims, self.lexicon)


def _chunks(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """A batch by pieces of about CHARS characters and at most TEXTS rows."""
    size = np.cumsum(batch[text].str.len().to_numpy())
    begun = 0
    while begun < len(batch):
        before = size[begun - 1] if begun else 0
        stop = min(begun + TEXTS, max(begun + 1, int(np.searchsorted(size, before + CHARS, "right"))))
        yield batch.iloc[begun:stop]
        begun = stop


def cosine_with(query: np.ndarray) -> Column:
    """A function of a vector column: its cosine with one vector; 0 if either is a zero vector."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1)

    @F.pandas_udf("double")
    def cosine(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        for k in range(0, len(vectors), 256):
            x = np.stack(vectors.iloc[k : k + 256].to_numpy()).astype(np.float64)
            size = np.linalg.norm(x, axis=1)
            out[k : k + 256] = (x @ q) / np.where(size > 0, size, 1)
        return pd.Series(out)

    return cosine


def query_parts(documents: DataFrame, text: str, terms: list[str], dims: int = DIMS, lexicon: Lexicon | None = LEXICON) -> DataFrame:
    """id, dense, sparse and bm25 of every document row of the index, for one query: no shuffle but for a row of statistics.

    dense is the cosine with the query's own vector, sparse the weighted Jaccard of sparse
    terms, bm25 that of the query's words with the sparse weights as frequencies. Terms are
    found inside each row.
    """
    normal, expand = plain(text), lexicon.expand_normal if lexicon else None
    keys, weights = term_arrays(normal, expand)
    held = lambda k: F.coalesce(F.get("weights", (F.array_position("keys", F.lit(int(k))) - 1).cast("int")), F.lit(0))
    least = sum((F.least(F.lit(int(w)), held(k)) for k, w in zip(keys, weights, strict=True)), F.lit(0))
    words = list(dict.fromkeys(terms))
    rows = documents.select("id", cosine_with(projection.dense_vector(normal, dims, expand))("vector").alias("dense"), least.alias("least"), "total", *[held(key_of(t)).alias(f"t{k}") for k, t in enumerate(words)])
    return _rated(rows, text, len(words), lexicon)


def _rated(rows: DataFrame, text: str, terms: int, lexicon: Lexicon | None) -> DataFrame:
    """id, dense, sparse, bm25 from rows of id, dense, least (the lesser weights of shared terms, summed), total, and the weights t0, t1, … of a query's words."""
    asked = int(term_arrays(plain(text), lexicon.expand_normal if lexicon else None)[1].sum())
    union = F.lit(asked) + F.col("total") - F.col("least")
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.col("total") / 20).alias("avg"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"df{k}") for k in range(terms)])
    score = F.lit(0.0)
    for k in range(terms):
        tf, df = F.col(f"t{k}") / 20, F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (F.col("total") / 20) / F.greatest(F.lit(1.0), F.col("avg"))))).otherwise(0.0)
    both = rows.crossJoin(F.broadcast(stats))  # a single row
    return both.select("id", "dense", F.when(union > 0, F.col("least") / union).otherwise(0.0).alias("sparse"), score.alias("bm25"))


def best_passages(passages: DataFrame, head: DataFrame, text: str, dims: int = DIMS, lexicon: Lexicon | None = LEXICON) -> DataFrame:
    """id, passage (the largest cosine of the head documents' passages with a query, at least 0) and label (of the first such passage to nine decimals, '' if none is above 0).

    head holds a top-k's ids: few, so they are broadcast, and only their passages are compared.
    """
    near = passages.join(F.broadcast(head.select("id")), "id", "left_semi").select("id", "ord", "label", cosine_with(projection.dense_vector(plain(text), dims, lexicon.expand_normal if lexicon else None))("vector").alias("c"))
    best = near.groupBy("id").agg(F.max("c").alias("c"), F.max_by("label", F.struct(F.round("c", 9), -F.col("ord"))).alias("label"))
    return best.select("id", F.greatest("c", F.lit(0.0)).alias("passage"), F.when(F.col("c") > 0, F.col("label")).otherwise("").alias("label"))
