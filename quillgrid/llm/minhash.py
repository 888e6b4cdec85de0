"""Near-duplicate documents: circulant MinHash, banding and exact Jaccard verification.

A document's set is that of its distinct 5-word shingles. One permutation spreads the
shingles over 32 bits; the second, circularly shifted by k, yields coordinate k of the
signature. Documents with equal sets form a class, and only classes go on, so copies
cost nothing. Classes that agree on all rows of a band share its bucket.

Links are found in three steps, none of which lists the pairs of a group. A member is
checked with the smallest member of its buckets, then with the smallest members of
all its buckets unless links join them already. What is left are pairs, in a bucket,
of members that no path of links joins. Those meet in blocks of bounded size, each pair
in the first band that it shares. Signatures show which members have a partner that
agrees in the share of coordinates that a link can't miss in practice; these alone
meet again with their texts. Each check compares the full sets. A link at the threshold escapes all 36 bands with probability 1e-6.

Cases: a document without words has no set, is linked with nothing and is kept; one
with fewer words than a shingle has the whole sequence as its only shingle; rows are
judged by their own text, so a repeated row joins its copies; a null doc_id takes part
but never names a component, unless all ids of the component are null: then
component_id is null and kept true; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_batches, cut, stored, table, trim_memory
from quillgrid.llm.components import SHARE, components
from quillgrid.llm.shingles import mixed, set_digest, shingle_set, similar

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 36, 4
#: Coordinates of which a checked pair agrees in at least so many: 4.6 standard deviations below the mean at the threshold.
AGREE = 84
#: Members of one block in the comparison by signature.
BLOCK = 4096
#: Representatives are broadcast up to this count (some 100 bytes each) and shuffled beyond it.
BROADCAST_IDS = 400_000


def _permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k places, over the places that the first one gives."""
    places = _permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x21F0AAAD, 0xD35A2D97)
    out = np.empty(size, np.uint32)
    step = max(1, 65536 // len(places))
    for k in range(0, size, step):
        shifts = np.arange(k, min(size, k + step), dtype=np.uint32)
        out[k : k + step] = _permuted(places[None, :] + shifts[:, None], 0x7FEB352D, 0x846CA68B).min(1)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    parts = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mixed(key ^ parts[:, k])
    return key.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t if isinstance(t, str) else None, SHINGLE) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "n_shingles": np.array([len(s) for s in sets], np.int64),
                "cls": [set_digest(s).hex() if len(s) else None for s in sets],
                "bands": [band_keys(signature(s)) if len(s) else None for s in sets],
            }
        )
    trim_memory()


def _with_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cls, text and signature (a byte for each coordinate) of the rows whose text has the set of their class."""
    for batch in batches:
        rows = []
        for cls, text in zip(batch["cls"], batch["text"], strict=True):
            s = shingle_set(text, SHINGLE)
            if len(s) and set_digest(s).hex() == cls:
                rows.append((cls, text, signature(s).astype(np.uint8).tobytes()))
        yield pd.DataFrame(rows, columns=["cls", "text", "coordinates"])


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose full sets pass."""
    sets: dict[str, np.ndarray] = {}

    def of(cls: str, text: str) -> np.ndarray:
        if cls not in sets:
            if len(sets) >= 512:
                sets.clear()
            sets[cls] = shingle_set(text, SHINGLE)
        return sets[cls]

    for batch in batches:
        found = [similar(of(a, x), of(b, y), PERCENT) for a, b, x, y in zip(batch["a"], batch["b"], batch["a_text"], batch["b_text"], strict=True)]
        yield batch.loc[np.array(found, bool), ["a", "b"]]
    sets.clear()
    trim_memory()


def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among pairs (a, b). Spark splits the rows of a class that is in very many pairs."""
    of = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"{c}_text"))
    return cut(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text").mapInPandas(_checked, "a string, b string"), SHARE)


class _Joined(dict):
    """Union-find over the components that meet in a block."""

    def root(self, x: str) -> str:
        while self.get(x, x) != x:
            x = self[x]
        return x


def _compared(verify: bool):
    """Compares the minor members of each block with all of it: by signature at first, which leaves the rows that have a
    partner (at most all rows); then by their full sets, which leaves links that join components (fewer than there are
    components). So no step lists pairs. Rows come sorted by block, and a block may span batches."""

    def compared(block: pd.DataFrame) -> pd.DataFrame:
        few, every = block[block["few"]], block[~block["few"]]
        band = int(block["band"].iloc[0])
        stack = lambda x, t: np.frombuffer(b"".join(x), t).reshape(len(x), -1)
        fs, es = stack(few["coordinates"], np.uint8), stack(every["coordinates"], np.uint8)
        fk, ek = stack(few["keys"], np.int64), stack(every["keys"], np.int64)
        fc, ec = few["comp"].to_numpy(), every["comp"].to_numpy()
        fm, em, minor = few["cls"].to_numpy(), every["cls"].to_numpy(), every["minor"].to_numpy()
        links, joined, sets = [], _Joined(), {}
        some, other = np.zeros(len(few), bool), np.zeros(len(every), bool)

        def set_of(rows: pd.DataFrame, i: int) -> np.ndarray:
            cls = rows["cls"].iat[i]
            if cls not in sets:
                sets[cls] = shingle_set(rows["text"].iat[i], SHINGLE)
            return sets[cls]

        for i in range(len(few)):
            # Two rows of the minor components meet twice; the order of their classes picks one meeting.
            ok = (ec != fc[i]) & ~(minor & (em <= fm[i]))
            ok &= ~(ek[:, :band] == fk[i, :band]).any(1)
            at = np.flatnonzero(ok)
            at = at[(es[at] == fs[i]).sum(1) >= AGREE]
            some[i] = len(at) > 0
            other[at] = True
            for j in at.tolist() if verify else ():
                x, y = joined.root(fc[i]), joined.root(ec[j])
                if x != y and similar(set_of(few, i), set_of(every, j), PERCENT):
                    joined[max(x, y)] = min(x, y)
                    links.append((fm[i], em[j]))
        return pd.DataFrame(links, columns=["a", "b"]) if verify else pd.concat([few[some], every[other]])[ROW]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            ends = np.flatnonzero(batch["block"].to_numpy()[1:] != batch["block"].to_numpy()[:-1]) + 1
            starts = [0, *ends.tolist()]
            for s, e in zip(starts, starts[1:], strict=False):
                yield compared(batch.iloc[s:e])
            rest = batch.iloc[starts[-1] :] if len(batch) else None
        if rest is not None:
            yield compared(rest)
        rest = batch = None
        trim_memory()

    return run


#: A member's row in a block.
ROW = ["block", "band", "cls", "comp", "minor", "few"]


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    docs = bounded_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = stored(docs.mapInPandas(_signed, "doc_id long, text_hash long, n_shingles long, cls string, bands array<long>"), "signed")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.first("bands").alias("bands"))
    buckets = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("center")).where("n > 1")
    members = cut(buckets.join(shared, "key"))

    reps = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    # A representative is a row by id and hash of its text: ids may be null in very many rows, whose texts then tell them apart.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("row")
    rows = signed.where("cls is not null").groupBy("cls").agg(row).select("cls", F.col("row.doc_id").alias("rep"), F.col("row.text_hash").alias("rep_hash"))
    wanted = cut(members.select("cls").distinct().join(rows, "cls"), SHARE)
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = docs.join(near, docs["doc_id"].eqNullSafe(near["rep"]) & (docs["text_hash"] == near["rep_hash"])).select("cls", "text")
    texts = stored(found.mapInPandas(_with_text, "cls string, text string, coordinates binary").dropDuplicates(["cls"]), "texts")

    # Each member with the smallest member of its buckets.
    spokes = members.where("cls != center").select(F.col("cls").alias("a"), F.col("center").alias("b"))
    first = spokes.groupBy("a").agg(F.min("b").alias("b"))
    links = check(first, texts)
    comp = cut(components(links), SHARE)

    def joined(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(comp.select(F.col("node").alias(column), F.col("comp").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    # Each with the smallest members of its other buckets, unless links join them.
    others = joined(joined(spokes.distinct().join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca != cb")
    links = links.union(check(others, texts))
    comp = cut(components(links), SHARE)

    # What is left in buckets of three or more that hold several components.
    rest = joined(members.where("n > 2 and cls != center"), "cls", "comp")
    sizes = rest.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("minors")).where("minors > 0")
    rest = rest.join(open_, "key").withColumn("minor", F.col("comp") != F.col("main"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    own = lambda n: F.pmod(F.xxhash64("cls", F.lit(n)), blocks(n))
    few = rest.where("minor").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks("all") - 1)))
    few = few.select("key", "band", "cls", "comp", "minor", F.lit(True).alias("few"), own("minors").alias("x"), F.col("other").alias("y"))
    every = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks("minors") - 1)))
    every = every.select("key", "band", "cls", "comp", "minor", F.lit(False).alias("few"), F.col("other").alias("x"), own("all").alias("y"))
    keys = classes.select("cls", F.transform("bands", lambda k: F.unhex(F.lpad(F.hex(k), 16, "0"))).alias("keys")).join(wanted.select("cls"), "cls", "left_semi")
    keys = cut(keys.select("cls", F.array_join(F.transform("keys", F.hex), "").alias("hexes")).select("cls", F.unhex("hexes").alias("keys")), SHARE)
    signs = texts.select("cls", "coordinates").join(keys, "cls")
    blocked = few.unionByName(every).withColumn("block", F.xxhash64("key", "x", "y")).select(ROW)
    together = lambda df: df.repartition("block").sortWithinPartitions("block", F.desc("few"), "cls")
    left = cut(together(blocked.join(signs, "cls")).mapInPandas(_compared(False), "block long, band int, cls string, comp string, minor boolean, few boolean"))
    full = left.join(signs, "cls").join(texts.select("cls", "text"), "cls")
    links = links.union(cut(together(full).mapInPandas(_compared(True), "a string, b string"), SHARE))
    comp = cut(components(links), SHARE)

    least = joined(reps, "cls", "comp").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = joined(reps, "cls", "comp").join(least, "comp").select("cls", "component_id")
    out = signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_minhash: the near-duplicate group of every document."""
    return groups(table(spark, sf_dir, "documents"))
