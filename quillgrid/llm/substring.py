"""Substring dedup with fixed-block anchors.

The reference blocks are each text's non-overlapping runs of BLOCK words; as a window is
at least twice as long less one, it holds a whole block. The index of block hashes is
probed with every rolling window of BLOCK words. A block that is found at another place
anchors a repeat; the anchors are extended to the windows that hold them, and these
are compared, whole, by 96-bit hashes. A window that starts elsewhere too covers its
words; the union of such windows is the union of the maximal exact repeats.

Texts are dealt to batches by a hash. A batch sends each distinct hash once, with a
mark for a block and one for more than one place, sorted and packed by ranges of the
hash, so a passage that very many documents hold arrives once for each batch and a
range stays small. The number of ranges follows the input, and a packed hash keeps the
32 bits below the range; that can only add anchors, which the whole windows then refute.

Cases: null and empty texts have no words and nothing to remove; texts shorter than a
window lose nothing; repeated rows repeat each other; windows may overlap themselves;
a null doc_id is a document as any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import table, text_bytes
from quillgrid.llm.shingles import Members, rolling_hashes, word_hashes

WINDOW, BLOCK = 35, 18
#: Bytes of text in a batch, and in a range of hashes, about.
BATCH_BYTES, RANGE_BYTES = 8_000_000, 24_000_000
IS_BLOCK, IS_MANY = 1, 2


class _Batch:
    """The texts of one batch: their words' hashes end to end, and which document each place is of."""

    def __init__(self, texts: pd.Series):
        self.words = [t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else [] for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate([word_hashes(w) for w in self.words]) if len(self.words) else np.empty(0, np.uint64)

    def inside(self, size: int) -> np.ndarray:
        """Whether a window of size words that starts at a place stays in its document."""
        left = np.repeat(self.starts[1:], self.sizes) - np.arange(len(self.hashes))
        return left >= size

    def rolling(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of windows and their hashes."""
        places = np.flatnonzero(self.inside(size))
        return places, rolling_hashes(self.hashes, size, seed)[places] if len(places) else np.empty(0, np.uint64)

    def blocks(self) -> np.ndarray:
        """Whether a place starts one of its document's reference blocks."""
        return (np.arange(len(self.hashes)) - np.repeat(self.starts[:-1], self.sizes)) % BLOCK == 0


def _bits(ranges: int) -> int:
    return max(1, ranges - 1).bit_length()


def _short(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's range, of a power of two of them, and the 32 bits below."""
    b = np.uint64(_bits(ranges))
    return (hashes >> (np.uint64(64) - b)).astype(np.int64), ((hashes >> (np.uint64(32) - b)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _send(ranges: int):
    """A batch's distinct rolling hashes, packed by range."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        batch = _Batch(group["text"])
        places, hashes = batch.rolling(BLOCK, 1)
        rows = []
        if len(places):
            of, low = _short(hashes, ranges)
            key = (of.astype(np.uint64) << np.uint64(32)) | low
            order = np.argsort(key)
            key, block = key[order], batch.blocks()[places][order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            mark = np.logical_or.reduceat(block, first) * IS_BLOCK + (np.diff(np.append(first, len(key))) > 1) * IS_MANY
            key = key[first]
            of = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for s, e in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                rows.append((int(group["batch"].iloc[0]), int(of[s]), key[s:e].astype(np.uint32).tobytes(), mark[s:e].astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "hashes", "marks"])

    return run


def _anchors(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the hashes of blocks that are found at two places or more, for each batch that sent them."""
    sent = [np.frombuffer(h, np.uint32) for h in group["hashes"]]
    marks = [np.frombuffer(m, np.uint8) for m in group["marks"]]
    every, where = np.unique(np.concatenate(sent), return_inverse=True)
    all_marks = np.concatenate(marks)
    senders = np.bincount(where, minlength=len(every))
    block = np.bincount(where, all_marks & IS_BLOCK, len(every)) > 0
    many = np.bincount(where, all_marks & IS_MANY, len(every)) > 0
    hit = block & (many | (senders > 1))
    keep, rows, at = hit[where], [], 0
    for batch, hashes in zip(group["batch"], sent, strict=True):
        mine = hashes[keep[at : at + len(hashes)]]
        at += len(hashes)
        if len(mine):
            rows.append((batch, int(group["part"].iloc[0]), mine.tobytes()))
    return pd.DataFrame(rows, columns=["batch", "part", "hashes"])


def _candidates(batch: _Batch, hits: pd.DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of windows that hold an anchor, and two hashes of each as rows."""
    places, hashes = batch.rolling(BLOCK, 1)
    none = np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    if not len(places) or not len(hits):
        return none
    known = np.concatenate([(np.uint64(p) << np.uint64(32)) | np.frombuffer(h, np.uint32).astype(np.uint64) for p, h in zip(hits["part"], hits["hashes"], strict=True)])
    of, low = _short(hashes, ranges)
    found = np.zeros(len(batch.hashes) + 1, np.int64)
    found[places] = Members(known).has((of.astype(np.uint64) << np.uint64(32)) | low)
    before = np.concatenate([[0], np.cumsum(found)])
    whole = np.flatnonzero(batch.inside(WINDOW))
    # An anchor starts in the first WINDOW - BLOCK + 1 words of the window.
    whole = whole[before[whole + WINDOW - BLOCK + 1] > before[whole]]
    if not len(whole):
        return none
    return whole, np.stack([rolling_hashes(batch.hashes, WINDOW, seed)[whole] for seed in (2, 3)], 1)


def _sorted_runs(first: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both numbers, and where each distinct pair starts in it."""
    order = np.lexsort((more, first))
    f, m = first[order], more[order]
    return order, np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (m[1:] != m[:-1])]))


def _distinct(first: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their counts."""
    order, starts = _sorted_runs(first, more)
    return first[order][starts], more[order][starts], np.diff(np.append(starts, len(order)))


def _ask(ranges: int):
    """A batch's distinct candidate windows, packed by range of their hash."""

    def run(texts: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(texts) and len(hits):
            _, keys = _candidates(_Batch(texts["text"]), hits, ranges)
            if len(keys):
                first, more, counts = _distinct(keys[:, 0], (keys[:, 1] >> np.uint64(32)).astype(np.uint32))
                of = (first >> np.uint64(64 - _bits(ranges))).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                for s, e in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
                    rows.append((int(texts["batch"].iloc[0]), int(of[s]), first[s:e].tobytes() + more[s:e].tobytes(), (counts[s:e] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "hashes", "marks"])

    return run


def _repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the windows at two places or more, for each batch that asked, by their first 64 bits."""
    sizes = np.array([len(h) // 12 for h in group["hashes"]])
    first = np.concatenate([np.frombuffer(h, np.uint64, n) for h, n in zip(group["hashes"], sizes, strict=True)])
    more = np.concatenate([np.frombuffer(h, np.uint32, n, 8 * n) for h, n in zip(group["hashes"], sizes, strict=True)])
    many = np.concatenate([np.frombuffer(m, bool) for m in group["marks"]])
    order, starts = _sorted_runs(first, more)
    runs = np.diff(np.append(starts, len(order)))
    again = (runs > 1) | (np.add.reduceat(many[order].astype(np.int64), starts) > 0)
    keep = np.empty(len(order), bool)
    keep[order] = np.repeat(again, runs)
    rows, at = [], 0
    for batch, n in zip(group["batch"], sizes.tolist(), strict=True):
        mine = first[at : at + n][keep[at : at + n]]
        at += n
        if len(mine):
            rows.append((batch, 0, mine.tobytes()))
    return pd.DataFrame(rows, columns=["batch", "part", "hashes"])


def _removed(keep_text: bool):
    """Each document without the words that repeated windows cover."""

    def run(texts: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        batch = _Batch(texts["text"])
        covered = np.zeros(len(batch.hashes) + 1, np.int64)
        if len(repeats):
            # What came back is of this batch's own windows, so their first 64 bits tell them apart.
            known = Members(np.concatenate([np.frombuffer(h, np.uint64) for h in repeats["hashes"]]))
            places = np.flatnonzero(batch.inside(WINDOW))
            places = places[known.has(rolling_hashes(batch.hashes, WINDOW, 2)[places])]
            np.add.at(covered, places, 1)
            np.add.at(covered, places + WINDOW, -1)
        gone = np.cumsum(covered)[:-1] > 0
        rows = []
        for k, words in enumerate(batch.words):
            mine = gone[batch.starts[k] : batch.starts[k + 1]]
            removed = int(mine.sum())
            left = b" ".join([w for w, g in zip(words, mine.tolist(), strict=True) if not g] if removed else words)
            rows.append((len(words), removed, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "surrogatepass")] if keep_text else [])))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])
        out.insert(0, "doc_id", texts["doc_id"].to_numpy())
        return out

    return run


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every row of docs (doc_id, text).

    The texts are shuffled once, by batch, and the later steps read that exchange again.
    """
    size = text_bytes(docs)
    batches = max(1, -(-size // BATCH_BYTES))
    ranges = max(2, 1 << _bits(-(-size // RANGE_BYTES)))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    packed = "batch long, part long, hashes binary"
    sent = dealt.groupBy("batch").applyInPandas(_send(ranges), f"{packed}, marks binary")
    hits = sent.groupBy("part").applyInPandas(_anchors, packed)
    asked = dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInPandas(_ask(ranges), f"{packed}, marks binary")
    found = asked.groupBy("part").applyInPandas(_repeats, packed)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_removed(keep_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_substring: what is left of every document."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


#: DuckDB SQL: every window as a hash of its words, those that start at two places, and the words they cover.
ORACLE = r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select r, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n from d),
a as (select r, i, n, word, list(word) over (partition by r order by i rows between current row and 34 following) as ws from k),
h as (select r, i, word, case when i <= n - 34 then md5(array_to_string(ws, ' ')) end as h from a),
m as (select *, case when h is not null and count(*) over (partition by h) > 1 then 1 else 0 end as again from h),
c as (select r, i, word, max(again) over (partition by r order by i rows between 34 preceding and current row) as gone from m),
s as (select r, count(*) as n_words, sum(gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '') as kept from c group by r)
select doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join s using (r)"""
