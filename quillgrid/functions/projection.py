"""Hashed dense vectors and sparse weights of one normalised text, for operators that work in Arrow batches.

Hashes run over UTF-16 units, all windows of one length at a time: as Column functions
they would be interpreted for each character of each n-gram.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np
import pandas as pd

from quillgrid.functions.vectors import FNV_OFFSET, FNV_PRIME, WORD32

#: What a lexicon makes of terms: themselves and those that mean the same.
Expand = Callable[[Iterable[str]], list[str]]
#: Weights of dense features.
PHRASE, WHOLE_PHRASE, WHOLE_WORD, CHAR, FULL, PER_HANGUL, PER_LATIN = 1.3, 1.25, 1.05, 0.28, 1.45, 0.05, 0.03
#: Weights of sparse terms, twenty times as large, so that sums are exact.
WORD20, PAIR20, TRIPLE20, CHAR20, ADDED20, ADDED_PHRASE20 = 20, 35, 44, 4, 17, 25
HANGUL = re.compile("[가-힣]")
#: Windows of fewer than so many go by all of their codes at a time.
FEW = 256
#: Characters and texts whose n-grams are counted together.
SLICE = (1 << 15, 64)


def projections(dims: int) -> int:
    """How many buckets a feature goes to."""
    return min(6, max(3, math.ceil(dims / 128)))


def words(normal: str) -> list[str]:
    """Words of two characters or more."""
    return [t for t in normal.split(" ") if len(t) >= 2]


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le"), np.uint16).astype(np.uint32)


def _hash(codes, h: int = FNV_OFFSET) -> int:
    prime, mask = FNV_PRIME, WORD32 - 1
    for c in codes:
        h = (h ^ c) * prime & mask
    return h


def _step(h: np.ndarray, c) -> np.ndarray:
    return (h ^ np.uint32(c) if isinstance(c, int) else h ^ c) * np.uint32(FNV_PRIME)


def _windows(codes: np.ndarray, start: np.ndarray, length: np.ndarray, before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the windows, each continued from the ones before it (several states): a code of all windows at a time, and the ends of those that are longer than most by _ends()."""
    order = np.argsort(-length, kind="stable")
    first, many = start[order], length[order]
    out = [h[order] for h in before]
    # So many windows are longer than done: they are the first in order.
    longer = len(many) - np.cumsum(np.bincount(many, minlength=1)) if len(many) else np.zeros(1, np.int64)
    done, live = 0, int(longer[0])
    while live >= FEW:
        c = codes[first[:live] + done]
        for h in out:
            h[:live] = _step(h[:live], c)
        done += 1
        live = int(longer[done])
    if live:
        for h, end in zip(out, _ends(codes, first[:live] + done, many[:live] - done, [h[:live] for h in out])):
            h[:live] = end
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return [h[back] for h in out]


def _ends(codes: np.ndarray, start: np.ndarray, length: np.ndarray, before: list[np.ndarray]) -> list[np.ndarray]:
    """What _windows() gives for windows that aren't empty, all of their codes at a time.

    A code changes the low bits of a state only, and bit k of the next state depends on bits up to k: it is bit k of this
    one, flipped by what the bits below it and the code say. So the low bits of all states come by running XORs, a
    bit at a time, and what each code adds to its state is known. The rest is a sum, of powers of the prime times these.
    """
    out = [h.copy() for h in before]
    first = np.cumsum(length) - length
    every = codes[np.repeat(start - first, length) + np.arange(first[-1] + length[-1])]
    wide = np.maximum.reduceat(every, first) > 255
    power = np.multiply.accumulate(np.full(int(length.max()), FNV_PRIME, np.uint32), dtype=np.uint32)
    for kind, which in ((np.uint8, ~wide), (np.uint16, wide)):
        if not which.any():
            continue
        c = (every if which.all() else every[np.repeat(which, length)]).astype(kind)
        many = length[which]
        end = np.cumsum(many)
        first = end - many
        reach = power[np.repeat(end, many) - np.arange(1, len(c) + 1)]
        for h in out:
            low = _low_bits(c, first, end, h[which].astype(kind))
            added = ((low ^ c).astype(np.uint32) - low) * reach
            h[which] = h[which] * power[many - 1] + np.add.reduceat(added, first, dtype=np.uint32)
    return out


def _low_bits(c: np.ndarray, first: np.ndarray, end: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The lowest bits, as many as c has, of the states before each code; runs of codes lie from first to end and begin with given states."""
    kind = c.dtype.type
    low, prime = np.zeros(len(c), kind), kind(FNV_PRIME & np.iinfo(kind).max)
    for k in range(8 * c.itemsize):
        flips = ((low ^ c) * prime >> kind(k)) & kind(1)
        bits = np.empty_like(flips)
        bits[1:] = flips[:-1]
        # Each run begins anew: what the one before it came to is taken back.
        at = begin >> kind(k) & kind(1)
        last = at ^ np.bitwise_xor.reduceat(flips, first) ^ flips[end - 1]
        bits[first[0]] = at[0]
        bits[first[1:]] = at[1:] ^ last[:-1]
        low |= np.bitwise_xor.accumulate(bits) << kind(k)
    return low


class Runs:
    """Words of several texts and the runs of two and three in each text. What is equal is held once: first its words, then pairs, then triples.

    owner and item: the text and the number of each that occurs. pairs and triples: what came before (a word, a pair), and the last word.
    """

    def __init__(self, texts: list[list[str]]):
        flat = [t for ts in texts for t in ts]
        owner = np.repeat(np.arange(len(texts)), [len(ts) for ts in texts])
        words, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
        self.words = list(distinct)
        n = max(len(self.words), 1)
        two = np.flatnonzero(owner[1:] == owner[:-1])  # words with a next one in their text
        pair, both = pd.factorize(words[two] * n + words[two + 1])
        three = np.flatnonzero(two[1:] == two[:-1] + 1) if len(two) else two
        three = three[owner[two[three]] == owner[two[three] + 2]] if len(three) else three
        triple, all_three = pd.factorize(pair[three] * n + words[two[three] + 2])
        self.pairs, self.triples = (np.stack([x // n, x % n]) if len(x) else np.zeros((2, 0), np.int64) for x in (both, all_three))
        self.sizes = (len(self.words), len(both), len(all_three))
        self.owner = [owner, owner[two], owner[two[three]]]
        self.item = [words, pair, triple]


def touched(words: Iterable[str], expand: Expand) -> frozenset[str]:
    """Those of the words that expand() makes more of."""
    words = list(dict.fromkeys(words))
    return frozenset() if len(expand(words)) == len(words) else frozenset(w for w in words if expand([w]) != [w])


def _chars(every: np.ndarray, sizes: np.ndarray, korean: np.ndarray, dims: int) -> np.ndarray:
    """What the n-grams of compact texts, which follow each other in every, add to the projections of each.

    Hashes of longer n-grams go on from those of shorter ones, and as all n-grams weigh the same, they are counted by
    bucket and sign. Some texts at a time, so that counts stay in a core's cache.
    """
    out = np.zeros((len(sizes), dims))
    ends = np.cumsum(sizes)
    for hangul in (True, False):
        rows = np.flatnonzero((korean == hangul) & (sizes > 1))
        lengths = (2, 3, 4) if hangul else (3, 4, 5)
        begun = 0
        while begun < len(rows):
            stop = begun + max(1, min(int(np.searchsorted(np.cumsum(sizes[rows[begun : begun + SLICE[1]]]), SLICE[0], "right")), SLICE[1]))
            part = rows[begun:stop]
            begun = stop
            codes = np.concatenate([every[ends[i] - sizes[i] : ends[i]] for i in part])
            left = np.concatenate([np.arange(sizes[i], 0, -1) for i in part])  # characters from here to the text's end
            base = np.repeat(np.arange(len(part)) * (2 * dims), sizes[part])
            for at in range(0, len(codes), SLICE[0]):  # a long text goes by pieces
                here = codes[at : at + SLICE[0] + lengths[-1]]
                size = min(SLICE[0], len(codes) - at)
                states = [np.full(size, _hash(map(ord, k + "char:")), np.uint32) for k in ("", "sign:")]
                for n in range(1, lengths[-1] + 1):
                    states = [_step(h[: len(here) - n + 1], here[n - 1 : n - 1 + len(h)]) for h in states]
                    if n not in lengths:
                        continue
                    fits = np.flatnonzero(left[at : at + len(states[0])] >= n)
                    to = base[at : at + size][fits]
                    h, s = (_step(x[fits], ord(":")) for x in states)
                    for i in range(projections(dims)):
                        place = to + _bucket(_step(h, ord("0") + i), dims) * 2 + (_step(s, ord("0") + i) & np.uint32(1))
                        n_signs = np.bincount(place, minlength=2 * dims * len(part)).reshape(len(part), dims, 2)
                        out[part] += (n_signs[:, :, 1] - n_signs[:, :, 0]) * (CHAR / (1.0 if i == 0 else i + 0.5))
    return out


def _bucket(h: np.ndarray, dims: int) -> np.ndarray:
    """The absolute value of a hash as a signed number, modulo dims."""
    signed = h.view(np.int32)
    size = np.where(signed < 0, np.uint32(0) - h, h)
    return size & np.uint32(dims - 1) if dims & (dims - 1) == 0 else size % np.uint32(dims)


def _grams(normal: str) -> tuple[str, tuple[int, ...]]:
    """The text without spaces, and the lengths of its n-grams: 2 to 4 if it holds Hangul, else 3 to 5."""
    compact = normal.replace(" ", "")
    return compact, (2, 3, 4) if HANGUL.search(compact) else (3, 4, 5)


def dense_vectors(normals: list[str], dims: int, expand: Expand | None = None, tokens: list[list[str]] | None = None) -> np.ndarray:
    """The hashed projections of normalised texts (tokens: their words, where they are known), a row each, at length 1, to six decimals; all zeros for an empty text.

    Features are words by count, runs of two and three words, words and whole text once each
    with what a lexicon's expand makes of them, n-grams, and the compact text. What several
    texts share is hashed once, and the windows of one kind for all texts together.
    """
    states: dict[str, list[np.ndarray]] = {"": [], "sign:": []}
    weights: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def spread(prefix: str | None, codes: np.ndarray, start: np.ndarray, length: np.ndarray, weight: np.ndarray | float, owner: np.ndarray, item: np.ndarray | None = None, before: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Notes the windows' hashes after a prefix or after those before, for each owner of an item (else of a window), and returns them."""
        got = _windows(codes, start, length, before or [np.full(len(start), _hash(map(ord, k + prefix)), np.uint32) for k in states])
        for kept, h in zip(states.values(), got):
            kept.append(h if item is None else h[item])
        weights.append(np.broadcast_to(weight, len(owner)))
        owners.append(owner)
        return got

    tokens = [words(n) for n in normals] if tokens is None else tokens
    runs = Runs(tokens)
    spaced = units(" " + " ".join(runs.words))
    size = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le")) // 2 for t in runs.words], np.int64)
    start = np.cumsum(size + 1) - size
    (word_owner, pair_owner, triple_owner), (word, pair, triple) = runs.owner, runs.item
    once, often = np.unique(word_owner * max(len(size), 1) + word, return_counts=True)
    at = once % max(len(size), 1)
    logs = np.array([1 + math.log1p(n) for n in range(int(often.max(initial=0)) + 1)])
    for prefix, weight in (("tok:", logs[often]), ("sem:", WHOLE_WORD)):
        spread(prefix, spaced, start, size, weight, once // max(len(size), 1), at)
    heads = _windows(spaced, start, size, [np.full(len(size), _hash(map(ord, k + "phrase:")), np.uint32) for k in states])
    for (head, last), owner, item in ((runs.pairs, pair_owner, pair), (runs.triples, triple_owner, triple)):
        heads = spread(None, spaced, start[last] - 1, size[last] + 1, PHRASE, owner, item, [h[head] for h in heads])
    compact = [_grams(n) for n in normals]
    short = [units(c) for c, _ in compact]
    every = np.concatenate(short) if short else np.zeros(0, np.uint32)
    sizes = np.array([len(x) for x in short], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if short else sizes
    full = np.flatnonzero([bool(n) for n in normals])
    whole = [i for i in full if " " in normals[i] or normals[i] not in tokens[i]]
    # The longest windows of all, in one go: each compact text, and each whole one.
    raw = [units(normals[i]) for i in whole]
    long = np.array([len(r) for r in raw], np.int64)
    ends = ["full:"] * len(full) + ["sem:"] * len(whole)
    begin = [np.array([_hash(map(ord, k + prefix)) for prefix in ends], np.uint32) for k in states]
    heavy = [FULL] * len(full) + [WHOLE_PHRASE if " " in normals[i] else WHOLE_WORD for i in whole]
    spread(None, np.concatenate([every, *raw]), np.concatenate([offset[full], len(every) + np.cumsum(long) - long]), np.concatenate([sizes[full], long]), np.array(heavy), np.array([*full, *whole], np.int64), before=begin)
    more = []
    wider = touched(runs.words, expand) if expand else frozenset()
    for i in full if expand else ():
        if len(expand([normals[i]])) > 1 or wider and not wider.isdisjoint(tokens[i]):
            own = {normals[i], *tokens[i]}
            more += [(i, t) for t in expand([normals[i], *tokens[i]]) if t not in own]
    if more:
        raw = [units(t) for _, t in more]
        long = np.array([len(r) for r in raw], np.int64)
        spread("sem:", np.concatenate(raw), np.cumsum(long) - long, long, np.array([WHOLE_PHRASE if " " in t else WHOLE_WORD for _, t in more]), np.array([i for i, _ in more]))
    h, s = (np.concatenate(x) for x in states.values())
    weight, base = np.concatenate(weights), np.concatenate(owners).astype(np.int64) * dims
    out = np.zeros(len(normals) * dims)
    for i in range(projections(dims)):
        odd = _step(_step(s, ord(":")), ord("0") + i) & np.uint32(1)
        out += np.bincount(base + _bucket(_step(_step(h, ord(":")), ord("0") + i), dims), weights=np.where(odd, weight, -weight) / (1.0 if i == 0 else i + 0.5), minlength=len(out))
    out = out.reshape(len(normals), dims) + _chars(every, sizes, np.array([g[1][0] == 2 for g in compact], bool), dims)
    which = np.repeat(np.arange(len(normals)), sizes)
    out[:, 0] += PER_HANGUL * np.bincount(which[(every >= 0xAC00) & (every <= 0xD7A3)], minlength=len(normals))
    out[:, 1] += PER_LATIN * np.bincount(which[(every >= ord("a")) & (every <= ord("z"))], minlength=len(normals))
    for row in out:
        norm = math.sqrt(float(row @ row))
        if norm:
            row[:] = np.round(row / norm, 6)
    return out


def dense_vector(normal: str, dims: int, expand: Expand | None = None) -> np.ndarray:
    """The hashed projection of one normalised text."""
    return dense_vectors([normal], dims, expand)[0]


def word_terms(normal: str, expand: Expand | None = None) -> Counter[str]:
    """Twenty times the sparse weight of each term but n-grams: words, pairs, triples, and what a lexicon's expand adds."""
    tokens, out = words(normal), Counter()
    for terms, weight in ((tokens, WORD20), (map(" ".join, pairwise(tokens)), PAIR20), (map(" ".join, zip(tokens, tokens[1:], tokens[2:])), TRIPLE20)):
        for t, n in Counter(terms).items():
            out[t] += n * weight
    for t in expand(tokens) if expand else ():
        if len(t) >= 2:
            out[t] = max(out[t], ADDED_PHRASE20 if " " in t else ADDED20)
    return out


def sparse_terms(normal: str, expand: Expand | None = None) -> Counter[str]:
    """word_terms(), and n-grams if the compact text has four characters."""
    out = word_terms(normal, expand)
    compact, lengths = _grams(normal)
    if len(compact) >= 4:
        for n in lengths:
            for t, k in Counter([compact[i : i + n] for i in range(len(compact) - n + 1)]).items():
                out[f"char:{t}"] = k * CHAR20
    return out


class Asked:
    """A question's terms: those wanted one by one, and all sparse terms of its normalised text with twenty times their weights."""

    def __init__(self, normal: str, wanted: Iterable[str], expand: Expand | None = None):
        self.wanted = list(wanted)
        self.terms = sparse_terms(normal, expand)


class Held:
    """What a normalised text holds of questions: twenty times the sparse weights, of the terms asked for only. The total needs their number and no terms. expand: of texts that a lexicon adds to."""

    def __init__(self, normal: str, tokens: list[str], expand: Expand | None = None):
        self.compact, self.lengths = _grams(normal)
        n = len(tokens)
        runs = n * WORD20 + max(n - 1, 0) * PAIR20 + max(n - 2, 0) * TRIPLE20
        grams = sum(max(len(self.compact) - k + 1, 0) for k in self.lengths) * CHAR20 if len(self.compact) >= 4 else 0
        self.tokens, self.terms = tokens, word_terms(normal, expand) if expand else None
        self.total = grams + (sum(self.terms.values()) if expand else runs)
        self.first: dict[str, list[int]] | None = None
        self.known: dict[str, int] = {}

    def weight(self, term: str) -> int:
        if term not in self.known:
            self.known[term] = self._gram(term[5:]) if term.startswith("char:") else self.terms.get(term, 0) if self.terms is not None else self._run(term)
        return self.known[term]

    def _run(self, term: str) -> int:
        words = term.split(" ")
        if len(words) > 3:
            return 0
        if self.first is None:
            self.first = {}
            for k, t in enumerate(self.tokens):
                self.first.setdefault(t, []).append(k)
        at = self.first.get(words[0], ())
        return (WORD20, PAIR20, TRIPLE20)[len(words) - 1] * (len(at) if len(words) == 1 else sum(self.tokens[k : k + len(words)] == words for k in at))

    def _gram(self, gram: str) -> int:
        """Places may overlap."""
        if len(gram) not in self.lengths or len(self.compact) < 4:
            return 0
        if not any(gram.startswith(gram[k:]) for k in range(1, len(gram))):
            return self.compact.count(gram) * CHAR20
        n, at = 0, self.compact.find(gram)
        while at >= 0:
            n, at = n + 1, self.compact.find(gram, at + 1)
        return n * CHAR20

    def least(self, asked: Asked) -> int:
        """The lesser weights of shared terms, summed."""
        return sum(min(w, self.weight(t)) for t, w in asked.terms.items())


#: Odd factors of an n-gram's characters, by place, and a last one; what is added says how long it is.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def gram_keys(normal: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of sparse_terms(), distinct and in rising order as signed numbers, and twenty times their weights."""
    compact, lengths = _grams(normal)
    if len(compact) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    codes = np.frombuffer(compact.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    every = []
    for n in lengths:
        h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h += codes[k : k + len(h)] * PLACES[k]
        every.append(h)
    h = np.concatenate(every)
    h = ((h ^ (h >> np.uint64(29))) * PLACES[5]).view(np.int64)
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], (np.diff(np.append(first, len(h))) * CHAR20).astype(np.int32)
