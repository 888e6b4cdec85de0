"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in rank order, by merge gadgets. The gadget of a merge
(u, v) -> w adds a state w. A state that let u follow now lets w follow too; w lets
follow whatever v let follow; and u no longer lets v follow. So a token sequence is the
encoding of its text exactly if each token lets the next one follow. An entry of this
relation is the result of the gadgets in rank order and never changes, so it is kept once
computed, and executors that fill different parts agree.

The labels of the states are compiled into one deterministic automaton over bytes: its
state is the longest end of what was read that starts a label, and a state knows the
labels that end there. A word is encoded by a transition for each byte. As every prefix
of a word has one encoding, and so one last token, that token is found among the labels
that end there: the one that the last token before it lets follow. The tokens are then
read back from the end. Time is the word's length times the labels that end at a place.

Decoding emits the arcs' labels from the ids alone.

Cases: null text counts as empty; an empty text has no ids; a text that spells a
special token yields its id, as the library does by default; repeated rows are
encoded each; other columns are passed through by encode_documents() and ignored by
the digest query.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, table, trim_memory

#: Words, and runs between blanks, kept with their encoding by one Python worker, in each of two generations: of the older, those that come again move up.
CACHE_WORDS = 160_000
#: Entries of the relation, and transitions that leave a label, kept by one Python worker.
TABLE_ENTRIES = 300_000
#: Rows encoded at a time.
ROWS = 256
#: A word longer than this is not kept.
CACHE_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible in Latin-1, else the next code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The tokenization automaton of a merge list, with word ends marked by a suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made: dict[str, tuple[int, str, str]] = {}
        self.follows: dict[int, bool] = {}
        for i, (u, v) in enumerate(merges):
            w = u + v
            # The gadget yields a reachable state only if u still lets v follow when its turn comes.
            if w not in self.made and self._lets(u, v, i):
                self.made[w] = (i, u, v)
        parts = {x for pair in merges for x in pair}
        self.state = {t: i for t, i in vocab.items() if t in self.made or t not in parts or len(t.removesuffix(end)) == 1}
        self.size = max(vocab.values()) + 1
        self.token = {i: t for t, i in self.state.items()}
        self._compile()

    def _compile(self) -> None:
        """Arcs over labels, the state of the longest proper end, and the labels that end at a state, inside of a word and at its end."""
        arcs: dict[int, int] = {}
        label: list[list[int]] = [[-1, -1]]
        self.length: dict[int, int] = {}
        parent, by = [0], [0]
        for token, number in self.state.items():
            node, text = 0, token.removesuffix(self.end)
            self.length[number] = len(text)
            for c in text:
                key = node << 9 | ord(c)
                to = arcs.get(key)
                if to is None:
                    to = arcs[key] = len(label)
                    label.append([-1, -1])
                    parent.append(node)
                    by.append(ord(c))
                node = to
            label[node][len(text) < len(token)] = number
        depth = [0] * len(label)
        for n in range(1, len(label)):  # a state's parent comes before it
            depth[n] = depth[parent[n]] + 1
        shorter, more = [0] * len(label), [0] * len(label)
        for n in sorted(range(1, len(label)), key=depth.__getitem__):
            f = shorter[parent[n]] if depth[n] > 1 else 0
            if depth[n] > 1:
                while f and f << 9 | by[n] not in arcs:
                    f = shorter[f]
                f = arcs.get(f << 9 | by[n], 0)
            shorter[n] = f
            more[n] = f if label[f] != [-1, -1] else more[f]
        self.arcs, self.shorter, self.more, self.depth = arcs, shorter, more, depth
        self.inner, self.final = [x[0] for x in label], [x[1] for x in label]
        self.leaps: dict[int, int] = {}

    def _leap(self, node: int, c: int) -> int:
        """The transition of a state that has no arc for c."""
        key, f = node << 9 | c, node
        while f and f << 9 | c not in self.arcs:
            f = self.shorter[f]
        if len(self.leaps) >= TABLE_ENTRIES:
            self.leaps.clear()
        to = self.leaps[key] = self.arcs.get(f << 9 | c, 0)
        return to

    def _lets(self, x: str, y: str, turn: int) -> bool:
        """Whether state x lets token y follow once the gadgets before turn are applied: undoes gadgets, latest first."""
        while True:
            if self.rank.get((x, y), turn) < turn:
                return False
            mx, my = self.made.get(x), self.made.get(y)
            if mx is None and my is None:
                return True
            if mx == my:  # a new state followed by itself: its right part, then its left part
                turn, x, y = mx[0], mx[2], mx[1]
            elif my is not None and (mx is None or my[0] > mx[0]):
                # y's gadget gave y to the states that let its left part follow, after taking its right part from that.
                turn, y = my[0] + (x == my[1] == my[2]), my[1]
            else:
                turn, x = mx[0], mx[2]

    def lets(self, x: int, y: int) -> bool:
        """Whether the token of id x lets that of id y follow."""
        key = x * self.size + y
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) >= TABLE_ENTRIES:
                self.follows.clear()
            got = self.follows[key] = self._lets(self.token[x], self.token[y], len(self.rank))
        return got

    def encode_word(self, symbols: str) -> list[int]:
        """The ids of one word, given as one symbol a byte; its last token has the end mark."""
        arcs, leaps, more, depth, of = self.arcs, self.leaps, self.more, self.depth, self.inner
        follows, size, n, node = self.follows, self.size, len(symbols), 0
        # The last token of each prefix, which the empty one lacks.
        ending = [-1] * (n + 1)
        for i, c in enumerate(symbols, 1):
            c = ord(c)
            key = node << 9 | c
            node = arcs.get(key) or leaps.get(key) or self._leap(node, c)
            if i == n:
                of = self.final
            at = node
            while at:
                token = of[at]
                if token >= 0:
                    before = ending[i - depth[at]]
                    ok = before < 0 or follows.get(before * size + token)
                    if ok or (ok is None and self.lets(before, token)):
                        ending[i] = token
                        break
                at = more[at]
        path = []
        while n:
            path.append(ending[n])
            n -= self.length[ending[n]]
        return path[::-1]


class RunSizes(dict):
    """The number of ids of each run of a tokenizer, for the first MOST runs."""

    MOST = 200_000

    def __init__(self, tok: WordTokenizer):
        self.tok = tok

    def __missing__(self, run: bytes) -> int:
        tok = self.tok
        n = len((tok.runs_kept[0].get(run) or tok._kept(tok.runs_kept, run, tok._run)).split())
        if len(self) < self.MOST:
            self[run] = n
        return n


class WordTokenizer:
    """Normaliser, pre-splitter, automaton and decoder of a word BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The label of each id, given in decimals.
        self.labels = {str(i): t for t, i in [*self.vocab.items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        self.words_kept: tuple[dict, dict] = {}, {}
        self.runs_kept: tuple[dict, dict] = {}, {}
        self.run_sizes = RunSizes(self)

    def normalise(self, text: str) -> str:
        """NFC, runs of white space as one space, each character in lower case by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the neighbours of this letter
                text = text.replace("Σ", "σ")
        return text.lower()

    def _kept(self, kept: tuple[dict, dict], key, made):
        """made(key), kept if the key is short."""
        fresh, older = kept
        got = older.get(key) or made(key)
        if len(key) <= CACHE_LENGTH:
            if len(fresh) >= CACHE_WORDS:
                older.clear()
                older.update(fresh)
                fresh.clear()
            fresh[key] = got
        return got

    def _word(self, word: str) -> str:
        return " ".join(map(str, self.automaton.encode_word("".join([self.symbols[b] for b in word.encode()]))))

    def _run(self, run: bytes) -> str:
        """The ids of a run between blanks, which no word crosses."""
        kept = self.words_kept[0].get
        return " ".join([kept(w) or self._kept(self.words_kept, w, self._word) for w in self.words.findall(run.decode())])

    def ids_of(self, text: str) -> str:
        """A text's ids in decimals, joined by spaces."""
        kept, out = self.runs_kept[0].get, []
        for part in self.at_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                out += [kept(r) or self._kept(self.runs_kept, r, self._run) for r in self.normalise(part).encode().split()]
        return " ".join(filter(None, out))

    def count_of(self, text: str) -> int:
        """How many ids a text has: len(ids_of(text).split()), without the ids of runs whose number is known."""
        n = 0
        for part in self.at_special.split(text) if "<|" in text else [text]:
            n += 1 if part in self.special else sum(map(self.run_sizes.__getitem__, self.normalise(part).encode().split()))
        return n

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.ids_of(text or "").split()]

    def decode(self, ids: list[str]) -> str:
        """The labels of the arcs, joined by spaces (the file names no decoder), from ids in decimals."""
        return " ".join(map(self.labels.__getitem__, ids))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per file and process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, *, text: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with ids (array<int>) and decoded (string) if asked for.

    A text's encoding depends on nothing else, so rows stay where they are: no shuffle, and memory for one batch.
    The columns it adds replace columns of those names.
    """
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if ids:
        added["ids"] = T.ArrayType(T.IntegerType())
    if decoded:
        added["decoded"] = T.StringType()
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path or default_path())
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):  # ids of a whole batch would be some hundred MB
                    yield encoded(tok, whole.slice(start, ROWS))
        finally:  # a worker outlives its task, and what it keeps counts against the tasks after it
            _TOKENIZERS.clear()
            del tok
            trim_memory()

    def encoded(tok: WordTokenizer, part: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in added}
        for value in part.column(text).to_pylist():
            joined = tok.ids_of(value or "")
            numbers = joined.split()
            labels = tok.decode(numbers)
            out["n_tokens"].append(len(numbers))
            out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(labels.encode()).hexdigest())
            if ids:
                out["ids"].append(np.array(numbers, np.int32))
            if decoded:
                out["decoded"].append(labels)
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        columns = [part.column(f.name) for f in kept] + [pa.array(v, types.get(n, pa.string())) for n, v in out.items()]
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *out])

    return bounded_batches(docs).select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_bpe: digests of every document's ids and decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
