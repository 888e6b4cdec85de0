"""HTML extraction by union-free regular-expression inference.

The pages of a host are aligned into a wrapper: a regular expression over page tokens,
without unions, of elements, text, optional groups and repeated groups. Tokens are
nested as their elements are, and a mismatch is resolved among the siblings where it
arises. Text that differs becomes a slot; siblings that repeat fold into a repeated
group; siblings that one side lacks become optional.

Pages of one shape (folded tokens without text) add up in any order, so each task sends
one row for each shape of a host. Shapes are then aligned, sorted, in a tree whose groups
follow their hashes: the wrapper doesn't depend on how the pages were dealt, and no task
aligns more than some FAN shapes.

The wrapper decides, once for a host, which of its nodes is the main container (an
article, else a main element, else the smallest element with most of the running text),
which elements in it are asides, and which text is template: the same on nearly all
pages that have the container, among them VOICES with different main text, while other
text there differs. A page is then matched against the wrapper's expression, sibling by
sibling, and the text that falls to content nodes is its main text. Constant asides show
in the wrapper; those whose text changes from page to page, such as adverts, differ from
content in nothing but names, so tag, role, class and id count as well, unless the
element so named holds most of the container's text. Elements that match no node are
judged by name; a page without text in its host's container, or without a host, is
matched against its own wrapper.

Cases: null and empty html, and a page without text, give an empty text; truncated
markup is closed at the end; repeated rows are extracted each and count as one voice;
beyond DEPTH levels only articles, main elements and the outermost aside have levels of
their own; other columns pass through extract() unless they have the names it adds, or
_host or _rules.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, cut, table

#: Levels of a wrapper.
DEPTH = 100
#: Wrappers that one task holds at a time; those of more are sent on as they are.
HELD = 500
#: Parts that the partial wrappers of one shape are merged in first, and wrappers that meet in a group of the tree, about.
PARTS, FAN = 64, 16
#: Rules are broadcast up to this many bytes and shuffled beyond it.
BROADCAST_BYTES = 32_000_000
#: Pages with different main text that must agree before text counts as template, and their share of the container's pages.
VOICES, NEARLY = 3, 0.9
#: Share of the running text that the main container holds, if no element says that it is it.
MOST = 0.6
#: Cells of an alignment table; larger ones are split, which finds alignments of the same length.
CELLS = 4_000_000

#: Elements whose content is no markup and ends with their end tag or the page.
RAW = frozenset("script style noscript title textarea iframe".split())
#: Elements that are dropped with all they hold, if they end.
OPAQUE = frozenset("template svg object select".split())
#: Elements that start a block of text.
BLOCKS = frozenset("html body main article section div nav header footer aside form ul ol li dl dt dd table caption thead tbody tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary fieldset center menu dialog".split())
#: What an element ends if it is open among its siblings.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that are no main text, and words of a class, id or role that say so.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus reply replies".split())
ASIDE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget toolbar pagination pager login signup search skip".split()
)
#: Words beside one of these that speak of a state and not of what the element is.
STATE_WORDS = frozenset("has no with without is enabled disabled free hidden open closed".split())
#: The same, but only outside an article, which may have a header of its own.
TOP_TAGS, TOP_WORDS = frozenset(["header"]), frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("main content article post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text: each of a name's words must say aside.
TEXT_TAGS = HEADINGS | frozenset("p li td th dt dd blockquote pre figcaption span b i em strong small a u mark q cite code abbr sub sup font label time".split())
INLINE_ALWAYS = frozenset("img input link meta a".split())

#: Attributes; a quote opens a value only after an equals sign, and only if it closes.
ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|</?[a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | OPAQUE}


def _label(tag: str, attributes: str) -> str:
    """The tag, and the names in class, id and role, in letters only."""
    if "=" not in attributes:
        return tag
    names = {"-".join(re.findall("[a-z]+", w)) for m in NAMES.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}
    return ".".join([tag, *sorted(names - {""})])


def _says(name: str, words: frozenset[str], whole: bool) -> bool:
    """Whether a name has one of the words (whole: nothing else) and speaks of no state."""
    parts = name.split("-")
    return (words.issuperset(parts) if whole else not words.isdisjoint(parts)) and STATE_WORDS.isdisjoint(parts)


def _is_aside(label: str, inside: bool) -> bool:
    """Whether an element is one by its names. An article is never one by a single name; html, body and main speak of the page as a whole."""
    tag, *names = label.split(".")
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body", "main") or (tag == "article" and not any(_says(n, ASIDE_WORDS, True) for n in names)):
        return False
    if any(_says(n, ASIDE_WORDS, tag in TEXT_TAGS) for n in names):
        return True
    return not inside and tag != "article" and (tag in TOP_TAGS or any(_says(n, TOP_WORDS, False) for n in names))


def _is_article(label: str) -> bool:
    return label.split(".", 1)[0] in ("article", "main")


Block = tuple[tuple[str, ...], tuple[int, ...], str, int]


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order: the labels of their elements, the places of those among their siblings, the text, and its characters inside links."""
    out: list[Block] = []
    labels: list[str] = []
    # All open elements, how many levels there were before each, and how many are open by name.
    tags: list[str] = []
    levels: list[int] = []
    opened: Counter[str] = Counter()
    places: list[int] = []
    counts = [0]
    parts: list[str] = []
    linked, in_link = 0, 0
    endless: set[str] = set()

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((tuple(labels), (*places, counts[-1]), text, min(linked, len(text))))
                counts[-1] += 1
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        n = levels[at]
        opened.subtract(tags[at:])
        del labels[n:], tags[at:], levels[at:], places[n:], counts[n + 1 :]

    def last(names: set[str]) -> int:
        return next(k for k in range(len(tags) - 1, -1, -1) if tags[k] in names)

    def has_level(label: str) -> bool:
        """Whether an element gets a level: any but the only child so far of one that is the same, and beyond DEPTH only some."""
        if labels and label == labels[-1] and counts[-1] == 0 and not parts:
            return False
        inside = any(map(_is_article, labels))
        return len(labels) < DEPTH or (not inside and _is_article(label)) or (_is_aside(label, inside) and not any(_is_aside(x, True) for x in labels[DEPTH:]))

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), m[1], m[3]
        if not ending and (tag == "head" or tag in RAW_END) and tag not in endless and not (tag in OPAQUE and attributes.endswith("/")):
            end = (HEAD_END if tag == "head" else RAW_END[tag]).search(page, at)
            if end or tag in RAW:
                at = end.end() if end else len(page)
                parts.append(" ")
                continue
            endless.add(tag)
        if tag == "a":
            in_link = 0 if ending else 1
        if tag in ("br", "hr"):
            end_block()
            continue
        if ending:
            if tag in BLOCKS or opened[tag] > 0:
                end_block()
                if opened[tag] > 0:
                    close(last({tag}))
            continue
        label = _label(tag, attributes)
        if tag not in BLOCKS and (tag in INLINE_ALWAYS or attributes.endswith("/") or not _is_aside(label, True) or (tag == "button" and opened["p"] > 0)):
            continue
        end_block()
        if opened["p"] > 0 and tag in BLOCKS:
            close(last({"p"}))
        for k in range(len(tags) - 1, -1, -1) if any(opened[t] > 0 for t in ENDS.get(tag, ())) else ():
            if tags[k] in SCOPE[tag]:
                break
            if tags[k] in ENDS[tag]:
                close(k)
                break
        if not attributes.endswith("/"):
            levels.append(len(labels))
            tags.append(tag)
            opened[tag] += 1
            if has_level(label):
                places.append(counts[-1])
                counts[-1] += 1
                counts.append(0)
                labels.append(label)
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


# A page's tree: items are (label, items) of an element or (None, number) of a block.
Item = tuple


def tree(found: list[Block]) -> list[Item]:
    def build(start: int, end: int, depth: int) -> list[Item]:
        items: list[Item] = []
        while start < end:
            labels, places, _, _ = found[start]
            if len(labels) == depth:
                items.append((None, start))
                start += 1
                continue
            j = start + 1
            while j < end and len(found[j][0]) > depth and found[j][1][depth] == places[depth]:
                j += 1
            items.append((labels[depth], build(start, j, depth + 1)))
            start = j
        return items

    return build(0, len(found), 0)


# A wrapper's nodes are tuples: shape, kind, label, children, payload. Kinds are "#" text, "<" element, "+" repeated, "?" optional.
# Payload of text: its hash if it is the same everywhere (else None), its characters, those in links, the pages that have it,
# and up to VOICES hashes of their main texts, the smallest. Of others: the pages that have it.
Node = tuple


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _text(value: int | None, size: int, linked: int, pages: int, voices: tuple[int, ...]) -> Node:
    return ("#", "#", "", (), (value, size, linked, pages, voices))


def _made(kind: str, label: str, children: tuple[Node, ...], pages: int = 1) -> Node:
    inner = "".join([c[0] for c in children])
    return (f"<{label}>{inner}</>" if kind == "<" else f"({inner}){kind}", kind, label, children, pages)


def _together(x: Node, y: Node, pages) -> Node:
    """Two nodes of the same shape as one. Sums, sets and "the same or not" don't depend on the order."""
    a, b = x[4], y[4]
    if x[1] == "#":
        return _text(a[0] if a[0] == b[0] else None, a[1] + b[1], a[2] + b[2], pages(a[3], b[3]), tuple(sorted({*a[4], *b[4]})[:VOICES]))
    return (*x[:3], tuple([_together(p, q, pages) for p, q in zip(x[3], y[3], strict=True)]), pages(a, b))


def _merged(x: Node, y: Node) -> Node:
    """Of the same pages."""
    return _together(x, y, max)


def added(x: Node, y: Node) -> Node:
    """Of different pages: their numbers add up."""
    return _together(x, y, int.__add__)


def folded(items: list[Node]) -> tuple[Node, ...]:
    """Siblings with runs of one to four that repeat as repeated groups, shortest period first."""
    for period in range(1, 5):
        out: list[Node] = []
        i = 0
        while i < len(items):
            one = items[i : i + period]
            shape = [x[0] for x in one]
            j = i + period
            while len(one) == period and [x[0] for x in items[j : j + period]] == shape:
                one = list(map(_merged, one, items[j : j + period]))
                j += period
            if j > i + period:
                group = one[0] if period == 1 and one[0][1] == "+" else _made("+", "", tuple(one), max(_pages(x) for x in one))
                out.append(group)
                i = j
            else:
                # A single sibling next to a repeated group of its shape joins it.
                if period == 1 and out and out[-1][1] == "+" and [c[0] for c in out[-1][3]] == shape:
                    out[-1] = _made("+", "", tuple(map(_merged, out[-1][3], one)), max(out[-1][4], _pages(one[0])))
                else:
                    out.append(items[i])
                i += 1
        items = out
    return tuple(items)


def _pages(x: Node) -> int:
    return x[4][3] if x[1] == "#" else x[4]


def page_wrapper(found: list[Block]) -> Node:
    """A page's own tokens, folded."""
    voice = max((text for _, _, text, _ in found), key=lambda t: (len(t), t), default="")
    voices = (text_hash(voice),)

    def build(items: list[Item]) -> tuple[Node, ...]:
        return folded([_text(text_hash(found[x][2]), len(found[x][2]), found[x][3], 1, voices) if label is None else _made("<", label, build(x)) for label, x in items])

    return _made("<", "", build(tree(found)))


def _key(x: Node) -> tuple[str, str, bool]:
    """Siblings with equal keys can be one: text, an element by its label, a group by its first member and whether it has others."""
    many = False
    while x[1] in "+?":
        many = many or len(x[3]) > 1
        x = x[3][0]
    return x[1], x[2], many


def _joined(x: Node, y: Node) -> Node:
    if x[0] == y[0]:
        return added(x, y)
    if x[1] == y[1]:
        return _made(x[1], x[2], aligned(x[3], y[3]), x[4] + y[4])
    a, b = (x, y) if x[1] == "?" or (x[1] == "+" and y[1] != "?") else (y, x)
    inner = _joined(a[3][0], b)
    return inner if a[1] == inner[1] else _made(a[1], "", (inner,), _pages(inner))


def _gains(a: np.ndarray, b: np.ndarray, shapes_a: np.ndarray, shapes_b: np.ndarray) -> np.ndarray:
    """For each place of b, the best alignment of all of a with what is at or behind it."""
    row = np.zeros(len(b) + 1, np.int64)
    for i in range(len(a) - 1, -1, -1):
        row = _row(a[i], b, shapes_a[i], shapes_b, row)
    return row


def _row(x: int, b: np.ndarray, shape: int, shapes_b: np.ndarray, below: np.ndarray) -> np.ndarray:
    both = np.where(b == x, below[1:] + 2 + (shapes_b == shape), 0)
    return np.append(np.maximum.accumulate(np.maximum(both, below[:-1])[::-1])[::-1], 0)


def _pairs(a: np.ndarray, b: np.ndarray, shapes_a: np.ndarray, shapes_b: np.ndarray) -> list[tuple[int, int]]:
    """A longest alignment of two lists of keys; equal shapes count half as much again."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return []
    if n > 1 and n * m > CELLS:
        # Where the best alignment passes from the first half of a to the second.
        h = n // 2
        ahead = _gains(a[:h][::-1], b[::-1], shapes_a[:h][::-1], shapes_b[::-1])[::-1]
        at = int((ahead + _gains(a[h:], b, shapes_a[h:], shapes_b)).argmax())
        return _pairs(a[:h], b[:at], shapes_a[:h], shapes_b[:at]) + [(i + h, j + at) for i, j in _pairs(a[h:], b[at:], shapes_a[h:], shapes_b[at:])]
    best = [np.zeros(m + 1, np.int64)]
    for i in range(n - 1, -1, -1):
        best.append(_row(a[i], b, shapes_a[i], shapes_b, best[-1]))
    best.reverse()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 2 + (shapes_a[i] == shapes_b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: tuple[Node, ...], b: tuple[Node, ...]) -> tuple[Node, ...]:
    """The regular expression that covers two lists of siblings: the most siblings that fit, in order, are joined; the others become optional."""
    if [x[0] for x in a] == [y[0] for y in b]:
        return tuple(map(added, a, b))
    keys: dict = {}
    number = lambda items, of: np.array([keys.setdefault(of(x), len(keys)) for x in items], np.int64)
    pairs = _pairs(number(a, _key), number(b, _key), number(a, lambda x: x[0]), number(b, lambda x: x[0]))
    optional = lambda x: x if x[1] == "?" else _made("?", "", (x,), _pages(x))
    out: list[Node] = []
    i = j = 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [optional(x) for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_joined(a[p], b[q]))
        i, j = p + 1, q + 1
    return folded(out)


def align(x: Node, y: Node) -> Node:
    return _joined(x, y)


def rules(wrapper: Node) -> list:
    """What a wrapper decides, as nodes [kind, label, mark, children]. Marks: of an element the rank of a main container, -1 of an aside, else 0; of text the hash of template text, else None."""
    leaves: list[tuple[tuple[str, ...], tuple]] = []
    reach: Counter[tuple[str, ...]] = Counter()

    def walk(node: Node, path: tuple[str, ...]) -> None:
        if node[1] == "#":
            leaves.append((path, node[4]))
        elif node[1] == "<":
            reach[path] += node[4]
        for c in node[3]:
            walk(c, (*path, c[2]) if c[1] == "<" else path)

    walk(wrapper, ())
    main: dict[tuple[str, ...], list[int]] = {}
    total: Counter[tuple[str, ...]] = Counter()
    running: Counter[tuple[str, ...]] = Counter()
    for path, (_, size, linked, _pages_, _voices) in leaves:
        inside, kept = False, True
        for k, label in enumerate(path):
            tag, *names = label.split(".")
            if not inside and tag in ("article", "main", "div", "section", "td"):
                rank = {"article": 0, "main": 1}.get(tag, 2 if any(_says(n, MAIN_WORDS, False) for n in names) else None)
                aside = _is_aside(label, True)
                if rank is not None and (tag == "article" or not aside):
                    # One that looks like an aside, or is inside of one, counts only if there is no other.
                    main.setdefault(path[: k + 1], [rank + 3 * (aside or not kept), 0])[1] += size - linked
            kept = kept and not _is_aside(label, inside)
            inside = inside or tag in ("article", "main")
        for k in range(len(path) + 1):
            running[path[:k]] += size - linked
            if kept:
                total[path[:k]] += size - linked
    named = sorted((p for p in main if main[p][1] > 0), key=lambda p: (main[p][0], -main[p][1], p))
    if not named and total[()] > 0:
        at: tuple[str, ...] = ()
        while True:
            below = sorted((p for p in total if len(p) == len(at) + 1 and p[:-1] == at), key=lambda p: (-total[p], p))
            if not below or total[below[0]] < MOST * total[()] or below[0][-1].split(".")[0] in ("p", "li", "td", "tr", "blockquote", *HEADINGS):
                break
            at = below[0]
        named = [at]
    ranks = {p: r for r, p in enumerate(named, 1)}
    changes = {p for p in named if any(t[0] is None for path, t in leaves if path[: len(p)] == p)}

    def told(node: Node, path: tuple[str, ...], best: tuple[str, ...] | None, inside: bool) -> list:
        mark: int | None = 0
        if node[1] == "#":
            value, _, _, pages, voices = node[4]
            same = best in changes and value is not None and len(voices) >= VOICES and pages >= NEARLY * reach[best]
            mark = value if same and not (path and path[-1].split(".")[0] in HEADINGS) else None
        elif node[1] == "<":
            if best is None and path in ranks:
                mark, best, inside = ranks[path], path, any(map(_is_article, path))
            elif best is not None and _is_aside(node[2], inside):
                comments = any(_says(n, COMMENT_WORDS, False) for n in node[2].split(".")[1:])
                most = running[path] > MOST * running[best] and node[2].split(".")[0] not in ASIDE_TAGS
                mark = 0 if most and not comments else -1
            inside = inside or _is_article(node[2])
        return [node[1], node[2], mark, [told(c, (*path, c[2]) if c[1] == "<" else path, best, inside) for c in node[3]]]

    return told(wrapper, (), None, False)


class Level:
    """The expression of one element's children, compiled: its places (mark and inner level), those that can start it, and those that can follow each."""

    def __init__(self, children: list):
        self.marks: list = []
        self.inner: list[Level | None] = []
        self.at: dict[str | None, list[int]] = {}
        self.follow: list[set[int]] = []
        first, _, _ = self._sequence(children)
        self.follow.append(first)  # of the start, place -1

    def _sequence(self, nodes: list) -> tuple[set[int], set[int], bool]:
        """The places that can start and end the nodes, and whether they can be left out."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for kind, label, mark, children in nodes:
            if kind in "#<":
                k = len(self.marks)
                self.marks.append(mark)
                self.follow.append(set())
                self.inner.append(Level(children) if kind == "<" else None)
                self.at.setdefault(label if kind == "<" else None, []).append(k)
                f, e, skip = {k}, {k}, False
            else:
                f, e, skip = self._sequence(children)
                if kind == "+":
                    for k in e:
                        self.follow[k] |= f
                skip = skip or kind == "?"
            for k in last:
                self.follow[k] |= f
            first = first | f if empty else first
            last = last | e if skip else e
            empty = empty and skip
        return first, last, empty

    def match(self, items: list[Item]) -> list[int | None]:
        """The place of each item on a path through the expression that leaves out the fewest items."""
        ends: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}
        for n, (label, _) in enumerate(items):
            fresh: dict[int, tuple[int, tuple | None]] = {}
            for k in self.at.get(label, ()):
                best = None
                for p, (score, path) in ends.items():
                    if k in self.follow[p] and (best is None or score > best[0]):
                        best = (score, path)
                if best is not None:
                    fresh[k] = (best[0] + 1, (best[1], n, k))
            if fresh:
                for k, end in fresh.items():
                    if k not in ends or ends[k][0] < end[0]:
                        ends[k] = end
                top = max(score for score, _ in ends.values())
                ends = {p: e for p, e in ends.items() if e[0] >= top - 2}
        out: list[int | None] = [None] * len(items)
        path = max(ends.values(), key=lambda e: e[0])[1]
        while path:
            path, n, k = path
            out[n] = k
        return out


class Rules:
    """A wrapper's decisions, ready to match pages."""

    def __init__(self, told: list):
        self.mark, self.level = told[2], Level(told[3])

    def texts(self, found: list[Block]) -> list[str]:
        """The blocks of a page in the best main container that has text."""
        out: dict[int, list[str]] = {}

        def walk(items: list[Item], level: Level | None, rank: int, inside: bool) -> None:
            at = level.match(items) if level is not None else [None] * len(items)
            for (label, x), k in zip(items, at, strict=True):
                if label is None:
                    if rank and (k is None or level.marks[k] is None or level.marks[k] != text_hash(found[x][2])):
                        out.setdefault(rank, []).append(found[x][2])
                    continue
                mark = (-1 if rank and _is_aside(label, inside) else 0) if k is None else level.marks[k]
                if not (rank and mark == -1):
                    walk(x, None if k is None else level.inner[k], rank or max(mark, 0), inside or _is_article(label))

        walk(tree(found), self.level, self.mark, False)
        return out[min(out)] if out else []


def main_text(page: str | None, told: Rules | None) -> str:
    """The main text of a page by its host's wrapper, else by its own."""
    found = blocks(page) if page else []
    got = told.texts(found) if told else []
    return "\n".join(got or (Rules(rules(page_wrapper(found))).texts(found) if found else []))


def host(url: Column) -> Column:
    """The host in a url, in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _pack(node: Node) -> str:
    plain = lambda x: [x[1], x[2], [plain(c) for c in x[3]], x[4]]
    return json.dumps(plain(node), ensure_ascii=False, separators=(",", ":"))


def _unpack(packed: str) -> Node:
    def node(x: list) -> Node:
        kind, label, children, payload = x
        return _text(*payload[:4], tuple(payload[4])) if kind == "#" else _made(kind, label, tuple([node(c) for c in children]), payload)

    return node(json.loads(packed))


PARTIAL = "host string, shape long, wrapper string"


def _shape(node: Node) -> int:
    return int(np.uint64(text_hash(node[0])).astype(np.int64)) & 0x7FFFFFFFFFFFFFFF


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pages of a task, added up by host and shape."""
    held: dict[tuple[str, int], Node] = {}
    send = lambda: pd.DataFrame([(h, s, _pack(w)) for (h, s), w in held.items()], columns=["host", "shape", "wrapper"])
    for batch in batches:
        for name, page in zip(batch["host"], batch["html"], strict=True):
            if isinstance(page, str) and page:
                one = page_wrapper(blocks(page))
                key = (name, _shape(one))
                held[key] = added(held[key], one) if key in held else one
                if len(held) > HELD:
                    yield send()
                    held.clear()
    yield send()


def _met(group: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of a group as one: those of a shape added up, then all aligned in the order of their shapes."""
    shapes: dict[str, Node] = {}
    for packed in group["wrapper"]:
        one = _unpack(packed)
        shapes[one[0]] = added(shapes[one[0]], one) if one[0] in shapes else one
    whole = None
    for shape in sorted(shapes, key=lambda s: (len(s), s)):
        whole = shapes[shape] if whole is None else align(whole, shapes[shape])
    return group.iloc[:1].assign(wrapper=_pack(whole))[["host", "shape", "wrapper"]]


def infer(pages: DataFrame) -> DataFrame:
    """host and rules (JSON) of every host of pages (url, html). Pages stay where they are; only wrappers meet."""
    spread = pages.select(host(F.col("url")).alias("host"), "html").where("host <> ''")
    partial = spread.mapInPandas(_partial, PARTIAL).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    found = cut(partial.groupBy("host", "shape", "part").applyInPandas(_met, PARTIAL))
    most = found.groupBy("host").agg(F.count_distinct("shape").alias("n")).agg(F.max("n")).first()[0] or 1
    width = FAN
    while width < most:
        width *= FAN
    while width > 1:
        # Groups of a width are the parts of those of the next.
        width //= FAN
        found = found.withColumn("shape", F.pmod("shape", F.lit(width))).groupBy("host", "shape").applyInPandas(_met, PARTIAL)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "rules": [json.dumps(rules(_unpack(w)), ensure_ascii=False, separators=(",", ":")) for w in batch["wrapper"]]})

    return found.mapInPandas(told, "host string, rules string")


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html and others) with text and n_chars."""
    known = cut(infer(bounded_batches(pages)))
    size = known.agg(F.coalesce(F.sum(F.octet_length("rules") + F.octet_length("host")), F.lit(0))).first()[0]
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", "_host", "_rules")]
    with_host = pages.select(*[F.col(f"`{f.name}`") for f in kept], host(F.col("url")).alias("_host"))
    known = known.select(F.col("host").alias("_host"), F.col("rules").alias("_rules"))
    joined = with_host.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "_host", "left").drop("_host")
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Rules] = {}
        for batch in batches:
            texts = []
            for page, packed in zip(batch["html"], batch["_rules"], strict=True):
                told = None
                if isinstance(packed, str):
                    if packed not in ready:
                        if len(ready) >= HELD:
                            ready.clear()
                        ready[packed] = Rules(json.loads(packed))
                    told = ready[packed]
                texts.append(main_text(page if isinstance(page, str) else None, told))
            out = batch[names].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    return joined.mapInPandas(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_wrappers: the main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
