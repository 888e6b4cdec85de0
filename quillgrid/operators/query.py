"""Query understanding on the driver: tokens, profile, translations and reformulations of one query.

These are small lists that become literals of a plan; the text rules are those of functions.text.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame

#: Words that say nothing of a topic, and words that name a source rather than a topic.
IDENTITY = frozenset("전람회 과학전람회 전국과학전람회 학생과학전람회 학생부전람회 발명품경진대회 science fair sciencefair rne 알앤이 한화 한화사이언스챌린지 사이언스 챌린지 hanwha challenge sciencechallenge".split())
STOPWORDS = IDENTITY | frozenset("연구 분석 시스템 모델 기반 설계 예측 요약 문서 검색 자료 평가 결과 analysis research system model based design prediction summary document search data evaluation results".split())
#: Single words too general to search for alone.
GENERIC = frozenset("cell cells learning model models system systems sensor sensors policy graph memory agent agents health medical bio adsorption membrane stability catalyst carbon hydrogen recycling water treatment prediction design paper article".split())
#: Sources by reach, and those of student research.
GLOBAL_SOURCES = ("semantic_scholar", "arxiv", "biorxiv", "medrxiv", "pubmed", "cve", "blackhat", "defcon")
DOMESTIC_SOURCES = ("riss", "kci", "scienceon", "dbpia", "kiss", "nanet", "ntis", "kipris", "rne_report", "science_fair", "student_invention_fair", "hanwha_science_challenge")
STUDENT_SOURCES = ("science_fair", "student_invention_fair", "hanwha_science_challenge", "rne_report")
#: Words that hint at a document type or a domain.
TYPE_HINTS = {
    "patent": ("patent", "특허", "kipris", "실용신안"),
    "report": ("report", "보고서", "ntis", "과제", "성과", "rne", "알앤이"),
    "fair_entry": ("science fair", "science challenge", "student invention", "발명", "전람회", "사이언스 챌린지", "sciencechallenge", "rne", "알앤이", "과학전람회", "발명품경진대회"),
}
DOMAIN_HINTS = {
    "humanities": ("문학", "역사", "철학", "예술", "미술", "연극", "humanities", "archaeology"),
    "education": ("교육", "학습", "수학 불안", "국어 교육", "pedagogy", "education"),
    "biomedical": ("bio", "biorxiv", "medrxiv", "pubmed", "의료", "의학", "생명과학", "유전자", "면역", "임플란트", "medical", "genetic", "immun", "clinical"),
    "engineering": ("반도체", "배터리", "드론", "센서", "로봇", "semiconductor", "battery", "drone", "robot", "sensor"),
    "earth_space": ("기후", "산불", "우주", "위성", "홍수", "지진", "climate", "wildfire", "space", "satellite", "flood", "earthquake"),
    "security": ("security", "cyber", "cve", "취약점", "보안", "해킹", "익스플로잇", "exploit", "malware", "랜섬웨어", "def con", "black hat", "reverse engineering"),
}
#: Sources that a domain suggests, in order.
DOMAIN_SOURCES = {
    "humanities": ("riss", "kci", "dbpia", "kiss", "nanet"),
    "education": ("riss", "kci", "dbpia", "kiss", "nanet"),
    "biomedical": ("pubmed", "biorxiv", "medrxiv", "scienceon", "semantic_scholar", "riss"),
    "engineering": ("arxiv", "semantic_scholar", "kci", "dbpia", "kipris"),
    "earth_space": ("semantic_scholar", "arxiv", "scienceon", "ntis"),
    "security": ("cve", "blackhat", "defcon"),
}


def unique(items: Iterable[str]) -> list[str]:
    return [x for x in dict.fromkeys(items) if x]


def normalize(text: str) -> str:
    kept = "".join(c if c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKC", text).lower())
    return " ".join(kept.split())


def tokenize(text: str) -> list[str]:
    return [t for t in normalize(text).split(" ") if len(t) >= 2]


def windows(tokens: list[str]) -> list[str]:
    """Distinct runs of two and three of the distinct tokens."""
    own = unique(tokens)
    return unique(" ".join(own[i : i + n]) for n in (2, 3) for i in range(len(own) - n + 1))


def hangul_chunks(text: str) -> list[str]:
    compact = normalize(text).replace(" ", "")
    if not re.fullmatch("[가-힣]{4,}", compact):
        return []
    return [compact[i : i + n] for n in (2, 3) for i in range(len(compact) - n + 1)]


class Lexicon:
    """Groups of terms that mean the same across languages. A term in two groups belongs to the later one.

    Terms inside a text are found by an automaton over all of them, in one pass over the text. A lexicon goes to every task that uses it;
    MOST bounds its terms (features.expand_terms joins larger ones).
    """

    MOST = 1_000_000

    def __init__(self, groups: Iterable[Iterable[str]], blocked: Iterable[str] = ()):
        self.groups = [[normalize(t) for t in g] for g in groups]
        self.blocked = frozenset(blocked)
        self.group_of: dict[str, list[str]] = {t: g for g in self.groups for t in g if t}
        self.place = {t: k for k, t in enumerate(self.group_of)}
        self.joined = "\n".join(self.place)
        self._found: ahocorasick.Automaton | None = None
        if len(self.place) > self.MOST:
            raise ValueError(f"{len(self.place)} terms are too many for a lexicon that is sent to tasks")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    @staticmethod
    def of(table: DataFrame) -> Lexicon:
        """From a table (group, term, and perhaps blocked), groups and their terms in order. At most MOST + 1 rows reach the driver."""
        rows = table.orderBy("group", "term").limit(Lexicon.MOST + 1).collect()
        groups: dict = {}
        for r in rows:
            groups.setdefault(r["group"], []).append(r["term"] or "")
        return Lexicon(groups.values(), [normalize(r["term"]) for r in rows if "blocked" in table.columns and r["blocked"]])

    @property
    def digest(self) -> str:
        """Equal for equal lexicons."""
        return hashlib.md5(repr((self.groups, sorted(self.blocked))).encode()).hexdigest()

    def _inside(self, value: str) -> set[str]:
        """Terms that a text holds."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for t in self.place:
                self._found.add_word(t, t)
            self._found.make_automaton()
        return {t for _, t in self._found.iter(value)} if self.place else set()

    def expand(self, values: Iterable[str]) -> list[str]:
        """The normalised values, each followed by the groups of terms that it is, holds or is held by."""
        return self.expand_normal(map(normalize, values))

    def expand_normal(self, values: Iterable[str]) -> list[str]:
        """The same of values that are normalised already."""
        def expandable(term: str, least: int) -> bool:
            return term not in self.blocked and (" " in term or (re.search("[가-힣]", term) is not None and len(term) >= 2) or len(term) >= least)

        values = [v for v in values if v]
        text = "\n".join(values)
        ko = re.search("[가-힣]", text) is not None
        # Most texts touch no term at all.
        if not self._inside(text) and not any(v in self.joined for v in values if ko or len(v) >= 10 or " " in v):
            return unique(values)
        out: list[str] = []
        for value in values:
            if value:
                out.append(value)
                terms = {t for t in self._inside(value) if t == value or expandable(t, 4)}
                if value in self.joined and expandable(value, 10):
                    terms |= {t for t in self.place if value in t}
                for t in sorted(terms, key=self.place.__getitem__):
                    out += self.group_of[t]
        return unique(out)

    def translations(self, query: str, script: str, most: int = 6) -> list[str]:
        """Terms in another script ("ko" or "en") of the groups that a query touches: whole phrases first, then by place in the query."""
        text, words = normalize(query), set(tokenize(query))
        pattern, found = ("[가-힣]" if script == "ko" else "[a-z]"), {}
        for group in self.groups:
            hit = [t for t in group if (" " in t and t in text) or t in words]
            if hit:
                phrase = any(" " in t for t in hit)
                place = min(text.find(t) for t in hit)
                for t in group:
                    if re.search(pattern, t) and t not in GENERIC and t not in hit:
                        found[t] = max(found.get(t, 0), 100 * (" " in t) + 25 * any(" " in x for x in group) + 80 * phrase + max(0, 200 - place) + len(t))
        return sorted(found, key=lambda t: (-found[t], t))[:most]


#: A small lexicon of our own, to be replaced by a deployment's.
LEXICON = Lexicon(
    [
        ("배터리", "이차전지", "battery", "secondary battery"),
        ("기후 변화", "기후변화", "climate change"),
        ("반도체", "semiconductor"),
        ("기계 학습", "기계학습", "machine learning"),
        ("면역", "immunity", "immune response"),
        ("산불", "wildfire", "forest fire"),
        ("취약점", "vulnerability"),
        ("위성", "satellite"),
    ]
)


@dataclass
class Profile:
    """What a query asks for."""

    language: str
    types: list[str]
    domains: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)


def language_of(text: str) -> str:
    ko, en = re.search("[가-힣]", text), re.search("[A-Za-z]", text)
    return "none" if not text.strip() else "mixed" if ko and en else "ko" if ko else "en" if en else "other"


def profile(query: str) -> Profile:
    normal = normalize(query)
    joined, compact = " ".join([normal, *unique(tokenize(query))]), normal.replace(" ", "")
    has = lambda hints: any(normalize(h) in joined for h in hints)
    rne = bool(re.search(r"\br\s*&\s*e\b|\brne\b", query, re.I)) or "알앤이" in compact
    types = [t for t, hints in TYPE_HINTS.items() if has(hints) or (rne and t != "patent")] or ["paper"]
    domains = [d for d, hints in DOMAIN_HINTS.items() if has(hints)]
    sources: list[str] = ["kipris"] if "patent" in types else []
    if "report" in types:
        sources += ["rne_report", "ntis"] if rne else ["ntis", "rne_report"]
    if "fair_entry" in types:
        named = {
            "science_fair": re.search(r"science\s*fair", query, re.I) or "전람회" in normal,
            "student_invention_fair": re.search(r"student\s+invention", query, re.I) or "학생발명" in compact or "발명품" in normal,
            "hanwha_science_challenge": re.search(r"science\s*challenge|hanwha", query, re.I) or "사이언스챌린지" in compact,
            "rne_report": rne,
        }
        sources += [s for s, hit in named.items() if hit] or list(named)
    for d in domains:
        sources += DOMAIN_SOURCES[d]
    return Profile(language_of(query), types, domains, unique(sources))


@dataclass
class Query:
    """A query with everything the scorer needs as literals."""

    text: str
    tokens: list[str]
    terms: list[str]
    profile: Profile
    translations: list[str] = field(default_factory=list)

    @staticmethod
    def of(text: str, lexicon: Lexicon = LEXICON, translate: bool = True) -> Query:
        """terms: distinct words; tokens: with windows, expansions, translations and Hangul chunks."""
        language = language_of(text)
        target = {"ko": "en", "en": "ko"}.get(language)
        translated = lexicon.translations(text, target) if translate and target else []
        base = unique(tokenize(text))
        expanded = lexicon.expand([text, *base])
        tokens = unique(normalize(t) for t in [*base, *windows(base), *expanded, *(x for v in translated for x in [v, *tokenize(v)]), *hangul_chunks(text)])
        return Query(text, [t for t in tokens if len(t) >= 2], base, profile(text), translated)

    @property
    def informative(self) -> list[str]:
        return [t for t in self.terms if t not in STOPWORDS]

    @property
    def compound(self) -> bool:
        return len(self.terms) >= 3 or (len(self.terms) >= 2 and len("".join(self.terms)) >= 4) or any(len(t) >= 5 for t in self.terms)


def token_weight(token: str) -> float:
    """1, more for phrases and for long tokens; little if all its words name sources, less if all are stop words."""
    words = token.split(" ")
    weight = 1 + 0.45 * (" " in token) + 0.25 * (len(token.replace(" ", "")) >= 8)
    if all(w in IDENTITY for w in words):
        return weight * 0.08
    return weight * 0.35 if all(w in STOPWORDS for w in words) else weight


def reformulations(query: Query, lexicon: Lexicon = LEXICON) -> list[str]:
    """Queries to try, in order, if a query finds nothing: compact, informative words, their runs, the first and the longest, translations, then lexicon phrases and single words."""
    normal, words = normalize(query.text), query.informative
    runs = windows(words)
    anchors = sum(len(lexicon.expand([t])) > 1 for t in unique([*words, *runs]))
    semantic = lexicon.expand([normal, *words, *runs]) if query.translations or len(words) <= 1 or anchors >= min(2, len(words)) else []
    semantic = [t for t in semantic if t != normal]
    longest = sorted(words, key=len, reverse=True)[:4]
    out = [
        normal, normal.replace(" ", ""), " ".join(words), *runs, " ".join(words[:2]), " ".join(words[:3]), " ".join(longest), *query.translations,
        *windows([t for v in query.translations for t in tokenize(v)]), *(t for t in semantic if " " in t), *(t for t in semantic if " " not in t and t not in GENERIC),
    ]
    if len(words) >= 3:
        out += [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
    # The query itself is no reformulation; only its exact normal and compact form is left out.
    return [v for v in unique(x.strip() for x in out) if normalize(v) != normal or normalize(v).replace(" ", "") != normal.replace(" ", "")]


def relaxed_terms(query: Query, lexicon: Lexicon = LEXICON) -> list[str]:
    """Terms of which one is enough in the relaxed search."""
    base = [*reformulations(query, lexicon)[:12], *query.translations, query.text]
    return [t for t in unique(normalize(x) for x in lexicon.expand([y for b in base for y in [b, *tokenize(b)]])) if len(t) >= 3 and t not in STOPWORDS]


def rank_sources(sources: Mapping[str, str], asked: Profile) -> list[str]:
    """Source keys by fit to a profile: hinted ones first, then by reach for the language; equal ones stay in order. sources: key to type."""

    def fit(key: str) -> float:
        hint = asked.sources.index(key) if key in asked.sources else math.inf
        reach = (asked.language == "ko" and key in DOMESTIC_SOURCES) or (asked.language == "en" and key in GLOBAL_SOURCES)
        return (40 - hint if hint < math.inf else 0) + 10 * reach

    return sorted(sources, key=lambda k: -fit(k))


def split_sources(keys: Iterable[str], direction: str) -> tuple[list[str], list[str]]:
    """Sources to search with the query as it is, and with its translation."""
    keys = list(keys)
    foreign = {"ko-to-en": GLOBAL_SOURCES, "en-to-ko": DOMESTIC_SOURCES, "other-to-en": GLOBAL_SOURCES}.get(direction, ())
    return [k for k in keys if k not in foreign], [k for k in keys if k in foreign]


def coerce_bool(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def coerce_list(value: str | None) -> list[str]:
    return unique(x.strip() for x in (value or "").split(","))
