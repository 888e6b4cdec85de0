"""Text functions as Column -> Column, inside whole-stage or interpreted JVM evaluation but for two.

char_ngrams_digest() is an Arrow UDF, as it makes 15 characters of each. Spark has no NFKC; nfkc() is an Arrow UDF for sources that need it, and everything here
takes text that is in that form already. Lengths are code points.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HANGUL, LATIN = "[가-힣]", "[A-Za-z]"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case; what is no letter, digit or space becomes a space; runs of space become one; trimmed."""
    kept = F.regexp_replace(F.lower(blank(c)), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def tokenize(c: Column) -> Column:
    """Normalised words of two characters or more."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: F.length(t) >= 2)


def unique_tokens(c: Column) -> Column:
    """Tokens by first occurrence."""
    return F.array_distinct(tokenize(c))


def compact_text(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def ngrams(tokens: Column, size: int, glue: str = " ") -> Column:
    """Runs of size neighbours, repeats kept; empty if there are fewer.

    Shifted slices are zipped, so that no lambda refers to tokens, which would be evaluated again for each element.
    """
    n = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), n)
    for k in range(1, size):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), n), lambda a, b: F.concat(a, F.lit(glue), b))
    return out


def adjacent_ngrams(tokens: Column) -> Column:
    return F.concat(ngrams(tokens, 2), ngrams(tokens, 3))


def token_windows(tokens: Column) -> Column:
    """Distinct runs of two, then three, of the distinct tokens."""
    return F.array_distinct(adjacent_ngrams(F.array_distinct(tokens)))


def joined_char_ngrams(compact: str) -> bytes:
    """char_ngrams() of a compact text as UTF-8 with bars between them: characters are numbers, and a size's runs are the rows of a matrix."""
    plain = compact.isascii()
    chars = np.frombuffer(compact.encode("ascii" if plain else "utf-32-le"), np.uint8 if plain else np.uint32)
    rows = []
    for size in (2, 3, 4) if not plain and re.search(HANGUL, compact) else (3, 4, 5):
        if len(chars) >= size:
            runs = np.full((len(chars) - size + 1, size + 1), ord("|"), chars.dtype)
            runs[:, :size] = np.lib.stride_tricks.sliding_window_view(chars, size)
            rows.append(runs.ravel())
    out = np.concatenate(rows)[:-1].tobytes() if rows else b""
    return out if plain else out.decode("utf-32-le").encode()


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("grams_md5", T.StringType())]))
def char_ngrams_digest(compact: pd.Series) -> pd.DataFrame:
    """Number of a compact text's char_ngrams(), and the hash of them joined by bars."""
    joined = (joined_char_ngrams(c) for c in compact)
    return pd.DataFrame([(j.count(b"|") + 1 if j else 0, hashlib.md5(j).hexdigest()) for j in joined], columns=["n", "grams_md5"])


def char_ngrams(c: Column) -> Column:
    """Character n-grams of the compact text: 2 to 4 if it holds Hangul, else 3 to 5. A size's runs come by one regular expression that looks ahead, so nothing is done element by element."""
    compact = compact_text(c)
    n = F.length(compact)
    # What follows the last run is too short for one: size - 1 characters, and the bar before them.
    runs = lambda size: F.when(n >= size, F.substring(F.regexp_replace(compact, f".(?=(.{{{size - 1}}}))", "$0$1|"), F.lit(1), (n - size + 1) * (size + 1) - 1))
    joined = F.when(compact.rlike(HANGUL), F.concat_ws("|", *map(runs, (2, 3, 4)))).otherwise(F.concat_ws("|", *map(runs, (3, 4, 5))))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "[|]"))


def hangul_chunks(c: Column) -> Column:
    """All runs of 2 and 3 characters of a text that is four Hangul characters or more."""
    compact = compact_text(c)
    chars = F.split(compact, "")
    return F.when(compact.rlike("^[가-힣]{4,}$"), F.concat(ngrams(chars, 2, ""), ngrams(chars, 3, ""))).otherwise(F.array().cast("array<string>"))


def detect_language(c: Column) -> Column:
    """none, ko, en, mixed or other, by script."""
    ko, en = blank(c).rlike(HANGUL), blank(c).rlike(LATIN)
    return F.when(F.trim(blank(c)) == "", "none").when(ko & en, "mixed").when(ko, "ko").when(en, "en").otherwise("other")


def detect_script_language(c: Column) -> Column:
    """As detect_language, with ja, zh, ru and ar; mixed before ko before ja before zh before en."""
    has = lambda p: blank(c).rlike(p)
    ko, en = has(HANGUL), has(LATIN)
    return (
        F.when(F.trim(blank(c)) == "", "none").when(ko & en, "mixed").when(ko, "ko").when(has("[぀-ヿ]"), "ja")
        .when(has("[一-鿿]"), "zh").when(en, "en").when(has("[Ѐ-ӿ]"), "ru").when(has("[؀-ۿ]"), "ar").otherwise("other")
    )


def decode_entities(c: Column) -> Column:
    """Six character references, the ampersand's first."""
    out = blank(c)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def strip_tags(c: Column) -> Column:
    """Text without CDATA marks and tags, references decoded before and after, space collapsed."""
    out = F.replace(F.replace(blank(c), F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    out = F.regexp_replace(decode_entities(decode_entities(out)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(out), r"\s+", " "))


def text_between(c: Column, start: str, end: str) -> Column:
    """What follows the first start, up to the next end or, without one, to the end; empty without start."""
    at = F.locate(start, blank(c))
    rest = F.substr(blank(c), at + len(start))
    stop = F.locate(end, rest)
    return F.when(at == 0, "").when(stop == 0, rest).otherwise(F.substr(rest, F.lit(1), stop - 1))


def normalize_authors(c: Column) -> Column:
    """Names of a list in one text."""
    parts = F.transform(F.split(blank(c), r"(?i)[,;·]| and "), strip_tags)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def safe_year(c: Column) -> Column:
    """The first year from 1900 to 2099, or null."""
    return F.nullif(F.regexp_extract(blank(c), r"(?:19|20)\d{2}", 0), F.lit("")).try_cast("int")


def truncate_text(c: Column, size: int = 320) -> Column:
    """Stripped text; beyond size, its first size - 3 characters and dots."""
    text = strip_tags(c)
    return F.when(F.length(text) > size, F.concat(F.substr(text, F.lit(1), F.lit(size - 3)), F.lit("..."))).otherwise(text)


def summarize(summary: Column, abstract: Column) -> Column:
    return F.when(F.trim(blank(summary)) != "", summary).otherwise(truncate_text(abstract, 180))


def keyword_bag(c: Column, most: int = 8) -> Column:
    return F.slice(unique_tokens(c), 1, most)


def has_broken_encoding(c: Column) -> Column:
    return blank(c).contains("�")


#: Patterns of page furniture and code, of signs that prose lacks, and of pieces of code.
NOISE_WORDS = r"(?i)engjungsung|engjongsung|input text|현재 페이지|function\s*\(|document\.|window\.|var\s+|const\s+|return\s+"
NOISE_SIGNS = r"[{}\[\];<>]|==|=>|\+\s*\d"
CODE_PIECES = r"[A-Za-z_]+\([^)]*\)|[A-Za-z_]+\.[A-Za-z_]+|</?[A-Za-z]+>"


def looks_like_noise(c: Column) -> Column:
    """Empty, or with a noise word or sign, six operators, or three pieces of code."""
    text = F.trim(blank(c))
    operators = F.length(text) - F.length(F.translate(text, "=+_*\\/", ""))
    return (text == "") | text.rlike(NOISE_WORDS) | text.rlike(NOISE_SIGNS) | (operators >= 6) | (F.regexp_count(text, F.lit(CODE_PIECES)) >= 3)


def hits(tokens: Column, normal: Column) -> Column:
    """Tokens that a normalised text contains, as substrings."""
    return F.filter(tokens, lambda t: F.contains(normal, t))


def coverage(tokens: Column, normal: Column) -> Column:
    """Share of tokens that a normalised text contains; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(hits(tokens, normal)) / F.size(tokens)).otherwise(F.lit(0.0))


def matches_query(c: Column, query: Column) -> Column:
    """The query as a substring, its compact form, or at least half of its words."""
    normal = normalize_text(c)
    return matches_normal(normal, F.replace(normal, F.lit(" "), F.lit("")), query)


def matches_normal(normal: Column, compact: Column, query: Column) -> Column:
    """matches_query() of a text given in normal form and compact."""
    wanted = normalize_text(query)
    words = F.filter(F.split(wanted, " "), lambda t: t != "")
    enough = F.size(hits(words, normal)) >= F.greatest(F.lit(1), F.ceil(F.size(words) / 2))
    return (wanted == "") | F.contains(normal, wanted) | F.contains(compact, F.replace(wanted, F.lit(" "), F.lit(""))) | enough


def is_usable(c: Column, query: Column) -> Column:
    return ~has_broken_encoding(c) & ~looks_like_noise(c) & matches_query(c, query)


#: Words of a title that name its venue, not its subject.
VENUE_WORDS = r"\b(?:arxiv|preprint|open access|poster|conference|학위논문|연구보고서)\b"


def title_key(title: Column, other: Column | None = None) -> Column:
    """A title's compact form without venue words; the other title's if that is empty."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(normalize_text(c), VENUE_WORDS, " "), r"\s+", "")
    own = clean(title)
    return own if other is None else F.when(own != "", own).otherwise(clean(other))


def author_key(authors: Column) -> Column:
    """The first three distinct normalised names."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), normalize_text), lambda a: a != ""))
    return F.array_join(F.slice(names, 1, 3), "|")


def slug(c: Column, most: int | None = None) -> Column:
    """Letters and digits in lower case, all else as single hyphens."""
    out = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.substr(out, F.lit(1), F.lit(most)) if most else out


def canonical_id(kind: Column, *ids: Column) -> Column:
    """kind: and the slug of the first id there is; an id that starts with its kind stays."""
    first = F.coalesce(*[F.nullif(F.trim(i), F.lit("")) for i in ids], F.lit(""))
    return F.when(F.startswith(first, F.concat(kind, F.lit(":"))), first).otherwise(F.concat(kind, F.lit(":"), slug(first)))


def organization_key(c: Column) -> Column:
    return F.array_join(F.slice(unique_tokens(c), 1, 3), ":")


def author_identity(author: Column, organization: Column) -> Column:
    return F.concat(normalize_text(author), F.lit("::"), organization_key(organization))


def query_variants(c: Column) -> Column:
    """A query as it is, normalised, compact, and its neighbouring pairs."""
    base = F.array(F.trim(blank(c)), normalize_text(c), compact_text(c))
    return F.array_distinct(F.filter(F.concat(base, ngrams(F.filter(F.split(normalize_text(c), " "), lambda t: t != ""), 2)), lambda v: v != ""))


def text_bundle(title: Column, english: Column, abstract: Column, *rest: Column) -> Column:
    """Fields as one text, titles and abstract twice; nulls and blanks are skipped."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, title, english, english, abstract, abstract, *rest)])
