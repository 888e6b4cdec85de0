"""Document files to text: PDF, DOCX, HWPX, HWP and plain text, by extension, in an Arrow UDF over binaryFile rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, text string, method string, confidence int, structured boolean, warnings array<string>"
#: How far each way of extraction is trusted.
CONFIDENCE = {"pdf-streams": 56, "pdf-raw": 28, "docx": 88, "hwpx": 86, "hwp-decoded": 48, "hwp-chunks": 42, "utf8": 100, "none": 0}
ENCODINGS = ("utf-8", "utf-16-le", "cp949", "euc-kr", "latin-1", "utf-16-be")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|<[0-9A-Fa-f\s]+>\s*Tj|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|[^\]])*\]\s*TJ", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>", re.S)


def _pdf_string(m: re.Match) -> str:
    if m[2] is not None:
        raw = bytes.fromhex(re.sub(r"\s", "", m[2].decode()).ljust(2, "0")[: len(re.sub(rb"\s", b"", m[2])) // 2 * 2])
        return raw.decode("utf-16-be", "ignore") if raw[:1] == b"\0" else raw.decode("latin-1")
    text = m[1].decode("latin-1")
    text = re.sub(r"\\([0-7]{1,3})", lambda o: chr(int(o[1], 8) & 255), text)
    return re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text, flags=re.S)


def _shown(stream: bytes) -> str:
    """Strings that a content stream shows, an operator a line."""
    return "\n".join("".join(map(_pdf_string, _STRING.finditer(m[0]))) for m in _SHOWN.finditer(stream))


def read_pdf(data: bytes) -> tuple[str, str]:
    """Text of inflated content streams, else of raw strings; with the method."""
    parts = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        raw = m[1]
        for window in (15, -15):
            try:
                raw = zlib.decompressobj(window).decompress(m[1])
                break
            except zlib.error:
                continue
        parts.append(_shown(raw))
    text = "\n".join(p for p in parts if p.strip())
    if text.strip():
        return text, "pdf-streams"
    raw = " ".join(_pdf_string(m) for m in re.finditer(rb"\(((?:\\.|[^\\()]){2,})\)(|)", data))
    return (raw, "pdf-raw") if raw.strip() else ("", "none")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _lines(root: ElementTree.Element, mark_tables: bool) -> list[str]:
    """Paragraphs, and table rows with cells between bars."""
    out: list[str] = []

    def words(e: ElementTree.Element) -> str:
        return "".join(x.text or "" for x in e.iter() if _local(x) == "t").strip()

    def walk(e: ElementTree.Element) -> None:
        for child in e:
            if _local(child) == "tbl":
                if mark_tables:
                    out.append("[TABLE]")
                for row in (x for x in child.iter() if _local(x) == "tr"):
                    cells = [words(c) for c in row if _local(c) == "tc"]
                    out.append(" | ".join(c for c in cells if c))
            elif _local(child) == "p" and not any(_local(x) == "tbl" for x in child.iter()):
                out.append(words(child))
            else:
                walk(child)

    walk(root)
    return [x for x in out if x]


def read_docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(_lines(ElementTree.fromstring(z.read("word/document.xml")), False))


def read_hwpx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.search(r"(?i)section\d*\.xml$", n))
        return "\n".join(line for n in names for line in _lines(ElementTree.fromstring(z.read(n)), True))


def read_hwp(data: bytes) -> tuple[str, str]:
    """The best of several decodings by length and Hangul, or printable chunks if these are longer."""

    def clean(text: str) -> str:
        return " ".join(re.sub(r"[^\w\s가-힣.,;:!?()\[\]'\"%-]", " ", text).split())

    decoded = max((clean(data.decode(e, "ignore")) for e in ENCODINGS), key=lambda t: len(t) + 4 * len(re.findall("[가-힣]", t)))
    chunks = " ".join(re.findall(r"[가-힣A-Za-z0-9 .,]{4,}", data.decode("utf-8", "ignore")))
    return (chunks, "hwp-chunks") if len(chunks) > len(decoded) else (decoded, "hwp-decoded") if decoded else ("", "none")


def read(path: str, data: bytes | None) -> tuple[str, str, list[str]]:
    """(text, method, warnings) of one file; a file that can't be read gives no text and says why."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if not data:
            return "", "none", ["empty-file"]
        if kind == "pdf":
            text, method = read_pdf(data)
            return text.strip(), method, [] if len(text.strip()) >= 80 else ["short-text", "ocr-unavailable"]
        if kind == "docx":
            return read_docx(data), "docx", []
        if kind == "hwpx":
            return read_hwpx(data), "hwpx", []
        if kind == "hwp":
            return *read_hwp(data), ["binary-format"]
        return data.decode("utf-8", "replace").strip(), "utf8", []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as error:
        return "", "none", [type(error).__name__]


def extract(files: DataFrame) -> DataFrame:
    """SCHEMA of files (path, content), as spark.read.format("binaryFile") gives them. A few files at a time are in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *read(p, c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            out = [(p, t, m, CONFIDENCE[m], m in ("docx", "hwpx", "pdf-streams"), w) for p, t, m, w in rows]
            yield pd.DataFrame(out, columns=["path", "text", "method", "confidence", "structured", "warnings"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
