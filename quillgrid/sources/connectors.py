"""Payloads of live sources as documents.

A connector is a table row: how a payload splits into records, and the expression of each
field of a record. Fetching is left to the caller, who hands over (source, query, payload)
rows; a payload that does not parse gives no documents and is counted in statuses().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as tx

LIMIT = 8
Field = Callable[[Column], Column]


def first(pattern: str, group: int = 1) -> Field:
    """The first match, stripped of tags."""
    return lambda r: tx.strip_tags(F.regexp_extract(r, pattern, group))


def every(pattern: str) -> Field:
    return lambda r: F.transform(F.regexp_extract_all(r, F.lit(pattern), F.lit(1)), tx.strip_tags)


def tag(name: str) -> Field:
    """The text of the first element of a name."""
    return first(rf"(?s)<{name}\b[^>]*>(.*?)</{name}>")


def at(path: str) -> Field:
    return lambda r: F.coalesce(F.get_json_object(r, path), F.lit(""))


def link(template: str, part: Field) -> Field:
    """A link with a part of the record in place of {}; empty without the part."""
    return lambda r: F.when(part(r) != "", F.format_string(template.replace("%", "%%").replace("{}", "%s"), part(r))).otherwise("")


def constant(value: str) -> Field:
    return lambda r: F.lit(value)


@dataclass(frozen=True)
class Connector:
    """type api or crawl; records: a pattern whose matches are records, or a JSON path to an array."""

    kind: str
    reach: str
    records: str
    fields: dict[str, Field]
    document_type: Field = field(default=constant("paper"))
    needs_match: bool = False


def _json(path: str, fields: dict[str, str], reach: str = "global", kind: str = "paper", detail: Field | None = None) -> Connector:
    parts: dict[str, Field] = {n: at(p) for n, p in fields.items()}
    return Connector("api", reach, path, parts | ({"detail": detail} if detail else {}), constant(kind))


def _anchors(href: str, detail: str, reach: str, kind: str | Field = "paper", extra: dict[str, Field] | None = None) -> Connector:
    """Anchors whose link matches href (group 1: the key), with what follows each up to the next anchor."""
    record = rf'(?s)(<a[^>]*href="[^"]*{href}[^"]*"[^>]*>.*?</a>(?:(?!<a\b).){{0,1200}})'
    key = first(rf'href="[^"]*{href}', 1)
    body = first(r"(?s)</a>(.*)$")
    parts = {"key": key, "title": first(r"(?s)<a[^>]*>(.*?)</a>"), "abstract": body, "detail": link(detail, key), "year": body}
    return Connector("crawl", reach, record, parts | (extra or {}), constant(kind) if isinstance(kind, str) else kind, True)


_DOI = r"(10\.\d{4,9}/[^\s\"<&]+)"
_PREPRINT = Connector(
    "crawl", "global", r'(?s)(<div class="highwire-cite"(?:(?!<div class="highwire-cite").)*)',
    {
        "key": first(r"/content/(10\.1101/[^\"<\s]+)"), "doi": first(r"/content/(10\.1101/[^\"<\s]+)"), "title": first(r'(?s)class="highwire-cite-title"[^>]*>(.*?)</span>'),
        "authors": first(r'(?s)class="highwire-cite-authors"[^>]*>(.*?)</span>'), "abstract": first(r'(?s)class="highwire-cite-snippet"[^>]*>(.*?)</div>'),
        "year": first(r'(?s)class="highwire-cite-metadata"[^>]*>(.*?)</div>'), "detail": link("https://www.biorxiv.org/content/{}", first(r"/content/(10\.1101/[^\"<\s]+)")),
    },
    needs_match=True,
)
_MED = Connector(_PREPRINT.kind, _PREPRINT.reach, _PREPRINT.records, _PREPRINT.fields | {"detail": link("https://www.medrxiv.org/content/{}", first(r"/content/(10\.1101/[^\"<\s]+)"))}, needs_match=True)
_THESIS: Field = lambda r: F.when(tx.strip_tags(r).rlike("학위논문|박사|석사"), "thesis").otherwise("paper")
_FAIR = Connector(
    "crawl", "domestic", r"(?s)(<tbody[^>]*onclick=\"fn_moveBbsNttDetail\('\d+'.*?</tbody>)",
    {
        "key": first(r"fn_moveBbsNttDetail\('(\d+)'"), "year": first(r"<td>((?:19|20)\d{2})</td>"), "keywords": first(r"(?s)<td>(?:19|20)\d{2}</td>\s*<td>(.*?)</td>"),
        "title": first(r"(?s)<td>(?:19|20)\d{2}</td>\s*<td>.*?</td>\s*<td>(.*?)</td>"), "abstract": first(r"(?s)<td>([^<]*)</td>\s*</tr>"),
        "detail": link("https://www.science.go.kr/mps/1079/bbs/423/moveBbsNttDetail.do?nttSn={}", first(r"fn_moveBbsNttDetail\('(\d+)'")),
    },
    constant("fair_entry"), True,
)

#: The connectors, by source key.
REGISTRY: dict[str, Connector] = {
    "semantic_scholar": _json("$.data[*]", {"key": "$.paperId", "title": "$.title", "abstract": "$.abstract", "year": "$.year", "citations": "$.citationCount", "doi": "$.externalIds.DOI", "detail": "$.url"}),
    "arxiv": Connector("api", "global", r"(?s)<entry>(.*?)</entry>", {"key": tag("id"), "title": tag("title"), "abstract": tag("summary"), "year": tag("published"), "detail": tag("id"), "authors": lambda r: F.array_join(every(r"<name>(.*?)</name>")(r), ",")}),
    "biorxiv": _PREPRINT,
    "medrxiv": _MED,
    "pubmed": Connector(
        "api", "global", r"(?s)<PubmedArticle>(.*?)</PubmedArticle>",
        {
            "key": tag("PMID"), "title": tag("ArticleTitle"), "abstract": lambda r: F.array_join(every(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>")(r), " "), "year": first(r"<Year>(\d{4})</Year>"),
            "doi": first(r'<ArticleId IdType="doi">(.*?)</ArticleId>'), "organization": first(r"(?s)<Journal>.*?<Title>(.*?)</Title>"), "detail": link("https://pubmed.ncbi.nlm.nih.gov/{}/", tag("PMID")),
            "authors": lambda r: F.array_join(
                F.concat(
                    F.zip_with(F.regexp_extract_all(r, F.lit(r"<ForeName>(.*?)</ForeName>"), F.lit(1)), F.regexp_extract_all(r, F.lit(r"<LastName>(.*?)</LastName>"), F.lit(1)), lambda a, b: F.concat_ws(" ", a, b)),
                    F.regexp_extract_all(r, F.lit(r"<CollectiveName>(.*?)</CollectiveName>"), F.lit(1)),
                ),
                ",",
            ),
        },
    ),
    "riss": _anchors(r"p_mat_type=([^&\"]+&(?:amp;)?control_no=[^\"&]+)", "https://www.riss.kr/search/detail/DetailView.do?p_mat_type={}", "domestic", _THESIS),
    "kci": _anchors(r"arti_id=(ART\d+)", "https://www.kci.go.kr/kciportal/landing/article.kci?arti_id={}", "domestic", extra={"authors": first(r"author=\{(.*?)\}"), "doi": first(r"doi=\{(.*?)\}"), "year": first(r"year=\{(\d{4})\}"), "organization": first(r"journal=\{(.*?)\}")}),
    "scienceon": _anchors(r"cn=([A-Z0-9]+)", "https://scienceon.kisti.re.kr/srch/selectPORSrchArticle.do?cn={}", "domestic"),
    "dbpia": _json("$.collection[*]", {"key": "$.node_id", "title": "$.title", "abstract": "$.abstract", "year": "$.year", "authors": "$.author", "organization": "$.publisher"}, "domestic", detail=link("https://www.dbpia.co.kr/journal/articleDetail?nodeId={}", at("$.node_id"))),
    "kiss": _anchors(r"/Detail/Ar\?key=(\d+)", "https://kiss.kstudy.com/Detail/Ar?key={}", "domestic", extra={"doi": first(r"DOI\s*" + _DOI)}),
    "nanet": _anchors(r"/detail/([A-Z0-9]+)", "https://dl.nanet.go.kr/detail/{}", "domestic", _THESIS),
    "ntis": _anchors(r"pjtId=(\d+)", "https://www.ntis.go.kr/project/pjtInfo.do?pjtId={}", "domestic", "report"),
    "kipris": Connector("api", "domestic", r"(?s)<item>(.*?)</item>", {"key": tag("applicationNumber"), "title": tag("inventionTitle"), "abstract": tag("astrtCont"), "year": tag("applicationDate"), "organization": tag("applicantName"), "detail": link("https://www.kipris.or.kr/?an={}", tag("applicationNumber"))}, constant("patent")),
    "cve": Connector(
        "api", "global", "$.vulnerabilities[*].cve",
        {
            "key": at("$.id"), "title": at("$.id"), "year": at("$.published"), "detail": link("https://nvd.nist.gov/vuln/detail/{}", at("$.id")), "organization": constant("NVD"),
            "abstract": lambda r: F.coalesce(F.filter(F.from_json(F.get_json_object(r, "$.descriptions"), "array<struct<lang:string,value:string>>"), lambda x: x["lang"] == "en")[0]["value"], F.get_json_object(r, "$.descriptions[0].value"), F.lit("")),
            "highlights": lambda r: F.array_join(F.slice(F.array_compact(F.concat(
                F.array(F.coalesce(*[F.get_json_object(r, f"$.metrics.{m}[0].{p}") for m, p in (("cvssMetricV31", "cvssData.baseSeverity"), ("cvssMetricV30", "cvssData.baseSeverity"), ("cvssMetricV2", "baseSeverity"))])),
                F.regexp_extract_all(F.coalesce(F.get_json_object(r, "$.weaknesses"), F.lit("")), F.lit(r"(CWE-\d+)"), F.lit(1)),
            )), 1, 4), ","),
        },
        constant("report"),
    ),
    "blackhat": _anchors(r"/briefings/schedule/(#[^\"]+)", "https://www.blackhat.com/briefings/schedule/{}", "global"),
    "defcon": _anchors(r"/node/(\d+)", "https://forum.defcon.org/node/{}", "global"),
    "science_fair": _FAIR,
    "student_invention_fair": _FAIR,
    "hanwha_science_challenge": Connector(
        "crawl", "domestic", r'(?s)(<tr class="tr_award.*?</tr>)',
        {
            "key": lambda r: F.coalesce(F.nullif(F.regexp_extract(r, r"fileDownload\('([^']+)'", 1), F.lit("")), tx.slug(tx.strip_tags(r), 96)),
            "title": first(r'(?s)class="t_center">.*?</td>\s*<td class="td_pl">(.*?)</td>'), "authors": first(r'(?s)class="t_center">(.*?)</td>'), "abstract": first(r'(?s)class="td_color td_pl">(.*?)</td>'),
            "highlights": first(r'(?s)class="td_category">(.*?)</td>'), "pdf": link("https://www.sciencechallenge.or.kr/common/file/download.hsc?fileCode={}", first(r"fileDownload\('([^']+)'")), "year": constant(""),
        },
        constant("fair_entry"), True,
    ),
    "rne_report": _anchors(r"/rs_report/(\d+)", "http://www.rne.or.kr/gnuboard5/rs_report/{}", "domestic", "report"),
}
TEXTS = ("key", "title", "abstract", "organization", "doi", "detail", "pdf")


def parse(payloads: DataFrame, source: str, limit: int = LIMIT) -> DataFrame:
    """Documents of the payloads (source, query, payload) of one source: the first limit of each payload, one for each key, by order in it.

    Records that have no title, guidance-only fair entries and, of crawled pages, records that don't match the query are left out.
    """
    c = REGISTRY[source]
    mine = payloads.where(F.col("source") == source)
    if c.records.startswith("$"):
        found = F.from_json(F.get_json_object("payload", c.records), "array<string>")
        records = F.coalesce(found, F.array(F.get_json_object("payload", c.records)))
    else:
        records = F.regexp_extract_all("payload", F.lit(c.records), F.lit(1))
    rows = mine.select("source", "query", "payload", F.posexplode(records).alias("ord", "record"))
    r = F.col("record")
    of = lambda n: c.fields[n](r) if n in c.fields else F.lit("")
    year = F.coalesce(tx.safe_year(of("year")), tx.safe_year(F.regexp_extract("payload", r'(?s)is_active.*?>((?:19|20)\d{2})<', 1)))
    cited = of("citations").try_cast("int")
    out = rows.select(
        "source", "query", "payload", "ord", "record", c.document_type(r).alias("type"), *[of(n).alias(n) for n in TEXTS], tx.normalize_authors(of("authors")).alias("authors"), year.alias("year"),
        F.coalesce(cited, F.lit(0)).alias("citations"), F.lit(c.reach).alias("reach"), F.filter(F.split(of("highlights"), ","), lambda h: h != "").alias("highlights"),
    )
    keep = (F.col("title") != "") & ~F.col("title").startswith("(지도논문)") & ~tx.has_broken_encoding(F.col("title"))
    if c.needs_match:
        keep = keep & tx.matches_query(F.concat_ws(" ", "title", "abstract"), F.col("query"))
    # Position orders the records of a payload; windows over one payload hold a page of results.
    page = Window.partitionBy("query", "payload")
    one = out.where(keep).withColumn("n", F.row_number().over(Window.partitionBy("query", "payload", "key").orderBy("ord"))).where("n = 1")
    return one.withColumn("n", F.row_number().over(page.orderBy("ord"))).where(F.col("n") <= limit).drop("n", "payload", "record")


def fan_out(payloads: DataFrame, sources: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Documents of all sources' payloads."""
    out = None
    for s in sources or REGISTRY:
        one = parse(payloads, s, limit)
        out = one if out is None else out.unionByName(one)
    return out


def statuses(payloads: DataFrame, documents: DataFrame) -> DataFrame:
    """source, status (online, limited, error or disabled) and documents of every source: without a payload it is disabled, a null payload is an error."""
    spark = payloads.sparkSession
    known = registry(spark).select("source", "kind")
    asked = payloads.groupBy("source").agg(F.count("*").alias("asked"), F.count_if(F.col("payload").isNull()).alias("failed"))
    got = documents.groupBy("source").agg(F.count("*").alias("documents"))
    both = known.join(F.broadcast(asked), "source", "left").join(F.broadcast(got), "source", "left")
    status = F.when(F.col("asked").isNull(), "disabled").when(F.col("failed") == F.col("asked"), "error").when(F.coalesce("documents", F.lit(0)) > 0, "online").otherwise("limited")
    return both.select("source", "kind", status.alias("status"), F.coalesce("documents", F.lit(0)).alias("documents"))


def registry(spark: SparkSession) -> DataFrame:
    """source, kind, reach, latency of the connectors."""
    rows = [(k, c.kind, c.reach, "fast" if c.kind == "api" else "moderate") for k, c in REGISTRY.items()]
    return spark.createDataFrame(rows, "source string, kind string, reach string, latency string")
