"""The document schema, its defaults, and the documents view of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
DOCUMENT = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("id", "canonicalId", "type", "source", "sourceLabel", "title", "englishTitle")),
        T.StructField("authors", T.ArrayType(_S)),
        T.StructField("organization", _S),
        T.StructField("year", T.IntegerType()),
        T.StructField("citations", T.IntegerType()),
        T.StructField("openAccess", T.BooleanType()),
        T.StructField("region", _S),
        T.StructField("language", _S),
        *(T.StructField(n, T.ArrayType(_S)) for n in ("keywords", "methods", "highlights")),
        *(T.StructField(n, _S) for n in ("abstract", "summary", "novelty")),
        *(T.StructField(n, T.MapType(_S, _S)) for n in ("links", "sourceIds")),
        T.StructField("alternateSources", T.ArrayType(_S)),
        T.StructField("rawRecord", _S),
        T.StructField("updatedAt", T.TimestampType()),
    ]
)
TYPES = ("paper", "thesis", "patent", "report", "fair_entry")


def with_defaults(df: DataFrame) -> DataFrame:
    """df with every field of DOCUMENT: what is absent or null gets an empty list, map or text, 0 citations, no open access; year and updatedAt stay null, an unknown type is a paper."""
    out = []
    for f in DOCUMENT.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            c = F.coalesce(c, F.create_map().cast(f.dataType))
        elif f.name == "type":
            c = F.when(c.isin(*TYPES), c).otherwise("paper")
        elif f.name in ("citations", "openAccess"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType) and f.name not in ("id", "canonicalId", "rawRecord"):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


#: Few files of at most so many bytes are dealt to all cores; larger ones have row groups to split.
SPREAD_BYTES = 256_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, whole. Texts in a single small file would keep one core busy, so their rows are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):
        files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
        if 0 < 2 * len(files) <= cores:
            path = lambda f: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            fs = path(files[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if sum(fs.getFileStatus(path(f)).getLen() for f in files) <= SPREAD_BYTES:
                return df.repartition(cores)
    return df


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as bibliographic rows: the first line is the title, the text the abstract; year, citations, region, type, authors, methods and keywords follow from other columns by fixed rules."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    words = F.array_distinct(F.filter(F.split(F.lower(title), "[^a-zà-ÿ]+"), lambda t: F.length(t) >= 6))
    return d.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.length("source") + F.length(title), F.lit(5)) + 1).cast("int")).alias("type"),
        "source",
        title.alias("title"),
        F.col("text").alias("abstract"),
        F.array(F.concat(F.lit("author "), F.pmod(F.col("doc_id") * 7, F.lit(211)).cast("string")), F.concat(F.lit("author "), F.pmod(F.col("doc_id") * 13, F.lit(307)).cast("string"))).alias("authors"),
        F.concat(F.col("source"), F.lit(" institute")).alias("organization"),
        (F.lit(2000) + F.pmod(F.length(title), F.lit(27))).cast("int").alias("year"),
        F.pmod(F.col("doc_id") * 37, F.lit(500)).cast("int").alias("citations"),
        F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, "domestic").otherwise("global").alias("region"),
        F.col("lang").alias("language"),
        F.slice(words, 1, 6).alias("keywords"),
        F.slice(words, 7, 2).alias("methods"),
    )


#: The same view as DuckDB SQL, without its WITH.
DOCUMENTS_VIEW_SQL = r"""docs0 as (select *, split_part(coalesce(text, ''), chr(10), 1) as title from documents),
docs1 as (select *, list_filter(string_split_regex(lower(title), '[^a-zà-ÿ]+'), lambda t: length(t) >= 6) as w0 from docs0),
docs2 as (select *, list_filter(w0, lambda t, i: list_position(w0, t) = i) as words from docs1),
docs as (select doc_id as id, ['paper', 'thesis', 'patent', 'report', 'fair_entry'][cast((length(source) + length(title)) % 5 + 1 as int)] as type, source, title, text as abstract,
 ['author ' || (doc_id * 7 % 211), 'author ' || (doc_id * 13 % 307)] as authors, source || ' institute' as organization, cast(2000 + length(title) % 27 as int) as year, cast(doc_id * 37 % 500 as int) as citations,
 case when doc_id % 2 = 0 then 'domestic' else 'global' end as region, lang as language, words[1:6] as keywords, words[7:8] as methods from docs2)"""
