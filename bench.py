"""Wall-clock of headline queries, one JSON line. One count of documents warms the session up; each query is then timed once, to a full result.

The folder is new in each run, so document_index hashes all documents; later ones read what it stored.
machine_sec is the time of a fixed sum over numbers alone, which tells machines apart; it is no part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from quillgrid.plans import catalogue

#: Those that read the stored index come last, after document_index, which makes it.
QUERIES = (
    "document_frequency", "sparse_overlap", "cosine_topk", "knn_edges", "similar_titles", "canonical_merge", "recommend_heuristic", "reference_edges", "two_hop_paths", "upsert_latest", "library_view", "hot_queries",
    "quality_summary", "strip_tags", "char_ngrams", "document_index", "bm25_topk", "hybrid_score", "search_relevance", "rerank_heuristic", "similarity_report",
)
#: No query begins after so many seconds; those that didn't are listed.
SECONDS = float(os.environ.get("BENCH_SECONDS", "400"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    own = tempfile.mkdtemp(prefix="quillgrid-bench-")
    conf = {
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": own, "spark.checkpoint.dir": f"{own}/shared",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or QUERIES
    every = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    numbers = spark.range(100_000_000).selectExpr("sum(xxhash64(id) % 1000)")
    numbers.collect()
    start = time.perf_counter()
    numbers.collect()
    machine, took = round(time.perf_counter() - start, 3), {}
    late, began = [], time.perf_counter()
    for name in names:
        start = time.perf_counter()
        if start - began > SECONDS:
            late.append(name)
            continue
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "machine_sec": machine, "not_run": late, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
