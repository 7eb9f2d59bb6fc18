"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicrate import catalog
from lexicrate.config import ALL_SCORERS, Okapi
from lexicrate.operators.search import bag_of_words, search
from lexicrate.operators.tables import document_tokens, postings

HEADLINE = (
    "score_okapi", "score_tfidf", "search_boolean_must", "search_phrase_w1", "strat_maxscore_topk",
    "idx_term_stats", "idx_blocks", "tok_unicode_counts", "fuse_rrf", "metrics_by_query", "expand_rm3",
)


def write(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    write(catalog.QUERIES["score_okapi"](spark, "/root/testdata/sf0.001"))  # compiles what all share
    spark.catalog.clearCache()
    took: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.perf_counter()
        work()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()

    index = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = catalog.table(spark, folder)

    def build() -> None:
        docs = document_tokens(raw.select("doc_id", "text")).select("doc_id", "tokens", "doc_len")
        docs.write.mode("overwrite").parquet(f"{index}/docs")
        stored = spark.read.parquet(f"{index}/docs")
        postings(stored).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{index}/postings")

    timed("index_build", build)
    docs, post = spark.read.parquet(f"{index}/docs"), spark.read.parquet(f"{index}/postings")
    n_docs = docs.count()
    items = catalog.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = bag_of_words(items).persist()
    n_queries = queries.select("query_id").distinct().count()
    timed("batch_search", lambda: write(search(docs, queries, Okapi(), 10, post=post)))
    queries = bag_of_words(items).persist()
    queries.count()

    def all_scorers() -> None:
        for scoring in ALL_SCORERS:
            write(search(docs, queries, scoring, 10, post=post))

    timed("batch_search_8_scorers", all_scorers)
    for name in HEADLINE:
        timed(name, lambda name=name: write(catalog.QUERIES[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "total seconds of index build, batch searches and headline queries",
                "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(folder.rstrip("/")), "docs_per_sec": round(n_docs / took["index_build"], 1),
                "batch_queries_per_sec": round(n_queries / took["batch_search"], 1), "n_docs": n_docs,
                "n_queries": n_queries,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
