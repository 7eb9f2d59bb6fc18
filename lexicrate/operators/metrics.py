"""Retrieval metrics over tables, and the latency profiler.

``ranked(query_id, doc_id, rank)`` and ``qrels(query_id, doc_id)`` of the
relevant documents; every query of ``queries(query_id)`` gets a row.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluate(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """nDCG, average precision, recall and precision at k, and reciprocal rank, by query.

    An id that is ranked twice counts twice; precision divides by k, average
    precision by the smaller of k and the number of relevant documents.
    """
    relevant = qrels.select("query_id", "doc_id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant, ["query_id", "doc_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    within = F.col("rank") <= k
    gains = (
        hits.withColumn("so_far", F.count("*").over(order))
        .groupBy("query_id")
        .agg(
            F.sum(F.when(within, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
            F.sum(F.when(within, F.col("so_far") / F.col("rank"))).alias("precisions"),
            F.sum(F.when(within, 1).otherwise(0)).alias("hits"),
            F.min("rank").alias("first"),
        )
    )
    depth = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    ideal = F.aggregate(
        F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0)
    )
    rows = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(
        gains, "query_id", "left"
    )

    def share(part: str, whole: Column) -> Column:
        return F.when(
            F.coalesce("n_rel", F.lit(0)) > 0, F.coalesce(part, F.lit(0.0)) / whole
        ).otherwise(0.0)

    return rows.select(
        "query_id",
        share("dcg", ideal).alias("ndcg"),
        share("precisions", depth).alias("ap"),
        share("hits", F.col("n_rel")).alias("recall"),
        (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


# -- single rankings ---------------------------------------------------------


def ndcg_at_k(ranked: Sequence[str], relevant: set[str], k: int) -> float:
    if not (k and ranked and relevant):
        return 0.0
    gain = sum(1 / math.log2(i + 2) for i, d in enumerate(ranked[:k]) if d in relevant)
    return gain / sum(1 / math.log2(i + 2) for i in range(min(len(relevant), k)))


def average_precision_at_k(ranked: Sequence[str], relevant: set[str], k: int) -> float:
    if not (k and relevant):
        return 0.0
    hits, total = 0, 0.0
    for i, d in enumerate(ranked[:k], 1):
        if d in relevant:
            hits += 1
            total += hits / i
    return total / min(len(relevant), k)


def recall_at_k(ranked: Sequence[str], relevant: set[str], k: int) -> float:
    return sum(d in relevant for d in ranked[:k]) / len(relevant) if relevant else 0.0


def precision_at_k(ranked: Sequence[str], relevant: set[str], k: int) -> float:
    return sum(d in relevant for d in ranked[:k]) / k if k else 0.0


def mrr(ranked: Sequence[str], relevant: set[str]) -> float:
    return next((1 / i for i, d in enumerate(ranked, 1) if d in relevant), 0.0)


def nearest_rank(values: Sequence[float], p: float) -> float:
    """The value at index (n - 1) p of the sorted values, half rounded up; 0 of none."""
    ordered = sorted(values)
    return ordered[math.floor((len(ordered) - 1) * p + 0.5)] if ordered else 0.0


def percentile_column(values: Column, p: float) -> Column:
    """``nearest_rank`` of an array column."""
    n = F.size(values)
    at = F.floor((n - 1) * p + 0.5).cast("int") + 1
    return F.when(n > 0, F.element_at(F.sort_array(values), at)).otherwise(0.0)


@dataclass
class LatencyProfiler:
    """Latencies in milliseconds and their percentiles."""

    values: list[float] = field(default_factory=list)

    def record(self, total_ms: float) -> None:
        if total_ms < 0:
            raise ValueError("a latency can't be negative")
        self.values.append(float(total_ms))

    def profile(self, work: Callable[[], object]) -> object:
        """Runs ``work`` and records how long it took."""
        began = time.perf_counter()
        try:
            return work()
        finally:
            self.record(1000 * (time.perf_counter() - began))

    def p50(self) -> float:
        return nearest_rank(self.values, 0.5)

    def p95(self) -> float:
        return nearest_rank(self.values, 0.95)

    def p99(self) -> float:
        return nearest_rank(self.values, 0.99)

    def p999(self) -> float:
        return nearest_rank(self.values, 0.999)

    def __len__(self) -> int:
        return len(self.values)
