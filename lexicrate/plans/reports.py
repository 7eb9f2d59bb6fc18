"""Benchmark reports: effectiveness, recall of strategies, comparison of scorers."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    ALL_SCORERS,
    BlockMaxWand,
    BM25Config,
    ExhaustiveDAAT,
    MaxScore,
    Okapi,
    Setting,
    TokenizerConfig,
    Wand,
)
from ..operators.metrics import LatencyProfiler, evaluate
from ..operators.search import bag_of_words, search
from ..operators.tables import document_tokens
from ..sources.datasets import Dataset, titled_text
from .strategies import retrieve

MEASURES = ("ndcg", "ap", "recall", "precision", "mrr")
CUTOFF = 10


@dataclass
class RunReport:
    """Per-query metrics, their means, and latency of the batch in milliseconds."""

    scoring: str
    strategy: str
    top_k: int
    num_docs: int
    num_queries: int
    qps: float
    profiler: LatencyProfiler
    per_query: DataFrame
    means: dict[str, float]

    def write_csv(self, path: str) -> None:
        self.per_query.orderBy("query_id").coalesce(1).write.option("header", True).csv(path)

    def summary(self) -> str:
        """The means as a table of text."""
        names = [*self.means, "qps"]
        values = [f"{v:.4f}" for v in [*self.means.values(), self.qps]]
        width = [max(len(n), len(v)) for n, v in zip(names, values, strict=True)]
        line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        row = lambda xs: "|" + "|".join(f" {x:>{w}} " for x, w in zip(xs, width, strict=True)) + "|"
        return "\n".join([line, row(names), line, row(values), line])


def index_tokens(data: Dataset, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """Tokens of a dataset's corpus, titles in front."""
    docs = data.corpus.select("doc_id", titled_text().alias("text"))
    return document_tokens(docs, config).select("doc_id", "tokens", "doc_len")


def run_benchmark(data: Dataset, config: BM25Config = BM25Config(), top_k: int = 10) -> RunReport:
    """All queries as one batch; metrics at 10, reciprocal rank over all of ``top_k``."""
    tokens = index_tokens(data, config.tokenizer).persist()
    n_docs, n_queries = tokens.count(), data.queries.count()
    terms = bag_of_words(data.queries, config.tokenizer)
    profiler, began = LatencyProfiler(), time.perf_counter()
    found = retrieve(tokens, terms, config.retrieval, config.scoring, top_k).persist()
    profiler.profile(found.count)
    took = time.perf_counter() - began
    relevant = data.qrels.where("score > 0").select("query_id", "doc_id")
    per_query = evaluate(data.queries, found, relevant, CUTOFF)
    sums = per_query.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEASURES]).first()
    return RunReport(
        config.scoring.tag, config.retrieval.tag, top_k, n_docs, n_queries,
        n_queries / took if took else 0.0, profiler, per_query, {m: float(sums[m]) for m in MEASURES},
    )


def recall_degradation(
    tokens: DataFrame, queries: DataFrame, scoring: Setting = Okapi(), ks: tuple[int, ...] = (1, 5, 10),
    budget: int = 1000,
) -> DataFrame:
    """(strategy, k, recall): the mean share of the exhaustive top k that a strategy finds.

    A query without any result counts as 1.
    """
    ks = sorted({k for k in ks if k > 0})
    most = max(ks, default=1)
    truth = retrieve(tokens, queries, ExhaustiveDAAT(), scoring, most).select(
        "query_id", "doc_id", F.col("rank").alias("true_rank")
    )
    ids = queries.select("query_id").distinct()
    cuts = tokens.sparkSession.createDataFrame([(k,) for k in ks], "k long")
    parts = []
    for strategy in (Wand(budget), BlockMaxWand(budget), MaxScore()):
        found = retrieve(tokens, queries, strategy, scoring, most).select("query_id", "doc_id", "rank")
        both = truth.join(found, ["query_id", "doc_id"], "left").join(
            F.broadcast(cuts), F.col("true_rank") <= F.col("k")
        )
        share = both.groupBy("query_id", "k").agg(
            (F.count_if(F.col("rank") <= F.col("k")) / F.count("*")).alias("recall")
        )
        every = ids.join(F.broadcast(cuts))  # a handful of cuts
        full = every.join(share, ["query_id", "k"], "left")
        parts.append(
            full.groupBy("k").agg(F.avg(F.coalesce("recall", F.lit(1.0))).alias("recall"))
            .select(F.lit(strategy.tag).alias("strategy"), "k", "recall")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def variant_comparison(
    tokens: DataFrame, queries: DataFrame, qrels: DataFrame,
    scorers: tuple[Setting, ...] = ALL_SCORERS, top_k: int = 10,
) -> DataFrame:
    """(variant, means of all metrics), one row per scoring function."""
    parts = None
    for scoring in scorers:
        found = search(tokens, queries, scoring, top_k)
        means = evaluate(queries, found, qrels, CUTOFF).agg(
            *[F.avg(m).alias(m) for m in MEASURES]
        ).select(F.lit(scoring.tag).alias("variant"), *MEASURES)
        parts = means if parts is None else parts.unionByName(means)
    return parts
