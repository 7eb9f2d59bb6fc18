"""Retrieval strategies as plans.

All strategies without a budget return the same top k, so they share one plan:
partial sums by document before the shuffle, then a limit per query.  ``pruned``
is the two-phase form that upper bounds allow, and ``budgeted`` the approximate
one that stops after a number of scored documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import BlockMaxWand, Okapi, Setting, Wand
from ..functions.scoring import score_bound, term_score
from ..operators.search import _hint, _small, effective_strategy, query_postings, search, top_k
from ..operators.tables import BLOCK, SLICE, corpus_stats, number_rows, ranked_postings, term_stats

#: Scores are compared rounded to 6 digits; the bound keeps a margin for that.
MARGIN = 1e-6


def _hits(
    docs: DataFrame, queries: DataFrame, scoring: Setting, post: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Scored postings of all query terms, each with its term's upper bound."""
    small = _hint(queries)
    post = query_postings(docs, small(queries.select("term").distinct()), post)
    stats = term_stats(post) if stats is None else stats
    corpus = corpus_stats(docs.select("doc_len")).select("n", "avgdl")
    # no more rows than the queries have; one row of corpus statistics
    weighed = queries.join(stats, "term").crossJoin(F.broadcast(corpus))
    col = F.col
    terms = {
        "term": col("term"), "avgdl": col("avgdl"), "n": col("n"), "df": col("doc_freq"),
        "cf": col("collection_freq"), "w": col("weight"),
    }
    bounds = weighed.withColumn("bound", score_bound(scoring, tf=col("max_tf"), **terms))
    joined = post.join(small(bounds), "term")
    return joined.select(
        "query_id", "term", "doc_id", "tf", "bound",
        score_bound(scoring, tf=col("tf"), **terms).alias("own_bound"),
        term_score(scoring, tf=col("tf"), dl=col("doc_len"), **terms).alias("part"),
    )


def pruned(
    docs: DataFrame, queries: DataFrame, scoring: Setting = Okapi(), k: int = 10, rest: int = 1, **kw
) -> DataFrame:
    """Exact top k in two phases: candidates come from all but the ``rest`` weakest terms.

    The k-th best sum over the strong terms is a lower bound of the result; a
    document stays if its sum and the bounds of the weak terms reach it.
    """
    hits = _hits(docs, queries.select("query_id", "term", "weight"), scoring, **kw).drop("own_bound")
    terms = hits.select("query_id", "term", "bound").distinct()
    order = Window.partitionBy("query_id").orderBy("bound", "term")
    weak = terms.withColumn("weak", F.row_number().over(order) <= rest)
    marked = hits.drop("bound").join(_small(weak), ["query_id", "term"])
    sums = marked.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(~F.col("weak"), F.col("part")).otherwise(0.0)).alias("strong"),
        F.sum("part").alias("score"),
    )
    slack = weak.groupBy("query_id").agg(
        F.sum(F.when(F.col("weak"), F.col("bound")).otherwise(0.0)).alias("slack")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("strong"), "doc_id")
    threshold = (
        sums.select("query_id", "doc_id", "strong")
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k)
        .select("query_id", F.col("strong").alias("least"))
    )
    kept = (
        sums.join(F.broadcast(threshold), "query_id", "left")  # one row per query
        .join(_small(slack), "query_id")
        .where(F.col("strong") + F.col("slack") >= F.coalesce("least", F.lit(0.0)) - MARGIN)
    )
    return top_k(kept.select("query_id", "doc_id", "score"), k)


def _reach(hits: DataFrame, blockwise: bool) -> DataFrame:
    """``hits`` with the most that a term can still add: over its whole list, or blockwise
    over the posting's block and all behind it."""
    if not blockwise:
        most = hits.groupBy("query_id", "term").agg(F.max("own_bound").alias("reach"))
        return hits.join(_small(most), ["query_id", "term"])
    keyed = hits.withColumn("term", F.struct("query_id", "term"))
    placed = ranked_postings(keyed).withColumn("_block", F.floor(F.col("place") / BLOCK))
    behind = Window.partitionBy("term").orderBy(F.desc("_block"))
    most = (
        placed.groupBy("term", "_block").agg(F.max("own_bound").alias("_most"))
        .select("term", "_block", F.max("_most").over(behind).alias("reach"))
    )
    return placed.join(most, ["term", "_block"]).withColumn("term", F.col("term.term"))


def _before(k: int):
    """Of one query: the best scores of all documents before each slice."""

    def run(table):
        import heapq

        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
        heap, kept = [], []
        for r in rows:
            kept.append(list(heap))
            heap = heapq.nlargest(k, heap + r["best"])
        return pa.Table.from_arrays(
            [
                pa.array([r["query_id"] for r in rows], pa.int64()),
                pa.array([r["slice"] for r in rows], pa.int64()),
                pa.array(kept, pa.list_(pa.float64())),
            ],
            ["query_id", "slice", "best"],
        )

    return run


def _in_slice(k: int):
    """Of one slice of documents: those whose bound beats the k-th best score before them."""

    def run(docs, state):
        import heapq

        import pyarrow as pa

        docs = docs.sort_by("doc_id")
        heap = state.column("best").to_pylist()[0] if len(state) else []
        heapq.heapify(heap)
        kept = []
        scores = docs.column("score").to_pylist()
        for i, (bound, score) in enumerate(zip(docs.column("bound").to_pylist(), scores, strict=True)):
            if bound <= (heap[0] if len(heap) == k else 0.0):
                continue
            kept.append(i)
            if score > 0:
                heapq.heappush(heap, score)
                if len(heap) > k:
                    heapq.heappop(heap)
        return docs.take(pa.array(kept, pa.int64())).select(["query_id", "slice", "doc_id", "score"])

    return run


def budgeted(
    docs: DataFrame, queries: DataFrame, strategy: Setting, scoring: Setting = Okapi(), k: int = 10, **kw
) -> DataFrame:
    """Approximate top k that stops after a budget of scored documents of a query.

    A cursor walk scores a document if the bounds of its terms beat the k-th best
    score before it.  What it skips can't be among the k best so far, so that
    score is the one of all documents before, and slices of doc_ids are walked
    apart, each from the best scores of the slices before it.  Running counts
    of scored documents then tell where the budget ends.  Ids keep their types:
    those that aren't numbers are walked in their order.  Without a budget the
    result is the exact one of ``pruned``; each document with a term is scored.
    """
    queries = queries.select("query_id", "term", "weight")
    budget = strategy.top_k_budget
    if not budget:
        hits = _hits(docs, queries, scoring, **kw)
        every = hits.groupBy("query_id").agg(F.count_distinct("doc_id").alias("scored_docs"))
        return pruned(docs, queries, scoring, k, **kw).join(_small(every), "query_id")
    if any(isinstance(df.schema[c].dataType, StringType) for df, c in ((docs, "doc_id"), (queries, "query_id"))):
        return _budgeted_by_number(docs, queries, strategy, scoring, k, **kw)
    queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
    hits = _hits(docs, queries, scoring, **kw)
    placed = _reach(hits, isinstance(strategy, BlockMaxWand))
    each = F.sort_array(F.collect_list(F.struct("term", "part", "reach")))
    total = lambda name: F.aggregate("each", F.lit(0.0), lambda x, y: x + y[name])
    by_doc = (
        placed.groupBy("query_id", F.col("doc_id").cast("long").alias("doc_id"))
        .agg(each.alias("each"))
        .select(
            "query_id", F.floor(F.col("doc_id") / SLICE).alias("slice"), "doc_id",
            total("reach").alias("bound"), total("part").alias("score"),
        )
    )
    best = Window.partitionBy("query_id", "slice").orderBy(F.desc("score"), "doc_id")
    tops = (
        by_doc.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        .groupBy("query_id", "slice")
        .agg(F.filter(F.collect_list("score"), lambda x: x > 0).alias("best"))
    )
    slices = ["query_id", "slice"]
    state = tops.groupBy("query_id").applyInArrow(
        _before(k), "query_id long, slice long, best array<double>"
    )
    scored = by_doc.groupBy(*slices).cogroup(state.groupBy(*slices)).applyInArrow(
        _in_slice(k), "query_id long, slice long, doc_id long, score double"
    )
    counts = scored.groupBy(*slices).agg(F.count("*").alias("_n"))
    until = Window.partitionBy("query_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(*slices, (F.sum("_n").over(until) - F.col("_n")).alias("_start")).where(
        F.col("_start") < budget
    )
    within = Window.partitionBy(*slices).orderBy("doc_id")
    first = (
        scored.withColumn("_at", F.row_number().over(within))
        .join(starts, slices)
        .where(F.col("_at") + F.col("_start") <= budget)
    )
    # at most ``budget`` rows of a query are left
    query = Window.partitionBy("query_id")
    counted = first.withColumn("scored_docs", F.count("*").over(query)).where("score > 0")
    return top_k(counted.select("query_id", "doc_id", "score", "scored_docs"), k)


def _numbers(ids: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number): dense numbers in the order of the ids, range by range."""
    ranged = ids.repartitionByRange(name).sortWithinPartitions(name)
    return number_rows(ranged, number).select(name, number)


def _budgeted_by_number(
    docs: DataFrame, queries: DataFrame, strategy: Setting, scoring: Setting, k: int,
    post: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """``budgeted`` for ids that aren't numbers: the walk sees their numbers."""
    of_doc = _numbers(docs.select("doc_id").distinct(), "doc_id", "_doc")
    of_query = _numbers(queries.select("query_id").distinct(), "query_id", "_query")
    named = lambda df, ids, name, number: (
        df.join(ids, name).drop(name).withColumnRenamed(number, name)
    )
    if post is not None:
        post = named(post, of_doc, "doc_id", "_doc")
    found = budgeted(
        named(docs, of_doc, "doc_id", "_doc"), named(queries, of_query, "query_id", "_query"),
        strategy, scoring, k, post=post, stats=stats,
    )
    back = found.withColumnsRenamed({"doc_id": "_doc", "query_id": "_query"})
    return (
        back.join(of_doc, "_doc").join(of_query, "_query")
        .select("query_id", "doc_id", "score", "scored_docs", "rank")
    )


def retrieve(
    docs: DataFrame, queries: DataFrame, strategy: Setting, scoring: Setting = Okapi(), k: int = 10, **kw
) -> DataFrame:
    """Top k of every query by the given strategy."""
    strategy = effective_strategy(strategy, scoring)
    if isinstance(strategy, (Wand, BlockMaxWand)) and strategy.top_k_budget:
        return budgeted(docs, queries, strategy, scoring, k, **kw).drop("scored_docs")
    return search(docs, queries, scoring, k, **kw)
