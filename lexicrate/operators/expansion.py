"""Query expansion from feedback documents or synonyms.

Queries are (query_id, term, weight), feedback documents (query_id, doc_id,
term, weight).  Results are weights divided by the sum of their absolute values;
a term that an expander appends stays a row of its own and is added up when it
is searched.  Equal candidates are taken in the order of the term.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY = ("query_id", "term", "weight")


class Expander(Protocol):
    def __call__(self, query: DataFrame, feedback: DataFrame) -> DataFrame: ...


def normalized(query: DataFrame) -> DataFrame:
    """Weights divided by the query's sum of absolute weights, unless that is 0."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy("query_id"))
    return query.withColumn(
        "weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight"))
    )


def _best(terms: DataFrame, n: Column | int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    ranked = terms.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= n).select(*QUERY)


def _summed(feedback: DataFrame, value: Column) -> DataFrame:
    return feedback.groupBy("query_id", "term").agg(F.sum(value).alias("weight"))


def rm3(query: DataFrame, feedback: DataFrame, terms: int = 10, weight: float = 0.5) -> DataFrame:
    """Appends the ``terms`` heaviest feedback terms at ``weight`` times their sums."""
    extra = _best(_summed(feedback, F.col("weight")), terms)
    extra = extra.withColumn("weight", F.col("weight") * weight)
    return normalized(query.select(*QUERY).unionByName(extra))


def rocchio(
    query: DataFrame, feedback: DataFrame, alpha: float = 1.0, beta: float = 0.75, terms: int = 10
) -> DataFrame:
    """alpha times the query plus beta times the mean feedback document.

    The heaviest terms stay: ``terms`` of them, or as many as the query has.
    """
    docs = feedback.groupBy("query_id").agg(F.count_distinct("doc_id").alias("_n"))
    sums = _summed(feedback, F.col("weight")).join(docs, "query_id")
    mean = sums.select("query_id", "term", (F.col("weight") * beta / F.col("_n")).alias("weight"))
    own = query.select("query_id", "term", (F.col("weight") * alpha).alias("weight"))
    merged = own.unionByName(mean).groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    sizes = query.groupBy("query_id").agg(
        F.greatest(F.count_distinct("term"), F.lit(terms)).alias("_most")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    kept = merged.withColumn("_rank", F.row_number().over(order)).join(sizes, "query_id")
    return normalized(kept.where("_rank <= _most").select(*QUERY))


def bo1(query: DataFrame, feedback: DataFrame, terms: int = 10) -> DataFrame:
    """Appends the terms of the greatest sums of ln(2 + weight)."""
    extra = _best(_summed(feedback, F.log(F.col("weight") + 2.0)), terms)
    return normalized(query.select(*QUERY).unionByName(extra))


def synonyms(query: DataFrame, table: DataFrame, decay: float = 0.5) -> DataFrame:
    """Appends the synonyms of ``table(term, synonym)`` at ``decay`` times the weight."""
    extra = query.join(table, "term").select(
        "query_id", F.col("synonym").alias("term"), (F.col("weight") * decay).alias("weight")
    )
    return normalized(query.select(*QUERY).unionByName(extra))


def pseudo_relevance(
    query: DataFrame, feedback: DataFrame, doc_freq: DataFrame, n_docs: int, skip: list[str],
    terms: int = 8, base_weight: float = 1.5, extra_weight: float = 0.9,
) -> DataFrame:
    """Query terms at ``base_weight``, then feedback terms by summed idf, at falling weights."""
    idf = F.log((F.lit(n_docs) + 1.0) / (F.col("doc_freq") + 1.0)) + 1.0
    found = feedback.where(~F.col("term").isin(*skip)) if skip else feedback
    found = found.join(query.select("query_id", "term"), ["query_id", "term"], "left_anti")
    found = _summed(found.join(doc_freq, "term"), F.col("weight") * idf)
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    ranked = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= terms)
    extra = ranked.select("query_id", "term", (F.lit(extra_weight) / F.col("_rank")).alias("weight"))
    return query.select("query_id", "term", F.lit(base_weight).alias("weight")).unionByName(extra)
