"""Fusion of ranked lists and normalization of their scores.

Lists are tables (query_id, doc_id, score, pos), ``pos`` from 1 in list order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FusionConfig
from ..errors import InvalidArgument

#: Values closer than this count as equal: the precision of a 32-bit float.
EPSILON = 2.0**-23


def rrf(primary: DataFrame, secondary: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + pos); a repeated id counts each time."""
    both = primary.select("query_id", "doc_id", "pos").unionByName(
        secondary.select("query_id", "doc_id", "pos")
    )
    return both.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.col("pos") + k)).alias("score")
    )


def _last(df: DataFrame, name: str) -> DataFrame:
    """The score of each id; of a repeated one, that of its last place."""
    return df.groupBy("query_id", "doc_id").agg(F.max_by("score", "pos").alias(name))


def linear_combination(primary: DataFrame, secondary: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha times the first score and 1 - alpha times the second; a missing one is 0."""
    a = min(max(alpha, 0.0), 1.0)
    both = _last(primary, "_p").join(_last(secondary, "_s"), ["query_id", "doc_id"], "full_outer")
    p, s = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("_p", "_s"))
    return both.select("query_id", "doc_id", (F.lit(a) * p + F.lit(1.0 - a) * s).alias("score"))


def _per_query() -> Window:
    return Window.partitionBy("query_id")


def min_max(score: str = "score") -> Column:
    """0 for the least and 1 for the greatest; 1 where all are equal."""
    low, high = F.min(score).over(_per_query()), F.max(score).over(_per_query())
    return F.when(F.abs(high - low) < EPSILON, 1.0).otherwise((F.col(score) - low) / (high - low))


def z_score(score: str = "score") -> Column:
    """Distance from the mean in population standard deviations; 0 where all are equal."""
    mean, spread = F.avg(score).over(_per_query()), F.stddev_pop(score).over(_per_query())
    return F.when(spread * spread < EPSILON, 0.0).otherwise((F.col(score) - mean) / spread)


def cdf(score: str = "score", pos: str = "pos") -> Column:
    """Ascending rank from 0 to 1, ties in list order; 0 for a single value."""
    rank = F.row_number().over(_per_query().orderBy(score, pos)) - 1
    n = F.count(F.lit(1)).over(_per_query())
    return rank / F.greatest(n - 1, F.lit(1))


NORMALIZERS = {"MinMax": min_max, "ZScore": z_score, "Cdf": cdf}


def fuse(primary: DataFrame, secondary: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Fusion as configured; a normalizer applies to the scores that are combined."""
    if config.method == "ReciprocalRankFusion":
        return rrf(primary, secondary, config.rrf_k)
    if config.method != "LinearCombination":
        raise InvalidArgument(f"unknown fusion method: {config.method}")
    if config.normalizer:
        column = NORMALIZERS[config.normalizer]()
        primary, secondary = (d.withColumn("score", column) for d in (primary, secondary))
    return linear_combination(primary, secondary, config.alpha)
