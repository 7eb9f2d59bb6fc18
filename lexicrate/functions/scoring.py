"""The eight scoring functions as Catalyst expressions.

Every term of a query adds its score; ``n`` is the number of live documents (at
least 1), ``df`` and ``cf`` a term's document and collection frequency, ``tf``
its frequency in the document, ``dl`` the document's length and ``w`` the term's
weight in the query.  All arithmetic is in double precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Adaptive, Atire, Bm25F, Bm25L, Bm25T, Okapi, Plus, Setting, TfIdf
from ..errors import InvalidArgument

LEAST_AVGDL = 1e-6


def robust_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)))


def atire_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n + 1.0) / (df + 0.5)))


def field_factor(setting: Bm25F) -> float:
    """The mean weight of the configured fields; 1 without any, 0.1 at least."""
    parts = [f.weight * (1 - f.b + f.b * setting.b) for f in setting.fields]
    return max(sum(parts) / len(parts), 0.1) if parts else 1.0


def k1_of(setting: Setting, term: Column, n: Column, cf: Column) -> Column:
    """The saturation parameter, which two variants choose term by term."""
    if isinstance(setting, Adaptive):
        spread = F.lit(0.7) + F.log1p(F.greatest(cf / n, F.lit(1e-6)))
        return F.least(F.greatest(spread, F.lit(0.8)), F.lit(2.2))
    if isinstance(setting, Bm25T):
        own = reduce(
            lambda rest, x: F.when(term == x[0], F.lit(float(x[1]))).otherwise(rest),
            sorted(setting.term_k1.items()),
            F.lit(float(setting.default_k1)),
        )
        return F.least(F.greatest(own, F.lit(0.1)), F.lit(4.0))
    return F.lit(float(getattr(setting, "k1", 0.0)))


def term_score(
    setting: Setting, *, term: Column, tf: Column, dl: Column, avgdl: Column,
    n: Column, df: Column, cf: Column, w: Column,
) -> Column:
    """What one term adds to a document's score."""
    tf = F.greatest(tf.cast("double"), F.lit(1.0))
    n, df, cf = n.cast("double"), df.cast("double"), cf.cast("double")
    if isinstance(setting, TfIdf):
        return tf * F.log(F.lit(1.0) + n / (df + 1.0)) * w
    b = F.lit(float(setting.b))
    length = F.lit(1.0) - b + b * (dl.cast("double") / F.greatest(avgdl, F.lit(LEAST_AVGDL)))
    k1 = k1_of(setting, term, n, cf)
    if isinstance(setting, Bm25L):
        tf = tf / length + setting.c
        return robust_idf(n, df) * (k1 + 1.0) * tf / (k1 + tf) * w
    if isinstance(setting, Bm25F):
        tf = tf * field_factor(setting)
    saturated = tf * (k1 + 1.0) / (tf + k1 * length)
    if isinstance(setting, Plus):
        saturated = saturated + float(setting.delta)
    if isinstance(setting, Atire):
        return atire_idf(n, df) * saturated * w
    if isinstance(setting, (Okapi, Plus, Adaptive, Bm25F, Bm25T)):
        return robust_idf(n, df) * saturated * w
    raise InvalidArgument(f"not a scoring function: {setting}")


def score_bound(setting: Setting, **terms: Column) -> Column:
    """An upper bound of ``term_score``: a document of no length, at a given tf."""
    return F.greatest(F.lit(0.0), term_score(setting, dl=F.lit(0), **terms))
