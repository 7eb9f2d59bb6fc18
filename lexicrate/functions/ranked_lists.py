"""Fusion and normalization of short lists in plain Python, as ``operators.fusion`` does for tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from ..operators.fusion import EPSILON

Ranked = Sequence[tuple[str, float]]


@dataclass(frozen=True)
class FusionResult:
    doc_id: str
    score: float


def _best_first(scores: dict[str, float]) -> list[FusionResult]:
    return [FusionResult(d, s) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]


def rrf(primary: Ranked, secondary: Ranked, k: int = 60) -> list[FusionResult]:
    scores: dict[str, float] = {}
    for ranking in (primary, secondary):
        for pos, (doc, _) in enumerate(ranking, 1):
            scores[doc] = scores.get(doc, 0.0) + 1.0 / (k + pos)
    return _best_first(scores)


def linear_combination(primary: Ranked, secondary: Ranked, alpha: float = 0.5) -> list[FusionResult]:
    a, first, second = min(max(alpha, 0.0), 1.0), dict(primary), dict(secondary)
    return _best_first(
        {d: a * first.get(d, 0.0) + (1 - a) * second.get(d, 0.0) for d in {**first, **second}}
    )


def min_max_normalize(values: Iterable[float]) -> list[float]:
    values = list(values)
    if not values:
        return []
    low, spread = min(values), max(values) - min(values)
    return [1.0 if spread < EPSILON else (v - low) / spread for v in values]


def z_score_normalize(values: Iterable[float]) -> list[float]:
    values = list(values)
    if not values:
        return []
    mean = sum(values) / len(values)
    variance = sum((v - mean) ** 2 for v in values) / len(values)
    return [0.0 if variance < EPSILON else (v - mean) / math.sqrt(variance) for v in values]


def cdf_normalize(values: Iterable[float]) -> list[float]:
    values = list(values)
    out = [0.0] * len(values)
    for rank, i in enumerate(sorted(range(len(values)), key=values.__getitem__)):
        out[i] = rank / max(len(values) - 1, 1)
    return out
