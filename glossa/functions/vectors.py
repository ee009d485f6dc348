"""Vector arithmetic on ``array<float>`` columns with higher-order functions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.fixed_text import PAIRWISE_EPS, RANKING_MARGIN


def l2_distance(a: Column, b: Column, eps: float = PAIRWISE_EPS) -> Column:
    """``||a - b + eps||_2`` in double — the pairwise distance used by the triplet loss."""
    sq = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double") + F.lit(eps), 2))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def harmonic_mean(a: Column, b: Column) -> Column:
    """``2ab / (a + b)``; null when ``a + b`` is 0."""
    return F.when(a + b != 0, F.lit(2.0) * a * b / (a + b))


def hinge(d_pos: Column, d_neg: Column, margin: float = RANKING_MARGIN) -> Column:
    return F.greatest(d_pos - d_neg + F.lit(margin), F.lit(0.0))


def mean_of(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)
