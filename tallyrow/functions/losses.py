"""Per-row losses on raw scores (logits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, label: Column) -> Column:
    return softplus(logit) - logit * label


def focal(logit: Column, label: Column, alpha: float, gamma: float) -> Column:
    p = sigmoid(logit)
    y = label.cast("double")
    p_true = p * y + (1 - p) * (1 - y)
    weight = F.lit(alpha) * y + F.lit(1 - alpha) * (1 - y)
    return weight * F.pow(1 - p_true, F.lit(gamma)) * bce(logit, y)
