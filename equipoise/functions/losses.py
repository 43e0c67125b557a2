"""Binomial log-loss on labels y in {-1, +1} and margins F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_label(label: Column) -> Column:
    """0/1 label to -1/+1."""
    return F.lit(2.0) * label.cast("double") - F.lit(1.0)


def pseudo_residual(y: Column, margin: Column) -> Column:
    """Negative gradient of the log-loss: 4y / (1 + exp(2yF))."""
    return F.lit(4.0) * y / (F.lit(1.0) + F.exp(F.lit(2.0) * y * margin))


def log_loss(y: Column, margin: Column) -> Column:
    """2 log(1 + exp(-2yF)), written so that large margins do not overflow."""
    m = F.lit(2.0) * y * margin
    return F.lit(2.0) * (F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight)."""
    return F.sum(value * weight) / F.sum(weight)
