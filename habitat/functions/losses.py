"""Sigmoid and the two training losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce_eps(p: Column, y: Column) -> Column:
    """Cross-entropy of a probability, with a small constant inside the logs."""
    return -(y * F.log(p + F.lit(EPS)) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p + F.lit(EPS)))


def bce_logits(z: Column, y: Column) -> Column:
    """Cross-entropy of a logit in the form that does not overflow."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
