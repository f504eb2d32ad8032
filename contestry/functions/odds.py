"""Arithmetic on prices and probabilities, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of ten reliability bins; fixed values, some of which are not the nearest double to a tenth.
BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def clip(p: Column, by: float = 1e-6) -> Column:
    return F.greatest(F.least(p, F.lit(1 - by)), F.lit(by))


def logit(p: Column) -> Column:
    c = clip(p, 1e-4)
    return F.log(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def expected(own: Column, other: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / scale))


def log_loss(p: Column, y: Column) -> Column:
    """The loss of one row; its mean is the log-loss."""
    q = clip(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def reliability_bin(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(0.0))
    return sum(((q >= edge).cast("int") for edge in BIN_EDGES[1:]), F.lit(0))


def shrink(p: Column, alpha: float) -> Column:
    return p * (1 - alpha) + 0.5 * alpha


def implied(odds: Column) -> Column:
    return 1 / odds


def fair(odds: Column, other: Column) -> Column:
    """Margin removed in proportion."""
    return (1 / odds) / (1 / odds + 1 / other)


def margin(odds: Column, other: Column) -> Column:
    return 1 / odds + 1 / other - 1


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly(p: Column, odds: Column, fraction: float = 0.25) -> Column:
    full = (p * odds - 1) / (odds - 1)
    return F.when((odds <= 1) | (full <= 0), F.lit(0.0)).otherwise(full * fraction)
