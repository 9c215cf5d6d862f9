"""Scalar functions as column expressions; vectorised where Spark has none."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Quotient that is null where the divisor is zero (ANSI mode would raise)."""
    return F.try_divide(a, b)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    @F.pandas_udf("double")
    def phi(values: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else 0.5 * math.erfc(-v / math.sqrt(2)) for v in values.to_numpy(dtype=float)],
                         dtype="float64")
    return phi(x.cast("double"))


def discrete_signal(signal: Column, step: float) -> Column:
    """Round to a multiple of ``step`` (half to even), clip to [-1, 1]."""
    return F.greatest(F.least(F.bround(signal / step) * step, F.lit(1.0)), F.lit(-1.0))


def bet_z(prob: Column, classes: int = 2, root: bool = False) -> Column:
    """Test statistic of a probability; 0 and 1 map to -1 and 1."""
    spread = prob * (1 - prob)
    z = ratio(prob - 1.0 / classes, F.sqrt(spread) if root else spread)
    return F.when(prob == 1, 1.0).when(prob == 0, -1.0).otherwise(z)


def bet_size(prob: Column, classes: int = 2, side: Column | None = None, step: float | None = None,
             scale: float = 1.0, root: bool = False) -> Column:
    size = 2 * normal_cdf(bet_z(prob, classes, root)) - 1
    size = size if side is None else size * side
    size = size if step is None else discrete_signal(size, step)
    return size * scale


def signed_log(x: Column, scale: float = 1.0) -> Column:
    return F.signum(x) * F.log1p(scale * F.abs(x))


def truncate_decimal(x: Column, digits: int) -> Column:
    """Drop decimals beyond ``digits``, toward zero."""
    d = x.cast("decimal(38,18)")
    unit = F.lit(10 ** digits)
    return (F.signum(x) * F.floor(F.abs(d) * unit).cast("double") / unit.cast("double"))


# dynamic sizing from the divergence of forecast and market price
def sigmoid_size(width: Column, divergence: Column) -> Column:
    return ratio(divergence, F.sqrt(width + divergence * divergence))


def width_for(size: Column, divergence: Column) -> Column:
    """Coefficient that gives ``size`` at ``divergence``."""
    return divergence * divergence * (1 / (size * size) - 1)


def target_position(width: Column, forecast: Column, market: Column, max_position: Column) -> Column:
    return (sigmoid_size(width, forecast - market) * max_position).cast("long")


def inverse_price(forecast: Column, width: Column, size: Column) -> Column:
    return forecast - size * F.sqrt(width / (1 - size * size))


def limit_price(target: Column, position: Column, forecast: Column, width: Column, max_position: Column) -> Column:
    """Mean break-even price of moving from ``position`` to ``target`` one unit at a time."""
    step = F.when(target >= position, 1).otherwise(-1).cast("long")
    steps = F.sequence(F.abs(position + step), F.abs(target))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + inverse_price(
        forecast, width, j.cast("double") / max_position))
    return F.when(target == position, F.lit(None).cast("double")).otherwise(total / F.abs(target - position))


def budget_size(active_long: Column, max_long: Column, active_short: Column, max_short: Column) -> Column:
    """Share of the long budget in use minus that of the short budget."""
    long_part = F.when(max_long > 0, active_long / max_long).otherwise(0.0)
    short_part = F.when(max_short > 0, active_short / max_short).otherwise(0.0)
    return long_part - short_part


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
