"""Scaling with statistics that never look ahead."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.operators.aggregates import tensor_stats
from tickweave.series import Series


def fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of count, sum-free statistics per column."""
    return df.agg(*[e for c in columns for e in (
        F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])


def scaled(x: Column, kind: str, lo: Column, hi: Column, mu: Column, sd: Column, a: float = 0.0, b: float = 1.0) -> Column:
    if kind == "minmax":
        return (x - lo) / F.nullif(hi - lo, F.lit(0.0)) * (b - a) + a
    return (x - mu) / F.nullif(sd, F.lit(0.0))


def apply_fit(df: DataFrame, stats: DataFrame, columns: Sequence[str], kind: str, a: float = 0.0, b: float = 1.0) -> DataFrame:
    out = df.crossJoin(F.broadcast(stats))  # one row
    out = out.withColumns({c: scaled(F.col(c), kind, *[F.col(f"_{s}_{c}") for s in ("lo", "hi", "mu", "sd")], a, b)
                           for c in columns})
    return out.drop(*[f"_{s}_{c}" for c in columns for s in ("lo", "hi", "mu", "sd")])


def train_fit_scale(df: DataFrame, columns: Sequence[str], split: str, kind: str, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Statistics from the train split only, applied to every split."""
    return apply_fit(df, fit(df.filter(F.col(split) == "train"), columns), columns, kind, a, b)


def anchored_days(length_us: int):
    """A period opens at a row and closes at the first row more than ``length_us`` later."""
    def kernel(state, fresh, arrays):
        anchor, is_open = state
        times = arrays["_time"].tolist()
        hits = np.zeros(len(times), dtype="int32")
        for i, t in enumerate(times):
            if not is_open:
                anchor, is_open = float(t), 1.0
            elif t - anchor > length_us:
                hits[i], is_open = 1, 0.0
        return (anchor, is_open), {"_hits": hits}
    return kernel


def number_days(series: Series, ts: str, length_us: int, anchored: bool, keep: Sequence[str]) -> DataFrame:
    """Calendar periods, or periods anchored at the first row after the last one closed."""
    if anchored:
        rows = series.with_columns({"_time": F.col(ts)}).relay(
            anchored_days(length_us), (0.0, 0.0), ["_time"], {"_hits": "int"},
            keep=list(dict.fromkeys([*series.order, *keep])))
        return rows.withColumnRenamed("_seq", "day").drop("_hits")
    first = series.df.groupBy(*series.keys).agg(F.min(F.floor(F.col(ts) / length_us)).alias("_d0"))
    rows = series.attach(series.df, first)
    return rows.withColumn("day", (F.floor(F.col(ts) / length_us) - F.col("_d0")).cast("long")).drop("_d0")


def trailing_scale(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: str, days: int = 5,
                   a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Scale each period by the statistics of up to ``days`` earlier ones (the first by itself).

    Moments are summed per period, merged over the small table of periods and
    joined back; rows never enter a window.
    """
    keys = list(keys)
    per = rows.groupBy(*keys, "day").agg(*[e for c in columns for e in (
        F.count(c).cast("double").alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}"),
        F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    w = Window.partitionBy(*keys).orderBy("day")
    frame = w.rowsBetween(-days, -1)
    first = F.row_number().over(w) == 1
    made = {}
    for c in columns:
        n, m, v = (F.col(f"_{s}_{c}") for s in ("n", "m", "v"))
        total = F.sum(n).over(frame)
        mean = F.sum(n * m).over(frame) / total
        # merged variance: within plus between periods
        second = F.sum(n * (v + m * m)).over(frame) / total
        made |= {f"_mu_{c}": F.when(first, m).otherwise(mean),
                 f"_sd_{c}": F.sqrt(F.greatest(F.when(first, v).otherwise(second - mean * mean), F.lit(0.0))),
                 f"_l_{c}": F.when(first, F.col(f"_lo_{c}")).otherwise(F.min(f"_lo_{c}").over(frame)),
                 f"_h_{c}": F.when(first, F.col(f"_hi_{c}")).otherwise(F.max(f"_hi_{c}").over(frame))}
    stats = per.withColumns(made).select(*keys, "day", *made)
    out = rows.join(stats, [*keys, "day"])
    return out.withColumns({c: scaled(F.col(c), kind, F.col(f"_l_{c}"), F.col(f"_h_{c}"), F.col(f"_mu_{c}"), F.col(f"_sd_{c}"), a, b)
                            for c in columns}).drop(*made)


def position_scale(df: DataFrame, tensor: str, kind: str = "zscore") -> DataFrame:
    """Scale every cell of a [feature][time] tensor by the statistics of its position."""
    stats = tensor_stats(df, tensor).withColumn(
        "_s", F.struct("mean", "std", "min", "max")).groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "_s"))), lambda e: e["_s"]).alias("_row"))
    packed = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "_row"))), lambda e: e["_row"]).alias("_t"))

    def cell(x, s):
        if kind == "zscore":
            return (x - s["mean"]) / F.nullif(s["std"], F.lit(0.0))
        return (x - s["min"]) / F.nullif(s["max"] - s["min"], F.lit(0.0))
    out = df.crossJoin(F.broadcast(packed))  # one row, as large as one tensor
    made = F.zip_with(F.col(tensor), F.col("_t"), lambda row, st: F.zip_with(row, st, cell))
    return out.withColumn(tensor, made).drop("_t")


def global_minmax(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Min-max over all columns taken together, or with given bounds."""
    if low is None or high is None:
        stats = df.agg(F.least(*[F.min(c) for c in columns]).alias("_lo"), F.greatest(*[F.max(c) for c in columns]).alias("_hi"))
        df = df.crossJoin(F.broadcast(stats))  # one row
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        lo, hi = F.lit(low), F.lit(high)
    return df.withColumns({c: ratio(F.col(c) - lo, hi - lo) for c in columns}).drop("_lo", "_hi")


def rescale(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Linear map of a column's range onto [low, high]."""
    return apply_fit(df, fit(df, [column]), [column], "minmax", low, high)


def feature_major(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide rows to long (feature, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))
