"""Row-frame operators: shifts, rolling and weighted statistics, sliding arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.functions.arrays import dot, mean_of, median_of, std_pop_of, transpose
from tickweave.operators.quantiles import exact_quantiles
from tickweave.series import Series


def rolling(value: Column, window, width: int, fn=F.avg, min_periods: int | None = None) -> Column:
    """Rolling aggregate that is null until ``min_periods`` values are in the frame."""
    frame = window.rowsBetween(-(width - 1), 0)
    need = width if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= need, fn(value).over(frame))


def shifts(series: Series, price: str, lags: Sequence[int] = (1, 2, 3), leads: Sequence[int] = (1,)) -> DataFrame:
    """lag, lead, diff, percent change and log return."""
    def build(df, w):
        p = F.col(price)
        out = {f"lag_{k}": F.lag(p, k).over(w) for k in lags}
        out |= {f"lead_{k}": F.lead(p, k).over(w) for k in leads}
        out |= {"diff": p - F.lag(p).over(w), "log_ret": F.log(ratio(p, F.lag(p).over(w)))}
        out |= {f"pct_{k}": ratio(p, F.lag(p, k).over(w)) - 1 for k in lags}
        return df.withColumns(out)
    return series.windowed(build, before=max(lags), after=max(leads, default=0))


def forward_return(series: Series, price: str, rows: int) -> DataFrame:
    return series.windowed(lambda df, w: df.withColumn(
        "fwd_ret", ratio(F.lead(price, rows).over(w), F.col(price)) - 1), after=rows)


def rolling_stats(series: Series, value: str, width: int) -> DataFrame:
    def build(df, w):
        v = F.col(value)
        return df.withColumns({"roll_mean": rolling(v, w, width), "roll_std": rolling(v, w, width, F.stddev_samp)})
    return series.windowed(build, before=width - 1)


def strided_rolling(series: Series, value: str, width: int, stride: int) -> DataFrame:
    """Rolling mean over every ``stride``-th row, for each phase, in the original order."""
    def build(df, w):
        phase = Window.partitionBy(*series.keys, "_chunk", F.col("_pos") % stride).orderBy("_pos")
        return df.withColumn("roll_mean", rolling(F.col(value), phase, width))
    return series.windowed(build, before=(width - 1) * stride)


def rolling_autocorr(series: Series, price: str, width: int, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation of log returns inside a ``width``-row frame.

    Sliding sums are differences of running sums inside the chunk, so the cost
    per row does not depend on the width.
    """
    def build(df, w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_r", F.log(ratio(F.col(price), F.lag(price).over(w))))
        df = df.withColumns({"_x": F.coalesce("_r", F.lit(0.0)), "_seen": F.col("_r").isNotNull().cast("int"),
                             **{f"_x{k}": F.coalesce(F.col("_r") * F.lag("_r", k).over(w), F.lit(0.0)) for k in lags}})
        df = df.withColumns({"_p1": F.sum("_x").over(upto), "_p2": F.sum(F.col("_x") * F.col("_x")).over(upto),
                             "_pn": F.sum("_seen").over(upto), **{f"_c{k}": F.sum(f"_x{k}").over(upto) for k in lags}})

        def back(name, rows):
            return F.coalesce(F.lag(name, rows).over(w), F.lit(0)) if rows else F.col(name)
        full = F.col("_pn") - back("_pn", width) >= width
        out = {}
        for k in lags:
            m = width - k  # pairs inside the frame
            sx, sxx = F.col("_p1") - back("_p1", m), F.col("_p2") - back("_p2", m)
            sy, syy = back("_p1", k) - back("_p1", width), back("_p2", k) - back("_p2", width)
            sxy = F.col(f"_c{k}") - back(f"_c{k}", m)
            spread = (m * sxx - sx * sx) * (m * syy - sy * sy)
            out[f"autocorr_{k}"] = F.when(full, ratio(m * sxy - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0)))))
        return df.withColumns(out).drop("_r", "_x", "_seen", "_p1", "_p2", "_pn", *[f"_x{k}" for k in lags], *[f"_c{k}" for k in lags])
    return series.windowed(build, before=width + max(lags) + 1)


def decay_of(span: float | None = None, com: float | None = None) -> float:
    """Weight kept per row."""
    alpha = 2 / (span + 1) if span is not None else 1 / (1 + com)
    return 1 - alpha


def ewm(series: Series, value: str, keep: float, skip: int = 0, mean: str = "ewm_mean",
        std: str | None = "ewm_std", min_periods: int = 0) -> DataFrame:
    """Exponentially weighted mean and unbiased deviation (normalised weights).

    ``keep`` is one minus alpha. Values must be non-null after the first
    ``skip`` rows of a key. Inside a chunk the weighted sum is an ordinary
    running sum of values scaled by ``keep ** -offset``; the chunk is short
    enough for that scale to stay finite, and the neighbour rows reach back
    until the weight is below double precision.
    """
    rate = -math.log(keep)
    reach = math.ceil(42 / rate)
    rows = max(1, math.floor(600 / rate) - reach)
    rows = min(rows, max(series.chunk_rows, reach))
    df = series.chunked(before=reach, rows=rows).filter(F.col("_pos") >= skip)
    w = series.chunk_window()
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    size = max(rows, reach)
    offset = F.col("_pos") - (F.col("_chunk") * size - reach)
    scale = F.pow(F.lit(keep), -offset.cast("double"))
    x = F.col(value)
    centre = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("_c", centre).withColumn("_x", x - F.col("_c")).withColumn("_s", scale)
    n = (F.col("_pos") - skip + 1).cast("double")
    weight = (1 - F.pow(F.lit(keep), n)) / (1 - keep)
    weight2 = (1 - F.pow(F.lit(keep), 2 * n)) / (1 - keep * keep)
    m1 = F.sum(F.col("_x") * F.col("_s")).over(frame) / F.col("_s") / weight
    df = df.withColumn("_m1", m1)
    enough = n >= max(min_periods, 1)
    if std:
        m2 = F.sum(F.col("_x") * F.col("_x") * F.col("_s")).over(frame) / F.col("_s") / weight
        spread = F.greatest(m2 - F.col("_m1") * F.col("_m1"), F.lit(0.0))
        fix = ratio(weight * weight, weight * weight - weight2)
        df = df.withColumn(std, F.when(enough & (n > 1), F.sqrt(spread * fix)))
    df = df.withColumn(mean, F.when(enough, F.col("_c") + F.col("_m1")))
    return df.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk", "_c", "_x", "_s", "_m1")


def volatility_level(df: DataFrame, w, price: str, width: int, name: str = "vol_level") -> DataFrame:
    """std + mean of absolute moves in the ``width`` rows before the current one.

    Moves are divided by the later price; null for the first ``width`` rows.
    """
    move = F.abs(ratio(F.col(price) - F.lag(price).over(w), F.col(price)))
    frame = w.rowsBetween(-(width - 1), -1)
    df = df.withColumn("_mv", move)
    level = F.stddev_pop("_mv").over(frame) + F.avg("_mv").over(frame)
    return df.withColumn(name, F.when(F.col("_pos") >= width, level)).drop("_mv")


def volatility_threshold(df: DataFrame, w, price: str, width: int, name: str = "vol_threshold",
                         include_current: bool = False) -> DataFrame:
    """std + mean of absolute percent changes of a window (divided by the earlier price).

    Without the current row the window covers the ``width`` rows before it;
    the deviation is a sample deviation only in the including variant.
    """
    df = df.withColumn("_mv", F.abs(ratio(F.col(price), F.lag(price).over(w)) - 1))
    if include_current:
        frame = w.rowsBetween(-(width - 2), 0)
        level = F.stddev_samp("_mv").over(frame) + F.avg("_mv").over(frame)
        ready = F.col("_pos") >= width - 1
    else:
        frame = w.rowsBetween(-(width - 1), -1)
        level = F.stddev_pop("_mv").over(frame) + F.avg("_mv").over(frame)
        ready = F.col("_pos") >= width
    return df.withColumn(name, F.when(ready, level)).drop("_mv")


def sliding_window(df: DataFrame, w, value: Column, width: int, name: str = "window",
                   include_current: bool = True) -> DataFrame:
    """Array of the last ``width`` values, null until there are that many."""
    frame = w.rowsBetween(-(width - 1), 0) if include_current else w.rowsBetween(-width, -1)
    first = width - 1 if include_current else width
    return df.withColumn(name, F.when(F.col("_pos") >= first, F.collect_list(value).over(frame)))


def feature_tensor(series: Series, features: Sequence[str], width: int, time_major: bool = False,
                   reverse: bool = False, name: str = "tensor") -> DataFrame:
    """Sliding multivariate windows ending at the row, ``[feature][time]`` or ``[time][feature]``."""
    def build(df, w):
        df = sliding_window(df, w, F.array(*[F.col(f).cast("double") for f in features]), width, name)
        made = F.col(name)
        if reverse:
            made = F.reverse(made)
        if not time_major:
            made = transpose(made, len(features))
        return df.withColumn(name, F.when(F.col(name).isNotNull(), made))
    return series.windowed(build, before=width - 1)


def lookback_pairs(series: Series, value: str, width: int) -> DataFrame:
    """X = the ``width`` values before the row, y = the row's value."""
    def build(df, w):
        return sliding_window(df, w, F.col(value), width, "x", include_current=False).withColumn("y", F.col(value))
    return series.windowed(build, before=width).filter(F.col("x").isNotNull())


def past_future(series: Series, value: str, past: int, future: int, sliding: bool = True) -> DataFrame:
    """Past-N / future-K samples, one per row or one per non-overlapping block."""
    if not sliding:
        size = past + future
        block = F.floor(F.col("_pos") / size).cast("long")
        rows = series.df.withColumn("sample", block).groupBy(*series.keys, "sample").agg(
            F.array_sort(F.collect_list(F.struct("_pos", value))).alias("_rows"))
        values = F.transform("_rows", lambda e: e[value])
        return rows.filter(F.size("_rows") == size).select(
            *series.keys, "sample", F.slice(values, 1, past).alias("x"), F.slice(values, past + 1, future).alias("y"))

    def build(df, w):
        return df.withColumns({
            "x": F.collect_list(value).over(w.rowsBetween(-(past - 1), 0)),
            "y": F.collect_list(value).over(w.rowsBetween(1, future))})
    done = series.windowed(build, before=past - 1, after=future)
    return done.filter((F.size("x") == past) & (F.size("y") == future))


def forecasting_frame(series: Series, value: str, max_shift: int) -> DataFrame:
    """For each row, the up-to-``max_shift`` values before it as a group of their own."""
    def build(df, w):
        return df.withColumn("_past", F.collect_list(F.struct("_pos", value)).over(w.rowsBetween(-max_shift, -1)))
    rolled = series.windowed(build, before=max_shift).withColumnRenamed("_pos", "group_pos")
    return rolled.select(*series.keys, "group_pos", F.explode("_past").alias("_e")).select(
        *series.keys, "group_pos", F.col("_e._pos").alias("time"), F.col(f"_e.{value}").alias("value"))


def window_features(series: Series, value: str, max_shift: int) -> DataFrame:
    """Minimal summary of the values before each row, straight from frames."""
    def build(df, w):
        f, v = w.rowsBetween(-max_shift, -1), F.col(value)
        return df.withColumns({
            "f_sum": F.sum(v).over(f), "f_median": median_of(F.collect_list(v).over(f)), "f_mean": F.avg(v).over(f),
            "f_length": F.count(v).over(f), "f_std": F.stddev_pop(v).over(f), "f_var": F.var_pop(v).over(f),
            "f_rms": F.sqrt(F.avg(v * v).over(f)), "f_max": F.max(v).over(f), "f_min": F.min(v).over(f)})
    return series.windowed(build, before=max_shift).filter("f_length > 0")


def impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+inf to the column maximum, -inf to the minimum, null/NaN to the median of finite values."""
    inf = float("inf")
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != inf), F.col(c)) for c in columns}
    stats = df.agg(*[e for c in columns for e in (F.max(finite[c]).alias(f"_hi_{c}"), F.min(finite[c]).alias(f"_lo_{c}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite[c].cast("double").alias("v")) for c in columns])
    middles = exact_quantiles(df.select(F.inline(cells)), ["column"], F.col("v"), [0.5], "m").groupBy().agg(
        *[F.max(F.when(F.col("column") == c, F.col("m")[0])).alias(f"_md_{c}") for c in columns])
    stats = stats.crossJoin(middles)  # one row each
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({
        c: F.when(F.col(c) == inf, F.col(f"_hi_{c}")).when(F.col(c) == -inf, F.col(f"_lo_{c}"))
            .when(F.col(c).isNull() | F.isnan(c), F.col(f"_md_{c}")).otherwise(F.col(c)) for c in columns
    }).drop(*[f"_{k}_{c}" for c in columns for k in ("hi", "lo", "md")])


def normalised_window(window: Column, mode: str = "zscore_first") -> Column:
    """``(x - first) / std_pop`` or ``x / first - 1`` of an array."""
    first = F.element_at(window, 1)
    if mode == "zscore_first":
        sd = std_pop_of(window)
        return F.transform(window, lambda x: ratio(x - first, sd))
    return F.transform(window, lambda x: ratio(x, first) - 1)


def interval_features(window: Column, intervals: Sequence[tuple[int, int]]) -> Column:
    """Mean, deviation and least-squares slope of fixed sub-intervals of an array."""
    parts = []
    for start, length in intervals:
        part = F.slice(window, start + 1, length)
        centre = (length - 1) / 2
        sxx = sum((i - centre) ** 2 for i in range(length))
        weights = F.array(*[F.lit((i - centre) / sxx) for i in range(length)])
        parts += [mean_of(part), std_pop_of(part), dot(part, weights)]
    return F.array(*parts)


def window_acf(window: Column, width: int, lags: Sequence[int]) -> Column:
    """Autocorrelation of an array around its own mean."""
    mean = mean_of(window)
    centred = F.transform(window, lambda x: x - mean)
    total = dot(centred, centred)
    return F.array(*[ratio(dot(F.slice(centred, 1, width - k), F.slice(centred, k + 1, width - k)), total) for k in lags])


def autoregression(window: Column, order: int) -> Column:
    """Autoregressive coefficients of an array, lag 1 first, by the Levinson-Durbin recursion on its autocovariances.

    At most one coefficient less than values; null for null or constant arrays.
    """
    def fit(arrays: pd.Series) -> pd.Series:
        made: list = [None] * len(arrays)
        sizes = np.array([-1 if a is None else len(a) for a in arrays])
        for n in set(sizes.tolist()) - {-1, 0, 1}:           # arrays of one length at once
            at = np.flatnonzero(sizes == n)
            x = np.stack([arrays.iloc[i] for i in at]).astype(float)
            x = x - x.mean(axis=1, keepdims=True)
            last = min(order, n - 1)
            cov = np.stack([(x[:, k:] * x[:, :n - k]).sum(axis=1) for k in range(last + 1)], 1)
            phi, left = np.zeros((len(at), 0)), cov[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                for k in range(1, last + 1):
                    tail = ((cov[:, k] - (phi * cov[:, k - 1:0:-1]).sum(axis=1)) / left)[:, None]
                    phi, left = np.hstack([phi - tail * phi[:, ::-1], tail]), left * (1 - tail[:, 0] ** 2)
            for i, row in zip(at, phi):
                made[i] = row.tolist() if np.isfinite(row).all() else None
        return pd.Series(made, dtype=object)
    return F.pandas_udf(fit, "array<double>")(window)


def power_spectrum(window: Column, width: int) -> Column:
    """Squared Fourier amplitudes of an array of ``width`` values at the lower half of its frequencies.

    A product with fixed cosines and sines; null if a value is null.
    """
    turns = 2 * np.pi * np.outer(np.arange(width), np.arange(width // 2)) / width

    def amplitudes(arrays: pd.Series) -> pd.Series:
        known = np.array([a is not None and len(a) == width for a in arrays], bool)
        made: list = [None] * len(arrays)
        if known.any():
            x = np.stack(arrays[known].to_list()).astype(float)
            power = (x @ np.cos(turns)) ** 2 + (x @ np.sin(turns)) ** 2
            for i, row in zip(np.flatnonzero(known), power):
                made[i] = row.tolist() if np.isfinite(row).all() else None
        return pd.Series(made, dtype=object)
    return F.pandas_udf(amplitudes, "array<double>")(window)


def acf(series: Series, value: str, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation function of each whole series, long form."""
    keys = list(series.keys)
    means = series.df.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    centred = series.attach(series.df, means)
    shifted = series.derive(centred.withColumn("_d", F.col(value) - F.col("_mu")))
    products = shifted.windowed(lambda df, w: df.withColumns(
        {f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in lags}), before=max(lags))
    sums = products.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_v"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), ratio(F.col(f"_p{k}"), F.col("_v")).alias("acf"))
                      for k in lags])
    return sums.select(*keys, F.inline(pairs))


def pacf(acf_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial autocorrelations from the ACF table by the Durbin-Levinson recursion.

    Each group holds one number per lag.
    """
    keys = list(keys)
    fields = ", ".join(f"`{c}` {t}" for c, t in acf_table.select(*keys).dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        rho = np.r_[1.0, pdf["acf"].to_numpy()]
        phi, made = np.zeros(0), []
        for k in range(1, len(rho)):
            tail = (rho[k] - phi @ rho[k - 1:0:-1]) / (1 - phi @ rho[1:k]) if k > 1 else rho[1]
            phi = np.r_[phi - tail * phi[::-1], tail]
            made.append(tail)
        out = pdf[[*keys, "lag"]].copy()
        out["pacf"] = made
        return out

    grouped = acf_table.groupBy(*keys)
    return grouped.applyInPandas(solve, f"{fields}{', ' if keys else ''}lag long, pacf double")


def seasonal_decompose(series: Series, value: str, period: int) -> DataFrame:
    """Centred moving-average trend, additive seasonal means, residual."""
    half, keys = period // 2, list(series.keys)

    def build(df, w):
        v = F.col(value)
        inner = F.sum(v).over(w.rowsBetween(-half, half))
        if period % 2 == 0:
            inner = inner - (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2
        full = F.count(v).over(w.rowsBetween(-half, half)) == 2 * half + 1
        return df.withColumn("trend", F.when(full, inner / period))
    trended = series.windowed(build, before=half, after=half).withColumn("phase", F.col("_pos") % period)
    means = trended.groupBy(*keys, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_m"))
    centre = means.groupBy(*keys).agg(F.avg("_m").alias("_mm"))
    seasonal = series.attach(means, centre).select(
        *keys, "phase", (F.col("_m") - F.col("_mm")).alias("seasonal"))
    return trended.join(seasonal, [*keys, "phase"]).withColumn(
        "resid", F.col(value) - F.col("trend") - F.col("seasonal"))
