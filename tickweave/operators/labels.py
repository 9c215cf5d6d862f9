"""Labels: barriers, fixed and volatility horizons, smoothed movement, trends."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.functions.arrays import one_hot
from tickweave.operators.joins import first_touch, price_at
from tickweave.series import Series
from tickweave.session import settle


def barrier_touches(series: Series, events: DataFrame, ids: Sequence[str], price: str, ts: str,
                    stop: float, profit: float) -> DataFrame:
    """Times at which the stop-loss and profit-taking barriers are first left.

    ``events`` carries p0, p1 (null: open end), entry, trgt, side. A
    coefficient of zero or less switches its barrier off.
    """
    widths = events.withColumns({
        "_low": F.col("trgt") * stop if stop > 0 else F.lit(None).cast("double"),
        "_up": F.col("trgt") * profit if profit > 0 else F.lit(None).cast("double")})
    return first_touch(series, widths, ids, price, ts, lower="_low", upper="_up")


def barrier_events(series: Series, events: DataFrame, ids: Sequence[str], price: str, ts: str,
                   stop: float, profit: float, min_target: float = 0.0) -> DataFrame:
    """First barrier of stop-loss, profit-taking and vertical; ties go in that order.

    ``events``: keys, ids, ``ts`` (start), p0, entry, trgt and optionally p1,
    t1 (vertical barrier) and side. Returns them with ``t_end``, ``type`` and the price there, ``exit_price``.
    """
    keys = list(series.keys)
    for name, filler in (("p1", F.lit(None).cast("long")), ("t1", F.lit(None).cast("long")), ("side", F.lit(1))):
        if name not in events.columns:
            events = events.withColumn(name, filler)
    # sampled events are few next to the bars but costly to derive, and are read several times below
    chosen = settle(events.filter(F.col("trgt") > min_target))
    touches = barrier_touches(series, chosen, ids, price, ts, stop, profit)
    out = chosen.join(touches, [*keys, *ids])
    end = F.least("t_lower", "t_upper", "t1")
    kind = (F.when(F.col("t_lower") == end, "sl").when(F.col("t_upper") == end, "tp")
            .when(F.col("t1") == end, "t1"))
    out = out.withColumns({"t_end": end, "type": kind})
    ends = series.df.select(*keys, F.col("_pos").alias("p1"), F.col(price).alias("_p1_price"))
    out = out.join(ends, [*keys, "p1"], "left")
    return out.withColumn("exit_price", F.when(F.col("type") == "sl", F.col("price_lower")).when(F.col("type") == "tp", F.col("price_upper"))
                          .otherwise(F.when(F.col("type") == "t1", F.col("_p1_price")))).drop("_p1_price", "price_lower", "price_upper")


def barrier_labels(bars: DataFrame, events: DataFrame, keys: Sequence[str], price: str, ts: str,
                   min_ret: float = 0.0, sign_label: bool = True, zero_label: int = 0, sided: bool = False,
                   tie: str | None = None) -> DataFrame:
    """Return and label of each event from its start to ``t_end``.

    With ``sided`` the return is multiplied by the side and anything not above
    ``min_ret`` gets ``zero_label``; else only moves within +-min_ret do. The
    price at the end is looked up in ``bars`` unless events carry ``exit_price``.
    """
    done = events.filter(F.col("t_end").isNotNull())
    if "exit_price" in events.columns:
        done = done.withColumn("_exit", F.col("exit_price")).drop("exit_price")
    else:
        done = price_at(bars, done, keys, ts, "t_end", price, "_exit", tie)
    ret = ratio(F.col("_exit"), F.col("entry")) - 1
    ret = ret * F.col("side") if sided else ret
    out = done.withColumn("ret", ret)
    flat = F.col("ret") <= min_ret if sided else F.abs(F.col("ret")) <= min_ret
    label = F.when(flat, zero_label).otherwise(F.signum("ret")).cast("int")
    if not sign_label:
        label = F.when(F.col("type") == "t1", zero_label).otherwise(label)
    return out.withColumn("label", label).drop("_exit")


def event_bins(labelled: DataFrame, sided: bool, vertical: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Bins from returns: {0, 1} with sides; {-1, 0, 1} without, 0 where the end is a vertical barrier time."""
    if sided:
        return labelled.withColumn("bin", F.when(F.col("ret") <= 0, 0).otherwise(F.signum("ret")).cast("int"))
    out = labelled.withColumn("bin", F.signum("ret").cast("int"))
    if vertical is None:
        return out
    marks = vertical.filter(F.col("t1").isNotNull()).select(*keys, F.col("t1").alias("t_end")).distinct().withColumn(
        "_vertical", F.lit(True))
    joined = out.join(marks, [*keys, "t_end"], "left")
    return joined.withColumn("bin", F.when(F.col("_vertical"), 0).otherwise(F.col("bin"))).drop("_vertical")


def touch_label(stop: Column, profit: Column) -> Column:
    """-1 if the stop comes first (or together), +1 if the profit does, 0 for neither."""
    first = F.least(stop, profit)
    return F.when(first.isNull(), 0).when(first == stop, -1).otherwise(1)


def smoothed_movement(series: Series, price: str, horizon: int, min_return: float) -> DataFrame:
    """Mean of the next ``horizon - 1`` rows against the mean of the last ``horizon + 1``."""
    def build(df, w):
        past = F.avg(price).over(w.rowsBetween(-horizon, 0))
        ahead = F.avg(price).over(w.rowsBetween(1, horizon - 1))
        n_ahead = F.count(price).over(w.rowsBetween(1, horizon))
        move = ratio(ahead - past, past)
        label = F.when(move > min_return, 1).when(move < -min_return, -1).otherwise(0)
        return df.withColumns({"movement": move, "label": label, "_ahead": n_ahead})
    done = series.windowed(build, before=horizon, after=horizon)
    return done.filter((F.col("_pos") >= horizon) & (F.col("_ahead") == horizon)).drop("_ahead")


def horizon_label(df: DataFrame, w, price: str, horizon: int, threshold: Column) -> DataFrame:
    """Return after ``horizon`` rows against +-threshold."""
    ret = ratio(F.lead(price, horizon).over(w) - F.col(price), F.col(price))
    df = df.withColumn("fwd_ret", ret)
    return df.withColumn("label", F.when(F.col("fwd_ret").isNull() | threshold.isNull(), None)
                         .when(F.col("fwd_ret") > threshold, 1).when(F.col("fwd_ret") < -threshold, -1).otherwise(0))


def meta_barrier(series: Series, price: str, horizon: int, threshold: Column, profit: float, stop: float,
                 vertical_zero: bool = True) -> DataFrame:
    """Direction of the later minimum-return crossing in the next rows, and whether to act on it.

    ``threshold`` is evaluated on columns of the series. Direction 0 is up, 1
    down, 2 (only with ``vertical_zero``) neither.
    """
    def build(df, w):
        df = df.withColumn("_w", F.collect_list(price).over(w.rowsBetween(0, horizon - 1)))
        return df.withColumn("_th", threshold)
    rows = series.windowed(build, after=horizon - 1).filter((F.size("_w") == horizon) & F.col("_th").isNotNull())
    rows = rows.withColumn("_d", F.transform("_w", lambda p: ratio(p - F.col(price), F.col(price))))
    up_at = F.array_position(F.transform("_d", lambda d: d >= F.col("_th")), True)
    down_at = F.array_position(F.transform("_d", lambda d: d < -F.col("_th")), True)
    rows = rows.withColumns({"_up": F.nullif(up_at, F.lit(0)), "_dn": F.nullif(down_at, F.lit(0))})
    neither = F.lit(2) if vertical_zero else F.when(F.element_at("_d", -1) > 0, 0).otherwise(1)
    # a side that is never crossed counts as infinitely late
    direction = (F.when(F.col("_up").isNull() & F.col("_dn").isNull(), neither)
                 .when(F.col("_up").isNull(), 0).when(F.col("_dn").isNull(), 1)
                 .when(F.col("_up") > F.col("_dn"), 0).otherwise(1))
    rows = rows.withColumn("direction", direction)
    wins, losses = F.exists("_d", lambda d: d >= profit), F.exists("_d", lambda d: d < stop)
    act = ((F.col("direction") == 0) & wins) | ((F.col("direction") == 1) & losses)
    return rows.withColumn("take_action", act.cast("int")).drop("_w", "_th", "_d", "_up", "_dn")


def window_barrier(series: Series, price: str, horizon: int, profit: float, stop: float) -> DataFrame:
    """+1 if the next ``horizon`` rows exceed the profit level, else -1 if they fall below the stop, else 0."""
    def build(df, w):
        f = w.rowsBetween(0, horizon)
        up, down = (ratio(e.over(f), F.col(price)) - 1 for e in (F.max(price), F.min(price)))
        return df.withColumn("label", F.when(up > profit, 1).when(down < stop, -1).otherwise(0))
    return series.windowed(build, after=horizon)


def trend_scan(series: Series, price: str, shortest: int = 10, longest: int = 20, split: float = 3.0,
               keep: Sequence[str] = ()) -> DataFrame:
    """t value of the strongest linear trend over the next ``shortest``..``longest`` rows, and its class.

    Classes: 0 below -split, 1 between, 2 above. Rows without ``longest`` rows
    ahead are left out. Every regression is closed-form from cumulative sums
    along the window, for all windows of a chunk at once.
    """
    keys, carried = list(series.keys), list(dict.fromkeys([*series.order, *keep]))
    fields = "".join(f"`{c}` {t}, " for c, t in series.df.select(*keys, *carried).dtypes)
    sizes = np.arange(shortest, longest + 1, dtype=float)
    sx, sxx = sizes * (sizes - 1) / 2, sizes * (sizes * sizes - 1) / 12

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        y, own = pdf[price].to_numpy(dtype=float), pdf["_own"].to_numpy()
        t_value, rows_used = np.zeros(len(y)), np.zeros(len(y), dtype="int32")
        whole = np.zeros(len(y), dtype=bool)
        if len(y) >= longest:
            windows = np.lib.stride_tricks.sliding_window_view(y, longest)
            for lo in range(0, len(windows), 65_536):
                w = windows[lo:lo + 65_536]
                w = w - w[:, :1]  # a trend test is blind to the level
                tail = slice(shortest - 1, longest)
                sy = np.cumsum(w, 1)[:, tail]
                syy = np.cumsum(w * w, 1)[:, tail]
                cxy = np.cumsum(w * np.arange(longest), 1)[:, tail] - sy * sx / sizes
                cyy = syy - sy * sy / sizes
                rss = cyy - cxy * cxy / sxx
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(rss <= 1e-12 * np.abs(cyy), 0.0, cxy / sxx / np.sqrt(rss / (sizes - 2) / sxx))
                best = np.abs(t).argmax(1)
                at = slice(lo, lo + len(w))
                t_value[at], rows_used[at], whole[at] = t[range(len(w)), best], sizes[best].astype("int32"), True
        use = own & whole
        out = pdf.loc[use, [*keys, *carried]].copy()
        out["t_value"], out["trend_rows"] = t_value[use], rows_used[use]
        out["label"] = np.where(t_value[use] < -split, 0, np.where(t_value[use] > split, 2, 1)).astype("int32")
        return out

    return series.per_chunk(scan, list(dict.fromkeys([*carried, price])), f"{fields}t_value double, trend_rows int, label int",
                            after=longest - 1)


def zero_based(label: Column) -> Column:
    """{-1, 0, 1} to {0, 1, 2}."""
    return (label + 1).cast("int")


def three_class_one_hot(label: Column) -> Column:
    return one_hot(zero_based(label), 3)


def two_class_one_hot(label: Column) -> Column:
    """{0, 1} to [1, 0] / [0, 1]."""
    return one_hot(label, 2)


def tune_target(df: DataFrame, target: str, min_ret: float, scale: float = 10.0) -> DataFrame:
    """Scale a target series until its minimum just exceeds ``min_ret``.

    Only the minimum decides the factor, so one number is brought to the
    driver; a non-positive minimum is left unscaled.
    """
    low = df.agg(F.min(target)).first()[0]
    if low is None or low <= 0:
        return df
    gap = min_ret / (low * scale)
    if gap > 1:
        factor = scale * 1.05 ** _steps_over(gap, 1.05)
    else:
        below = 0.95 ** _steps_over(1 / gap, 1 / 0.95)
        factor = scale * below * 1.01 ** _steps_over(gap / below, 1.01)
    return df.withColumn(target, F.col(target) * factor)


def _steps_over(gap: float, ratio: float) -> int:
    """Smallest number of multiplications by ``ratio`` (above 1) that reaches ``gap``."""
    near = max(0, round(math.log(gap) / math.log(ratio)))
    return next(k for k in (near - 1, near, near + 1) if k >= 0 and ratio ** k >= gap * (1 - 1e-12))
