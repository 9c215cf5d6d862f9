"""Bars: grouping ticks by time, count, traded amount or order-flow imbalance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.series import Series


def _ohlcv(price: str, qty: str, at: Column) -> list[Column]:
    return [F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, at).alias("close"), F.sum(qty).alias("volume")]


def time_bars(df: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, qty: str,
              width_us: int, fill_gaps: bool = True) -> DataFrame:
    """Left-closed windows labelled by their right edge; gaps give null prices, zero volume."""
    keys = list(keys)
    edge = (F.floor(F.col(ts) / F.lit(width_us)) + 1).cast("long")
    bars = df.groupBy(*keys, edge.alias("_edge")).agg(*_ohlcv(price, qty, F.struct(ts, tie)))
    if fill_gaps:
        span = bars.groupBy(*keys).agg(F.min("_edge").alias("_a"), F.max("_edge").alias("_b"))
        grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("_edge"))
        bars = grid.join(bars, [*keys, "_edge"], "left").fillna({"volume": 0.0})
    return bars.withColumn("bar_ts", F.col("_edge") * F.lit(width_us)).drop("_edge")


def tick_bars(series: Series, ts: str, tie: str, price: str, qty: str, every: int) -> DataFrame:
    """Every ``every`` rows; labelled with the next bar's first row, so a bar without one is dropped."""
    keys, bar = list(series.keys), F.floor(F.col("_pos") / every).cast("long")
    bars = series.df.groupBy(*keys, bar.alias("bar")).agg(*_ohlcv(price, qty, F.col("_pos")))
    labels = series.df.filter((F.col("_pos") % every == 0) & (F.col("_pos") > 0)).select(
        *keys, (F.floor(F.col("_pos") / every) - 1).cast("long").alias("bar"),
        F.col(ts).alias("bar_ts"), F.col(tie).alias("bar_id"))
    return bars.join(labels, [*keys, "bar"])


def every_nth(series: Series, every: int) -> DataFrame:
    """Row sampling: the last row of each run of ``every`` rows."""
    return series.df.filter((F.col("_pos") + 1) % every == 0)


def amount_clock(threshold: float):
    """Accumulate; a row that reaches the threshold closes and resets to zero."""
    def kernel(state, fresh, arrays):
        acc = state[0]
        values = arrays["_amount"].tolist()
        hits = np.zeros(len(values), dtype="int32")
        for i, value in enumerate(values):
            acc += value
            if acc >= threshold:
                hits[i] = 1
                acc = 0.0
        return (acc,), {"_hits": hits}
    return kernel


class AmountExits:
    """What an amount clock does to the state over a run of rows, as a function of the state before it.

    The state decides the first row that reaches the threshold; from there on
    nothing depends on it. Reached rows follow from running sums: the row that
    closes a bar begun at row i is the first whose running sum exceeds the
    one before i by the threshold. Amounts must not be negative.
    """

    def __init__(self, threshold: float, reach: np.ndarray, states: np.ndarray, hits: np.ndarray, total: float):
        self.threshold, self.reach, self.states, self.hits, self.total = threshold, reach, states, hits, total

    def __call__(self, state: float) -> tuple[float, int]:
        at = int(np.searchsorted(self.reach, self.threshold - state))
        return (state + self.total, 0) if at == len(self.reach) else (float(self.states[at]), int(self.hits[at]))

    def packed(self) -> tuple:
        return self.threshold, self.reach, self.states, self.hits, self.total

    @staticmethod
    def unpacked(parts: tuple) -> "AmountExits":
        return AmountExits(*parts)


class amount_exits:
    """Describes rows of an amount clock (see ``Series.fold``)."""

    unpacked = staticmethod(AmountExits.unpacked)

    def __init__(self, threshold: float):
        self.threshold = threshold

    def untouched(self, state: float, total: float) -> bool:
        """Whether rows that sum up to ``total`` close no bar after ``state``."""
        return total < self.threshold - state

    def __call__(self, arrays: dict) -> AmountExits:
        values = arrays["_amount"].astype(float)
        if not (values >= 0).all():
            raise ValueError("amounts of a bar clock must not be negative or missing")
        n, sums = len(values), np.cumsum(values)
        before = np.concatenate([[0.0], sums])                      # sum before a bar that begins at row i
        closing = np.searchsorted(sums, before + self.threshold)    # its closing row; n: none
        closing = np.maximum(closing, np.arange(n + 1))
        last, hits = np.where(closing < n, closing + 1, np.arange(n + 1)), (closing < n).astype(np.int64)
        while True:                                                 # pointer jumping to the bar that stays open
            further = last[last]
            if (further == last).all():
                break
            hits, last = hits + hits[last], further
        # rows that can close the first bar: up to the one that does so from state zero
        rows = np.unique(np.searchsorted(sums, sums[:min(n, int(closing[0]) + 1)]))
        return AmountExits(self.threshold, sums[rows], sums[-1] - before[last[rows + 1]], 1 + hits[rows + 1], float(sums[-1]))


def amount_bars(series: Series, ts: str, price: str, qty: str, amount: Column, threshold: float) -> DataFrame:
    """Volume bars (``amount`` = quantity) and dollar bars (price times quantity).

    The overshoot is not carried over and a trailing open bar is dropped.
    """
    keys = list(series.keys)
    rows = series.with_columns({"_amount": amount}).fold(
        amount_clock(threshold), (0.0,), ["_amount"], {"_hits": "int"},
        keep=[*series.order, price, qty, "_amount"], exits=amount_exits(threshold))
    at = F.struct(*series.order)
    bars = rows.groupBy(*keys, F.col("_seq").alias("bar")).agg(
        *_ohlcv(price, qty, at), F.sum("_amount").alias("amount"), F.max(ts).alias("bar_ts"),
        F.max("_hits").alias("_done"))
    return bars.filter("_done = 1").drop("_done")


def amount_samples(series: Series, amount: Column, threshold: float, keep: Sequence[str]) -> DataFrame:
    """Row sampling: the rows at which the accumulated amount reached the threshold."""
    rows = series.with_columns({"_amount": amount}).fold(
        amount_clock(threshold), (0.0,), ["_amount"], {"_hits": "int"}, keep=keep, exits=amount_exits(threshold))
    return rows.filter("_hits = 1").drop("_hits").withColumnRenamed("_seq", "bar")


def tick_rule(series: Series, price: str, tolerance: float = 1e-3, name: str = "tick_sign") -> DataFrame:
    """Sign of each price change, carrying the last sign over flat moves (zero at the start)."""
    def build(df, w):
        move = F.col(price) - F.lag(price).over(w)
        flat = F.abs(move) <= F.greatest(
            F.lit(1e-9) * F.greatest(F.abs(move), F.lit(0.0)), F.lit(tolerance))
        return df.withColumn("_move", F.when(~flat, F.signum(move)))
    moved = series.windowed(build, before=1)
    carried = series.derive(moved)
    return carried.running({name: ("last", F.col("_move"))}).withColumn(
        name, F.coalesce(F.col(name), F.lit(0.0))).drop("_move")


def segments(series: Series, value: str, max_delta: float, persist: int = 0) -> DataFrame:
    """Cut where the value jumps by more than ``max_delta``; ``segment`` counts the cuts so far.

    With ``persist`` the jump must also show between the rows that far on either side.
    """
    def build(df, w):
        jump = F.abs(F.col(value) - F.lag(value).over(w)) > max_delta
        if persist:
            ahead = F.coalesce(F.lead(value, persist - 1).over(w), F.last(value).over(
                w.rowsBetween(0, persist - 1)))
            behind = F.lag(value, persist + 1).over(w)
            jump = jump & (F.abs(ahead - behind) > max_delta)
        return df.withColumn("_cut", F.when(jump, 1).otherwise(0))
    cut = series.windowed(build, before=persist + 1, after=persist)
    marked = series.derive(cut)
    return marked.running({"segment": ("sum", F.col("_cut"))}).drop("_cut")


def segment_lengths(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segmented.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n_rows"))


def since_previous(series: Series, ts: str, wrap_days: bool = False) -> DataFrame:
    """Whole seconds since the previous bar; ``wrap_days`` keeps only the part below a day."""
    def build(df, w):
        gap = F.floor((F.col(ts) - F.lag(ts).over(w)) / 1_000_000).cast("long")
        gap = gap % 86_400 if wrap_days else gap
        return df.withColumn("seconds_since", F.coalesce(gap, F.lit(0).cast("long")))
    return series.windowed(build, before=1)


# -- order-flow bars -----------------------------------------------------------

def tick_imbalance_clock(warmup: int, min_bar: int, max_bar: int):
    """Close when the signed tick count reaches E[length] * |E[sign]|.

    State: rows seen, E[length], E[sign], E[sign] including the open bar, sum
    of signs, last price, last sign, bar length, bar length without the
    closing row. Both expectations are exponentially weighted, spans
    ``warmup / 10`` (bars) and ``warmup`` (ticks).
    """
    a_len, a_sign = 2 / (warmup / 10 + 1), 2 / (warmup + 1)

    def kernel(state, fresh, arrays):
        seen, e_len, e_sign, shadow, theta, last, sign, length, open_rows = state
        prices = arrays["_price"].tolist()
        hits = np.zeros(len(prices), dtype="int32")
        live = np.zeros(len(prices), dtype="int32")
        for i, p in enumerate(prices):
            if seen < warmup:
                if seen > 0:
                    move = (p > last) - (p < last)
                    sign = float(move) if move else sign
                    e_sign = sign if seen == 1 else e_sign + a_sign * (sign - e_sign)
                last = p
                seen += 1
                if seen == warmup:
                    e_len, shadow, theta, sign, length, open_rows = float(warmup), e_sign, 0.0, 0.0, 0, 0
                continue
            live[i] = 1
            if length:
                move = (p > last) - (p < last)
                sign = float(move) if move else sign
                theta += sign
                shadow += a_sign * (sign - shadow)
            last = p
            length += 1
            if length >= min_bar and (abs(theta) >= e_len * abs(e_sign) or length > max_bar):
                hits[i] = 1
                e_len += a_len * (open_rows - e_len)
                e_sign = shadow
                theta, sign, length, open_rows = 0.0, 0.0, 0, 0
            else:
                open_rows += 1
        return (seen, e_len, e_sign, shadow, theta, last, sign, length, open_rows), {"_hits": hits, "_live": live}
    return kernel


def tick_imbalance_bars(series: Series, ts: str, price: str, qty: str, warmup: int = 100,
                        min_bar: int = 10, max_bar: int = 1000) -> DataFrame:
    """Volume leaves out the closing row, as the rule defines it."""
    keys = list(series.keys)
    rows = series.with_columns({"_price": F.col(price)}).relay(
        tick_imbalance_clock(warmup, min_bar, max_bar), (0.0,) * 9, ["_price"],
        {"_hits": "int", "_live": "int"}, keep=[*series.order, price, qty]).filter("_live = 1")
    at = F.struct(*series.order)
    bars = rows.groupBy(*keys, F.col("_seq").alias("bar")).agg(
        *_ohlcv(price, qty, at)[:4], F.sum(F.when(F.col("_hits") == 0, F.col(qty))).alias("volume"),
        F.max(ts).alias("bar_ts"), F.count(F.lit(1)).alias("n_ticks"), F.max("_hits").alias("_done"))
    return bars.filter("_done = 1").drop("_done").fillna({"volume": 0.0})


def flow_clock(first_length: float, flow_span: int, length_span: int, run: bool):
    """Imbalance and run bars with exponentially weighted expectations.

    Imbalance: close when |sum b*v| >= E[T] * |E[b*v]|. Run: close when the
    larger one-sided sum >= E[T] * max(P(buy) E[v|buy], (1-P(buy)) E[v|sell]).
    The first ``first_length`` ticks of a key only warm up the expectations
    and belong to no bar.
    """
    a_flow, a_len = 2 / (flow_span + 1), 2 / (length_span + 1)

    def kernel(state, fresh, arrays):
        seen, e_len, e_up, e_down, up, down, last, sign, length = state
        prices, amounts = arrays["_price"].tolist(), arrays["_amount"].tolist()
        hits = np.zeros(len(prices), dtype="int32")
        live = np.zeros(len(prices), dtype="int32")
        for i, (p, v) in enumerate(zip(prices, amounts)):
            if seen > 0:
                move = (p > last) - (p < last)
                sign = float(move) if move else sign
            last = p
            seen += 1
            buy, sell = (v if sign > 0 else 0.0), (v if sign < 0 else 0.0)
            if seen == 1:
                e_up, e_down, e_len = buy, sell, float(first_length)
            else:
                e_up += a_flow * (buy - e_up)
                e_down += a_flow * (sell - e_down)
            if seen <= first_length:
                continue
            live[i] = 1
            up += buy
            down += sell
            length += 1
            if run:
                reached = max(up, down) >= e_len * max(e_up, e_down)
            else:
                reached = abs(up - down) >= e_len * abs(e_up - e_down)
            if reached:
                hits[i] = 1
                e_len += a_len * (length - e_len)
                up, down, length = 0.0, 0.0, 0
        return (seen, e_len, e_up, e_down, up, down, last, sign, length), {"_hits": hits, "_live": live}
    return kernel


def flow_bars(series: Series, ts: str, price: str, qty: str, amount: Column, run: bool = False,
              first_length: int = 100, flow_span: int = 1000, length_span: int = 3) -> DataFrame:
    """Tick, volume or dollar imbalance/run bars; ``amount`` picks which."""
    keys = list(series.keys)
    rows = series.with_columns({"_price": F.col(price), "_amount": amount.cast("double")}).relay(
        flow_clock(first_length, flow_span, length_span, run), (0.0,) * 9, ["_price", "_amount"],
        {"_hits": "int", "_live": "int"}, keep=[*series.order, price, qty]).filter("_live = 1")
    at = F.struct(*series.order)
    bars = rows.groupBy(*keys, F.col("_seq").alias("bar")).agg(
        *_ohlcv(price, qty, at), F.max(ts).alias("bar_ts"), F.count(F.lit(1)).alias("n_ticks"),
        F.max("_hits").alias("_done"))
    return bars.filter("_done = 1").drop("_done")
