"""Event sampling: cumulative-sum filters as reset recurrences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.series import Series


def fixed_threshold(threshold: float):
    """Raw price moves; the falling side is tested first and only the fired side resets."""
    def kernel(state, fresh, arrays):
        up, down, last = state
        prices = arrays["_price"].tolist()
        side = np.zeros(len(prices), dtype="int32")
        for i, p in enumerate(prices):
            if not (fresh and i == 0):
                move = p - last
                up, down = max(0.0, up + move), min(0.0, down + move)
                if down < -threshold:
                    down, side[i] = 0.0, -1
                elif up > threshold:
                    up, side[i] = 0.0, 1
            last = p
        return (up, down, last), {"side": side}
    return kernel


def moving_threshold(drift: float = 0.0):
    """Raw moves less drift; the threshold is only re-read when an event fires; rising side first."""
    def kernel(state, fresh, arrays):
        up, down, last, th, armed = state
        side = np.zeros(len(arrays["_price"]), dtype="int32")
        for i, (p, h) in enumerate(zip(arrays["_price"].tolist(), arrays["_h"].tolist())):
            if fresh and i == 0:
                last = p
                continue
            move, last = p - last, p
            if h is None or h != h:
                continue
            if not armed:
                th, armed = h, 1.0
            up, down = max(0.0, up + move - drift), min(0.0, down + move + drift)
            if up > th:
                up, th, side[i] = 0.0, h, 1
            elif down < -th:
                down, th, side[i] = 0.0, h, -1
        return (up, down, last, th, armed), {"side": side}
    return kernel


def absolute_log_moves(threshold: float):
    """Absolute log moves, leaving out the first one: only the rising side can fire."""
    def kernel(state, fresh, arrays):
        up, last, seen = state
        prices = arrays["_price"].tolist()
        side = np.zeros(len(prices), dtype="int32")
        logs = np.log(arrays["_price"].astype(float)).tolist()
        for i, p in enumerate(logs):
            if seen >= 2:
                up = max(0.0, up + abs(p - last))
                if up > threshold:
                    up, side[i] = 0.0, 1
            seen = min(seen + 1, 2)
            last = p
        return (up, last, seen), {"side": side}
    return kernel


def return_moves():
    """Changes of percent returns against a threshold per row; rising side first."""
    def kernel(state, fresh, arrays):
        up, down, last, last_ret, seen = state
        side = np.zeros(len(arrays["_price"]), dtype="int32")
        for i, (p, h) in enumerate(zip(arrays["_price"].tolist(), arrays["_h"].tolist())):
            if seen >= 1:
                ret = p / last - 1 if last else last_ret
                if seen >= 2 and h is not None and h == h:
                    move = ret - last_ret
                    up, down = max(0.0, up + move), min(0.0, down + move)
                    if up > h:
                        up, side[i] = 0.0, 1
                    elif down < -h:
                        down, side[i] = 0.0, -1
                last_ret = ret
            seen = min(seen + 1, 2)
            last = p
        return (up, down, last, last_ret, seen), {"side": side}
    return kernel


STATE_SIZE = {"fixed": 3, "moving": 5, "abs_log": 3, "returns": 5}


def cusum(series: Series, price: str, kind: str = "fixed", threshold: float | Column | None = None,
          drift: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Rows at which the filter fires, with the ``side`` that fired.

    ``threshold`` is a number, or a column for the kinds that read it per row.
    """
    kernels: dict[str, Callable] = {
        "fixed": lambda: fixed_threshold(threshold), "moving": lambda: moving_threshold(drift),
        "abs_log": lambda: absolute_log_moves(threshold), "returns": return_moves}
    columns = {"_price": F.col(price).cast("double")}
    reads = ["_price"]
    if kind in ("moving", "returns"):
        columns["_h"] = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double")
        reads.append("_h")
    rows = series.with_columns(columns).fold(
        kernels[kind](), (0.0,) * STATE_SIZE[kind], reads, {"side": "int"},
        keep=list(dict.fromkeys([*series.order, *keep])))
    return rows.filter("side <> 0")


def all_rows(series: Series, price: str) -> DataFrame:
    """The pass-through filter: every row with a price."""
    return series.df.filter(F.col(price).isNotNull())


FILTERS: dict[str, Callable] = {"cusum": cusum, "none": all_rows}
