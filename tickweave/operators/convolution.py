"""Convolution of whole series by a Fourier transform dealt over tasks.

A key of n rows is padded to N = rows x columns, a power of two of at least 2n,
and position t is cell (t // columns, t % columns). One task transforms a band
of columns, the next stage a band of rows, where signal and kernel are
multiplied and transformed back, and a last stage the columns again. Between
the stages only tiles of the two bands' crossings are shuffled, so three
shuffles of N numbers do for any length, and a task holds about ``BAND_CELLS``
cells. The kernel is a function of the lag, evaluated inside the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.series import Series
from tickweave.session import stored

ONE_STEP_BITS = 14         # transforms up to this size are one column
BAND_CELLS = 1 << 18


def shape(n: int) -> tuple[int, int]:
    """Rows and columns of the padded transform of ``n`` values."""
    bits = max(2 * int(n) - 1, 1).bit_length()
    across = bits // 2 if bits > ONE_STEP_BITS else 0
    return 1 << (bits - across), 1 << across


def _band(length: int) -> int:
    """How many lines of ``length`` cells make a band."""
    return max(1, BAND_CELLS // length)


def fractional_lags(d: float) -> Callable[[np.ndarray], np.ndarray]:
    """The binomial weight of (1 - L)^d at any lag: exact products first, then their asymptotic series."""
    head = np.cumprod(np.r_[1.0, (np.arange(1023) - d) / np.arange(1, 1024)])
    whole = d >= 0 and float(d).is_integer()
    scale = 0.0 if whole else 1 / math.gamma(-d)

    def at(lags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lags))
        near = lags < len(head)
        out[near] = head[lags[near]]
        if not whole:
            # the ratio of two gamma functions, expanded around the middle of their arguments
            u = lags[~near] - d / 2
            out[~near] = scale * u ** (-d - 1) * (1 + d * (d + 1) * (d + 2) / 24 / u**2
                                                  + d * (d + 1) * (d + 2) * (d + 3) * (d + 4) * (5 * d - 2) / 5760 / u**4)
        return out
    return at


def absolute_weight(d: float, terms: int) -> float:
    """Sum of the absolute binomial weights of the first ``terms`` lags, in closed form beyond the first thousand."""
    head = np.cumprod(np.r_[1.0, (np.arange(1023) - d) / np.arange(1, 1024)])
    if terms <= len(head):
        return float(np.abs(head[:terms]).sum())
    # the weights of (1 - L)^(d - 1) are running sums of those of (1 - L)^d, whose signs agree beyond the head
    last = fractional_lags(d - 1)(np.array([terms - 1]))[0]
    return float(np.abs(head).sum() + abs(last - head.sum()))


def convolve(series: Series, value: Column, lags: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``name``: for each row the sum over its whole past of ``lags(k)`` times the value k rows before.

    Keys and ``_pos`` with the sums are returned. A null or NaN value makes its whole key null, as one transform does.
    """
    keys = list(series.keys)
    lengths = series.lengths() if keys else series.df.agg(F.count(F.lit(1)).alias("_n"))
    rows = series.attach(series.df.select(*keys, "_pos", value.cast("double").alias("_x")), lengths)
    kinds = dict(rows.dtypes)
    fields = "".join(f"`{c}` {kinds[c]}, " for c in keys)

    @F.pandas_udf("long")
    def column_band(pos: pd.Series, n: pd.Series) -> pd.Series:
        shapes = {v: shape(v) for v in n.unique()}
        return pd.Series([p % shapes[v][1] // _band(shapes[v][0]) for p, v in zip(pos, n)], dtype="int64")

    def tiles(pdf: pd.DataFrame, n: int, band: int, made: list[np.ndarray], high: int) -> pd.DataFrame:
        """Cut arrays of (row, column of the band) into bands of rows."""
        out = pd.DataFrame({"_n": n, "_from": band, "_to": np.arange(-(-made[0].shape[0] // high))})
        for i, array in enumerate(made):
            out[f"_t{i}"] = [np.ascontiguousarray(array[lo:lo + high]).tobytes() for lo in range(0, array.shape[0], high)]
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "_n", "_from", "_to", *[f"_t{i}" for i in range(len(made))]]]

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["_n"].iloc[0]), int(pdf["_band"].iloc[0])
        high, wide = shape(n)
        columns = np.arange(band * _band(high), min((band + 1) * _band(high), wide))
        pos = pdf["_pos"].to_numpy()
        x = np.zeros((high, len(columns)))
        x[pos // wide, pos % wide - columns[0]] = pdf["_x"].to_numpy(dtype=float)
        lag = (np.arange(high)[:, None] * wide + columns).ravel()
        w = np.where(lag < n, lags(np.minimum(lag, n - 1)), 0.0).reshape(x.shape)
        turn = np.exp(-2j * np.pi * np.outer(np.arange(high // 2 + 1), columns) / (high * wide))
        return tiles(pdf, n, band, [np.fft.rfft(x, axis=0) * turn, np.fft.rfft(w, axis=0) * turn], _band(wide))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["_n"].iloc[0]), int(pdf["_to"].iloc[0])
        high, wide = shape(n)
        pdf = pdf.sort_values("_from")
        count = min((band + 1) * _band(wide), high // 2 + 1) - band * _band(wide)
        both = [np.hstack([np.frombuffer(t, complex).reshape(count, -1) for t in pdf[c]]) for c in ("_t0", "_t1")]
        made = np.fft.ifft(np.fft.fft(both[0], axis=1) * np.fft.fft(both[1], axis=1), axis=1)
        made *= np.exp(2j * np.pi * np.outer(np.arange(band * _band(wide), band * _band(wide) + count), np.arange(wide)) / (high * wide))
        return tiles(pdf, n, band, [made.T], _band(high))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["_n"].iloc[0]), int(pdf["_to"].iloc[0])
        high, wide = shape(n)
        first = band * _band(high)
        count = min(first + _band(high), wide) - first
        spectrum = np.vstack([np.frombuffer(t, complex).reshape(count, -1).T for t in pdf.sort_values("_from")["_t0"]])
        values = np.fft.irfft(spectrum, high, axis=0)
        pos = np.arange(high)[:, None] * wide + np.arange(first, first + count)
        whole = pos < n
        out = pd.DataFrame({"_pos": pos[whole], name: values[whole]})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "_pos", name]]

    head = f"{fields}_n long, _from long, _to long, _t0 binary"
    by_column = stored(rows.withColumn("_band", column_band("_pos", "_n")).groupBy(*keys, "_band").applyInPandas(down, head + ", _t1 binary"))
    by_row = by_column.groupBy(*keys, "_to").applyInPandas(across, head)
    sums = by_row.groupBy(*keys, "_to").applyInPandas(up, f"{fields}_pos long, {name} double")
    return sums.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def rows_to_skip(lengths: DataFrame, d: float, loss: float) -> int:
    """How many lags of the longest key have a share of the absolute weight above ``loss``, the nearest lags first."""
    longest = int(lengths.agg(F.max("_n")).first()[0] or 0)
    if not longest:
        return 0
    total, low, high = absolute_weight(d, longest), 1, longest + 1
    while low < high:                       # shares grow with the lag
        middle = (low + high) // 2
        low, high = (low, middle) if middle > longest or absolute_weight(d, middle) / total > loss else (middle + 1, high)
    return longest - low + 1


__all__: Sequence[str] = ["absolute_weight", "convolve", "fractional_lags", "rows_to_skip", "shape"]
