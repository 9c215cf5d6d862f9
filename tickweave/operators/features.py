"""Series features: fractional differences, stationarity tests, indicators, entropy, projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.operators.convolution import convolve, fractional_lags, rows_to_skip
from tickweave.operators.quantiles import exact_quantiles
from tickweave.operators.windows import decay_of, ewm, rolling
from tickweave.series import Series, lay_out

# -- fractional differences ------------------------------------------------------


def fraction_weights(d: float, threshold: float | None = None, size: int | None = None) -> np.ndarray:
    """Binomial weights of (1 - L)^d, newest first, cut below ``threshold`` or at ``size`` terms."""
    made = [1.0]
    while size is None or len(made) < size:
        k = len(made)
        w = -made[-1] * (d - k + 1) / k
        if threshold is not None and abs(w) < threshold:
            break
        made.append(w)
    return np.array(made)


def lag_weights(series: Series, d: float, name: str = "weight") -> DataFrame:
    """The weight with which each row enters the difference at its key's last row, and its lag ``k`` from there."""
    weigh = fractional_lags(d)

    @F.pandas_udf("double")
    def at(lags: pd.Series) -> pd.Series:
        return pd.Series(weigh(lags.to_numpy()))

    return series.with_length().df.withColumn("k", F.col("_n") - 1 - F.col("_pos")).withColumn(name, at("k")).drop("_n")


def frac_diff(series: Series, value: str, d: float, threshold: float = 1e-4, limit: int | None = None,
              pad: bool = False, name: str = "frac_diff") -> DataFrame:
    """Fixed-width fractional difference; the first ``width`` rows are null (zero with ``pad``)."""
    weights = fraction_weights(d, threshold, limit)
    width, keys = len(weights) - 1, list(series.keys)
    carried = [c for c in series.df.columns if c not in keys and c != "_pos"]
    fields = ", ".join(f"`{c}` {t}" for c, t in series.df.select(*keys, *carried).dtypes)

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(dtype=float)
        made = np.convolve(x, weights)[:len(x)]
        made[pdf["_pos"].to_numpy() < width] = 0.0 if pad else np.nan
        own = pdf["_own"].to_numpy()
        out = pdf.loc[own, [*keys, *carried, "_pos"]].copy()
        out[name] = made[own]
        return out

    out = series.per_chunk(convolve, carried, f"{fields}, _pos long, {name} double", before=width)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def frac_diff_expanding(series: Series, value: str, d: float, loss: float = 0.01, name: str = "frac_diff") -> DataFrame:
    """Expanding-window fractional difference: every row uses its whole past.

    Rows whose cumulative absolute weight still changes by more than ``loss``
    are left out. ``frac_diff`` is the fixed-width form.
    """
    skip = rows_to_skip(series.lengths(), d, loss)
    sums = convolve(series, F.col(value), fractional_lags(d), name)
    return series.df.join(sums, [*series.keys, "_pos"]).filter(F.col("_pos") >= skip)


def frac_diff_fft(series: Series, value: str, d: float, name: str = "frac_diff") -> DataFrame:
    """Fractional difference of whole keys: keys, ``_pos`` and the sum over each row's whole past, by Fourier transforms."""
    return convolve(series, F.col(value), fractional_lags(d), name)


# -- unit-root tests ---------------------------------------------------------------

# Published response-surface coefficients of the Dickey-Fuller
# distribution with a constant (one and two series), lowest order first.
TAU_SURFACE = {
    1: {"low": (2.1659, 1.4412, 0.038269), "high": (1.7339, 0.93202, -0.12745, -0.010368),
        "star": -1.61, "min": -18.83, "max": 2.74},
    2: {"low": (2.92, 1.5012, 0.039796), "high": (2.1945, 0.64695, -0.29198, -0.042377),
        "star": -2.62, "min": -16.18, "max": 0.92},
}
CRITICAL_5PCT = (-2.86154, -2.8903, -4.234, -40.04)


def unit_root_p(stat: float, n_series: int = 1) -> float:
    surface = TAU_SURFACE[n_series]
    if not math.isfinite(stat):
        return float("nan")
    if stat > surface["max"]:
        return 1.0
    if stat < surface["min"]:
        return 0.0
    terms = surface["low"] if stat <= surface["star"] else surface["high"]
    z = sum(c * stat ** i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _t_of_first(moments: np.ndarray, size: int) -> tuple[float, int]:
    """t statistic of the first regressor from packed [n, yy, X'y, X'X]."""
    n, yy, xy = int(moments[0]), moments[1], moments[2:2 + size]
    xx = moments[2 + size:].reshape(size, size)
    if n <= size:
        return float("nan"), n
    try:
        inverse = np.linalg.inv(xx)
    except np.linalg.LinAlgError:
        return float("nan"), n
    beta = inverse @ xy
    rss = yy - beta @ xy
    var = rss / (n - size) * inverse[0, 0]
    return (beta[0] / math.sqrt(var) if var > 0 else float("nan")), n


def _pack(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.r_[len(y), y @ y, x.T @ y, (x.T @ x).ravel()]


def adf(df: DataFrame, series: Series, value: str, lags: int = 1, constant: bool = True, n_series: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller test per key.

    The normal equations are Spark aggregates; only a handful of sums per key
    reach the solver. Values are centred first, which the constant absorbs.
    """
    keys = list(series.keys)
    means = series.df.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    centred = series.attach(series.df, means)
    shift = F.col("_mu") if constant else F.lit(0.0)
    base = series.derive(centred.withColumn("_y", F.col(value) - shift))

    def build(d, w):
        d = d.withColumns({"_l": F.lag("_y").over(w)}).withColumn("_dy", F.col("_y") - F.col("_l"))
        return d.withColumns({f"_d{k}": F.lag("_dy", k).over(w) for k in range(1, lags + 1)})
    rows = base.windowed(build, before=lags + 2).dropna(subset=["_dy", *[f"_d{k}" for k in range(1, lags + 1)]])
    x = [F.col("_l"), *[F.col(f"_d{k}") for k in range(1, lags + 1)], *([F.lit(1.0)] if constant else [])]
    y, size = F.col("_dy"), lags + 1 + int(constant)
    cells = [F.count(y).cast("double"), F.sum(y * y), *[F.sum(a * y) for a in x], *[F.sum(a * b) for a in x for b in x]]
    packed = rows.groupBy(*keys).agg(F.array(*cells).alias("_m"))
    return _solve_adf(packed, keys, size, n_series, lags)


def _solve_adf(packed: DataFrame, keys: Sequence[str], size: int, n_series: int, lags: int) -> DataFrame:
    fields = "".join(f"`{c}` {t}, " for c, t in packed.select(*keys).dtypes)

    def solve(batches):
        for pdf in batches:
            made = [_t_of_first(np.asarray(m, dtype=float), size) for m in pdf["_m"]]
            out = pdf[list(keys)].copy()
            out["adf_stat"] = [s for s, _ in made]
            out["p_value"] = [unit_root_p(s, n_series) for s, _ in made]
            out["lags"] = lags
            out["n_obs"] = [n for _, n in made]
            out["critical_5pct"] = [sum(c / max(n, 1) ** i for i, c in enumerate(CRITICAL_5PCT)) for _, n in made]
            yield out
    return packed.mapInPandas(solve, f"{fields}adf_stat double, p_value double, lags int, n_obs long, critical_5pct double")


def difference_scan(series: Series, value: str, orders: Sequence[float], threshold: float = 1e-4, limit: int | None = None,
                    lags: int = 1, pad: bool = True) -> DataFrame:
    """ADF of the fractional difference for every order, plus correlation with the original.

    Each chunk differences itself for all orders and returns only its sums,
    so the data is not copied per order.
    """
    keys = list(series.keys)
    weights = {float(d): fraction_weights(d, threshold, limit) for d in orders}
    reach = max(len(w) for w in weights.values()) - 1 + lags + 1
    fields = "".join(f"`{c}` {t}, " for c, t in series.df.select(*keys).dtypes)
    size = lags + 2

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        x, pos, own = pdf[value].to_numpy(dtype=float), pdf["_pos"].to_numpy(), pdf["_own"].to_numpy()
        rows = []
        for d, w in weights.items():
            width = len(w) - 1
            first = 0 if pad else width
            made = np.convolve(x, w)[:len(x)]
            made[pos < width] = 0.0
            dy = np.r_[0.0, np.diff(made)]
            use = own & (pos >= first + lags + 1)
            use[:lags + 1] = False
            at = np.flatnonzero(use)
            cols = [made[at - 1], *[dy[at - k] for k in range(1, lags + 1)], np.ones(len(at))]
            moments = _pack(dy[at], np.column_stack(cols)) if len(at) else np.zeros(2 + size + size * size)
            seen = own & (pos >= width)
            a, b = made[seen], x[seen]
            pair = [len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b]
            rows.append((d, np.r_[moments, pair].tolist()))
        out = pd.DataFrame(rows, columns=["d", "_p"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "d", "_p"]]

    parts = series.per_chunk(part, [value], f"{fields}d double, _p array<double>", before=reach)
    total_size = 2 + size + size * size + 6
    sums = parts.groupBy(*keys, "d").agg(F.array(*[F.sum(F.col("_p")[i]) for i in range(total_size)]).alias("_m"))
    cell = lambda i: F.col("_m")[2 + size + size * size + i]
    n = cell(0)
    corr = ratio(n * cell(5) - cell(1) * cell(2), F.sqrt(
        (n * cell(3) - cell(1) * cell(1)) * (n * cell(4) - cell(2) * cell(2))))
    corr_table = sums.select(*keys, "d", corr.alias("corr"))
    stats = _solve_adf(sums.withColumn("_m", F.slice("_m", 1, 2 + size + size * size)), [*keys, "d"], size, 1, lags)
    return stats.join(corr_table, [*keys, "d"])


def smallest_order(scan: DataFrame, keys: Sequence[str], p: float = 0.01) -> DataFrame:
    """First order whose difference passes the test, else the largest one tried."""
    return scan.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("p_value") < p, F.col("d"))), F.max("d")).alias("d"))


def cointegration(pairs: Series, a: str, b: str, lags: int = 1) -> DataFrame:
    """Engle-Granger: regress a on b, then test the residual for a unit root."""
    keys = list(pairs.keys)
    fit = pairs.df.groupBy(*keys).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"))
    joined = pairs.attach(pairs.df, fit)
    rest = pairs.derive(joined.withColumn("_resid", F.col(a) - F.col("slope") * F.col(b) - F.col("intercept")))
    tested = adf(rest.df, rest, "_resid", lags, constant=False, n_series=2)
    return pairs.attach(tested, fit)


def backward_sup_adf(series: Series, value: str, ts: str, shortest: int, constant: str = "c",
                     lags: int | Sequence[int] = 1, as_written: bool = False) -> DataFrame:
    """Largest ADF statistic of the level over all start points of windows ending at the last row.

    ``lags`` is the number of lagged differences or a list of their lags;
    ``as_written`` gives the t value of the first lagged difference instead
    (the literal form). Suffix moments come from one running sum over the
    reversed series; every start point is then an independent small solve.
    With a constant, level and trend are centred and the trend is scaled per
    key, which changes no t value but keeps the moments well conditioned.
    """
    keys = list(series.keys)
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    longest = max(lags, default=0)

    def build(d, w):
        d = d.withColumn("_dy", F.col(value) - F.lag(value).over(w)).withColumn("_lv", F.lag(value).over(w))
        return d.withColumns({f"_d{k}": F.lag("_dy", k).over(w) for k in lags})
    rows = series.windowed(build, before=longest + 2).dropna(subset=[f"_d{longest}" if lags else "_dy"])
    level, trend = F.col("_lv"), (F.col("_pos") - (longest + 1)).cast("double")
    if constant != "nc":
        middle = series.df.groupBy(*keys).agg(F.avg(value).alias("_mid_level"), F.max("_pos").alias("_last"))
        rows = series.attach(rows, middle)
        level, trend = level - F.col("_mid_level"), (2 * trend - F.col("_last")) / F.greatest("_last", F.lit(1))
    x = [F.col(f"_d{k}") for k in lags]
    x = [*x, level] if as_written else [level, *x]
    if constant != "nc":
        x.append(F.lit(1.0))
    if constant.startswith("ct"):
        x.append(trend)
    if constant == "ctt":
        x.append(trend * trend)
    size, y = len(x), F.col("_dy")
    cells = {"c0": F.lit(1.0), "c1": y * y}
    cells |= {f"c{2 + i}": a * y for i, a in enumerate(x)}
    cells |= {f"c{2 + size + i * size + j}": x[i] * x[j] for i in range(size) for j in range(size)}
    base = rows.select(*keys, (-F.col("_pos")).alias("_back"), *[v.alias(c) for c, v in cells.items()])
    back = lay_out(base, keys, ["_back"], series.chunk_rows)
    suffix = back.running({f"s{c}": ("sum", F.col(c)) for c in cells})
    usable = suffix.filter(F.col("sc0") >= shortest).select(*keys, F.array(*[f"s{c}" for c in cells]).alias("_m"))

    @F.pandas_udf("double")
    def stat(moments: pd.Series) -> pd.Series:
        return pd.Series([_t_of_first(np.asarray(m, dtype=float), size)[0] for m in moments])

    tested = usable.withColumn("_t", stat("_m"))
    ends = series.df.groupBy(*keys).agg(F.max(ts).alias("end_ts"))
    best = tested.filter(F.col("_t").isNotNull() & ~F.isnan("_t")).groupBy(*keys).agg(
        F.max("_t").alias("bsadf"), F.count(F.lit(1)).alias("n_starts"))
    return series.attach(best, ends)


# -- indicators -----------------------------------------------------------------------

def directional_index(series: Series, high: str, low: str, span: int) -> DataFrame:
    """Rounded share of upward moves, from highs and lows, exponentially weighted."""
    def build(df, w):
        up = F.col(high) - F.lag(high).over(w)
        down = F.lag(low).over(w) - F.col(low)
        return df.withColumns({
            "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    moves = series.windowed(build, before=1)
    base = series.derive(moves)
    keep = decay_of(span=span)
    up = ewm(base, "_up", keep, mean="_pos_di", std=None, min_periods=span)
    both = ewm(series.derive(up), "_dn", keep,
               mean="_neg_di", std=None, min_periods=span)
    return both.withColumn("rsi", F.bround(ratio(F.col("_pos_di") * 100.0, F.col("_pos_di") + F.col("_neg_di")))).drop(
        "_up", "_dn", "_pos_di", "_neg_di")


def bollinger(series: Series, price: str, span: int, width: float) -> DataFrame:
    out = ewm(series, price, decay_of(span=span), mean="band_mid", std="_sd")
    return out.withColumns({"band_upper": F.col("band_mid") + F.col("_sd") * width,
                            "band_lower": F.col("band_mid") - F.col("_sd") * width}).drop("_sd")


def crossover_side(series: Series, price: str, fast: int, slow: int) -> DataFrame:
    """+1 while the fast average is at or above the slow one, else -1; lagged one row."""
    def build(df, w):
        a, b = rolling(F.col(price), w, fast), rolling(F.col(price), w, slow)
        side = F.when(a >= b, 1).when(a < b, -1)
        return df.withColumns({"fast": a, "slow": b, "_s": side}).withColumn("side", F.lag("_s").over(w)).drop("_s")
    return series.windowed(build, before=slow)


def feature_matrix(series: Series, price: str, momenta: Sequence[int] = (1, 2, 3, 4, 5),
                   lags: Sequence[int] = (1, 2, 3, 4, 5), vols: Sequence[int] = (15, 31, 50)) -> DataFrame:
    """Momentum, lagged log returns and rolling volatilities, all shifted one row back."""
    names = [f"mom_{k}" for k in momenta] + [f"log_t{k}" for k in lags] + [f"vol_{k}" for k in vols]

    def build(df, w):
        p = F.col(price)
        df = df.withColumn("_lr", F.log(ratio(p, F.lag(p).over(w))))
        made = {f"mom_{k}": ratio(p, F.lag(p, k).over(w)) - 1 for k in momenta}
        made |= {f"log_t{k}": F.lag("_lr", k).over(w) for k in lags}
        made |= {f"vol_{k}": rolling(F.col("_lr"), w, k, F.stddev_samp) for k in vols}
        df = df.withColumns(made)
        return df.withColumns({c: F.lag(c).over(w) for c in names}).drop("_lr")
    return series.windowed(build, before=max(*momenta, *lags, *vols) + 2)


def quantile_bins(series: Series, value: str, bins: int) -> DataFrame:
    """Quantile bin of percent changes (exact quantiles) and its one-hot array."""
    moved = series.windowed(lambda df, w: df.withColumn(
        "change", ratio(F.col(value), F.lag(value).over(w)) - 1), before=1).filter("change IS NOT NULL")
    keys = list(series.keys)
    cuts = exact_quantiles(moved, keys, F.col("change"), [i / bins for i in range(bins + 1)], "_q")
    out = series.attach(moved, cuts)
    index = F.size(F.filter(F.slice("_q", 2, bins - 1), lambda q: q < F.col("change")))
    return out.withColumn("bin", index.cast("long")).withColumn(
        "one_hot", F.array(*[(F.col("bin") == i).cast("int") for i in range(bins)])).drop("_q")


# -- entropy of symbol sequences ----------------------------------------------------------

def match_entropy(data: Sequence, window: int | None = None) -> tuple[float, float, int]:
    """Entropy rate from match lengths, redundancy, and the number of points used.

    The match length of a point is one plus the longest run starting there
    that also starts in the entries before it (all, or the last ``window``).
    Common run lengths are built from the end backwards, a row at a time.
    """
    data = np.asarray(data)
    n = len(data)
    if n < 2:
        return float("nan"), float("nan"), 0
    width = None if window is None else min(window, n // 2)
    first, last = (1, n // 2) if width is None else (width, n - width)
    runs, total = np.zeros(n + 1, dtype=np.int64), 0.0
    for i in range(n - 1, first - 1, -1):
        runs = np.where(data[:i] == data[i], runs[1:i + 1] + 1, 0)
        if i <= last:
            reach = i if width is None else width
            best = min(int(runs[max(i - reach, 0):].max()), reach)
            total += math.log2(reach + 1) / (best + 1)
    points = last - first + 1
    h = total / points
    return h, 1 - h / math.log2(n), points


def window_entropies(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``match_entropy`` of each window ``data[first:end]``, for windows in order of their ends; NaN for fewer than two symbols.

    Windows that follow each other share their matches. Starts are taken from the last to the first: common run lengths
    of a start with each later point follow from those of the next start, and the longest run of a point grows with
    them. So a window costs a few passes over its first half.
    """
    n, rates = len(data), np.full(len(first), np.nan)
    size = end - first
    half = int(size.max(initial=0)) // 2
    if not half:
        return rates
    logs = np.array([math.log2(i + 1) for i in range(1, half + 1)])
    caps = np.arange(1, half + 1)
    runs = np.zeros(half + 2, dtype=np.int32)                  # by distance from the start
    best = np.zeros(n + half + 2, dtype=np.int32)              # by point, over all starts so far
    padded = np.r_[data, np.zeros(half + 1, dtype=data.dtype)]
    windows: dict[int, list[int]] = {}
    for w in np.flatnonzero(size >= 2):
        windows.setdefault(int(first[w]), []).append(int(w))
    low = min(windows, default=n)
    for s in range(n - 1, low - 1, -1):
        runs[1:half + 1] += 1
        runs[1:half + 1] *= padded[s + 1:s + half + 1] == data[s]
        beyond = n - 1 - s
        if beyond < half:
            runs[beyond + 1:] = 0
        np.maximum(best[s + 1:s + half + 1], runs[1:half + 1], out=best[s + 1:s + half + 1])
        held: dict[int, float] = {}
        for w in windows.get(s, ()):
            if int(end[w]) not in held:
                m = int(size[w]) // 2
                found = np.minimum(best[s + 1:s + m + 1], caps[:m])
                found = np.minimum(found, int(end[w]) - s - caps[:m])           # a run ends with the window
                held[int(end[w])] = float(np.cumsum((logs[:m] / (found + 1))[::-1])[-1]) / m
            rates[w] = held[int(end[w])]
    return rates


def dictionary_size(data: Sequence) -> int:
    """Number of phrases of the greedy incremental dictionary of a symbol sequence."""
    phrases, current = {(data[0],)} if len(data) else set(), ()
    for symbol in list(data)[1:]:
        current = (*current, symbol)
        if current not in phrases:
            phrases.add(current)
            current = ()
    return len(phrases)


def phrase_clock():
    """Greedy incremental dictionary: a row hits where its symbol ends a new phrase.

    State: the trie of phrases as (node, symbol number) to node, the symbol numbers, and the node of the open phrase.
    """
    def kernel(state, fresh, arrays):
        trie, numbers, node = state if state else ({}, {}, 0)
        hits = np.zeros(len(arrays["_symbol"]), dtype="int32")
        for i, symbol in enumerate(arrays["_symbol"].tolist()):
            step = node << 40 | numbers.setdefault(symbol, len(numbers))
            node = trie.get(step, 0)
            if not node:
                trie[step] = len(trie) + 1
                hits[i] = 1
        return (trie, numbers, node), {"_hits": hits}
    return kernel


def dictionary_of(series: Series, symbol: Column, rows: int | None = None) -> DataFrame:
    """``n_phrases``: size of the greedy dictionary of each key's whole sequence. A null is a symbol of its own.

    A phrase depends on all before it, so a key is read in order; runs of ``rows`` positions hand the trie on.
    """
    marked = series.with_columns({"_symbol": F.coalesce(symbol.cast("long"), F.lit(-(1 << 63)))}).relay(
        phrase_clock(), (), ["_symbol"], {"_hits": "int"}, rows=rows)
    return marked.groupBy(*series.keys).agg(F.sum("_hits").cast("long").alias("n_phrases"))


def entropy_rate(series: Series, symbol: Column, ts: str, span_us: int) -> DataFrame:
    """Match-length entropy of the values in the trailing ``span_us`` before each row, itself included.

    Rows earlier than one span after the key's first row are left out. The
    frame is cut by time, so rows are spread over buckets of one span and
    copied to the next bucket only; a bucket's windows are measured together
    (see ``window_entropies``). Null symbols are in no window, rows without a time are left out.
    """
    keys = list(series.keys)
    home = F.floor(F.col(ts) / span_us).cast("long")
    spread = series.df.filter(F.col(ts).isNotNull()).select(*keys, "_pos", F.col(ts).alias("_at"), symbol.cast("long").alias("_symbol"), home.alias("_home")).withColumn(
        "_bucket", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    # the numbers of a nullable column would lose digits
    marked = spread.select(*keys, "_bucket", "_pos", "_at", F.coalesce("_symbol", F.lit(0).cast("long")).alias("_symbol"),
                           F.col("_symbol").isNotNull().alias("_known"), (F.col("_home") == F.col("_bucket")).alias("_own"))
    kinds = dict(series.df.dtypes)

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_pos"])
        known, own = pdf[pdf["_known"]], pdf[pdf["_own"]]
        at, asked = known["_at"].to_numpy(), own["_at"].to_numpy()
        first, end = np.searchsorted(at, asked - span_us, side="left"), np.searchsorted(at, asked, side="right")
        out = own[[*keys, "_pos"]].copy()
        rates = window_entropies(known["_symbol"].to_numpy(), first, end)
        out["entropy_rate"] = pd.Series(rates, index=out.index).astype("Float64").mask(np.isnan(rates))
        return out

    # few bytes but long work: not to be put together by size
    dealt = marked.repartition(4 * series.df.sparkSession.sparkContext.defaultParallelism, *keys, "_bucket")
    rates = dealt.groupBy(*keys, "_bucket").applyInPandas(
        measured, "".join(f"`{c}` {kinds[c]}, " for c in keys) + "_pos long, entropy_rate double")
    starts = series.df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    ready = series.attach(series.df, starts).filter(F.col(ts) >= F.col("_start") + span_us).drop("_start")
    return ready.join(rates, [*keys, "_pos"])


# -- projections ---------------------------------------------------------------------------

def orthogonal_features(df: DataFrame, columns: Sequence[str], share: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    """Principal components of z-scored columns up to and including the one reaching ``share``.

    The Gram matrix is one aggregate; only columns-squared numbers reach the
    driver. Each component's largest loading is made positive.
    """
    k = len(columns)
    c = [F.col(x).cast("double") for x in columns]
    first = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)],
                   *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(c)]).first()
    z = [(x - F.lit(first[f"m{i}"])) / F.lit(first[f"s{i}"]) for i, x in enumerate(c)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in upper]).first()
    gram = np.zeros((k, k))
    for i, j in upper:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    values, vectors = np.linalg.eigh(gram)
    order = values.argsort()[::-1]
    values, vectors = values[order], vectors[:, order]
    dim = int(np.searchsorted(values.cumsum() / values.sum(), share)) + 1
    vectors = vectors[:, :dim] * np.sign(vectors[np.abs(vectors[:, :dim]).argmax(0), range(dim)])
    made = [sum((z[i] * float(vectors[i, j]) for i in range(k)), F.lit(0.0)).alias(f"pc_{j + 1}") for j in range(dim)]
    return df.select(*keep, *made)


def pca_pipeline(columns: Sequence[str], components: int):
    """Sorted columns, z-score, principal components, as an ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    return Pipeline(stages=[
        VectorAssembler(inputCols=sorted(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=components, inputCol="_scaled", outputCol="components")])


def relevant_features(df: DataFrame, columns: Sequence[str], label: str, rate: float = 0.05) -> list[str]:
    """Columns kept by a false-discovery-rate test of each feature against the label."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    vec = VectorAssembler(inputCols=list(columns), outputCol="_f").transform(df)
    picker = UnivariateFeatureSelector(featuresCol="_f", labelCol=label, outputCol="_o", selectionMode="fdr")
    picker = picker.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(rate)
    return [columns[i] for i in picker.fit(vec).selectedFeatures]


KERNEL_ROWS = 128       # arrays that meet the kernels of one shape at once; their outputs stay near the processor
FRAME_ROWS = 1024       # arrays whose features are handed over together


def random_kernels(length: int, count: int, sizes: Sequence[int] = (7, 9, 11), seed: int = 7) -> list[tuple]:
    """Seeded (weights, bias, dilation, padding) kernels, none longer than the array.

    A padded kernel gets half its reach at either side, so its output is as long as the array.
    """
    rng = np.random.default_rng(seed)
    fitting = [s for s in sizes if s <= length] or [length]
    made = []
    for _ in range(count):
        size = int(rng.choice(fitting))
        w = rng.normal(size=size)
        room = max((length - 1) // max(size - 1, 1), 1)
        dilation = int(2 ** rng.uniform(0, math.log2(room)))
        pad = (size - 1) * dilation // 2 if rng.integers(2) else 0
        made.append((w - w.mean(), float(rng.uniform(-1, 1)), dilation, pad))
    return made


def kernel_features(df: DataFrame, array: str, keep: Sequence[str], kernels: list[tuple], name: str = "features") -> DataFrame:
    """Maximum and share of positive outputs of each dilated convolution of an array column; a maximum that is not a number is null."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    alike: dict[tuple, list[int]] = {}
    for k, (w, _, dilation, pad) in enumerate(kernels):
        alike.setdefault((len(w), dilation, pad), []).append(k)
    groups = [(np.array(at), size, dilation, pad, np.column_stack([kernels[k][0] for k in at]), np.array([kernels[k][1] for k in at]))
              for (size, dilation, pad), at in alike.items()]

    def features(x: np.ndarray) -> np.ndarray:
        """Kernels of one shape share the places they look at: one matrix product for all of them."""
        made = np.empty((len(x), 2 * len(kernels)))
        for at, size, dilation, pad, weights, bias in groups:
            padded = np.pad(x, ((0, 0), (pad, pad)))
            span = padded.shape[1] - (size - 1) * dilation
            places = np.arange(span)[:, None] + np.arange(size) * dilation
            out = (padded[:, places].reshape(-1, size) @ weights).reshape(len(x), span, len(at))
            made[:, 2 * at], made[:, 2 * at + 1] = out.max(1) + bias, np.add.reduce(out > -bias, axis=1, dtype=np.int32) / span
        return made

    def convolve(batches):
        for batch in batches:
            pdf = batch.select([array]).to_pandas()
            x = np.vstack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            for start in range(0, len(x), FRAME_ROWS):
                stop = min(start + FRAME_ROWS, len(x))
                made = np.concatenate([features(x[i:min(i + KERNEL_ROWS, stop)]) for i in range(start, stop, KERNEL_ROWS)])
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, stop - start) for c in keep],
                                                  pa.ListArray.from_arrays(ends, pa.array(made.ravel(), from_pandas=True))], [*keep, name])
    return df.select(*dict.fromkeys([*keep, array])).mapInArrow(convolve, f"{fields}, {name} array<double>")


def nearest_by_warping(df: DataFrame, array: str, keep: Sequence[str], exemplars: list[tuple[str, list[float]]],
                       band: int | None = None) -> DataFrame:
    """Label of the exemplar with the smallest dynamic-time-warping distance.

    ``exemplars`` is a short list held by the caller; it travels with the task.
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def distances(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
        n, m = x.shape[1], len(ref)
        reach = max(band or max(n, m), abs(n - m))
        prev = np.full((len(x), m + 1), np.inf)
        prev[:, 0] = 0
        for i in range(1, n + 1):
            cur = np.full((len(x), m + 1), np.inf)
            for j in range(max(1, i - reach), min(m, i + reach) + 1):
                cost = (x[:, i - 1] - ref[j - 1]) ** 2
                cur[:, j] = cost + np.minimum(np.minimum(prev[:, j], cur[:, j - 1]), prev[:, j - 1])
            prev = cur
        return np.sqrt(prev[:, m])

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf[array].to_numpy()).astype(float)
            table = np.column_stack([distances(x, np.asarray(ref, dtype=float)) for _, ref in exemplars])
            best = table.argmin(1)
            out = pdf[list(keep)].copy()
            out["nearest"] = [exemplars[b][0] for b in best]
            out["distance"] = table[range(len(best)), best]
            yield out
    return df.select(*dict.fromkeys([*keep, array])).mapInPandas(score, f"{fields}, nearest string, distance double")
