"""Scalar restatements and invariants for operators without a SQL statement."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.functions import scalars as S
from tickweave.operators import aggregates as G
from tickweave.operators import bars as B
from tickweave.operators import book as BK
from tickweave.operators import features as X
from tickweave.operators import labels as L
from tickweave.operators import splits as SP
from tickweave.operators import weights as WT
from tickweave.operators import windows as W
from tickweave.series import lay_out

KEYS, ORDER = ["symbol"], ["ts", "id"]


@pytest.fixture(scope="module")
def series(spark, skewed):
    return lay_out(skewed, KEYS, ORDER, 97, 5)


@pytest.fixture(scope="module")
def hot(series):
    return series.df.filter("symbol = 'hot'").orderBy("_pos").toPandas()


def test_ewm_matches_pandas(series, hot):
    got = W.ewm(series, "price", W.decay_of(span=15)).filter("symbol = 'hot'").orderBy("_pos").toPandas()
    e = hot["price"].ewm(span=15)
    assert np.allclose(got["ewm_mean"], e.mean())
    assert np.allclose(got["ewm_std"].iloc[1:], e.std().iloc[1:])


def test_autocorrelation_matches_pandas(series, hot):
    got = W.rolling_autocorr(series, "price", 30, [1, 3]).filter("symbol = 'hot'").orderBy("_pos").toPandas()
    logs = np.log(hot["price"]).diff()
    for k in (1, 3):
        want = logs.rolling(30).apply(lambda x: x.autocorr(lag=k), raw=False)
        assert np.allclose(got[f"autocorr_{k}"], want, equal_nan=True, atol=1e-8)


def test_tick_imbalance_bars_match_a_plain_loop(series, hot):
    warm, low, high = 60, 5, 80
    p, q, ts = hot["price"].tolist(), hot["qty"].tolist(), hot["ts"].tolist()

    def signs(x):
        s = np.sign(np.diff(x))
        for i in range(1, len(s)):
            s[i] = s[i] if s[i] else s[i - 1]
        return s.tolist()

    def ewma(x, span):
        a, y = 2 / (span + 1), x[0]
        for v in x[1:]:
            y += a * (v - y)
        return y
    lengths, all_signs, bars, buf, vol, open_rows = [warm], signs(p[:warm]), [], [], [], 0
    for i in range(warm, len(p)):
        buf.append(p[i])
        b = signs(buf)
        limit = ewma(lengths, warm / 10) * abs(ewma(all_signs, warm))
        if (abs(sum(b)) >= limit or len(buf) > high) and len(buf) >= low:
            bars.append((ts[i], buf[0], max(buf), min(buf), buf[-1], sum(vol)))
            lengths.append(open_rows)
            all_signs += b
            buf, vol, open_rows = [], [], 0
        else:
            vol.append(q[i])
            open_rows += 1
    got = B.tick_imbalance_bars(series, "ts", "price", "qty", warm, low, high).filter("symbol = 'hot'").orderBy("bar").toPandas()
    assert len(got) == len(bars) > 5
    assert np.allclose(got[["bar_ts", "open", "high", "low", "close", "volume"]].to_numpy(float), np.array(bars, dtype=float))


def test_volume_is_conserved_across_bars(series, hot):
    bars = B.amount_bars(series, "ts", "price", "qty", F.col("qty"), 120).filter("symbol = 'hot'").toPandas()
    last = hot[hot["ts"] <= bars["bar_ts"].max()]
    assert (bars["volume"] >= 120).all()
    assert bars["volume"].sum() <= last["qty"].sum()
    assert hot["qty"].sum() - bars["volume"].sum() < 120


def test_flow_bars_do_not_depend_on_partitioning(spark, skewed):
    made = []
    for parts in (1, 9):
        s = lay_out(skewed, KEYS, ORDER, 97, parts)
        for run in (False, True):
            made.append(B.flow_bars(s, "ts", "price", "qty", F.col("price") * F.col("qty"), run, 40)
                        .orderBy("symbol", "bar").toPandas())
    pd.testing.assert_frame_equal(made[0], made[2])
    pd.testing.assert_frame_equal(made[1], made[3])
    assert len(made[0]) > 3


def test_frac_diff_forms_agree(series, hot):
    w = X.fraction_weights(0.4, 1e-3)
    got = X.frac_diff(series, "price", 0.4, 1e-3).filter("symbol = 'hot'").orderBy("_pos").toPandas()["frac_diff"]
    x = hot["price"].to_numpy()
    want = [np.dot(w, x[i - len(w) + 1:i + 1][::-1]) if i >= len(w) - 1 else np.nan for i in range(len(x))]
    assert np.allclose(got, want, equal_nan=True)
    wide = X.frac_diff_expanding(series, "price", 0.4, loss=1.0).filter("symbol = 'hot'").orderBy("_pos").toPandas()
    full = np.convolve(x, X.fraction_weights(0.4, size=len(x)))[:len(x)]
    assert np.allclose(wide["frac_diff"], full[wide["_pos"]])


def test_unit_root_statistic_matches_least_squares(series, hot):
    row = X.adf(series.df, series, "price", lags=2).filter("symbol = 'hot'").first()
    y = hot["price"].to_numpy()
    d = np.diff(y)
    x = np.column_stack([y[2:-1], d[1:-1], d[:-2], np.ones(len(d) - 2)])
    beta, rss, *_ = np.linalg.lstsq(x, d[2:], rcond=None)
    sigma = rss[0] / (len(x) - 4) * np.linalg.inv(x.T @ x)[0, 0]
    assert math.isclose(row["adf_stat"], beta[0] / math.sqrt(sigma), rel_tol=1e-6)
    assert row["n_obs"] == len(x)
    assert X.unit_root_p(-2.8615) == pytest.approx(0.05, abs=2e-3)  # published 5% point


def test_difference_scan_equals_single_tests(series):
    scan = X.difference_scan(series, "price", [0.0, 0.5, 1.0], 1e-3, pad=False).filter("symbol = 'hot'").toPandas().set_index("d")
    plain = X.adf(series.df, series, "price", lags=1).filter("symbol = 'hot'").first()
    assert scan.at[0.0, "adf_stat"] == pytest.approx(plain["adf_stat"], rel=1e-6)
    assert scan.at[0.0, "corr"] == pytest.approx(1.0)
    assert scan.at[1.0, "adf_stat"] < scan.at[0.0, "adf_stat"]


def test_smallest_order_scans_the_whole_grid(monkeypatch):
    from tickweave.plans import feature_queries as Q
    seen = []
    monkeypatch.setattr(Q, "_logs", lambda spark, folder: None)
    monkeypatch.setattr(X, "difference_scan", lambda s, value, orders, threshold: seen.append((orders, threshold)))
    monkeypatch.setattr(X, "smallest_order", lambda scan, keys: None)
    Q.smallest_stationary_order(None, None)
    assert np.allclose(seen[0][0], np.linspace(0, 1, 100)) and seen[0][1] == 1e-5


def test_sup_statistic_matches_brute_force(series, hot):
    row = X.backward_sup_adf(series, "price", "ts", 1900, "ct", lags=1).filter("symbol = 'hot'").first()
    y = hot["price"].to_numpy()
    d = np.diff(y)
    dep, lag1, lev = d[1:], d[:-1], y[1:-1]
    trend = np.arange(len(dep))
    best = -np.inf
    for start in range(0, len(dep) - 1900 + 1):
        x = np.column_stack([lev, lag1, np.ones(len(dep)), trend])[start:]
        inv = np.linalg.inv(x.T @ x)
        beta = inv @ x.T @ dep[start:]
        err = dep[start:] - x @ beta
        best = max(best, beta[0] / math.sqrt(err @ err / (len(x) - 4) * inv[0, 0]))
    assert row["bsadf"] == pytest.approx(best, rel=1e-5)


def test_entropy_and_dictionary():
    assert X.dictionary_size(list("aababcabcd")) == len({"a", "ab", "abc", "abcd"})
    h, redundancy, n = X.match_entropy([0, 0, 0, 0, 0, 0, 0, 0])
    assert n == 4 and h < 1.3 and redundancy == pytest.approx(1 - h / 3)


def test_orthogonal_features_are_uncorrelated(spark, skewed):
    df = skewed.withColumn("mix", F.col("price") * 2 + F.col("qty"))
    out = X.orthogonal_features(df, ["price", "qty", "mix"], 0.99, ["id"]).toPandas()
    c = np.corrcoef(out[["pc_1", "pc_2"]].to_numpy().T)
    assert abs(c[0, 1]) < 1e-9


def test_risk_parity_weights(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 4))
    base[:, 1] = base[:, 0] + 0.1 * base[:, 1]
    pdf = pd.DataFrame(base, columns=list("abcd")).stack().reset_index()
    pdf.columns = ["t", "asset", "ret"]
    weights = G.risk_parity(G.asset_moments(spark.createDataFrame(pdf), "t", "asset", "ret", list("abcd")), []).toPandas()
    assert weights["weight"].sum() == pytest.approx(1.0)
    w = weights.set_index("asset")["weight"]
    assert w["a"] + w["b"] < w["c"] + w["d"]


def test_normal_distribution(spark):
    row = spark.range(1).select(S.normal_cdf(F.lit(1.96)).alias("a"), S.bet_size(F.lit(0.5)).alias("b"), S.bet_size(F.lit(1.0)).alias("c")).first()
    assert row.a == pytest.approx(0.9750021) and row.b == 0.0 and row.c == pytest.approx(0.6826895)


def test_folds_cover_rows_and_never_overlap(spark, series):
    base = lay_out(series.df.select("symbol", "id", F.col("ts").alias("t0"), (F.col("ts") + F.col("qty") * 1_000_000).cast("long").alias("t1")),
                   KEYS, ["t0", "id"], 80, 3)
    out = SP.purged_kfold(base, "t0", "t1", 4, embargo=0.01).toPandas()
    assert out[out["role"] == "test"].groupby("symbol")["id"].nunique().sum() == 3000
    for _, g in out.groupby(["symbol", "fold"]):
        test, train = g[g["role"] == "test"], g[g["role"] == "train"]
        lo, hi = test["t0"].min(), test["t1"].max()
        assert ((train["t1"] < lo) | (train["t0"] > hi)).all()


def test_return_weights_sum_to_the_number_of_events(spark, series):
    spans = series.df.filter("id % 10 = 0").select("symbol", "id", F.col("_pos").alias("p0"), (F.col("_pos") + 3).alias("p1"))
    ends = series.lengths()
    spans = spans.join(ends, "symbol").filter("p1 < _n").drop("_n")
    got = WT.return_weights(series, spans, F.col("qty") - 10).groupBy("symbol").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).toPandas()
    assert np.allclose(got["w"], got["n"])
    uniq = WT.average_uniqueness(series, spans).agg(F.min("uniqueness"), F.max("uniqueness")).first()
    assert 0 < uniq[0] <= uniq[1] <= 1


def test_bootstrap_prefers_unique_events(spark):
    rows = [("x", i, 0, 9) for i in range(9)] + [("x", 9, 50, 59)]
    spans = spark.createDataFrame(rows, "symbol string, id long, p0 long, p1 long")
    out = WT.sequential_bootstrap(spans, KEYS, "id", replicates=60, draws=2).toPandas()
    second = out[out["draw"] == 1]
    assert (second["id"] == 9).mean() > 0.1 and len(out) == 120


def test_oversampling_balances_exactly(spark):
    df = spark.range(103).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in WT.oversample(df, "y", ["id"]).groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 92


def test_touch_label_and_one_hot(spark):
    row = spark.range(1).select(
        L.touch_label(F.lit(5), F.lit(9)).alias("a"), L.touch_label(F.lit(None).cast("int"), F.lit(9)).alias("b"),
        L.touch_label(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("c"), L.two_class_one_hot(F.lit(0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (-1, 1, 0, [1, 0])


@pytest.mark.parametrize("chunk", [16, 5000])
def test_best_prices_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    rows = [("s", i, "bid" if rng.random() < 0.5 else "ask", 0.0, float(rng.integers(0, 3))) for i in range(600)]
    rows = [(k, i, s, float(rng.integers(90, 100) if s == "bid" else rng.integers(101, 111)), q) for k, i, s, _, q in rows]
    df = spark.createDataFrame(rows, "symbol string, seq long, side string, price double, qty double")
    got = BK.top_of_book(df, KEYS, "side", "price", "qty", "seq", chunk).orderBy("seq").toPandas()
    book = {"bid": {}, "ask": {}}
    for (_, seq, side, price, qty), g in zip(rows, got.itertuples()):
        book[side].pop(price, None)
        if qty:
            book[side][price] = qty
        want = (max(book["bid"], default=None), min(book["ask"], default=None))
        assert tuple(None if pd.isna(v) else v for v in (g.best_bid, g.best_ask)) == want


def test_threshold_grid_edges(spark):
    df = spark.createDataFrame([(1.0, 0.5), (-1.0, 0.2), (2.0, 1.0)], "ret double, prob double")
    grid = G.threshold_grid(df, "ret", "prob", 0.25).orderBy("threshold").toPandas()
    assert grid["threshold"].tolist() == [0.5, 0.75, 1.0]
    # 0.5: rows 1, 3 are long (and 1, 3 short); 0.75: complements 0.5 and 0 are short; 1: every complement is
    assert grid["n_bets"].tolist() == [2, 2, 3]


def _windows(spark, series, width):
    return series.windowed(lambda df, w: W.sliding_window(df, w, F.col("price"), width), width - 1).filter("window IS NOT NULL")


def test_warping_matches_brute_force(spark, series):
    refs = [("up", [100.0, 104.0, 108.0, 112.0]), ("flat", [105.0] * 5)]
    rows = X.nearest_by_warping(_windows(spark, series, 5), "window", ["symbol", "id", "window"], refs).limit(40).toPandas()

    def dtw(a, b):
        table = np.full((len(a) + 1, len(b) + 1), np.inf)
        table[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
        return math.sqrt(table[-1, -1])
    for row in rows.itertuples():
        want = {name: dtw(row.window, ref) for name, ref in refs}
        assert row.distance == pytest.approx(min(want.values())) and want[row.nearest] == pytest.approx(row.distance)


def test_kernel_features_match_brute_force(spark, series):
    kernels = X.random_kernels(16, 6, seed=2)
    rows = X.kernel_features(_windows(spark, series, 16), "window", ["id", "window"], kernels).limit(10).toPandas()
    for row in rows.itertuples():
        for k, (w, bias, dilation, pad) in enumerate(kernels):
            x = np.r_[np.zeros(pad), row.window, np.zeros(pad)]
            out = [bias + sum(w[i] * x[t + i * dilation] for i in range(len(w))) for t in range(len(x) - (len(w) - 1) * dilation)]
            assert row.features[2 * k] == pytest.approx(max(out))
            assert row.features[2 * k + 1] == pytest.approx(np.mean(np.array(out) > 0))


def test_kernel_features_are_handed_over_in_small_frames(spark, monkeypatch):
    monkeypatch.setattr(X, "KERNEL_ROWS", 3)
    monkeypatch.setattr(X, "FRAME_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(50, 20, 12).round(1).tolist()) for i in range(29)] + [(29, [None] * 3 + [1.0] * 9), (30, [4.0] * 12)]
    kernels = X.random_kernels(12, 40, seed=3)
    df = spark.createDataFrame(rows, "id long, window array<double>").coalesce(1)
    sizes, keep = [], type(df).mapInArrow

    def spied(self, func, schema):
        frames = lambda batches: (f.append_column("size", pa.array([len(f)] * len(f), pa.int32())) for f in func(batches))      # noqa: E731
        return keep(self, frames, f"{schema}, size int")
    monkeypatch.setattr(type(df), "mapInArrow", spied)
    for row in X.kernel_features(df, "window", ["id"], kernels).collect():
        sizes.append(row["size"])
        x = np.array(rows[row.id][1], dtype=float)
        for k, (w, bias, dilation, pad) in enumerate(kernels):
            padded = np.pad(x, pad)
            out = bias + sum(w[i] * padded[i * dilation:i * dilation + len(padded) - (len(w) - 1) * dilation] for i in range(len(w)))
            assert row.features[2 * k] == (None if np.isnan(out).any() else pytest.approx(out.max()))
            assert row.features[2 * k + 1] == pytest.approx((out > 0).mean())
    assert len(sizes) == 31 and max(sizes) == 8


def test_rolling_entropy_rate_matches_brute_force(series, hot):
    span = 40_000_000
    got = X.entropy_rate(series, F.floor(F.col("price") / 5), "ts", span).filter("symbol = 'hot'").toPandas().set_index("id")["entropy_rate"]
    for row in hot.iloc[::97].itertuples():
        part = hot[(hot["ts"] >= row.ts - span) & (hot["ts"] <= row.ts)]
        if row.ts < hot["ts"].min() + span:
            assert row.id not in got.index
            continue
        h, _, _ = X.match_entropy((part["price"] // 5).astype(int).tolist())
        same_time = hot[hot["ts"] == row.ts]["id"].tolist()
        assert any(abs(got[i] - h) < 1e-9 for i in same_time)


def test_synthetic_rows_lie_between_minority_neighbours(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, int(i % 6 == 0), p.tolist()) for i, p in enumerate(pts)], "id long, y int, v array<double>")
    out = WT.synthetic_minority(df, "v", "y", 1, "id", k=3, per_row=2).toPandas()
    assert len(out) == 20
    for row in out.itertuples():
        a, b = pts[row.id], pts[row.neighbour]
        g = (np.array(row.v) - a) / (b - a)
        assert row.neighbour % 6 == 0 and np.allclose(g, g[0]) and 0 <= g[0] <= 1


def test_best_resting_level_of_every_chunk(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        a = int(rng.integers(0, 38))
        rows.append(("x" if i % 3 else "y", "bid" if i % 2 else "ask", float(i), float(i % 7 + 1), a, int(rng.integers(a, 39))))
    spans = spark.createDataFrame(rows, "symbol string, side string, price double, _q double, _from long, _to long")
    chunks = spark.createDataFrame([(k, c) for k in "xy" for c in range(39)], "symbol string, _chunk long")
    got = BK._best_resting(spans, chunks, KEYS, "side", "price", "qty", 38).collect()
    want = set()
    for k in "xy":
        for c in range(39):
            for side, pick in (("bid", max), ("ask", min)):
                held = [(r[2], r[3]) for r in rows if r[:2] == (k, side) and r[4] <= c <= r[5]]
                if held:
                    want.add((k, c, side, *pick(held)))
    assert len(got) == len(want) and {(r.symbol, r._chunk, r.side, r.price, r.qty) for r in got} == want
