import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import features as X
from tickweave.operators import quantiles as Q
from tickweave.operators import windows as W
from tickweave.series import lay_out

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("bins,small", [(2048, 4096), (8, 5)])
def test_equal_to_the_sorted_values(spark, monkeypatch, bins, small):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "SMALL", small)
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(0, 1, 900), "ties": np.r_[np.full(500, 7.0), rng.integers(0, 4, 300)], "one": [3.5], "two": [1.0, 4.0],
            "tail": np.exp(rng.normal(0, 6, 400)), "wide": [-1.7e308, 0.0, 1.7e308, 5.0, 5.0], "same": [2.0] * 50, "tiny": [0.0] * 9 + [5e-324] * 9}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("normal", None), ("ties", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "symbol string, v double").repartition(3)
    got = {r.symbol: r.quantiles for r in Q.exact_quantiles(frame, ["symbol"], F.col("v"), SHARES).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        x = np.sort(np.array(x, float))
        for s, q in zip(SHARES, got[k]):
            at = s * (len(x) - 1)
            lo, part = int(np.floor(at)), at - np.floor(at)
            want = x[lo] * (1 - part) + x[min(lo + 1, len(x) - 1)] * part if part else x[lo]
            assert q == pytest.approx(want, rel=1e-12)
    whole = Q.exact_quantiles(frame, [], F.col("v"), [0.5]).first()["quantiles"]
    assert whole == [pytest.approx(np.median(np.concatenate([np.array(x, float) for x in data.values()])))]
    assert Q.exact_quantiles(frame.limit(0), ["symbol"], F.col("v"), SHARES).count() == 0


def test_bins_and_imputation_use_them(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 20)
    rng = np.random.default_rng(5)
    prices = np.round(100 + rng.normal(0, 3, 400).cumsum() / 5, 2)
    series = lay_out(spark.createDataFrame([("a", i, float(p)) for i, p in enumerate(prices)], "symbol string, ts long, price double"), ["symbol"], ["ts"])
    got = X.quantile_bins(series, "price", 4).orderBy("ts").toPandas()
    change = prices[1:] / prices[:-1] - 1
    assert got["bin"].tolist() == [int((np.quantile(change, [0.25, 0.5, 0.75]) < c).sum()) for c in change]
    assert all(sum(o) == 1 and o[b] == 1 for o, b in zip(got["one_hot"], got["bin"]))
    inf = float("inf")
    frame = spark.createDataFrame([(1, 1.0), (2, inf), (3, -inf), (4, None), (5, float("nan")), (6, 5.0), (7, 2.0)], "id long, x double")
    done = {r.id: r.x for r in W.impute(frame, ["x"]).collect()}
    assert done == {1: 1.0, 2: 5.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 5.0, 7: 2.0}
    assert W.impute(frame.filter("id = 4"), ["x"]).first().x is None


def test_autoregression_and_power_of_arrays(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (30, 24)).cumsum(axis=1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [2.0] * 24), (92, [1.0, 2.0, 4.0]), (93, [1.0])]
    frame = spark.createDataFrame(rows, "id long, w array<double>")
    got = {r.id: r for r in frame.select("id", W.autoregression(F.col("w"), 5).alias("ar"), W.power_spectrum(F.col("w"), 24).alias("ps")).collect()}
    for i, v in enumerate(x):
        c = v - v.mean()
        cov = np.array([c[k:] @ c[:24 - k] for k in range(6)])
        want = np.linalg.solve(np.array([[cov[abs(a - b)] for b in range(5)] for a in range(5)]), cov[1:])
        assert np.allclose(got[i].ar, want) and np.allclose(got[i].ps, (np.abs(np.fft.fft(v)) ** 2)[:12])
    assert got[90].ar is None and got[90].ps is None and got[91].ar is None and len(got[92].ar) == 2 and got[92].ps is None and got[93].ar is None


def test_discrete_quantile_is_a_value_and_gathers_no_key(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 8)
    monkeypatch.setattr(Q, "SMALL", 5)
    rng = np.random.default_rng(5)
    data = {"many": rng.integers(0, 10**12, 400).tolist(), "ties": [3] * 200 + [9] * 200, "even": [1, 2, 3, 4], "big": [2**60, 2**60 + 1, 2**60 + 2]}
    frame = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("many", None), ("none", None)], "symbol string, seq long").repartition(3)
    for share in (0.0, 0.5):
        got = {r.symbol: r.snap for r in Q.discrete_quantile(frame, ["symbol"], "seq", share, "snap").collect()}
        assert got == {k: sorted(x)[max(int(np.ceil(len(x) * share)) - 1, 0)] for k, x in data.items()}


def test_updates_after_snapshot_gathers_no_key(spark, tmp_path):
    from tickweave.plans.feed_queries import updates_after_snapshot
    rows = [("A" if i % 5 else "B", "F" if i % 2 else "O", 20.0 + i % 31, 1000.0 + i, i % 900, 19000 + i % 7) for i in range(900)]
    frame = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_orderkey long, d int")
    frame.withColumn("l_shipdate", F.date_from_unix_date("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = updates_after_snapshot(spark, str(tmp_path))
    assert "percentile" not in out._jdf.queryExecution().toString()
    from tickweave.plans.feed_queries import book_updates
    seqs = {}
    for r in book_updates(spark, str(tmp_path)).collect():
        seqs.setdefault(r.symbol, []).append(r.seq)
    want = sum(sum(s > sorted(x)[(len(x) + 1) // 2 - 1] for s in x) for x in seqs.values())
    assert out.count() == want
