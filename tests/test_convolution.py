import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import convolution as C
from tickweave.operators import features as X
from tickweave.series import lay_out


@pytest.mark.parametrize("d", [0.3, 0.5, 1.7, -0.4, 1.0, 0.0, 2.0])
def test_weights_at_any_lag(d):
    want = X.fraction_weights(d, size=200_000)
    lags = np.array([0, 1, 2, 900, 1023, 1024, 1025, 5000, 199_999])
    assert np.allclose(C.fractional_lags(d)(lags), want[lags], rtol=1e-10, atol=0)
    for terms in (1, 3, 1024, 1500, 200_000):
        assert abs(C.absolute_weight(d, terms) / np.abs(want[:terms]).sum() - 1) < 1e-9


@pytest.mark.parametrize("bits,cells", [(14, 1 << 18), (4, 64), (4, 1)])
def test_whole_past_of_every_row(spark, monkeypatch, bits, cells):
    monkeypatch.setattr(C, "ONE_STEP_BITS", bits)       # small: rows and columns, in several bands
    monkeypatch.setattr(C, "BAND_CELLS", cells)
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(5, 1, 700), "b": rng.normal(0, 3, 33), "c": np.array([2.0]), "d": np.array([1.0, 4.0])}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    series = lay_out(spark.createDataFrame(rows, "symbol string, ts long, v double"), ["symbol"], ["ts"])
    got = X.frac_diff_fft(series, "v", 0.4).toPandas()
    assert len(got) == len(rows)
    for k, x in data.items():
        made = got[got["symbol"] == k].sort_values("_pos")["frac_diff"].to_numpy()
        assert np.allclose(made, np.convolve(x, X.fraction_weights(0.4, size=len(x)))[:len(x)], atol=1e-9)
    wide = X.frac_diff_expanding(series, "v", 0.4, loss=0.9).groupBy("symbol").count().collect()
    share = np.cumsum(np.abs(X.fraction_weights(0.4, size=700)))
    skip = int((share / share[-1] > 0.9).sum())
    assert {r["symbol"]: r["count"] for r in wide} == {k: len(x) - skip for k, x in data.items() if len(x) > skip}


def test_gaps_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 2.0)], "symbol string, ts long, v double")
    got = {(r.symbol, r._pos): r.frac_diff for r in X.frac_diff_fft(lay_out(rows, ["symbol"], ["ts"]), "v", 0.4).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): 2.0}
    assert X.frac_diff_fft(lay_out(rows.limit(0), ["symbol"], ["ts"]), "v", 0.4).count() == 0
    one = lay_out(rows.filter("symbol = 'b'").drop("symbol"), [], ["ts"])
    assert [r.frac_diff for r in X.frac_diff_fft(one, "v", 0.4).collect()] == [2.0]
