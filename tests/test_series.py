"""The layout patterns give the same rows whatever the chunk length or partition count."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.operators.bars import amount_clock
from tickweave.operators.events import fixed_threshold
from tickweave.series import fit_chunk_rows, lay_out

KEYS, ORDER = ["symbol"], ["ts", "id"]


def frame(df, order=("symbol", "id")):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("chunk,parts", [(37, 1), (64, 5), (5000, 3)])
def test_positions_and_windows_match_one_global_window(spark, skewed, chunk, parts):
    series = lay_out(skewed, KEYS, ORDER, chunk, parts)
    got = series.windowed(lambda df, w: df.withColumn("m", F.avg("price").over(w.rowsBetween(-19, 5))), 19, 5)
    w = Window.partitionBy("symbol").orderBy("ts", "id")
    want = skewed.withColumns({"m": F.avg("price").over(w.rowsBetween(-19, 5)), "_pos": F.row_number().over(w) - 1})
    a, b = frame(got), frame(want)
    assert len(a) == len(b) == 3000
    assert (a["_pos"] == b["_pos"]).all()
    assert np.allclose(a["m"], b["m"])


@pytest.mark.parametrize("chunk", [41, 4000])
def test_running_matches_unbounded_windows(spark, skewed, chunk):
    series = lay_out(skewed, KEYS, ORDER, chunk, 4)
    sparse = F.when(F.col("id") % 11 == 0, F.col("price"))
    got = series.running({"s": ("sum", F.col("qty")), "l": ("last", sparse), "hi": ("max", F.col("price")), "lo": ("min", F.col("price"))})
    w = Window.partitionBy("symbol").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumns({"s": F.sum("qty").over(w), "l": F.last(sparse, True).over(w),
                               "hi": F.max("price").over(w), "lo": F.min("price").over(w)})
    a, b = frame(got), frame(want)
    for c in ("s", "l", "hi", "lo"):
        pd.testing.assert_series_equal(a[c], b[c], check_dtype=False)


def scalar_clock(values, threshold):
    acc, out = 0.0, []
    for v in values:
        acc += v
        out.append(int(acc >= threshold))
        acc = 0.0 if acc >= threshold else acc
    return out


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_fold_is_exact_for_any_partitioning(spark, skewed, parts):
    series = lay_out(skewed, KEYS, ORDER, 100, parts).with_columns({"_amount": F.col("qty")})
    assert parts == 1 or series.laid.rdd.getNumPartitions() > 1
    rows = frame(series.fold(amount_clock(50), (0.0,), ["_amount"], {"_hits": "int"}, keep=ORDER + ["qty"]))
    for _, g in rows.groupby("symbol"):
        hits = scalar_clock(g["qty"], 50)
        assert g["_hits"].tolist() == hits
        assert g["_seq"].tolist() == (np.cumsum(hits) - hits).tolist()


def test_fold_is_exact_when_guesses_never_settle(spark):
    """A constant amount keeps every wrong guess out of step for ever."""
    df = spark.range(900).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), "id", F.lit(1.0).alias("_amount"))
    series = lay_out(df, KEYS, ORDER, 50, 12)
    rows = frame(series.fold(amount_clock(7), (0.0,), ["_amount"], {"_hits": "int"}, keep=ORDER))
    assert rows["_hits"].tolist() == scalar_clock([1.0] * 900, 7)
    assert rows["_seq"].iloc[-1] == 899 // 7


def test_fold_carries_over_many_small_keys(spark):
    df = spark.range(500).select((F.col("id") % 83).alias("symbol"), F.col("id").alias("ts"), "id",
                                 (F.col("id") % 5 + 1.0).alias("price"))
    series = lay_out(df, KEYS, ORDER, 10, 6).with_columns({"_price": F.col("price")})
    rows = frame(series.fold(fixed_threshold(1.5), (0.0,) * 3, ["_price"], {"side": "int"}, keep=ORDER + ["price"]))
    for _, g in rows.groupby("symbol"):
        up = down = 0.0
        want = [0]
        for move in np.diff(g["price"]):
            up, down, side = max(0.0, up + move), min(0.0, down + move), 0
            if down < -1.5:
                down, side = 0.0, -1
            elif up > 1.5:
                up, side = 0.0, 1
            want.append(side)
        assert g["side"].tolist() == want


def test_chunk_length_stays_in_bounds():
    assert fit_chunk_rows(100, 8) == 1 << 10
    assert fit_chunk_rows(10 ** 13, 8) == 1 << 20


def test_no_plan_puts_a_whole_key_in_one_window(spark, skewed):
    series = lay_out(skewed, KEYS, ORDER, 64, 4)
    out = series.windowed(lambda df, w: df.withColumn("m", F.lag("price").over(w)), 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_chunk" in plan.split("hashpartitioning(symbol")[1].split(")")[0]


@pytest.mark.parametrize("quantity", ["qty", "one"])
def test_amount_clock_reads_the_layout_twice_whatever_the_partitions(spark, skewed, monkeypatch, quantity):
    from tickweave.operators import bars as B
    rows = skewed.withColumn("one", F.lit(1.0))
    DataFrame = type(rows)
    results, calls = [], []
    plain = DataFrame.mapInPandas
    for parts in (1, 12, 24):
        series = lay_out(rows, ["symbol"], ["ts", "id"], parts=parts)
        seen = []
        monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, *a, **k: (seen.append(1), plain(self, *a, **k))[1])
        bars = B.amount_bars(series, "ts", "price", "qty", F.col(quantity), 700.0)
        monkeypatch.setattr(DataFrame, "mapInPandas", plain)
        results.append(sorted(tuple(r) for r in bars.select("symbol", "bar", "open", "high", "low", "close", "bar_ts").collect()))
        calls.append(len(seen))
    assert calls == [2, 2, 2] and results[0] == results[1] == results[2] and results[0]


@pytest.mark.parametrize("rows", [50, 1 << 20])
def test_relay_reads_every_row_once_whatever_the_partitions(spark, skewed, rows):
    results = []
    for parts in (1, 12, 24):
        series = lay_out(skewed, KEYS, ORDER, parts=parts).with_columns({"_amount": F.col("qty")})
        read = spark.sparkContext.accumulator(0)
        plain = amount_clock(50)

        def kernel(state, fresh, arrays, read=read):
            read.add(len(arrays["_amount"]))
            return plain(state, fresh, arrays)
        out = frame(series.relay(kernel, (0.0,), ["_amount"], {"_hits": "int"}, keep=ORDER + ["qty"], rows=rows))
        assert read.value == 3000
        results.append(out)
    for out in results:
        for _, g in out.groupby("symbol"):
            hits = scalar_clock(g["qty"], 50)
            assert g["_hits"].tolist() == hits and g["_seq"].tolist() == (np.cumsum(hits) - hits).tolist()


def test_relay_without_keys_and_without_rows(spark):
    df = spark.range(300).select(F.col("id").alias("ts"), "id", F.lit(1.0).alias("_amount"))
    out = lay_out(df, [], ORDER).relay(amount_clock(7), (0.0,), ["_amount"], {"_hits": "int"}, keep=ORDER, rows=40)
    assert out.columns == ["ts", "id", "_hits", "_seq"] and out.agg(F.sum("_hits"), F.count("*")).first() == (42, 300)
    assert lay_out(df.limit(0), [], ORDER).relay(amount_clock(7), (0.0,), ["_amount"], {"_hits": "int"}, rows=40).count() == 0


def test_bars_longer_than_partitions_keep_their_descriptions_in_storage(spark, monkeypatch):
    """A bar outlasts several partitions; only small rows come to the driver."""
    from tickweave.operators import bars as B
    monkeypatch.setattr("tickweave.series.SMALL_EXIT_BYTES", 600)
    df = spark.range(6000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), "id", (F.col("id") % 7 + 1.0).alias("qty"), F.lit(1.0).alias("price"))
    series = lay_out(df, KEYS, ORDER, parts=12)
    for threshold in (8000.0, 1500.0, 60.0):
        got = B.amount_samples(series, F.col("qty"), threshold, ["id"]).orderBy("bar").collect()
        hits = scalar_clock([i % 7 + 1.0 for i in range(6000)], threshold)
        assert [r["id"] for r in got] == [i for i, h in enumerate(hits) if h] and [r["bar"] for r in got] == list(range(sum(hits)))
