import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import joins as J
from tickweave.operators import weights as WT
from tickweave.series import lay_out

KEYS, ORDER = ["symbol"], ["ts", "id"]


@pytest.mark.parametrize("chunk", [17, 5000])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_matches_merge_asof(spark, skewed, chunk, forward):
    left = skewed.filter("id % 4 = 0").select("symbol", (F.col("ts") + 500_000).alias("ts"), "id")
    right = skewed.filter("id % 7 = 1").groupBy("symbol", "ts").agg(F.max("price").alias("mid"))
    got = J.asof_join(left, right, KEYS, "ts", "ts", ["mid"], forward=forward, chunk_rows=chunk).toPandas()
    l, r = left.toPandas().sort_values("ts"), right.toPandas().sort_values("ts")
    want = pd.merge_asof(l, r, on="ts", by="symbol", direction="forward" if forward else "backward")
    a, b = got.sort_values("id").reset_index(drop=True), want.sort_values("id").reset_index(drop=True)
    pd.testing.assert_series_equal(a["mid"], b["mid"])


def test_asof_can_leave_out_equal_times(spark):
    left = spark.createDataFrame([("a", 10, 1)], "symbol string, ts long, id long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0)], "symbol string, at long, v double")
    assert J.asof_join(left, right, KEYS, "ts", "at", ["v"]).first()["v"] == 2.0
    assert J.asof_join(left, right, KEYS, "ts", "at", ["v"], allow_exact=False).first()["v"] == 1.0


def test_open_tail_rule(spark):
    trades = spark.createDataFrame([("a", 5, 1), ("a", 20, 2)], "symbol string, ts long, id long")
    book = spark.createDataFrame([("a", 4, 1.0), ("a", 10, 2.0)], "symbol string, ts long, mid double")
    kept = {r.id: r.mid for r in J.trades_with_book(trades, book, KEYS, "ts", ["mid"]).collect()}
    closed = {r.id: r.mid for r in J.trades_with_book(trades, book, KEYS, "ts", ["mid"], drop_open_tail=True).collect()}
    assert kept == {1: 1.0, 2: 2.0} and closed == {1: 1.0, 2: None}


@pytest.mark.parametrize("chunk,fan,searches", [(23, 64, 50_000), (23, 2, 7), (23, 3, 50_000), (128, 64, 20), (5000, 64, 50_000)])
def test_first_touch_matches_brute_force(spark, skewed, monkeypatch, chunk, fan, searches):
    monkeypatch.setattr(J, "FAN", fan)
    monkeypatch.setattr(J, "SEARCHES", searches)
    series = lay_out(skewed, KEYS, ORDER, chunk, 3)
    ends = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("_pos") + 40)
    ev = series.df.filter("id % 13 = 0").select(
        "symbol", "id", F.col("_pos").alias("p0"), ends.alias("p1"), F.col("price").alias("entry"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("side"), F.lit(0.05).alias("lower"), F.lit(0.12).alias("upper"))
    got = J.first_touch(series, ev, ["id"], "price", "ts").toPandas().set_index("id")
    bars = series.df.toPandas().sort_values("_pos")
    for e in ev.toPandas().itertuples():
        path = bars[(bars["symbol"] == e.symbol) & (bars["_pos"] >= e.p0)]
        if e.p1 == e.p1 and e.p1 is not None:
            path = path[path["_pos"] <= e.p1]
        ret = (path["price"] / e.entry - 1) * e.side
        for column, hit in (("t_lower", path[ret < -e.lower]), ("t_upper", path[ret > e.upper])):
            value = got.at[e.id, column]
            assert (pd.isna(value) and hit.empty) or value == hit["ts"].iloc[0]
            assert hit.empty or got.at[e.id, column.replace("t_", "price_")] == hit["price"].iloc[0]


@pytest.mark.parametrize("stride,scan", [(2, 1), (3, 0), (64, 8)])
def test_first_hits_equal_a_plain_search(monkeypatch, stride, scan):
    monkeypatch.setattr(J, "STRIDE", stride)
    monkeypatch.setattr(J, "SCAN", scan)
    monkeypatch.setattr(J, "PIECE", 37)
    rng = np.random.default_rng(4)
    prices = (100 + np.cumsum(rng.normal(0, 1, 700))).round(1)
    prices[rng.random(700) < 0.1], prices[300:340] = np.nan, np.nan
    first = rng.integers(0, 700, 400)
    stop = np.where(rng.random(400) < 0.3, 700, np.minimum(700, first + rng.integers(-3, 300, 400)))
    entry, side = rng.choice([-50.0, 90.0, 110.0, np.nan], 400, p=[0.1, 0.4, 0.4, 0.1]), rng.choice([-1.0, 0.0, 1.0, 2.0], 400)
    width = rng.choice([0.0, 0.05, 0.2, 0.4, np.nan, -0.1], 400)
    for up in (False, True):
        got = J._first_hits(prices, first, stop, entry, side, width, up)
        for i in range(400):
            moves = (prices[first[i]:max(stop[i], first[i])] / entry[i] - 1) * side[i]
            hits = np.flatnonzero(moves > width[i] if up else moves < -width[i])
            assert got[i] == (first[i] + hits[0] if len(hits) else -1), i


def test_first_touch_copies_no_chunk_for_its_own_events(spark, monkeypatch):
    monkeypatch.setattr(J, "SEARCHES", 500)
    monkeypatch.setattr(J, "HOME_ROWS", 400, raising=False)
    asked, keep = [], J._searched
    monkeypatch.setattr(J, "_searched", lambda wanted, *a: asked.append(wanted) or keep(wanted, *a))
    rows = spark.range(2000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), "id", (F.col("id") % 7 + 1.0).alias("price"))
    series = lay_out(rows, KEYS, ORDER, 2000)
    ev = series.df.select("symbol", "id", F.col("_pos").alias("p0"), F.lit(None).cast("long").alias("p1"), F.col("price").alias("entry"),
                          F.lit(1).alias("side"), F.lit(0.5).alias("lower"), F.lit(0.5).alias("upper"))
    assert J.first_touch(series, ev, ["id"], "price", "ts").count() == 2000
    assert asked[0].groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0] <= J.SEARCHES     # one task, one copy of the chunk


def test_purge_leaves_no_overlap(spark):
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1000, 200))
    pdf = pd.DataFrame({"id": np.arange(200), "t0": a, "t1": a + rng.integers(0, 30, 200)})
    df = spark.createDataFrame(pdf)
    train, test = df.filter("id % 5 <> 0"), df.filter("id % 20 = 0")
    kept = J.overlap_anti_join(train, test, [], "t0", "t1").toPandas()
    t = pdf[pdf["id"] % 20 == 0]
    clash = lambda r: ((t["t0"] <= r["t1"]) & (t["t1"] >= r["t0"])).any()
    want = pdf[(pdf["id"] % 5 != 0) & ~pdf.apply(clash, axis=1)]
    assert sorted(kept["id"]) == sorted(want["id"])


def test_concurrency_sweep(spark, skewed):
    series = lay_out(skewed, KEYS, ORDER, 50, 3)
    spans = series.df.filter("id % 6 = 0").select("symbol", F.col("_pos").alias("p0"), (F.col("_pos") + F.col("id") % 9).alias("p1"))
    got = J.concurrency(series, spans).toPandas()
    s = spans.toPandas()
    for key, g in got.groupby("symbol"):
        x = s[s["symbol"] == key]
        want = [((x["p0"] <= p) & (x["p1"] >= p)).sum() for p in g["_pos"]]
        assert g["n_active"].tolist() == want


def test_uniqueness_from_runs_of_the_indicator(spark):
    rng = np.random.default_rng(2)
    first = rng.integers(0, 90, 70)
    rows = [("x" if i % 4 else "y", i // 2 * 2, int(a), int(a + rng.integers(0, 25))) for i, a in enumerate(first)]     # ids come twice
    spans = spark.createDataFrame(rows, "symbol string, id long, p0 long, p1 long")
    pairs = J.indicator_pairs(spans, ["symbol"], "id")
    want = {(r.symbol, r.id): r.uniqueness for r in WT.uniqueness_from_pairs(pairs, ["symbol"], "id").collect()}
    for block in (1, 7, 1000):
        runs = J.indicator_pairs(spans, ["symbol"], "id", block=block)
        assert runs.agg(F.sum(F.col("bar_hi") - F.col("bar_lo") + 1)).first()[0] == pairs.count()
        got = {(r.symbol, r.id): r.uniqueness for r in WT.uniqueness_from_pairs(runs, ["symbol"], "id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_uniqueness_query_writes_no_pairs(spark, monkeypatch):
    from tickweave.plans import label_queries as LQ
    seen, keep = [], J.indicator_pairs
    monkeypatch.setattr(J, "indicator_pairs", lambda *a, **k: seen.append(keep(*a, **k)) or seen[-1])
    spans = spark.createDataFrame([("x", i, i, i + 30) for i in range(40)], "symbol string, id long, p0 long, p1 long")
    monkeypatch.setattr(LQ, "spans", lambda *_: (None, spans))
    assert LQ.uniqueness_from_indicator(spark, "").count() == 40 and seen[0].count() < 200     # 1,240 pairs
