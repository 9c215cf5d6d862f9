"""Streams give what the batch forms give, also when fed in several micro-batches."""

import pytest
from pyspark.sql import functions as F

from tickweave.operators import bars as B
from tickweave.operators import events as E
from tickweave.series import lay_out
from tickweave.streaming import ingest, stateful

KEYS, ORDER = ["symbol"], ["ts", "id"]


@pytest.fixture(scope="module")
def feed(spark, skewed, tmp_path_factory):
    """The tape in three files, in time order."""
    path = str(tmp_path_factory.mktemp("feed"))
    for i in range(3):
        skewed.filter((F.col("id") >= i * 1000) & (F.col("id") < (i + 1) * 1000)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    ingest.drain(df, out, str(tmp_path / "state"), mode)
    return spark.read.parquet(out).drop("batch")


def stream(spark, feed, skewed):
    return ingest.files(spark, feed, skewed.schema, per_trigger=1)


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_volume_bars_equal_batch(spark, skewed, feed, tmp_path):
    live = stateful.amount_bars(stream(spark, feed, skewed).withColumn("amt", F.col("qty")), "symbol", "ts", "id", "price", "qty", "amt", 100.0)
    batch = B.amount_bars(lay_out(skewed, KEYS, ORDER), "ts", "price", "qty", F.col("qty"), 100.0)
    cols = ["symbol", "bar", "open", "high", "low", "close", "volume", "bar_ts"]
    assert rows(run(spark, live, tmp_path), cols) == rows(batch, cols)


def test_stream_cusum_equals_batch(spark, skewed, feed, tmp_path):
    live = stateful.cusum(stream(spark, feed, skewed).drop("qty"), "symbol", "ts", "id", "price", 6.0)
    batch = E.cusum(lay_out(skewed, KEYS, ORDER), "price", "fixed", 6.0)
    got = rows(run(spark, live, tmp_path), ["symbol", "id", "side"])
    assert got == rows(batch, ["symbol", "id", "side"]) and len(got) > 20


MESSAGE = ("symbol string, is_snapshot boolean, first_id long, last_id long, previous_id long, "
           "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")


def book(spark, tmp_path, batches):
    src = str(tmp_path / "src")
    for b in batches:
        spark.createDataFrame(b, MESSAGE).coalesce(1).write.mode("append").parquet(src)
    live = stateful.rebuild_book(ingest.files(spark, src, spark.read.parquet(src).schema, per_trigger=1))
    out = run(spark, live, tmp_path)
    return [(r.last_id, r.kind, r.best_bid, r.best_ask) for r in out.orderBy("last_id").collect()]


def test_book_follows_updates_and_drops_stale_ones(spark, tmp_path):
    got = book(spark, tmp_path, [
        [("s", True, 0, 10, 0, [(99.0, 1.0), (98.0, 1.0)], [(101.0, 1.0)])],
        [("s", False, 1, 9, 0, [(120.0, 1.0)], []), ("s", False, 9, 12, 8, [(99.0, 0.0)], []),
         ("s", False, 13, 14, 12, [], [(100.5, 2.0)])],
        [("s", False, 15, 15, 14, [(98.5, 1.0)], [(100.5, 0.0)])]])
    assert got == [(10, "book", 99.0, 101.0), (12, "book", 98.0, 101.0), (14, "book", 98.0, 100.5), (15, "book", 98.5, 101.0)]


def test_book_resyncs_after_a_gap(spark, tmp_path):
    got = book(spark, tmp_path, [
        [("s", True, 0, 10, 0, [(99.0, 1.0)], [(101.0, 1.0)]), ("s", False, 11, 12, 10, [(99.5, 1.0)], [])],
        [("s", False, 14, 15, 13, [(100.0, 1.0)], []), ("s", False, 16, 16, 15, [(100.2, 1.0)], [])],
        [("s", True, 0, 20, 0, [(97.0, 1.0)], [(103.0, 1.0)]), ("s", False, 20, 22, 19, [(97.5, 1.0)], [])]])
    assert [g[:2] for g in got] == [(10, "book"), (12, "book"), (15, "gap"), (20, "book"), (22, "book")]
    assert got[-1][2:] == (97.5, 103.0)


def test_time_bars_come_once_each_over_several_batches(spark, feed, skewed, tmp_path):
    src = stream(spark, feed, skewed).withColumn("at", F.timestamp_micros("ts"))
    out = str(tmp_path / "out")
    ingest.drain_windows(src, "at", lambda live: stateful.time_bars(live, KEYS, "at", "id", "price", "qty", "5 minutes", "1 minute"),
                         out, str(tmp_path / "state"), str(tmp_path / "beat"))
    got = spark.read.parquet(out).drop("batch")
    want = B.time_bars(skewed, KEYS, "ts", "id", "price", "qty", 300_000_000, fill_gaps=False)
    pick = ["symbol", "bar_ts", "open", "high", "low", "close", "volume"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*pick).collect())
    assert rows(got) == rows(want) and got.select("batch" if "batch" in got.columns else "bar_ts").count() == want.count()


@pytest.fixture(scope="module")
def later(skewed):
    """The tape at a later date: a watermark starts at 1970 and lets nothing of its first moment pass."""
    return skewed.withColumn("ts", F.col("ts") + 10**15)


@pytest.fixture(scope="module")
def shuffled(later, tmp_path_factory):
    """The tape in five files, each with rows of all times in no order."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    for i in range(5):
        later.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == i).withColumn("at", F.timestamp_micros("ts")).orderBy(F.rand(i)).coalesce(1).write.mode(
            "append").parquet(path)
    return path


def ordered(spark, path, tmp_path, build):
    src = ingest.files(spark, path, spark.read.parquet(path).schema, per_trigger=1)
    out = str(tmp_path / "out")
    ingest.drain_windows(src, "at", build, out, str(tmp_path / "state"), str(tmp_path / "beat"))
    return spark.read.parquet(out)


def test_shuffled_files_give_the_bars_of_the_batch(spark, later, shuffled, tmp_path):
    got = ordered(spark, shuffled, tmp_path, lambda live: stateful.amount_bars(
        live.withColumn("amt", F.col("qty")), "symbol", "ts", "id", "price", "qty", "amt", 100.0, at="at", late="1 hour"))
    batch = B.amount_bars(lay_out(later, KEYS, ORDER), "ts", "price", "qty", F.col("qty"), 100.0)
    cols = ["symbol", "bar", "open", "high", "low", "close", "volume", "bar_ts"]
    assert rows(got, cols) == rows(batch, cols)


def test_out_of_order_cusum_folds_as_the_watermark_passes(spark, later, tmp_path):
    """Neighbouring files overlap in time; most rows are folded before the source ends."""
    path = str(tmp_path / "overlap")
    for i in range(5):
        part = later.filter(F.floor((F.col("id") + F.pmod(F.xxhash64("id"), F.lit(150))) / 600) == i)
        part.withColumn("at", F.timestamp_micros("ts")).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(path)
    rest = later.filter(F.floor((F.col("id") + F.pmod(F.xxhash64("id"), F.lit(150))) / 600) == 5)
    rest.withColumn("at", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(path)
    got = ordered(spark, path, tmp_path, lambda live: stateful.cusum(live, "symbol", "ts", "id", "price", 6.0, at="at", late="3 minutes"))
    batch = E.cusum(lay_out(later, KEYS, ORDER), "price", "fixed", 6.0)
    assert rows(got, ["symbol", "id", "side"]) == rows(batch, ["symbol", "id", "side"])
    assert got.select("batch").distinct().count() > 2


def test_order_book_is_fed_in_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from tickweave.plans import feed_queries as FQ
    rows = [("A" if i % 3 else "B", "F" if i % 2 else "O", 15.0 + i % 31, 1000.0 + i * 37 % 4000, i % 70, 19000 + i % 3) for i in range(180)]
    frame = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_orderkey long, d int")
    frame.withColumn("l_shipdate", F.date_from_unix_date("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = sorted(FQ.stream_order_book(spark, str(tmp_path)).collect())
    monkeypatch.setattr(FQ, "FEED_ROWS", 60)
    sizes, files = [], FQ.ingest.files
    monkeypatch.setattr(FQ.ingest, "files", lambda s, path, *a, **k: sizes.append([f.count() for f in [s.read.parquet(path)]]) or files(s, path, *a, **k))
    parts = sorted(FQ.stream_order_book(spark, str(tmp_path)).collect())
    assert parts == whole and len(whole) > 20 and sizes[0][0] > 60


def test_order_book_keeps_few_partitions_of_state_and_takes_feeds_in_order(spark, tmp_path, monkeypatch):
    """Four partitions a symbol whatever the session deals out to; feeds in order also where files keep no times of change."""
    import os

    from pyspark.sql import functions as F
    from tickweave.plans import feed_queries as FQ
    rows = [("A" if i % 3 else "B", "F" if i % 2 else "O", 15.0 + i % 31, 1000.0 + i * 37 % 4000, i % 70, 19000 + i % 3) for i in range(180)]
    frame = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_orderkey long, d int")
    frame.withColumn("l_shipdate", F.date_from_unix_date("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = sorted(FQ.stream_order_book(spark, str(tmp_path)).collect())
    monkeypatch.setattr(FQ, "FEED_ROWS", 60)
    states, drain = [], FQ.ingest.drain
    monkeypatch.setattr(FQ.ingest, "drain", lambda df, path, checkpoint, *a, **k: states.append(checkpoint) or drain(df, path, checkpoint, *a, **k))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        parts = sorted(FQ.stream_order_book(spark, str(tmp_path)).collect())
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    state = states[0].removeprefix("file:")
    assert parts == whole and len([d for d in os.listdir(f"{state}/state/0") if d.isdigit()]) == 8
    assert len([f for f in os.listdir(f"{state}/offsets") if f.isdigit()]) > 2
    monkeypatch.setattr(FQ.ingest, "by_time", lambda spark, paths: False)
    assert sorted(FQ.stream_order_book(spark, str(tmp_path)).collect()) == whole


def test_messages_come_in_order_with_their_levels(monkeypatch):
    import numpy as np
    import pandas as pd
    from tickweave.streaming import stateful as S
    monkeypatch.setattr(S, "FOLD_ROWS", 2)
    nan = float("nan")
    made = [(False, 5, 5, 3, 1, [10.0, 1.0, 20.0, 2.0]), (False, 2, 3, 1, 2, [11.0, 3.0, 12.0, 4.0, 21.0, 5.0]), (False, 9, nan, 0, 0, []),
            (False, 1, 1, 0, 1, [nan, 6.0, 22.0, 0.0]), (True, 1, 1, 0, 0, [23.0, 8.0])]
    cols = ["is_snapshot", "first_id", "last_id", "previous_id", "n_bids", "levels"]
    frame = pd.DataFrame([(*m[:5], np.array(m[5])) for m in made], columns=cols)
    got = [c for some in S._messages(iter([frame.iloc[:2], frame.iloc[2:]])) for c in [some]]
    heads = [row for some in got for row in zip(*some[:6])]
    assert [h[:3] for h in heads][:4] == [(True, 1, 1.0), (False, 1, 1.0), (False, 2, 3.0), (False, 5, 5.0)] and heads[4][2] != heads[4][2]
    assert [h[4:] for h in heads] == [(0, 1), (0, 1), (2, 1), (1, 1), (0, 0)]
    assert sum((some[6] for some in got), []) == [23.0, 22.0, 11.0, 12.0, 21.0, 10.0, 20.0]
    assert sum((some[7] for some in got), []) == [8.0, 0.0, 3.0, 4.0, 5.0, 1.0, 2.0]
