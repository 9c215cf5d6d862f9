import json

import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.sources import feeds, scans, sinks


def test_depth_and_trade_messages_keep_case(spark):
    msg = json.dumps({"e": "depthUpdate", "E": 5, "T": 6, "s": "AB", "U": 1, "u": 3, "pu": 0, "b": [["1.5", "2"]], "a": []})
    row = feeds.depth_diffs(spark.createDataFrame([(msg,)], "value string")).first()
    assert (row.first_id, row.last_id, row.previous_id, row.event_ts, row.bids[0].price, row.asks) == (1, 3, 0, 5000, 1.5, [])
    msg = json.dumps({"a": 7, "p": "1.25", "q": "2", "f": 1, "l": 2, "T": 9, "m": True, "M": False})
    row = feeds.agg_trades(spark.createDataFrame([(msg,)], "value string")).first()
    assert (row.aggregate_trade_id, row.price, row.ts, row.is_buyer_market_maker) == (7, 1.25, 9000, True)


def test_benchmark_matrix_reader(spark, tmp_path):
    n_features, events = 40, 7
    for name in ("train_1.txt", "test_1.txt"):
        lines = [" ".join(str(f + e / 10) for e in range(events)) for f in range(n_features + 3)]
        lines += [" ".join(str(e % 3 + 1) for e in range(events)) for _ in range(5)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = scans.numbered_matrices(spark, str(tmp_path)).orderBy("file", "event").collect()
    assert len(got) == 14 and {r.file for r in got} == {"train_1.txt", "test_1.txt"}
    assert got[3].depth == [f + 0.3 for f in range(40)] and got[4].label_10 == 1 and got[2].label_100 == 2


def test_jdbc_options():
    assert scans.jdbc_options("jdbc:x", "SELECT 1") == {"url": "jdbc:x", "query": "SELECT 1"}
    opts = scans.jdbc_options("jdbc:x", "trades", "id", (0, 100), 4)
    assert opts["dbtable"] == "trades" and opts["numPartitions"] == "4" and opts["upperBound"] == "100"


def test_replayed_batch_does_not_duplicate(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        sinks.append_batch(df, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_contract_check(spark):
    df = spark.range(1).select(F.lit("a").alias("symbol"), F.col("id").alias("seq"), F.lit("bid").alias("side"),
                               F.lit(1.0).alias("price"), F.lit(1.0).alias("qty"))
    assert schemas.check(df, schemas.BOOK_UPDATES) is df
    with pytest.raises(TypeError):
        schemas.check(df, schemas.TRADES)


def test_seeded_fixtures(spark):
    a, b = (scans.synthetic_classes(spark, 200, 3, 2, 2, seed=4) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.select("bin").distinct().count() == 2
    assert abs(scans.correlated_block(spark, 500, 2, 2).stat.corr("x0", "x2")) > 0.9
    assert scans.timed_samples(spark, 50, 10, 100).filter("eval_time < pred_time").count() == 0
