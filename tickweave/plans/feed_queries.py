"""Scans, sinks, message parsing, scalar functions, order books and streams."""

import os
import uuid

from pyspark.sql import functions as F

from tickweave.functions import arrays as A
from tickweave.functions import scalars as S
from tickweave.operators import book as BK
from tickweave.operators.quantiles import discrete_quantile
from tickweave.plans.bar_queries import HOUR, OHLC_SQL, _bars_sql
from tickweave.plans.label_queries import _DIFF, _cusum_sql
from tickweave.plans.registry import RAW_TICKS_SQL, TICKS_SQL, query, r, table, ticks
from tickweave.schemas import KLINE_FIELDS
from tickweave.series import lay_out
from tickweave.session import checkpoint_folder, micros, stored
from tickweave.sources import feeds, scans, sinks
from tickweave.streaming import ingest, stateful

FEED_ROWS = 1 << 21     # messages of a micro-batch of the order book
FEED_BLOCK_BYTES = 8 * 2**20        # read by a task at least
STATE_PARTS = 4         # partitions of a symbol's state, so that symbols seldom share one


def _scratch(spark, name):
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, folder):
    return os.path.join(folder, "events.parquet")


# -- scans --------------------------------------------------------------------

@query("scan_ordered", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 1000")
def scan_ordered(spark, folder):
    return scans.ordered(scans.parquet(spark, _events(spark, folder), ["event_id", "value"]), ["event_id"], 1000)


@query("scan_between_other_bounds", """SELECT event_id FROM events WHERE event_id BETWEEN (SELECT min(doc_id) FROM labels) AND (SELECT max(doc_id) FROM labels)""")
def scan_between_other_bounds(spark, folder):
    return scans.between_bounds_of(scans.parquet(spark, _events(spark, folder), ["event_id"]), "event_id", table(spark, folder, "labels"), "doc_id")


@query("scan_drop_rename", "SELECT event_id AS id, ts::VARCHAR AS at, value AS close FROM events")
def scan_drop_rename(spark, folder):
    df = scans.parquet(spark, _events(spark, folder), drop=["user_id", "event_type", "props"], rename={"event_id": "id", "value": "close"})
    return df.select("id", F.col("ts").cast("string").alias("at"), "close")


@query("first_and_last_row", """SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(value, (ts, event_id)) AS first_value,
  arg_max(event_id, (ts, event_id)) AS last_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def first_and_last_row(spark, folder):
    out = scans.first_and_last(table(spark, folder, "events"), ["ts", "event_id"], ["event_type"])
    return out.select("event_type", F.col("first.event_id").alias("first_id"), F.col("first.value").alias("first_value"),
                      F.col("last.event_id").alias("last_id"), F.col("last.value").alias("last_value"))


@query("incremental_pull", f"""WITH {TICKS_SQL}, s AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM t WHERE pos BETWEEN 500 AND 900 AND symbol <> 'view' GROUP BY 1)
SELECT t.symbol, t.id FROM t LEFT JOIN s USING (symbol) WHERE lo IS NULL OR ts < lo OR ts > hi""")
def incremental_pull(spark, folder):
    new = ticks(spark, folder)
    stored = lay_out(new, ["symbol"], ["ts", "id"]).df.filter("_pos BETWEEN 500 AND 900 AND symbol <> 'view'")
    return scans.outside_stored(new, stored, ["symbol"], "ts").select("symbol", "id")


@query("missing_bar_ranges", f"""WITH {RAW_TICKS_SQL}, b AS (SELECT DISTINCT symbol, ts // {HOUR} * {HOUR} AS o FROM ticks),
s AS (SELECT min(o) AS a, max(o) AS z FROM b), g AS (SELECT symbol, unnest(range(a, z + 1, {HOUR})) AS o FROM (SELECT DISTINCT symbol FROM b), s),
m AS (SELECT g.* FROM g ANTI JOIN b USING (symbol, o)), i AS (SELECT *, o - row_number() OVER (PARTITION BY symbol ORDER BY o) * {HOUR} AS k FROM m)
SELECT symbol, min(o) AS start, max(o) AS end FROM i GROUP BY symbol, k""")
def missing_bar_ranges(spark, folder):
    bars = ticks(spark, folder).select("symbol", (F.floor(F.col("ts") / HOUR) * HOUR).cast("long").alias("o")).distinct()
    a, z = scans.bounds_of(bars, "o")
    return scans.gap_ranges(scans.missing_opens(bars, ["symbol"], "o", a, z, HOUR), ["symbol"], "o", HOUR)


@query("symbol_universe", """SELECT DISTINCT upper(p_brand) AS symbol FROM part WHERE p_size <= 45 AND p_size % 2 = 0 AND upper(p_brand) IN ('BRAND#1', 'BRAND#2', 'BRAND#11', 'BRAND#22', 'BRAND#35')""")
def symbol_universe(spark, folder):
    listed = F.array(F.struct(F.upper("p_brand").alias("symbol"), F.when(F.col("p_size") <= 45, "TRADING").otherwise("BREAK").alias("status"),
                              (F.col("p_size") % 2 == 0).alias("isMarginTradingAllowed")))
    info = table(spark, folder, "part").select(listed.alias("symbols"))  # one document per listing
    return scans.symbol_universe(info, ["BRAND#1", "BRAND#2", "BRAND#11", "BRAND#22", "BRAND#35"])


# -- sinks ---------------------------------------------------------------------

@query("parquet_round_trip", "SELECT event_type AS symbol, event_id AS id, value AS price FROM events")
def parquet_round_trip(spark, folder):
    path = _scratch(spark, "bars")
    sinks.parquet(ticks(spark, folder).select("symbol", "id", "price"), path)
    return spark.read.parquet(path)


def _kinds(t):
    """Event types: a handful, one file each."""
    return sorted(row[0] for row in t.select("symbol").distinct().collect())


@query("append_round_trip", "SELECT event_id AS id, value AS price FROM events")
def append_round_trip(spark, folder):
    path, t = _scratch(spark, "append"), ticks(spark, folder)
    for kind in _kinds(t):
        sinks.append(t.filter(F.col("symbol") == kind).select("id", "price"), path)
    return spark.read.parquet(path)


@query("daily_partitioned_trades", "SELECT event_type AS symbol, CAST(ts AS DATE)::VARCHAR AS date, count(*) AS n FROM events GROUP BY ALL")
def daily_partitioned_trades(spark, folder):
    path = _scratch(spark, "daily")
    sinks.daily(ticks(spark, folder), path, "ts")
    return spark.read.parquet(path).groupBy("symbol", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("dataset_bundle_round_trip", """SELECT CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, event_id AS id, value FROM events""")
def dataset_bundle_round_trip(spark, folder):
    path, m = _scratch(spark, "bundle"), F.col("event_id") % 10
    df = table(spark, folder, "events").select(
        F.when(m < 6, "train").when(m < 8, "val").otherwise("test").alias("split"), F.col("event_id").alias("id"), "value")
    sinks.dataset_bundle(df, path)
    return spark.read.parquet(path).select("split", "id", "value")


@query("csv_round_trip_by_file", "SELECT event_type AS bar_type, event_id AS id, value AS price FROM events")
def csv_round_trip_by_file(spark, folder):
    path, t = _scratch(spark, "csv"), ticks(spark, folder)
    kinds = _kinds(t)
    for kind in kinds:
        sinks.csv(t.filter(F.col("symbol") == kind).select("id", "price"), f"{path}/{kind}")
    return scans.csv_by_file(spark, [f"{path}/{kind}" for kind in kinds], "id long, price double").select("bar_type", "id", "price")


@query("array_store_append", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM embeddings")
def array_store_append(spark, folder):
    path, e = _scratch(spark, "arrays"), table(spark, folder, "embeddings")
    sinks.append(e.filter("vec_id % 2 = 0"), path)
    sinks.append(e.filter("vec_id % 2 = 1"), path)
    v = F.transform("embedding", lambda x: x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), r(A.sum_of(v)).alias("total"))


# -- messages --------------------------------------------------------------------

@query("parse_agg_trades", """SELECT event_id AS aggregate_trade_id, value AS price, user_id::DOUBLE AS quantity, epoch_us(ts) // 1000 * 1000 AS ts, event_id % 2 = 0 AS is_buyer_market_maker FROM events""")
def parse_agg_trades(spark, folder):
    msg = F.to_json(F.struct(F.col("event_id").alias("a"), F.col("value").cast("string").alias("p"), F.col("user_id").cast("string").alias("q"),
                             F.floor(micros("ts") / 1000).alias("T"), (F.col("event_id") % 2 == 0).alias("m")))
    out = feeds.agg_trades(table(spark, folder, "events").select(msg.alias("value")))
    return out.select("aggregate_trade_id", "price", "quantity", "ts", "is_buyer_market_maker")


@query("parse_depth_diffs", """SELECT 'S' || user_id AS symbol, epoch_us(ts) // 1000 * 1000 AS event_ts, event_id * 10 AS first_id, event_id * 10 + 9 AS last_id,
  event_id * 10 - 1 AS previous_id, value AS bid, user_id::DOUBLE AS bid_qty, 0 AS n_asks FROM events""")
def parse_depth_diffs(spark, folder):
    e = F.col("event_id") * 10
    body = F.concat(F.lit('{"e":"depthUpdate","E":'), F.floor(micros("ts") / 1000), F.lit(',"T":1,"s":"S'), F.col("user_id"), F.lit('","U":'), e,
                    F.lit(',"u":'), e + 9, F.lit(',"pu":'), e - 1, F.lit(',"b":[["'), F.col("value"), F.lit('","'), F.col("user_id"), F.lit('"]],"a":[]}'))
    out = feeds.depth_diffs(table(spark, folder, "events").select(body.alias("value")))
    return out.select("symbol", "event_ts", "first_id", "last_id", "previous_id", F.col("bids")[0]["price"].alias("bid"),
                      F.col("bids")[0]["qty"].alias("bid_qty"), F.size("asks").alias("n_asks"))


@query("parse_depth_snapshots", """SELECT event_id AS snapshot_id, value AS bid, value + 1 AS ask FROM events""")
def parse_depth_snapshots(spark, folder):
    body = F.concat(F.lit('{"lastUpdateId":'), F.col("event_id"), F.lit(',"bids":[["'), F.col("value"), F.lit('","1"]],"asks":[["'),
                    F.col("value") + 1, F.lit('","2"]]}'))
    out = feeds.snapshots(table(spark, folder, "events").select(body.alias("value")))
    return out.select("snapshot_id", F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))


_KLINE_SQL = f"""b AS (SELECT symbol, pos // 20 AS k, min(ts) // 1000 AS open_time, max(ts) // 1000 AS close_time, {OHLC_SQL}, sum(qty) AS volume, count(*) AS number_of_trades,
  round(sum(price * qty), 4) AS quote_asset_volume FROM t GROUP BY ALL)"""


def _klines(spark, folder):
    t = lay_out(ticks(spark, folder), ["symbol"], ["ts", "id"]).df
    b = t.groupBy("symbol", F.floor(F.col("_pos") / 20).alias("k")).agg(
        F.floor(F.min("ts") / 1000).alias("open_time"), F.floor(F.max("ts") / 1000).alias("close_time"),
        F.min_by("price", "_pos").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_pos").alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("number_of_trades"),
        F.round(F.sum(F.col("price") * F.col("qty")), 4).alias("quote_asset_volume"))
    cells = [F.col(n).cast("string") if n in b.columns else F.lit("0") for n in KLINE_FIELDS]
    return b.select("symbol", F.to_json(F.array(*cells)).alias("value"))


@query("parse_klines", f"""WITH {TICKS_SQL}, {_KLINE_SQL} SELECT symbol, open_time, open, high, low, close, volume, close_time, quote_asset_volume, number_of_trades FROM b""")
def parse_klines(spark, folder):
    return feeds.klines(_klines(spark, folder)).drop("taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")


@query("klines_to_bars", f"""WITH {TICKS_SQL}, {_KLINE_SQL} SELECT symbol, close_time * 1000 AS bar_ts, close, volume FROM b""")
def klines_to_bars(spark, folder):
    return feeds.klines(_klines(spark, folder)).select("symbol", (F.col("close_time") * 1000).alias("bar_ts"), "close", "volume")


@query("route_multiplexed_messages", """SELECT upper('sym' || user_id) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'kline_1m' ELSE 'aggTrade' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN '{"c":' || event_id || '}' ELSE '{"a":' || event_id || '}' END AS payload FROM events""")
def route_multiplexed_messages(spark, folder):
    even = F.col("event_id") % 2 == 0
    name = F.concat(F.lit("sym"), F.col("user_id"), F.when(even, "@kline_1m").otherwise("@aggTrade"))
    body = F.when(even, F.concat(F.lit('{"k":{"c":'), F.col("event_id"), F.lit("}}"))).otherwise(
        F.concat(F.lit('{"a":'), F.col("event_id"), F.lit("}")))
    msg = F.concat(F.lit('{"stream":"'), name, F.lit('","data":'), body, F.lit("}"))
    return feeds.route(table(spark, folder, "events").select(msg.alias("value")))


# -- order book from line items: side by status, level by rounded price ---------------

_BOOK_SQL = """u AS (SELECT l_returnflag AS symbol, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side,
  round(l_extendedprice / l_quantity, -2) + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 6000 END AS price,
  CASE WHEN l_quantity <= 20 THEN 0 ELSE l_quantity END AS qty, l_orderkey AS seq0, epoch_us(l_shipdate) // 86400000000 AS day FROM lineitem),
up AS (SELECT symbol, side, price, max(qty) AS qty, day * 100000 + seq0 % 100000 AS seq FROM u GROUP BY symbol, side, price, day * 100000 + seq0 % 100000)"""


def _book_lines(spark, folder):
    """Level updates as line items tell them."""
    line = table(spark, folder, "lineitem")
    bid = F.col("l_linestatus") == "F"
    return line.select(
        F.col("l_returnflag").alias("symbol"), F.when(bid, "bid").otherwise("ask").alias("side"),
        (F.round(F.col("l_extendedprice") / F.col("l_quantity"), -2) + F.when(bid, 0).otherwise(6000)).alias("price"),
        F.when(F.col("l_quantity") <= 20, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
        (F.floor(micros("l_shipdate") / 86_400_000_000) * 100_000 + F.col("l_orderkey") % 100_000).cast("long").alias("seq"))


def book_updates(spark, folder):
    """Level updates with one quantity per (symbol, side, price, update id)."""
    return _book_lines(spark, folder).groupBy("symbol", "side", "price", "seq").agg(F.max("qty").alias("qty"))


@query("book_top_levels", f"""WITH {_BOOK_SQL}, l AS (SELECT symbol, side, price, arg_max(qty, seq) AS qty FROM up GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS level FROM l WHERE qty > 0)
SELECT symbol, side, level, price, qty FROM a WHERE level <= 10""")
def book_top_levels(spark, folder):
    out = BK.book_at(book_updates(spark, folder), ["symbol"], "side", "price", "qty", "seq", None, 10)
    return out.select("symbol", "side", F.col("level").cast("long").alias("level"), "price", "qty")


@query("book_level_lifetimes", f"""WITH {_BOOK_SQL}, n AS (SELECT *, lead(seq) OVER (PARTITION BY symbol, side, price ORDER BY seq) AS until FROM up)
SELECT symbol, side, price, qty, seq, until FROM n WHERE qty > 0""")
def book_level_lifetimes(spark, folder):
    return BK.level_lifetimes(book_updates(spark, folder), ["symbol"], "side", "price", "qty", "seq").select(
        "symbol", "side", "price", "qty", "seq", "until")


_BEST_SQL = f"""{_BOOK_SQL}, n AS (SELECT *, lead(seq) OVER (PARTITION BY symbol, side, price ORDER BY seq) AS until FROM up),
s AS (SELECT DISTINCT symbol, seq FROM up),
bb AS (SELECT s.symbol, s.seq, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask
  FROM s JOIN n ON n.symbol = s.symbol AND n.qty > 0 AND n.seq <= s.seq AND (n.until > s.seq OR n.until IS NULL) GROUP BY ALL)"""


@query("book_best_prices", f"WITH {_BEST_SQL} SELECT symbol, seq, best_bid, best_ask FROM bb")
def book_best_prices(spark, folder):
    out = BK.top_of_book(book_updates(spark, folder), ["symbol"], "side", "price", "qty", "seq")
    return out.filter("best_bid IS NOT NULL OR best_ask IS NOT NULL").select("symbol", "seq", "best_bid", "best_ask")


@query("updates_after_snapshot", f"""WITH {_BOOK_SQL}, p AS (SELECT symbol, quantile_disc(seq, 0.5) AS snap FROM up GROUP BY 1)
SELECT up.symbol, side, price, qty, seq FROM up JOIN p USING (symbol) WHERE seq > snap""")
def updates_after_snapshot(spark, folder):
    up = book_updates(spark, folder)
    snap = discrete_quantile(up, ["symbol"], "seq", 0.5, "snapshot_id")
    return BK.after_snapshot(up, snap, ["symbol"], "seq", "snapshot_id").select("symbol", "side", "price", "qty", "seq")


@query("sequence_gap_segments", """WITH d AS (SELECT event_type AS symbol, event_id * 10 AS first_id, event_id * 10 + 9 AS last_id,
  lag(event_id) OVER w * 10 + 9 + CASE WHEN user_id % 40 = 0 THEN 1 ELSE 0 END AS previous_id, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
g AS (SELECT *, CASE WHEN pos > 0 AND previous_id <> lag(last_id) OVER (PARTITION BY symbol ORDER BY last_id) THEN 1 ELSE 0 END AS gap FROM d)
SELECT symbol, last_id, gap, CAST(sum(gap) OVER (PARTITION BY symbol ORDER BY last_id) AS BIGINT) AS segment FROM g""")
def sequence_gap_segments(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("symbol"), (F.col("event_id") * 10).alias("first_id"),
                                              (F.col("event_id") * 10 + 9).alias("last_id"), "user_id")
    s = lay_out(e, ["symbol"], ["last_id"])
    named = s.windowed(lambda df, w: df.withColumn(
        "previous_id", F.lag("last_id").over(w) + F.when(F.col("user_id") % 40 == 0, 1).otherwise(0)), before=1)
    series = lay_out(named.drop("_pos"), ["symbol"], ["last_id"])
    return BK.sequence_gaps(series, "first_id", "last_id", "previous_id").select("symbol", "last_id", "gap", "segment")


@query("mid_and_depth_row", """WITH g AS (SELECT l_suppkey, list(DISTINCT l_extendedprice) FILTER (l_linestatus = 'F') AS b, list(DISTINCT l_extendedprice) FILTER (l_linestatus = 'O') AS a FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, list_sort(b, 'DESC')[1:3] AS b, list_sort(a)[1:3] AS a FROM g)
SELECT l_suppkey, round((b[1] + a[1]) / 2 + 3e-7, 6) AS mid, 12 AS n_cells, round(list_sum(b) + list_sum(a) + 9 + 3e-7, 6) AS total FROM s WHERE len(a) = 3 AND len(b) = 3""")
def mid_and_depth_row(spark, folder):
    from tickweave.operators.cleaning import top_per_key
    x = table(spark, folder, "lineitem").select("l_suppkey", "l_linestatus", F.col("l_extendedprice").alias("p")).distinct()
    tops = top_per_key(x, ["l_suppkey", "l_linestatus"], [F.when(F.col("l_linestatus") == "F", -F.col("p")).otherwise(F.col("p"))], 3)
    level = F.struct("rank", F.col("p").alias("price"), F.lit(1.5).alias("qty"))
    sides = tops.groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == "F", level))).alias("bids"),
        F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == "O", level))).alias("asks"))
    full = sides.filter((F.size("bids") == 3) & (F.size("asks") == 3)).withColumn("row", BK.depth_row(F.col("bids"), F.col("asks"), 3))
    mid = (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2
    return full.select("l_suppkey", F.round(mid + 3e-7, 6).alias("mid"), F.size("row").alias("n_cells"),
                       F.round(A.sum_of(F.col("row")) + 3e-7, 6).alias("total"))


# -- scalars ------------------------------------------------------------------------

_PROB_SQL = "p AS (SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN 1.0 WHEN event_id % 89 = 0 THEN 0.0 ELSE 1 - exp(-value / 50) END::DOUBLE AS p, value, user_id FROM events)"


def _probs(spark, folder):
    e = F.col("event_id")
    p = F.when(e % 97 == 0, 1.0).when(e % 89 == 0, 0.0).otherwise(1 - F.exp(-F.col("value") / 50))
    return table(spark, folder, "events").select(e.alias("id"), p.alias("p"), "value", "user_id")


@query("discrete_signal", f"WITH {_PROB_SQL} SELECT id, round(greatest(least(round_even((p * 3 - 1.5) / 0.1, 0) * 0.1, 1), -1), 6) + 0.0 AS signal FROM p")
def discrete_signal(spark, folder):
    return _probs(spark, folder).select("id", r(S.discrete_signal(F.col("p") * 3 - 1.5, 0.1)).alias("signal"))


@query("bet_statistic", f"""WITH {_PROB_SQL} SELECT id, round(CASE WHEN p = 1 THEN 1 WHEN p = 0 THEN -1 ELSE (p - 0.5) / (p * (1 - p)) END, 4) + 0.0 AS z,
  round(CASE WHEN p = 1 THEN 1 WHEN p = 0 THEN -1 ELSE (p - 1 / 3.0::DOUBLE) / sqrt(p * (1 - p)) END, 4) + 0.0 AS z_root FROM p""")
def bet_statistic(spark, folder):
    return _probs(spark, folder).select("id", r(S.bet_z(F.col("p")), 4).alias("z"), r(S.bet_z(F.col("p"), 3, root=True), 4).alias("z_root"))


@query("bet_size_from_probability")
def bet_size_from_probability(spark, folder):
    side = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    return _probs(spark, folder).select("id", S.bet_size(F.col("p"), 2, side, step=0.05).alias("size"), S.bet_size(F.col("p"), 3, root=True).alias("size_three"))


@query("signed_log", f"WITH {_PROB_SQL} SELECT id, round(sign(value - 40) * ln(1 + 2 * abs(value - 40)), 6) + 0.0 AS y FROM p")
def signed_log(spark, folder):
    return _probs(spark, folder).select("id", r(S.signed_log(F.col("value") - 40, 2.0)).alias("y"))


@query("truncating_round", "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(trunc(CAST(l_extendedprice - 50000 AS DECIMAL(18, 4)) * 10) / 10 AS DOUBLE) + 0.0 AS y FROM lineitem")
def truncating_round(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        (S.truncate_decimal(F.col("l_extendedprice").cast("decimal(18,4)") - 50000, 1) + F.lit(0.0)).alias("y"))


@query("flat_levels_round_trip", """SELECT vec_id, len(embedding[1:8]) // 2 AS n_levels, round(list_sum([embedding[i]::DOUBLE for i in [1, 3, 5, 7]]), 6) + 0.0 AS price_sum,
  round(list_sum([embedding[i]::DOUBLE for i in range(1, 9)]), 6) + 0.0 AS total FROM embeddings""")
def flat_levels_round_trip(spark, folder):
    pairs = A.pairs_from_flat(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.size(pairs).cast("long").alias("n_levels"), r(A.sum_of(F.transform(pairs, lambda x: x["price"]))).alias("price_sum"),
        r(A.sum_of(A.flat_from_pairs(pairs))).alias("total"))


@query("name_splitting", "SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS pair, concat_ws('_', p_brand, p_type) AS word FROM part")
def name_splitting(spark, folder):
    return table(spark, folder, "part").select(feeds.pair_of_table(F.regexp_replace("p_name", " ", "_")).alias("pair"),
                                               F.concat_ws("_", "p_brand", "p_type").alias("word")).distinct()


@query("date_math", """SELECT event_id AS id, strftime(ts, '%d %b, %Y') AS label, epoch_us(date_trunc('day', ts)) // 1000 AS day_ms, epoch_us(ts + INTERVAL 90 MINUTE) AS later FROM events""")
def date_math(spark, folder):
    ts = F.col("ts").cast("timestamp")
    label = F.date_format(ts, "dd MMM, yyyy")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), label.alias("label"), F.floor(F.unix_micros(F.to_timestamp(label, "dd MMM, yyyy")) / 1000).alias("day_ms"),
        F.unix_micros(ts + F.expr("INTERVAL 90 MINUTES")).alias("later"))


@query("array_dot_clip", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) + 0.0 AS dot,
  round(list_sum(list_transform(embedding, lambda x: greatest(least(x::DOUBLE, 0.1), -0.1))), 6) + 0.0 AS clipped FROM embeddings""")
def array_dot_clip(spark, folder):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select(
        "vec_id", r(A.dot(v, v)).alias("dot"), r(A.sum_of(F.transform(v, lambda x: S.clip(x, -0.1, 0.1)))).alias("clipped"))


@query("class_weight_lookup", """WITH c AS (SELECT quality, max(count(*)) OVER () / count(*) AS w FROM labels GROUP BY 1) SELECT doc_id, round_even(w, 2) AS weight FROM labels JOIN c USING (quality)""")
def class_weight_lookup(spark, folder):
    from tickweave.operators.aggregates import class_weights
    labels = table(spark, folder, "labels")
    lookup = class_weights(labels, "quality").agg(F.map_from_entries(F.collect_list(F.struct("quality", "majority_ratio"))).alias("m"))  # one entry per class
    return labels.crossJoin(F.broadcast(lookup)).select("doc_id", F.element_at("m", F.col("quality")).alias("weight"))


@query("dynamic_bet_sizing", f"""WITH {_PROB_SQL}, f AS (SELECT id, value AS forecast, 50.0::DOUBLE AS market, 100 * (1 / 0.25 - 1) AS w, user_id % 7 AS pos FROM p)
SELECT id, round((forecast - market) / sqrt(w + (forecast - market) ** 2), 6) + 0.0 AS size, CAST(trunc((forecast - market) / sqrt(w + (forecast - market) ** 2) * 20) AS BIGINT) AS target,
  round(forecast - 0.3 * sqrt(w / (1 - 0.09)), 6) + 0.0 AS inverse FROM f""")
def dynamic_bet_sizing(spark, folder):
    w = S.width_for(F.lit(0.5), F.lit(10.0))
    gap = F.col("value") - 50.0
    return _probs(spark, folder).select(
        "id", r(S.sigmoid_size(w, gap)).alias("size"), S.target_position(w, F.col("value"), F.lit(50.0), F.lit(20)).alias("target"),
        r(S.inverse_price(F.col("value"), w, F.lit(0.3))).alias("inverse"))


@query("limit_price", f"""WITH {_PROB_SQL}, f AS (SELECT id, value AS forecast, user_id % 7 AS pos, CAST(3 + user_id % 5 AS BIGINT) AS target FROM p),
j AS (SELECT id, pos, target, unnest(generate_series(least(abs(pos + sg), target), greatest(abs(pos + sg), target))) AS j, forecast FROM (SELECT *, CASE WHEN target >= pos THEN 1 ELSE -1 END AS sg FROM f))
SELECT id, round(sum(forecast - j / 20.0::DOUBLE * sqrt(300 / (1 - (j / 20.0::DOUBLE) ** 2))) / abs(target - pos), 6) + 0.0 AS price FROM j WHERE target <> pos GROUP BY id, target, pos""")
def limit_price(spark, folder):
    pos, target = (F.col("user_id") % 7).cast("long"), (3 + F.col("user_id") % 5).cast("long")
    return _probs(spark, folder).filter(pos != target).select(
        "id", r(S.limit_price(target, pos, F.col("value"), F.lit(300.0), F.lit(20))).alias("price"))


@query("budget_sizing", f"""WITH {TICKS_SQL} SELECT symbol, round(count(*) FILTER (price > 50) / max(qty) - count(*) FILTER (price <= 50) / 1000, 6) + 0.0 AS size FROM t GROUP BY 1""")
def budget_sizing(spark, folder):
    g = ticks(spark, folder).groupBy("symbol").agg(F.count(F.when(F.col("price") > 50, 1)).alias("l"), F.count(F.when(F.col("price") <= 50, 1)).alias("s"), F.max("qty").alias("m"))
    return g.select("symbol", r(S.budget_size(F.col("l"), F.col("m"), F.col("s"), F.lit(1000))).alias("size"))


# -- streams ---------------------------------------------------------------------------

def _stream(spark, folder):
    raw = ingest.files(spark, folder, table(spark, folder, "events").schema, pattern="events.parquet")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), micros("ts").alias("ts"),
                      F.col("event_id").alias("id"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))


def _drained(spark, df, mode="append", parts=None):
    path = _scratch(spark, "stream")
    ingest.drain(df, path, path + "-state", mode, parts)
    return spark.read.parquet(path).drop("batch")


@query("stream_ingest_batches", "SELECT event_type AS symbol, event_id AS id, value AS price FROM events")
def stream_ingest_batches(spark, folder):
    return _drained(spark, _stream(spark, folder).select("symbol", "id", "price"))


@query("stream_time_bars", f"""WITH {TICKS_SQL} SELECT symbol, (ts // {HOUR} + 1) * {HOUR} AS bar_ts, {OHLC_SQL}, sum(qty) AS volume FROM t GROUP BY symbol, ts // {HOUR}""")
def stream_time_bars(spark, folder):
    path = _scratch(spark, "stream")
    ingest.drain_windows(_stream(spark, folder), "at", lambda live: stateful.time_bars(live, ["symbol"], "at", "id", "price", "qty", "1 hour", "10 minutes"),
                         path, path + "-state", path + "-beat")
    return spark.read.parquet(path).drop("batch")


@query("stream_volume_bars", _bars_sql("qty", 500))
def stream_volume_bars(spark, folder):
    src = _stream(spark, folder).drop("at").withColumn("amt", F.col("qty"))
    return _drained(spark, stateful.amount_bars(src, "symbol", "ts", "id", "price", "qty", "amt", 500.0)).withColumn("amount", r("amount", 4))


@query("stream_cusum_events", _cusum_sql("mv", 1, "", True, extra=_DIFF, h="150.0"))
def stream_cusum_events(spark, folder):
    return _drained(spark, stateful.cusum(_stream(spark, folder).drop("at", "qty"), "symbol", "ts", "id", "price", 150.0))


def _out_of_order(spark, folder, build):
    """The events in five files with times of the whole table in each, one file a trigger, folded as the watermark passes."""
    path = _scratch(spark, "shuffled")
    sinks.parquet(table(spark, folder, "events").repartition(5, "event_id"), path)
    raw = ingest.files(spark, path, spark.read.parquet(path).schema, per_trigger=1)
    src = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), micros("ts").alias("ts"),
                     F.col("event_id").alias("id"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))
    ingest.drain_windows(src, "at", build, path + "-out", path + "-state", path + "-beat")
    return spark.read.parquet(path + "-out").drop("batch")


@query("stream_volume_bars_out_of_order", _bars_sql("qty", 500))
def stream_volume_bars_out_of_order(spark, folder):
    made = _out_of_order(spark, folder, lambda live: stateful.amount_bars(
        live.withColumn("amt", F.col("qty")), "symbol", "ts", "id", "price", "qty", "amt", 500.0, at="at", late="1000 days", bucket_us=24 * HOUR))
    return made.withColumn("amount", r("amount", 4))


@query("stream_cusum_events_out_of_order", _cusum_sql("mv", 1, "", True, extra=_DIFF, h="150.0"))
def stream_cusum_events_out_of_order(spark, folder):
    return _out_of_order(spark, folder, lambda live: stateful.cusum(live, "symbol", "ts", "id", "price", 150.0, at="at", late="1000 days", bucket_us=24 * HOUR))


def _fed_in_order(spark, msgs, feed, feeds):
    """Messages as a stream that brings one ``feed`` (a column, 0 to ``feeds - 1``) a micro-batch, the lowest first.

    Each is one file, and the source takes files by their time of change. Where that cannot be set, the files are written
    once more one after the other.
    """
    path = _scratch(spark, "depth")
    laid = msgs.withColumn("_feed", feed.cast("int")).repartition(feeds, "_feed").sortWithinPartitions("_feed", "symbol", "last_id")
    laid.write.option("parquet.block.size", FEED_BLOCK_BYTES).partitionBy("_feed").parquet(path)
    schema = spark.read.schema(laid.schema).parquet(path).schema
    files = {f: n for f, n in spark.read.schema(schema).parquet(path).select("_feed", F.col("_metadata.file_path")).distinct().collect()}   # one a feed
    if not ingest.by_time(spark, [files[f] for f in sorted(files)]):
        spread, path = path, _scratch(spark, "depth")
        for f in sorted(files):
            sinks.append(spark.read.schema(schema).parquet(spread).filter(F.col("_feed") == f).coalesce(1), path)
    return ingest.files(spark, path, schema, per_trigger=1).drop("_feed")


@query("stream_order_book", f"""WITH {_BEST_SQL}, q AS (SELECT symbol, seq, best_bid, best_ask, row_number() OVER w AS k,
  lag(best_bid) OVER w AS pb, lag(best_ask) OVER w AS pa FROM bb WINDOW w AS (PARTITION BY symbol ORDER BY seq))
SELECT symbol, seq AS last_id, best_bid, best_ask FROM q WHERE k = 1 OR best_bid IS DISTINCT FROM pb OR best_ask IS DISTINCT FROM pa""")
def stream_order_book(spark, folder):
    lines = _book_lines(spark, folder)
    # all lines of a message meet once: both groupings keep to that
    up = lines.repartition("symbol", "seq").groupBy("symbol", "side", "price", "seq").agg(F.max("qty").alias("qty"))
    side = lambda name: F.transform(F.filter("levels", lambda x: x["side"] == name), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    # stored, since a layout reads its input twice
    diffs = stored(up.groupBy("symbol", "seq").agg(F.collect_list(F.struct("side", "price", "qty")).alias("levels")).select(
        "symbol", "seq", side("bid").alias("bids"), side("ask").alias("asks")))
    series = lay_out(diffs, ["symbol"], ["seq"]).with_length()
    chained = series.windowed(lambda df, w: df.withColumn("previous_id", F.coalesce(F.lag("seq").over(w), F.lit(0).cast("long"))), before=1)
    feeds = max(1, -(-series.total // FEED_ROWS))
    # each feed takes the same share of every symbol; what has no id comes last
    feed = F.when(F.col("last_id").isNull(), feeds - 1).otherwise(F.floor(F.col("_at") * feeds))
    msgs = chained.select("symbol", F.lit(False).alias("is_snapshot"), F.when(F.col("_pos") == 0, F.lit(1).cast("long")).otherwise(F.col("seq")).alias("first_id"),
                          F.col("seq").alias("last_id"), "previous_id", "bids", "asks", (F.col("_pos") / F.col("_n")).alias("_at"))
    empty = F.array().cast("array<struct<price:double,qty:double>>")
    zero = F.lit(0).cast("long")
    symbols = stored(lines.select("symbol").distinct())           # each has a book of its own
    snaps = symbols.select(
        "symbol", F.lit(True).alias("is_snapshot"), zero.alias("first_id"), zero.alias("last_id"),
        zero.alias("previous_id"), empty.alias("bids"), empty.alias("asks"), F.lit(0.0).alias("_at"))
    live = _fed_in_order(spark, msgs.unionByName(snaps), feed, feeds)
    out = _drained(spark, stateful.rebuild_book(live), parts=STATE_PARTS * max(1, symbols.count()))
    return out.filter("kind = 'book'").select("symbol", "last_id", "best_bid", "best_ask")
