"""Point-in-time, interval and alignment joins."""

from pyspark.sql import functions as F

from tickweave.operators import joins as J
from tickweave.plans.registry import TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, ticks
from tickweave.series import lay_out
from tickweave.session import micros

DAY = 86_400_000_000
HOUR = 3_600_000_000
SIDES_SQL = """tr AS (SELECT user_id, epoch_us(ts) AS ts, event_id AS id, value AS price FROM events WHERE event_type = 'purchase'),
bk AS (SELECT user_id, epoch_us(ts) AS ts, event_id AS bid_id, value AS mid, value * 2 AS depth FROM events WHERE event_type = 'view')"""


def _sides(spark, folder):
    e = table(spark, folder, "events").select("user_id", micros("ts").alias("ts"), "event_id", "event_type", "value")
    trades = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))
    book = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("bid_id"),
                                                  F.col("value").alias("mid"), (F.col("value") * 2).alias("depth"))
    return trades, book


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


@query("asof_trades_quotes", f"""WITH {SIDES_SQL}
SELECT tr.user_id, tr.ts, tr.id, tr.price, bk.bid_id, bk.mid, bk.depth FROM tr ASOF LEFT JOIN bk
  ON tr.user_id = bk.user_id AND tr.ts >= bk.ts""")
def asof_trades_quotes(spark, folder):
    trades, book = _sides(spark, folder)
    return J.trades_with_book(trades, book, ["user_id"], "ts", ["bid_id", "mid", "depth"], tie="bid_id")


@query("asof_trades_quotes_closed_tail", f"""WITH {SIDES_SQL}, e AS (SELECT user_id, max(ts) AS last_book FROM bk GROUP BY 1)
SELECT tr.user_id, tr.ts, tr.id, tr.price, CASE WHEN tr.ts <= last_book THEN bk.bid_id END AS bid_id,
  CASE WHEN tr.ts <= last_book THEN bk.mid END AS mid
FROM tr ASOF LEFT JOIN bk ON tr.user_id = bk.user_id AND tr.ts >= bk.ts LEFT JOIN e ON e.user_id = tr.user_id""")
def asof_trades_quotes_closed_tail(spark, folder):
    trades, book = _sides(spark, folder)
    return J.trades_with_book(trades, book, ["user_id"], "ts", ["bid_id", "mid"], tie="bid_id", drop_open_tail=True)


@query("asof_one_long_series", f"""WITH {SIDES_SQL}
SELECT tr.id, bk.bid_id, bk.mid FROM tr ASOF LEFT JOIN bk ON tr.ts >= bk.ts""")
def asof_one_long_series(spark, folder):
    trades, book = _sides(spark, folder)
    return J.asof_join(trades, book, [], "ts", "ts", ["bid_id", "mid"], tie="bid_id").select("id", "bid_id", "mid")


@query("vertical_barrier", f"""WITH {TICKS_SQL}
SELECT e.symbol, e.id, b.ts AS t1 FROM (SELECT *, ts + {DAY} AS due FROM t) e ASOF JOIN t b ON e.symbol = b.symbol AND e.due <= b.ts""")
def vertical_barrier(spark, folder):
    bars = ticks(spark, folder)
    return J.vertical_barrier(bars, bars.select("symbol", "ts", "id"), ["symbol"], "ts", DAY).select("symbol", "id", "t1")


@query("price_backfill", f"""WITH {TICKS_SQL}
SELECT e.symbol, e.id, b.price AS next_price FROM (SELECT *, ts + {HOUR} AS due FROM t) e
ASOF LEFT JOIN t b ON e.symbol = b.symbol AND e.due <= b.ts""")
def price_backfill(spark, folder):
    bars = ticks(spark, folder)
    points = bars.select("symbol", "id", (F.col("ts") + HOUR).alias("due"))
    return J.price_at(bars, points, ["symbol"], "ts", "due", "price", "next_price", tie="id").drop("due")


@query("lookback_return_first_at_or_after", f"""WITH {TICKS_SQL},
a AS (SELECT e.symbol, e.id, e.pos, e.price / b.price - 1 AS ret, b.pos AS ref FROM (SELECT *, ts - {DAY} AS due FROM t) e
  ASOF JOIN t b ON e.symbol = b.symbol AND e.due <= b.ts)
SELECT symbol, id, round(ret, 6) + 0.0 AS ret FROM a WHERE ref > 0
QUALIFY row_number() OVER (PARTITION BY symbol, ref ORDER BY pos) = 1""")
def lookback_return_first_at_or_after(spark, folder):
    return J.lookback_return(ticks(spark, folder), ["symbol"], "ts", "price", DAY, tie="id").select(
        "symbol", "id", r("ret").alias("ret"))


@query("lookback_return_last_before", f"""WITH {TICKS_SQL}
SELECT e.symbol, e.id, round(e.price / b.price - 1, 6) + 0.0 AS ret FROM (SELECT *, ts - {DAY} AS due FROM t) e
  ASOF JOIN t b ON e.symbol = b.symbol AND e.due > b.ts""")
def lookback_return_last_before(spark, folder):
    return J.lookback_return(ticks(spark, folder), ["symbol"], "ts", "price", DAY, "before", tie="id").select(
        "symbol", "id", r("ret").alias("ret"))


def spans(spark, folder, series=None):
    """An event at every tick, open until the first tick six hours later."""
    series = series or _ticks(spark, folder)
    bars = series.df.select("symbol", "ts", "id", F.col("_pos").alias("p1"))
    picked = series.df.select("symbol", "ts", "id", F.col("_pos").alias("p0"))
    ahead = J.vertical_barrier(bars.withColumnRenamed("id", "bar_id"), picked, ["symbol"], "ts", 6 * HOUR, ["p1"])
    return series, ahead


SPANS_SQL = f"""sp AS (SELECT e.symbol, e.id, e.ts AS t0, e.pos AS p0, b.pos AS p1, b.ts AS t1
  FROM (SELECT *, ts + {6 * HOUR} AS due FROM t) e ASOF JOIN t b ON e.symbol = b.symbol AND e.due <= b.ts)"""


@query("purge_overlapping_intervals", f"""WITH {TICKS_SQL}, {SPANS_SQL}
SELECT a.symbol, a.id FROM sp a WHERE a.p0 % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.symbol = a.symbol
  AND b.p0 % 35 = 0 AND a.t0 <= b.t1 AND a.t1 >= b.t0)""")
def purge_overlapping_intervals(spark, folder):
    _, sp = spans(spark, folder)
    cols = sp.select("symbol", "id", F.col("ts").alias("t0"), "t1", "p0")
    return J.overlap_anti_join(cols.filter("p0 % 3 <> 0"), cols.filter("p0 % 35 = 0"), ["symbol"], "t0", "t1").select("symbol", "id")


@query("event_concurrency", f"""WITH {TICKS_SQL}, {SPANS_SQL}
SELECT t.symbol, t.id, CAST(count(sp.id) AS BIGINT) AS n_active FROM t LEFT JOIN sp ON sp.symbol = t.symbol AND t.pos BETWEEN sp.p0 AND sp.p1
GROUP BY ALL""")
def event_concurrency(spark, folder):
    series, sp = spans(spark, folder)
    return J.concurrency(series, sp).select("symbol", "id", "n_active")


@query("indicator_pairs", f"""WITH {TICKS_SQL}, {SPANS_SQL}
SELECT sp.symbol, sp.id, t.pos AS bar_pos FROM sp JOIN t ON sp.symbol = t.symbol AND t.pos BETWEEN sp.p0 AND sp.p1""")
def indicator_pairs(spark, folder):
    _, sp = spans(spark, folder)
    return J.indicator_pairs(sp, ["symbol"], "id")


@query("average_active_signals", f"""WITH {TICKS_SQL}, {SPANS_SQL},
s AS (SELECT symbol, t0, CASE WHEN p0 % 21 = 0 THEN NULL ELSE t1 END AS t1, CASE WHEN id % 2 = 0 THEN 1.0 ELSE -0.5 END::DOUBLE AS signal FROM sp),
p AS (SELECT symbol, t0 AS t FROM s UNION SELECT symbol, t1 FROM s WHERE t1 IS NOT NULL)
SELECT p.symbol, p.t, CAST(count(s.signal) AS BIGINT) AS n_active, round(coalesce(avg(s.signal), 0), 6) + 0.0 AS signal
FROM p LEFT JOIN s ON s.symbol = p.symbol AND s.t0 <= p.t AND (p.t < s.t1 OR s.t1 IS NULL) GROUP BY ALL""")
def average_active_signals(spark, folder):
    _, sp = spans(spark, folder)
    s = sp.select("symbol", F.col("ts").alias("t0"), F.when(F.col("p0") % 21 != 0, F.col("t1")).alias("t1"),
                  F.when(F.col("id") % 2 == 0, 1.0).otherwise(-0.5).alias("signal"))
    out = J.active_signals(s, ["symbol"], "t0", "t1", "signal")
    return out.withColumn("signal", r("signal"))


@query("equi_join_on_time", """
SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_extendedprice FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderdate < TIMESTAMP '1996-01-01'""")
def equi_join_on_time(spark, folder):
    o = table(spark, folder, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    l = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    return J.equi_join(o.select("o_orderkey", "o_totalprice"), l, ["o_orderkey"], "left")


@query("outer_concat_on_time", """
WITH a AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, max(value) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, max(value) AS views FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT * FROM a FULL JOIN b USING (user_id, day)""")
def outer_concat_on_time(spark, folder):
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts").cast("string"))
    a = e.filter("event_type = 'click'").groupBy("user_id", "day").agg(F.max("value").alias("clicks"))
    b = e.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.max("value").alias("views"))
    return J.equi_join(a, b, ["user_id", "day"], "full")


@query("semi_join_customers", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_customers(spark, folder):
    o = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.equi_join(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), o, ["c_custkey"], "left_semi")


@query("align_by_position", f"""WITH {TICKS_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS p FROM t WHERE symbol = 'click'),
b AS (SELECT id AS other_id, row_number() OVER (ORDER BY ts, id) AS p FROM t WHERE symbol = 'view')
SELECT id, other_id FROM a JOIN b USING (p)""")
def align_by_position(spark, folder):
    e = ticks(spark, folder)
    a = lay_out(e.filter("symbol = 'click'").select("ts", "id"), [], ["ts", "id"])
    b = lay_out(e.filter("symbol = 'view'").select("ts", F.col("id").alias("other_id")), [], ["ts", "other_id"])
    return J.align_by_position(a, b, ["other_id"]).select("id", "other_id")
