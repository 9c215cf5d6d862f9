"""Bars over the event tape, one series per event type."""

from pyspark.sql import functions as F

from tickweave.operators import bars as B
from tickweave.plans.registry import TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, ticks
from tickweave.series import lay_out

HOUR = 3_600_000_000
OHLC_SQL = "arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close"


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


@query("time_bars_1h", f"""
WITH {TICKS_SQL},
b AS (SELECT symbol, (ts // {HOUR} + 1) * {HOUR} AS bar_ts, {OHLC_SQL}, sum(qty) AS volume FROM t GROUP BY ALL),
g AS (SELECT symbol, unnest(range(min(bar_ts), max(bar_ts) + 1, {HOUR})) AS bar_ts FROM b GROUP BY symbol)
SELECT g.symbol, g.bar_ts, open, high, low, close, coalesce(volume, 0) AS volume
FROM g LEFT JOIN b USING (symbol, bar_ts)""")
def time_bars_1h(spark, folder):
    return B.time_bars(ticks(spark, folder), TICK_KEYS, "ts", "id", "price", "qty", HOUR)


@query("tick_bars_100", f"""
WITH {TICKS_SQL},
b AS (SELECT symbol, pos // 100 AS bar, {OHLC_SQL}, sum(qty) AS volume FROM t GROUP BY ALL),
l AS (SELECT symbol, pos // 100 - 1 AS bar, ts AS bar_ts, id AS bar_id FROM t WHERE pos % 100 = 0 AND pos > 0)
SELECT * FROM b JOIN l USING (symbol, bar)""")
def tick_bars_100(spark, folder):
    return B.tick_bars(_ticks(spark, folder), "ts", "id", "price", "qty", 100)


@query("tick_bar_samples", f"""
WITH {TICKS_SQL} SELECT symbol, ts, id, price FROM t WHERE (pos + 1) % 25 = 0""")
def tick_bar_samples(spark, folder):
    return B.every_nth(_ticks(spark, folder), 25).select("symbol", "ts", "id", "price")


def _clock_sql(amount, threshold):
    return f"""
WITH RECURSIVE {TICKS_SQL},
a AS (SELECT *, {amount} AS amt FROM t),
f AS (
  SELECT symbol, pos, CASE WHEN amt >= {threshold} THEN 0 ELSE amt END AS acc,
         amt >= {threshold} AS hit, CAST(0 AS BIGINT) AS bar FROM a WHERE pos = 0
  UNION ALL
  SELECT a.symbol, a.pos, CASE WHEN f.acc + a.amt >= {threshold} THEN 0 ELSE f.acc + a.amt END,
         f.acc + a.amt >= {threshold}, f.bar + CAST(f.hit AS BIGINT)
  FROM f JOIN a ON a.symbol = f.symbol AND a.pos = f.pos + 1)"""


def _bars_sql(amount, threshold):
    return _clock_sql(amount, threshold) + f"""
SELECT symbol, bar, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, pos) AS close, sum(qty) AS volume, round(sum(amt), 4) + 0.0 AS amount, max(ts) AS bar_ts
FROM f JOIN a USING (symbol, pos) GROUP BY symbol, bar HAVING bool_or(hit)"""


def _samples_sql(amount, threshold):
    return _clock_sql(amount, threshold) + """
SELECT symbol, bar, ts, id, price FROM f JOIN a USING (symbol, pos) WHERE hit"""


def _amount_bars(spark, folder, amount, threshold):
    out = B.amount_bars(_ticks(spark, folder), "ts", "price", "qty", amount, threshold)
    return out.withColumn("amount", r("amount", 4))


def _amount_samples(spark, folder, amount, threshold):
    return B.amount_samples(_ticks(spark, folder), amount, threshold, ["symbol", "ts", "id", "price"]).select(
        "symbol", "bar", "ts", "id", "price")


@query("volume_bars", _bars_sql("qty", 500))
def volume_bars(spark, folder):
    return _amount_bars(spark, folder, F.col("qty"), 500)


@query("dollar_bars", _bars_sql("price * qty", 25000))
def dollar_bars(spark, folder):
    return _amount_bars(spark, folder, F.col("price") * F.col("qty"), 25000)


@query("volume_bar_samples", _samples_sql("qty", 300))
def volume_bar_samples(spark, folder):
    return _amount_samples(spark, folder, F.col("qty"), 300)


@query("dollar_bar_samples", _samples_sql("price * qty", 12000))
def dollar_bar_samples(spark, folder):
    return _amount_samples(spark, folder, F.col("price") * F.col("qty"), 12000)


@query("tick_rule_signs", f"""
WITH {TICKS_SQL},
m AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY pos) AS mv FROM t)
SELECT symbol, ts, id, coalesce(last_value(CASE WHEN abs(mv) > 1e-3 THEN CAST(sign(mv) AS DOUBLE) END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY pos), 0) AS tick_sign FROM m""")
def tick_rule_signs(spark, folder):
    return B.tick_rule(_ticks(spark, folder), "price").select("symbol", "ts", "id", "tick_sign")


@query("gap_segments", f"""
WITH {TICKS_SQL},
c AS (SELECT symbol, pos, CASE WHEN abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY pos)) > 250
  THEN 1 ELSE 0 END AS cut FROM t),
s AS (SELECT symbol, CAST(sum(cut) OVER (PARTITION BY symbol ORDER BY pos) AS BIGINT) AS segment FROM c)
SELECT symbol, segment, count(*) AS n_rows FROM s GROUP BY ALL""")
def gap_segments(spark, folder):
    return B.segment_lengths(B.segments(_ticks(spark, folder), "price", 250.0), TICK_KEYS)


@query("gap_segments_persistent", f"""
WITH {TICKS_SQL},
c AS (SELECT symbol, pos, CASE WHEN abs(price - lag(price) OVER w) > 150
  AND abs(coalesce(lead(price, 9) OVER w, last_value(price) OVER (PARTITION BY symbol ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - lag(price, 11) OVER w) > 150
  THEN 1 ELSE 0 END AS cut FROM t WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
s AS (SELECT symbol, CAST(sum(cut) OVER (PARTITION BY symbol ORDER BY pos) AS BIGINT) AS segment FROM c)
SELECT symbol, segment, count(*) AS n_rows FROM s GROUP BY ALL""")
def gap_segments_persistent(spark, folder):
    return B.segment_lengths(B.segments(_ticks(spark, folder), "price", 150.0, persist=10), TICK_KEYS)


@query("seconds_since_previous_bar", f"""
WITH {TICKS_SQL},
b AS (SELECT symbol, pos // 20 AS bar, min(ts) AS bar_ts FROM t GROUP BY ALL)
SELECT symbol, bar_ts, coalesce((bar_ts - lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts)) // 1000000, 0)
  AS seconds_since FROM b""")
def seconds_since_previous_bar(spark, folder):
    base = _ticks(spark, folder).df.groupBy("symbol", F.floor(F.col("_pos") / 20).alias("bar")).agg(
        F.min("ts").alias("bar_ts"))
    series = lay_out(base.select("symbol", "bar_ts"), ["symbol"], ["bar_ts"])
    return B.since_previous(series, "bar_ts").select("symbol", "bar_ts", "seconds_since")


_MOVES = """mv AS (SELECT *, CAST(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY pos)) AS DOUBLE) AS mv FROM t),
m AS (SELECT *, coalesce(last_value(nullif(mv, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos), 0) AS sg FROM mv)"""
_CLOSED = """SELECT symbol, bar, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,
  VOLUME AS volume, max(ts) AS bar_ts, count(*) AS n_ticks FROM f JOIN t USING (symbol, pos) WHERE live GROUP BY symbol, bar HAVING bool_or(hit)"""


def _flow_sql(amount, run):
    a, b = repr(2 / 1001), repr(2 / 4)
    reached = "greatest(up, dn) >= el * greatest(eu, ed)" if run else "abs(up - dn) >= el * abs(eu - ed)"
    return f"""WITH RECURSIVE {TICKS_SQL}, {_MOVES},
x AS (SELECT symbol, pos, CASE WHEN sg > 0 THEN {amount} ELSE 0 END::DOUBLE AS buy, CASE WHEN sg < 0 THEN {amount} ELSE 0 END::DOUBLE AS sell FROM m),
f AS (SELECT symbol, pos, 50.0::DOUBLE AS el, buy AS eu, sell AS ed, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, CAST(0 AS BIGINT) AS ln, false AS hit, false AS live, CAST(0 AS BIGINT) AS bar
      FROM x WHERE pos = 0
  UNION ALL
  SELECT symbol, pos, CASE WHEN hit THEN el + {b}::DOUBLE * (ln - el) ELSE el END, eu, ed, up, dn, ln, hit, live, bar FROM (
    SELECT *, live AND {reached} AS hit FROM (
      SELECT x.symbol, x.pos, f.el, f.eu + {a}::DOUBLE * (x.buy - f.eu) AS eu, f.ed + {a}::DOUBLE * (x.sell - f.ed) AS ed, x.pos >= 50 AS live,
        CASE WHEN x.pos >= 50 THEN CASE WHEN f.hit THEN 0 ELSE f.up END + x.buy ELSE 0 END AS up,
        CASE WHEN x.pos >= 50 THEN CASE WHEN f.hit THEN 0 ELSE f.dn END + x.sell ELSE 0 END AS dn,
        CASE WHEN x.pos >= 50 THEN CASE WHEN f.hit THEN 0 ELSE f.ln END + 1 ELSE 0 END AS ln, f.bar + CAST(f.hit AS BIGINT) AS bar
      FROM f JOIN x ON x.symbol = f.symbol AND x.pos = f.pos + 1)))
{_CLOSED.replace("VOLUME", "sum(qty)")}"""


_TICK_SQL = f"""WITH RECURSIVE {TICKS_SQL}, {_MOVES},
f AS (SELECT symbol, pos, 0.0::DOUBLE AS el, 0.0::DOUBLE AS es, 0.0::DOUBLE AS sh, 0.0::DOUBLE AS th, 0.0::DOUBLE AS sg, 0 AS ln, 0 AS op, false AS hit, false AS live, CAST(0 AS BIGINT) AS bar
      FROM m WHERE pos = 0
  UNION ALL
  SELECT symbol, pos, CASE WHEN hit THEN el + {2 / 11!r}::DOUBLE * (op - el) ELSE el END, CASE WHEN hit THEN sh ELSE es END, sh, th, sg, ln,
    CASE WHEN live AND NOT hit THEN op + 1 ELSE op END, hit, live, bar FROM (
    SELECT *, live AND ln >= 10 AND (abs(th) >= el * abs(es) OR ln > 1000) AS hit FROM (
      SELECT symbol, pos, live, bar, op, sg, CASE WHEN pos = 100 THEN 100.0 ELSE el END AS el,
        CASE WHEN live THEN es WHEN pos = 1 THEN sg ELSE es + {2 / 101!r}::DOUBLE * (sg - es) END AS es,
        CASE WHEN live AND pos = 100 THEN es WHEN live AND l0 > 0 THEN sh + {2 / 101!r}::DOUBLE * (sg - sh) ELSE sh END AS sh,
        CASE WHEN live AND l0 > 0 THEN t0 + sg ELSE 0 END AS th, CASE WHEN live THEN l0 + 1 ELSE 0 END AS ln FROM (
        SELECT *, CASE WHEN live AND l0 = 0 THEN 0 WHEN mv <> 0 THEN mv ELSE s0 END AS sg FROM (
          SELECT m.symbol, m.pos, m.mv, m.pos >= 100 AS live, f.bar + CAST(f.hit AS BIGINT) AS bar, f.el, f.es, f.sh,
            CASE WHEN f.hit OR m.pos = 100 THEN 0 ELSE f.ln END AS l0, CASE WHEN f.hit OR m.pos = 100 THEN 0 ELSE f.sg END AS s0,
            CASE WHEN f.hit OR m.pos = 100 THEN 0 ELSE f.th END AS t0, CASE WHEN f.hit OR m.pos = 100 THEN 0 ELSE f.op END AS op
          FROM f JOIN m ON m.symbol = f.symbol AND m.pos = f.pos + 1)))))
{_CLOSED.replace("VOLUME", "coalesce(sum(qty) FILTER (NOT hit), 0)")}"""


@query("tick_imbalance_bars", _TICK_SQL)
def tick_imbalance_bars(spark, folder):
    return B.tick_imbalance_bars(_ticks(spark, folder), "ts", "price", "qty", warmup=100)


def _flow(spark, folder, amount, run=False):
    return B.flow_bars(_ticks(spark, folder), "ts", "price", "qty", amount, run=run, first_length=50)


@query("dollar_imbalance_bars", _flow_sql("price * qty", False))
def dollar_imbalance_bars(spark, folder):
    return _flow(spark, folder, F.col("price") * F.col("qty"))


@query("dollar_run_bars", _flow_sql("price * qty", True))
def dollar_run_bars(spark, folder):
    return _flow(spark, folder, F.col("price") * F.col("qty"), run=True)


@query("volume_imbalance_bars", _flow_sql("qty", False))
def volume_imbalance_bars(spark, folder):
    return _flow(spark, folder, F.col("qty"))


@query("volume_run_bars", _flow_sql("qty", True))
def volume_run_bars(spark, folder):
    return _flow(spark, folder, F.col("qty"), run=True)


@query("tick_run_bars", _flow_sql("1.0", True))
def tick_run_bars(spark, folder):
    return _flow(spark, folder, F.lit(1.0), run=True)
