"""Event sampling, labelling and sample weights."""

from pyspark.sql import functions as F

from tickweave.functions import arrays as A
from tickweave.operators import aggregates as G
from tickweave.operators import cleaning as C
from tickweave.operators import events as E
from tickweave.operators import joins as J
from tickweave.operators import labels as L
from tickweave.operators import neighbours as NB
from tickweave.operators import weights as WT
from tickweave.operators import windows as W
from tickweave.plans.join_queries import SPANS_SQL, spans
from tickweave.plans.registry import RAW_TICKS_SQL, TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, ticks
from tickweave.series import Series, lay_out

OW = "(PARTITION BY symbol ORDER BY pos)"
HOUR = 3_600_000_000


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


# -- event sampling ---------------------------------------------------------------

def _cusum_sql(move, first, up_test, down_first, out="symbol, ts, id, side", extra="", h="h"):
    """Recursive fold. ``first`` is the first position with a move."""
    up, dn = f"greatest(0, f.up + a.{move})", f"least(0, f.dn + a.{move})"
    fire_up, fire_dn = f"{up} > {h}", f"{dn} < -{h}"
    if down_first:
        side = f"CASE WHEN {fire_dn} THEN -1 WHEN {fire_up} THEN 1 ELSE 0 END"
    else:
        side = f"CASE WHEN {fire_up} THEN 1 WHEN {fire_dn} THEN -1 ELSE 0 END"
    return f"""
WITH RECURSIVE {TICKS_SQL}, {extra},
f AS (SELECT symbol, CAST({first - 1} AS BIGINT) AS pos, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS side FROM a WHERE pos = {first - 1}
  UNION ALL
  SELECT symbol, pos, CASE WHEN side = 1 THEN 0 ELSE up END, CASE WHEN side = -1 THEN 0 ELSE dn END, side FROM (
    SELECT a.symbol, a.pos, {up} AS up, {dn} AS dn, {side} AS side FROM f JOIN a ON a.symbol = f.symbol AND a.pos = f.pos + 1))
SELECT {out} FROM f JOIN t USING (symbol, pos) WHERE side <> 0"""


_DIFF = f"a AS (SELECT symbol, pos, price - lag(price) OVER {OW} AS mv, 150.0::DOUBLE AS h FROM t)"


@query("cusum_events", _cusum_sql("mv", 1, "", True, extra=_DIFF, h="150.0"))
def cusum_events(spark, folder):
    return E.cusum(_ticks(spark, folder), "price", "fixed", 150.0).select("symbol", "ts", "id", "side")


_MOVING_SQL = f"""
WITH RECURSIVE {TICKS_SQL},
a AS (SELECT symbol, pos, price - lag(price) OVER {OW} AS mv, 50 + qty AS h FROM t),
f AS (SELECT a.symbol, CAST(0 AS BIGINT) AS pos, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, b.h AS th, 0 AS side
      FROM a JOIN a b ON a.symbol = b.symbol AND b.pos = 1 WHERE a.pos = 0
  UNION ALL
  SELECT symbol, pos, CASE WHEN side = 1 THEN 0 ELSE up END, CASE WHEN side = -1 THEN 0 ELSE dn END,
    CASE WHEN side <> 0 THEN h ELSE th END, side FROM (
    SELECT a.symbol, a.pos, a.h, f.th, greatest(0, f.up + a.mv - 2) AS up, least(0, f.dn + a.mv + 2) AS dn,
      CASE WHEN greatest(0, f.up + a.mv - 2) > f.th THEN 1 WHEN least(0, f.dn + a.mv + 2) < -f.th THEN -1 ELSE 0 END AS side
    FROM f JOIN a ON a.symbol = f.symbol AND a.pos = f.pos + 1))"""


def _moving(spark, folder):
    return E.cusum(_ticks(spark, folder), "price", "moving", F.col("qty") + 50, drift=2.0)


@query("cusum_events_moving_threshold", _MOVING_SQL + "\nSELECT symbol, ts, id FROM f JOIN t USING (symbol, pos) WHERE side <> 0")
def cusum_events_moving_threshold(spark, folder):
    return _moving(spark, folder).select("symbol", "ts", "id")


@query("cusum_sides", _MOVING_SQL + "\nSELECT symbol, id, side FROM f JOIN t USING (symbol, pos) WHERE side <> 0")
def cusum_sides(spark, folder):
    return _moving(spark, folder).select("symbol", "id", "side")


@query("cusum_events_absolute_logs", _cusum_sql(
    "mv", 2, "", False, out="symbol, ts, id", h="5.0",
    extra=f"a AS (SELECT symbol, pos, abs(ln(price) - lag(ln(price)) OVER {OW}) AS mv FROM t)"))
def cusum_events_absolute_logs(spark, folder):
    return E.cusum(_ticks(spark, folder), "price", "abs_log", 5.0).select("symbol", "ts", "id")


@query("cusum_events_on_returns", _cusum_sql(
    "mv", 2, "", False, h="a.h", extra=f"""q AS (SELECT symbol, pos, price / lag(price) OVER {OW} - 1 AS ret, qty / 10 AS h FROM t),
a AS (SELECT symbol, pos, h, ret - lag(ret) OVER {OW} AS mv FROM q)"""))
def cusum_events_on_returns(spark, folder):
    return E.cusum(_ticks(spark, folder), "price", "returns", F.col("qty") / 10).select("symbol", "ts", "id", "side")


@query("event_filter_pass_through", f"WITH {TICKS_SQL} SELECT symbol, id FROM t WHERE price IS NOT NULL")
def event_filter_pass_through(spark, folder):
    return E.FILTERS["none"](_ticks(spark, folder), "price").select("symbol", "id")


# -- barriers -----------------------------------------------------------------------

EVENTS_SQL = f"""v AS (SELECT *, abs((price - lag(price) OVER {OW}) / price) AS mv FROM t),
g AS (SELECT *, CASE WHEN pos >= 20 THEN stddev_pop(mv) OVER f + avg(mv) OVER f END AS trgt FROM v
  WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
e AS (SELECT x.symbol, x.id, x.ts, x.pos AS p0, x.price AS entry, x.trgt AS trgt, b.ts AS t1, b.pos AS p1,
    CASE WHEN x.id % 2 = 0 THEN 1 ELSE -1 END AS side
  FROM (SELECT *, ts + {24 * HOUR} AS due FROM g) x ASOF LEFT JOIN t b ON x.symbol = b.symbol AND x.due <= b.ts),
c AS (SELECT e.*, t.ts AS bt, (t.price / e.entry - 1) * SIDE AS ret FROM e JOIN t ON t.symbol = e.symbol AND t.pos >= e.p0 AND (e.p1 IS NULL OR t.pos <= e.p1)
  WHERE e.trgt > 0.5),
k AS (SELECT symbol, id, any_value(ts) AS ts, any_value(entry) AS entry, any_value(side) AS side, any_value(t1) AS t1, any_value(trgt) AS trgt,
  min(bt) FILTER (ret < -0.3 * trgt) AS t_lower, min(bt) FILTER (ret > 0.5 * trgt) AS t_upper FROM c GROUP BY symbol, id),
z AS (SELECT *, least(t_lower, t_upper, t1) AS t_end, CASE WHEN t_lower = least(t_lower, t_upper, t1) THEN 'sl'
  WHEN t_upper = least(t_lower, t_upper, t1) THEN 'tp' WHEN t1 = least(t_lower, t_upper, t1) THEN 't1' END AS type FROM k)"""


def _events(spark, folder, sided, vertical=True):
    series = _ticks(spark, folder)
    picked = series.windowed(lambda df, w: W.volatility_level(df, w, "price", 20, "trgt"), before=21)
    start = picked.select("symbol", "ts", "id", F.col("_pos").alias("p0"), F.col("price").alias("entry"),
                          "trgt",
                          F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("side"))
    if not sided:
        start = start.withColumn("side", F.lit(1))
    if vertical:
        bars = series.df.select("symbol", "ts", F.col("_pos").alias("p1"))
        ahead = J.vertical_barrier(bars, start, ["symbol"], "ts", 24 * HOUR, ["p1"]).select("symbol", "id", "t1", "p1")
        start = start.join(ahead, ["symbol", "id"], "left")
    return series, start


def _barriers(spark, folder, sided):
    series, start = _events(spark, folder, sided)
    return series, L.barrier_events(series, start, ["id"], "price", "ts", 0.3, 0.5, min_target=0.5)


def _esql(side):
    return EVENTS_SQL.replace("* SIDE", "* e.side" if side else "* 1")


@query("first_barrier_touches", f"WITH {TICKS_SQL}, {_esql(True)} SELECT symbol, id, t_lower, t_upper FROM k")
def first_barrier_touches(spark, folder):
    return _barriers(spark, folder, True)[1].select("symbol", "id", "t_lower", "t_upper")


@query("first_touches_open_end", f"""WITH {TICKS_SQL}, e AS (SELECT symbol, id, pos AS p0, price AS entry FROM t)
SELECT e.symbol, e.id, min(t.ts) FILTER (t.price / entry - 1 < -0.999) AS t_lower, min(t.ts) FILTER (t.price / entry - 1 > 8.0) AS t_upper
FROM e JOIN t ON t.symbol = e.symbol AND t.pos >= p0 GROUP BY ALL""")
def first_touches_open_end(spark, folder):
    series = lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER, chunk_rows=256)
    ev = series.df.select("symbol", "id", F.col("_pos").alias("p0"), F.lit(None).cast("long").alias("p1"),
                                                   F.col("price").alias("entry"), F.lit(1).alias("side"),
                                                   F.lit(0.999).alias("lower"), F.lit(8.0).alias("upper"))
    return J.first_touch(series, ev, ["id"], "price", "ts").select("symbol", "id", "t_lower", "t_upper")


@query("triple_barrier_events", f"WITH {TICKS_SQL}, {_esql(False)} SELECT symbol, id, ts, round(trgt, 6) + 0.0 AS trgt, t_end, type FROM z")
def triple_barrier_events(spark, folder):
    return _barriers(spark, folder, False)[1].select("symbol", "id", "ts", r("trgt").alias("trgt"), "t_end", "type")


def _label_sql(side, label):
    mult = "* z.side" if side else ""
    return f"""WITH {TICKS_SQL}, {_esql(side)}, y AS (SELECT z.*, (x.price / entry - 1) {mult} AS ret FROM z JOIN t x ON x.symbol = z.symbol AND x.ts = z.t_end)
SELECT symbol, id, round(ret, 6) + 0.0 AS ret, CAST({label} AS INTEGER) AS label, t_end, type FROM y"""


@query("triple_barrier_labels", _label_sql(False, "CASE WHEN abs(ret) <= 0.1 THEN 0 ELSE sign(ret) END"))
def triple_barrier_labels(spark, folder):
    series, ev = _barriers(spark, folder, False)
    out = L.barrier_labels(ticks(spark, folder), ev, TICK_KEYS, "price", "ts", min_ret=0.1, tie="id")
    return out.select("symbol", "id", r("ret").alias("ret"), "label", "t_end", "type")


@query("triple_barrier_labels_sided_vertical_zero",
       _label_sql(True, "CASE WHEN type = 't1' THEN 0 WHEN ret <= 0.05 THEN 0 ELSE sign(ret) END"))
def triple_barrier_labels_sided_vertical_zero(spark, folder):
    series, ev = _barriers(spark, folder, True)
    out = L.barrier_labels(ticks(spark, folder), ev, TICK_KEYS, "price", "ts", min_ret=0.05, sign_label=False, sided=True, tie="id")
    return out.select("symbol", "id", r("ret").alias("ret"), "label", "t_end", "type")


@query("event_bins", f"""WITH {TICKS_SQL}, {_esql(False)}, y AS (SELECT z.*, x.price / entry - 1 AS ret FROM z JOIN t x ON x.symbol = z.symbol AND x.ts = z.t_end)
SELECT symbol, id, CAST(CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.symbol = y.symbol AND e.t1 = y.t_end) THEN 0 ELSE sign(ret) END AS INTEGER) AS bin FROM y""")
def event_bins(spark, folder):
    series, start = _events(spark, folder, False)
    ev = L.barrier_events(series, start, ["id"], "price", "ts", 0.3, 0.5, min_target=0.5)
    lab = L.barrier_labels(ticks(spark, folder), ev, TICK_KEYS, "price", "ts", tie="id")
    return L.event_bins(lab, False, start, TICK_KEYS).select("symbol", "id", "bin")


@query("meta_bins", f"""WITH {TICKS_SQL}, {_esql(True)}, y AS (SELECT z.*, (x.price / entry - 1) * z.side AS ret FROM z JOIN t x ON x.symbol = z.symbol AND x.ts = z.t_end)
SELECT symbol, id, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS bin FROM y""")
def meta_bins(spark, folder):
    series, ev = _barriers(spark, folder, True)
    lab = L.barrier_labels(ticks(spark, folder), ev, TICK_KEYS, "price", "ts", sided=True, tie="id")
    return L.event_bins(lab, True).select("symbol", "id", "bin")


@query("touch_labels", f"""WITH {TICKS_SQL}, {_esql(True)}
SELECT symbol, id, CASE WHEN least(t_lower, t_upper) IS NULL THEN 0 WHEN least(t_lower, t_upper) = t_lower THEN -1 ELSE 1 END AS label FROM k""")
def touch_labels(spark, folder):
    ev = _barriers(spark, folder, True)[1]
    return ev.select("symbol", "id", L.touch_label(F.col("t_lower"), F.col("t_upper")).alias("label"))


@query("smoothed_movement_label", f"""WITH {TICKS_SQL}, a AS (SELECT *, avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS 10 PRECEDING) AS p,
  avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS f FROM t)
SELECT symbol, id, round((f - p) / p, 6) + 0.0 AS movement, CASE WHEN (f - p) / p > 0.2 THEN 1 WHEN (f - p) / p < -0.2 THEN -1 ELSE 0 END AS label
FROM a WHERE pos >= 10 AND pos < n - 10""")
def smoothed_movement_label(spark, folder):
    out = L.smoothed_movement(_ticks(spark, folder), "price", 10, 0.2)
    return out.select("symbol", "id", r("movement").alias("movement"), "label")


@query("fixed_horizon_label", f"""WITH {TICKS_SQL}, a AS (SELECT *, lead(price, 5) OVER {OW} / price - 1 AS ret FROM t)
SELECT symbol, id, CASE WHEN ret > 0.5 THEN 1 WHEN ret < -0.5 THEN -1 ELSE 0 END AS label FROM a WHERE pos >= 20 AND ret IS NOT NULL""")
def fixed_horizon_label(spark, folder):
    out = _ticks(spark, folder).windowed(lambda df, w: L.horizon_label(df, w, "price", 5, F.lit(0.5)), after=5)
    return out.filter("_pos >= 20 AND label IS NOT NULL").select("symbol", "id", "label")


_VH_SQL = f"""a AS (SELECT *, abs(price / lag(price) OVER {OW} - 1) AS mv, lead(price, 5) OVER {OW} / price - 1 AS ret FROM t),
b AS (SELECT *, stddev_pop(mv) OVER f + avg(mv) OVER f AS th FROM a WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
h AS (SELECT symbol, id, CASE WHEN ret > th THEN 1 WHEN ret < -th THEN -1 ELSE 0 END AS label FROM b WHERE pos >= 20 AND ret IS NOT NULL)"""


def _vol_horizon(series):
    def build(df, w):
        df = W.volatility_threshold(df, w, "price", 20)
        return L.horizon_label(df, w, "price", 5, F.col("vol_threshold"))
    return series.windowed(build, before=21, after=5).filter("label IS NOT NULL")


@query("volatility_horizon_label", f"WITH {TICKS_SQL}, {_VH_SQL} SELECT * FROM h")
def volatility_horizon_label(spark, folder):
    return _vol_horizon(_ticks(spark, folder)).select("symbol", "id", "label")


@query("horizon_label_counts", f"""WITH {RAW_TICKS_SQL},
d AS (SELECT symbol, ts, arg_min(price, id) AS price, arg_min(qty, id) AS qty FROM ticks GROUP BY symbol, ts),
bars AS (SELECT symbol, (ts // {HOUR} + 1) * {HOUR} AS ts, arg_max(price, ts) AS price FROM d GROUP BY ALL),
t AS (SELECT symbol, ts, ts AS id, price, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM bars), {_VH_SQL}
SELECT symbol, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) + 0.0 AS share FROM h GROUP BY symbol, label""")
def horizon_label_counts(spark, folder):
    from tickweave.operators.bars import time_bars
    clean = C.first_per_time(ticks(spark, folder), ["symbol"], "ts", ["id"])
    bars = time_bars(clean, ["symbol"], "ts", "id", "price", "qty", HOUR, fill_gaps=False)
    series = lay_out(bars.select("symbol", F.col("bar_ts").alias("ts"), F.col("close").alias("price")), ["symbol"], ["ts"])
    out = G.class_counts(_vol_horizon(series), ["symbol"], "label")
    return out.select("symbol", "label", "n", r("share").alias("share"))


@query("meta_barrier_labels", f"""WITH {TICKS_SQL}, a AS (SELECT *, list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM t),
d AS (SELECT symbol, id, list_transform(w, lambda p: (p - price) / price) AS d FROM a WHERE len(w) = 8),
u AS (SELECT *, nullif(list_position(list_transform(d, lambda x: x >= 0.8), true), 0) AS up, nullif(list_position(list_transform(d, lambda x: x < -0.8), true), 0) AS dn FROM d),
s AS (SELECT symbol, id, d, CASE WHEN up IS NULL AND dn IS NULL THEN 2 WHEN up IS NULL THEN 0 WHEN dn IS NULL THEN 1 WHEN up > dn THEN 0 ELSE 1 END AS direction FROM u)
SELECT symbol, id, direction, CASE WHEN (direction = 0 AND list_max(d) >= 2.0) OR (direction = 1 AND list_min(d) < -0.9) THEN 1 ELSE 0 END AS take_action FROM s""")
def meta_barrier_labels(spark, folder):
    out = L.meta_barrier(_ticks(spark, folder), "price", 8, F.lit(0.8), 2.0, -0.9)
    return out.select("symbol", "id", "direction", "take_action")


@query("window_barrier_labels", f"""WITH {TICKS_SQL}
SELECT symbol, id, CASE WHEN max(price) OVER f / price - 1 > 1.0 THEN 1 WHEN min(price) OVER f / price - 1 < -0.7 THEN -1 ELSE 0 END AS label
FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""")
def window_barrier_labels(spark, folder):
    return L.window_barrier(_ticks(spark, folder), "price", 6, 1.0, -0.7).select("symbol", "id", "label")


@query("trend_scanning_labels", f"""WITH {TICKS_SQL},
p AS (SELECT a.symbol, a.id, l, regr_slope(b.price, b.pos - a.pos) AS s, regr_syy(b.price, b.pos - a.pos) AS syy, regr_sxx(b.price, b.pos - a.pos) AS sxx
  FROM t a, range(10, 21) g(l), t b WHERE a.pos + 20 <= a.n AND b.symbol = a.symbol AND b.pos BETWEEN a.pos AND a.pos + l - 1 GROUP BY ALL),
q AS (SELECT symbol, id, l, s / sqrt((syy - s * s * sxx) / (l - 2) / sxx) AS t FROM p),
b AS (SELECT symbol, id, arg_max(t, (abs(t), -l)) AS t FROM q GROUP BY ALL)
SELECT symbol, id, round(t, 5) + 0.0 AS t_value, CASE WHEN t < -3 THEN 0 WHEN t > 3 THEN 2 ELSE 1 END AS label FROM b""")
def trend_scanning_labels(spark, folder):
    out = L.trend_scan(_ticks(spark, folder), "price")
    return out.select("symbol", "id", r("t_value", 5).alias("t_value"), "label")


@query("label_encodings", f"""WITH {TICKS_SQL}, {_VH_SQL}
SELECT symbol, id, label + 1 AS class, concat_ws(',', CAST(label = -1 AS INTEGER), CAST(label = 0 AS INTEGER), CAST(label = 1 AS INTEGER)) AS three,
  concat_ws(',', CAST(abs(label) = 0 AS INTEGER), CAST(abs(label) = 1 AS INTEGER)) AS two FROM h""")
def label_encodings(spark, folder):
    out = _vol_horizon(_ticks(spark, folder))
    return out.select("symbol", "id", L.zero_based(F.col("label")).alias("class"),
                      F.array_join(L.three_class_one_hot(F.col("label")).cast("array<string>"), ",").alias("three"),
                      F.array_join(L.two_class_one_hot(F.abs("label")).cast("array<string>"), ",").alias("two"))


@query("probabilities_to_one_hot", """SELECT event_id AS id, CASE WHEN value >= k AND value >= 30 THEN '1,0,0' WHEN k >= 30 THEN '0,1,0' ELSE '0,0,1' END AS one_hot
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def probabilities_to_one_hot(spark, folder):
    k = F.get_json_object("props", "$.k").cast("double")
    p = F.array(F.col("value"), k, F.lit(30.0))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.array_join(A.argmax_one_hot(p, 3).cast("array<string>"), ",").alias("one_hot"))


@query("volatility_target_tuning", f"""WITH RECURSIVE {TICKS_SQL}, m AS (SELECT min(qty + 1) AS low FROM t),
s AS (SELECT low, 0.05::DOUBLE AS f, 0 AS phase FROM m
  UNION ALL SELECT low, CASE WHEN phase < 2 AND low * f > 0.03 THEN f * 0.95 ELSE f * 1.01 END, CASE WHEN phase < 2 AND low * f > 0.03 THEN 1 ELSE 2 END
  FROM s WHERE low * f > 0.03 AND phase < 2 OR low * f < 0.03)
SELECT symbol, id, round((qty + 1) * (SELECT arg_min(f, CASE WHEN low * f >= 0.03 AND (phase = 2 OR low * f <= 0.03) THEN 0 ELSE 1 END) FROM s), 6) + 0.0 AS trgt FROM t""")
def volatility_target_tuning(spark, folder):
    df = ticks(spark, folder).withColumn("trgt", F.col("qty") + 1)
    return L.tune_target(df, "trgt", 0.03, scale=0.05).select("symbol", "id", r("trgt").alias("trgt"))


# -- weights ------------------------------------------------------------------------

_CONC_SQL = f"""WITH {TICKS_SQL}, {SPANS_SQL}, cc AS (SELECT t.symbol, t.pos, count(sp.id) AS c, any_value(t.price) AS price FROM t
  JOIN sp ON sp.symbol = t.symbol AND t.pos BETWEEN sp.p0 AND sp.p1 GROUP BY ALL)"""


@query("concurrency_uniqueness", f"""{_CONC_SQL} SELECT sp.symbol, sp.id, round(avg(1 / c), 6) + 0.0 AS uniqueness
FROM sp JOIN cc ON sp.symbol = cc.symbol AND cc.pos BETWEEN sp.p0 AND sp.p1 GROUP BY ALL""")
def concurrency_uniqueness(spark, folder):
    series, sp = spans(spark, folder)
    return WT.average_uniqueness(series, sp).select("symbol", "id", r("uniqueness").alias("uniqueness"))


@query("uniqueness_from_indicator", f"""{_CONC_SQL} SELECT sp.symbol, sp.id, round(avg(1 / c), 6) + 0.0 AS uniqueness
FROM sp JOIN cc ON sp.symbol = cc.symbol AND cc.pos BETWEEN sp.p0 AND sp.p1 GROUP BY ALL""")
def uniqueness_from_indicator(spark, folder):
    _, sp = spans(spark, folder)
    out = WT.uniqueness_from_pairs(J.indicator_pairs(sp, TICK_KEYS, "id", block=1 << 16), TICK_KEYS, "id")
    return out.withColumn("uniqueness", r("uniqueness"))


@query("return_attribution_weights", f"""{_CONC_SQL}, lr AS (SELECT symbol, pos, coalesce(ln(price / lag(price) OVER {OW}), 0) AS lr FROM t),
w AS (SELECT sp.symbol, sp.id, abs(sum(lr.lr / c)) AS w FROM sp JOIN cc ON sp.symbol = cc.symbol AND cc.pos BETWEEN sp.p0 AND sp.p1
  JOIN lr ON lr.symbol = cc.symbol AND lr.pos = cc.pos GROUP BY ALL)
SELECT symbol, id, round(w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol), 6) + 0.0 AS weight FROM w""")
def return_attribution_weights(spark, folder):
    series, sp = spans(spark, folder)
    logs = series.windowed(lambda df, w: df.withColumn("lr", F.log(F.try_divide(F.col("price"), F.lag("price").over(w)))), before=1)
    base = series.derive(logs)
    return WT.return_weights(base, sp, F.col("lr")).select("symbol", "id", r("weight").alias("weight"))


def _decay_sql(expr):
    return f"""WITH {TICKS_SQL}, c AS (SELECT symbol, id, sum(qty + 1) OVER {OW} AS cum, sum(qty + 1) OVER (PARTITION BY symbol) AS tot FROM t)
SELECT symbol, id, round({expr}, 6) + 0.0 AS decay FROM c"""


def _decay(spark, folder, last, **options):
    series = _ticks(spark, folder).with_columns({"u": F.col("qty") + 1})
    return WT.time_decay(series, "u", last, **options).select("symbol", "id", r("decay").alias("decay"))


@query("time_decay_linear", _decay_sql("1 - 0.6 / tot * tot + 0.6 / tot * cum"))
def time_decay_linear(spark, folder):
    return _decay(spark, folder, 0.4)


@query("time_decay_negative", _decay_sql("greatest(0, 1 - 1 / (0.7 * tot) * tot + 1 / (0.7 * tot) * cum)"))
def time_decay_negative(spark, folder):
    return _decay(spark, folder, -0.3)


@query("time_decay_exponential", _decay_sql("exp(ln(0.2) - ln(0.2) / tot * cum)"))
def time_decay_exponential(spark, folder):
    return _decay(spark, folder, 0.2, exponential=True)


@query("sequential_bootstrap")
def sequential_bootstrap(spark, folder):
    _, sp = spans(spark, folder)
    return WT.sequential_bootstrap(sp, TICK_KEYS, "id", replicates=2)


@query("oversample_minority", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT toxic, (SELECT max(n) FROM c) AS n_rows, n AS n_distinct FROM c""")
def oversample_minority(spark, folder):
    out = WT.oversample(table(spark, folder, "labels"), "toxic", ["doc_id"])
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_distinct"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("minor"), F.col("embedding").cast("array<double>").alias("embedding"))


@query("synthetic_minority_rows")
def synthetic_minority_rows(spark, folder):
    out = WT.synthetic_minority(_vectors(spark, folder), "embedding", "minor", 1, "vec_id", per_row=2)
    return out.select("vec_id", "neighbour", "copy", A.sum_of(F.col("embedding")).alias("total"))


@query("synthetic_minority_by_density")
def synthetic_minority_by_density(spark, folder):
    out = WT.synthetic_minority(_vectors(spark, folder), "embedding", "minor", 1, "vec_id", per_row=2, density=True)
    return out.select("vec_id", "neighbour", "copy", A.sum_of(F.col("embedding")).alias("total"))


@query("minority_neighbours", """WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 0),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance FROM m a JOIN m b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) + 0.0 AS distance FROM k WHERE rank <= 5""")
def minority_neighbours(spark, folder):
    small = _vectors(spark, folder).filter("minor = 1")
    out = NB.nearest(small, small, "vec_id", "embedding", 5, "minor")
    return out.select("vec_id", "rank", "neighbour", r("distance").alias("distance"))


@query("minority_density", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label, list_distance(a.v, b.v) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.label = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT vec_id, round(avg(CASE WHEN label <> 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM k WHERE rank <= 5 GROUP BY vec_id""")
def minority_density(spark, folder):
    rows = _vectors(spark, folder)
    out = NB.nearest(rows, rows.filter("minor = 1"), "vec_id", "embedding", 5, "minor")
    return out.groupBy("vec_id").agg(r(F.avg((F.col("neighbour_mark") != 1).cast("double"))).alias("share"))


@query("append_weight_and_side", f"""WITH {TICKS_SQL} SELECT symbol, id, price, qty, qty / 100 AS weight, CASE WHEN price > 50 THEN 1 ELSE -1 END AS side FROM t""")
def append_weight_and_side(spark, folder):
    return ticks(spark, folder).withColumns({
        "weight": F.col("qty") / 100, "side": F.when(F.col("price") > 50, 1).otherwise(-1)}).drop("ts")
