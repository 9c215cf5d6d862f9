"""Shifts, rolling statistics and sliding arrays over the event tape."""

from pyspark.sql import functions as F

from tickweave.functions.arrays import index_dot, sum_of
from tickweave.operators import windows as W
from tickweave.plans.registry import TAPE_SQL, TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, tape, ticks
from tickweave.series import lay_out

OW = "(PARTITION BY symbol ORDER BY pos)"


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


def _tape(spark, folder):
    return lay_out(tape(spark, folder), [], TICK_ORDER)


def R(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0"


@query("shifts_and_returns", f"""
WITH {TICKS_SQL}
SELECT symbol, id, lag(price, 1) OVER w AS lag_1, lag(price, 2) OVER w AS lag_2, lead(price, 1) OVER w AS lead_1,
  {R('price - lag(price) OVER w')} AS diff, {R('ln(price / lag(price) OVER w)')} AS log_ret,
  {R('price / lag(price, 1) OVER w - 1')} AS pct_1, {R('price / lag(price, 2) OVER w - 1')} AS pct_2
FROM t WINDOW w AS {OW}""")
def shifts_and_returns(spark, folder):
    out = W.shifts(_ticks(spark, folder), "price", (1, 2), (1,))
    return out.select("symbol", "id", "lag_1", "lag_2", "lead_1",
                      *[r(c).alias(c) for c in ("diff", "log_ret", "pct_1", "pct_2")])


@query("forward_return", f"""
WITH {TICKS_SQL} SELECT symbol, id, {R('lead(price, 5) OVER w / price - 1')} AS fwd_ret
FROM t WINDOW w AS {OW}""")
def forward_return(spark, folder):
    return W.forward_return(_ticks(spark, folder), "price", 5).select("symbol", "id", r("fwd_ret").alias("fwd_ret"))


@query("rolling_mean_std", f"""
WITH {TICKS_SQL}
SELECT symbol, id, CASE WHEN pos >= 19 THEN {R('avg(price) OVER f')} END AS roll_mean,
  CASE WHEN pos >= 19 THEN {R('stddev_samp(price) OVER f')} END AS roll_std
FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING)""")
def rolling_mean_std(spark, folder):
    out = W.rolling_stats(_ticks(spark, folder), "price", 20)
    return out.select("symbol", "id", r("roll_mean").alias("roll_mean"), r("roll_std").alias("roll_std"))


@query("rolling_mean_one_long_series", f"""
WITH {TAPE_SQL}
SELECT id, CASE WHEN pos >= 99 THEN {R('avg(price) OVER (ORDER BY pos ROWS 99 PRECEDING)')} END AS roll_mean FROM t""")
def rolling_mean_one_long_series(spark, folder):
    return W.rolling_stats(_tape(spark, folder), "price", 100).select("id", r("roll_mean").alias("roll_mean"))


@query("strided_rolling_mean", f"""
WITH {TICKS_SQL}
SELECT symbol, id, CASE WHEN count(*) OVER f >= 5 THEN {R('avg(price) OVER f')} END AS roll_mean
FROM t WINDOW f AS (PARTITION BY symbol, pos % 4 ORDER BY pos ROWS 4 PRECEDING)""")
def strided_rolling_mean(spark, folder):
    return W.strided_rolling(_ticks(spark, folder), "price", 5, 4).select(
        "symbol", "id", r("roll_mean").alias("roll_mean"))


def _ac(k):
    return f"""CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING) >= 50
  THEN {R(f'corr(r, l{k}) OVER (PARTITION BY symbol ORDER BY pos ROWS {49 - k} PRECEDING)')} END AS autocorr_{k}"""


@query("rolling_autocorrelation", f"""
WITH {TICKS_SQL},
a AS (SELECT *, ln(price / lag(price) OVER {OW}) AS r FROM t),
b AS (SELECT *, {', '.join(f'lag(r, {k}) OVER {OW} AS l{k}' for k in range(1, 6))} FROM a)
SELECT symbol, id, {', '.join(_ac(k) for k in range(1, 6))} FROM b""")
def rolling_autocorrelation(spark, folder):
    out = W.rolling_autocorr(_ticks(spark, folder), "price", 50, range(1, 6))
    return out.select("symbol", "id", *[r(f"autocorr_{k}").alias(f"autocorr_{k}") for k in range(1, 6)])


def _ewm_query(keep):
    return f"""
WITH {TICKS_SQL}, e AS (
  SELECT x.symbol, x.id, sum(p) AS sw, sum(p * p) AS sw2, sum(p * y.price) / sum(p) AS m,
    sum(p * (y.price - x.price) ** 2) / sum(p) - (sum(p * (y.price - x.price)) / sum(p)) ** 2 AS v
  FROM (SELECT x.symbol, x.id, x.price, y.price AS yp, x.pos - y.pos AS k, {keep} ** CAST(x.pos - y.pos AS DOUBLE) AS p
        FROM t x JOIN t y ON y.symbol = x.symbol AND y.pos <= x.pos AND y.pos > x.pos - {int(33 / (1 - keep)) + 5}) x,
  LATERAL (SELECT x.yp AS price) y GROUP BY x.symbol, x.id)
SELECT symbol, id, {R('m')} AS ewm_mean, CASE WHEN sw * sw - sw2 > 1e-9
  THEN {R('sqrt(greatest(v, 0) * sw * sw / (sw * sw - sw2))')} END AS ewm_std FROM e"""


@query("ewm_mean_std_span", _ewm_query(1 - 2 / 21))
def ewm_mean_std_span(spark, folder):
    out = W.ewm(_ticks(spark, folder), "price", W.decay_of(span=20))
    return out.select("symbol", "id", r("ewm_mean").alias("ewm_mean"), r("ewm_std").alias("ewm_std"))


@query("ewm_mean_std_com", _ewm_query(1 - 1 / 13))
def ewm_mean_std_com(spark, folder):
    out = W.ewm(_ticks(spark, folder), "price", W.decay_of(com=12))
    return out.select("symbol", "id", r("ewm_mean").alias("ewm_mean"), r("ewm_std").alias("ewm_std"))


@query("volatility_level", f"""
WITH {TICKS_SQL},
m AS (SELECT *, abs((price - lag(price) OVER {OW}) / price) AS mv FROM t)
SELECT symbol, id, CASE WHEN pos >= 50 THEN {R('stddev_pop(mv) OVER f + avg(mv) OVER f')} END AS vol_level
FROM m WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)""")
def volatility_level(spark, folder):
    out = _ticks(spark, folder).windowed(lambda df, w: W.volatility_level(df, w, "price", 50), before=51)
    return out.select("symbol", "id", r("vol_level").alias("vol_level"))


@query("volatility_level_with_current", f"""
WITH {TICKS_SQL},
m AS (SELECT *, abs(price / lag(price) OVER {OW} - 1) AS mv FROM t)
SELECT symbol, id, CASE WHEN pos >= 49 THEN {R('stddev_samp(mv) OVER f + avg(mv) OVER f', 5)} END AS vol_threshold
FROM m WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 48 PRECEDING)""")
def volatility_level_with_current(spark, folder):
    out = _ticks(spark, folder).windowed(
        lambda df, w: W.volatility_threshold(df, w, "price", 50, include_current=True), before=51)
    return out.select("symbol", "id", r("vol_threshold", 5).alias("vol_threshold"))


@query("sliding_windows_univariate", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS x
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING))
SELECT symbol, id, x[1] AS first_value, x[10] AS last_value, {R('list_sum(x)')} AS total,
  {R('list_sum(list_transform(range(1, 11), lambda i: i * x[i]))')} AS index_dot FROM a WHERE pos >= 9""")
def sliding_windows_univariate(spark, folder):
    out = _ticks(spark, folder).windowed(
        lambda df, w: W.sliding_window(df, w, F.col("price"), 10), before=9).filter("window IS NOT NULL")
    x = F.col("window")
    return out.select("symbol", "id", x[0].alias("first_value"), x[9].alias("last_value"),
                      r(sum_of(x)).alias("total"), r(index_dot(x)).alias("index_dot"))


def _tensor_sql(order):
    return f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS p, list(qty) OVER f AS q
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 7 PRECEDING)),
b AS (SELECT symbol, id, {order} AS flat FROM a WHERE pos >= 7)
SELECT symbol, id, len(flat) AS n_cells, {R('list_sum(list_transform(range(1, 17), lambda i: i * flat[i]))')} AS index_dot FROM b"""


def _tensor(spark, folder, **options):
    out = W.feature_tensor(_ticks(spark, folder), ["price", "qty"], 8, **options).filter("tensor IS NOT NULL")
    flat = F.flatten("tensor")
    return out.select("symbol", "id", F.size(flat).cast("long").alias("n_cells"), r(index_dot(flat)).alias("index_dot"))


@query("feature_tensor_feature_major", _tensor_sql("list_concat(p, q)"))
def feature_tensor_feature_major(spark, folder):
    return _tensor(spark, folder)


_TM = "flatten(list_transform(range(1, 9), lambda i: [p[i], q[i]]))"


@query("feature_tensor_time_major", _tensor_sql(_TM))
def feature_tensor_time_major(spark, folder):
    return _tensor(spark, folder, time_major=True)


@query("feature_tensor_time_reversed", _tensor_sql("flatten(list_transform(range(1, 9), lambda i: [p[9 - i], q[9 - i]]))"))
def feature_tensor_time_reversed(spark, folder):
    return _tensor(spark, folder, time_major=True, reverse=True)


@query("windows_with_labels", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS x, CASE WHEN lead(price) OVER {OW} > price THEN 1 ELSE 0 END AS y
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING))
SELECT symbol, id, y AS label, {R('list_sum(x)')} AS total FROM a WHERE pos >= 9""")
def windows_with_labels(spark, folder):
    series = _ticks(spark, folder)
    labels = series.windowed(lambda df, w: df.withColumn(
        "label", F.when(F.lead("price").over(w) > F.col("price"), 1).otherwise(0)), after=1).select("symbol", "_pos", "label")
    x = series.windowed(lambda df, w: W.sliding_window(df, w, F.col("price"), 10), before=9).filter("window IS NOT NULL")
    return x.join(labels, ["symbol", "_pos"]).select("symbol", "id", "label", r(sum_of(F.col("window"))).alias("total"))


@query("lookback_pairs", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, price AS y, list(price) OVER (PARTITION BY symbol ORDER BY pos
  ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x FROM t)
SELECT symbol, id, y, {R('list_sum(list_transform(range(1, 7), lambda i: i * x[i]))')} AS index_dot FROM a WHERE pos >= 6""")
def lookback_pairs(spark, folder):
    return W.lookback_pairs(_ticks(spark, folder), "price", 6).select(
        "symbol", "id", "y", r(index_dot(F.col("x"))).alias("index_dot"))


@query("past_future_sliding", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, n,
  list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS 3 PRECEDING) AS x,
  list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS y FROM t)
SELECT symbol, id, {R('list_sum(x)')} AS past_sum, {R('list_sum(y)')} AS future_sum FROM a WHERE pos >= 3 AND pos + 2 < n""")
def past_future_sliding(spark, folder):
    return W.past_future(_ticks(spark, folder), "price", 4, 2).select(
        "symbol", "id", r(sum_of(F.col("x"))).alias("past_sum"), r(sum_of(F.col("y"))).alias("future_sum"))


@query("past_future_tumbling", f"""
WITH {TICKS_SQL}
SELECT symbol, pos // 6 AS sample, {R('sum(price) FILTER (pos % 6 < 4)')} AS past_sum,
  {R('sum(price) FILTER (pos % 6 >= 4)')} AS future_sum FROM t GROUP BY ALL HAVING count(*) = 6""")
def past_future_tumbling(spark, folder):
    return W.past_future(_ticks(spark, folder), "price", 4, 2, sliding=False).select(
        "symbol", "sample", r(sum_of(F.col("x"))).alias("past_sum"), r(sum_of(F.col("y"))).alias("future_sum"))


@query("forecasting_frame", f"""
WITH {TICKS_SQL}
SELECT a.symbol, a.pos AS group_pos, b.pos AS time, b.price AS value FROM t a
JOIN t b ON b.symbol = a.symbol AND b.pos < a.pos AND b.pos >= a.pos - 5""")
def forecasting_frame(spark, folder):
    return W.forecasting_frame(_ticks(spark, folder), "price", 5)


@query("window_summary_features", f"""
WITH {TICKS_SQL}
SELECT symbol, id, {R('sum(price) OVER f')} AS f_sum, {R('median(price) OVER f')} AS f_median,
  {R('avg(price) OVER f')} AS f_mean, count(*) OVER f AS f_length, {R('stddev_pop(price) OVER f', 5)} AS f_std,
  {R('var_pop(price) OVER f', 8)} AS f_var, {R('sqrt(avg(price * price) OVER f)')} AS f_rms,
  max(price) OVER f AS f_max, min(price) OVER f AS f_min FROM t
WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
QUALIFY count(*) OVER f > 0""")
def window_summary_features(spark, folder):
    out = W.window_features(_ticks(spark, folder), "price", 20)
    names = ["f_sum", "f_median", "f_mean", "f_rms"]
    return out.select("symbol", "id", *[r(c).alias(c) for c in names], "f_length", r("f_std", 5).alias("f_std"),
                      r("f_var", 8).alias("f_var"), "f_max", "f_min")


@query("window_impute", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, CASE WHEN qty > 90 THEN 'inf'::DOUBLE WHEN qty < 10 THEN '-inf'::DOUBLE
  WHEN qty < 20 THEN NULL ELSE price END AS x FROM t),
s AS (SELECT max(x) AS hi, min(x) AS lo, median(x) AS md FROM a WHERE isfinite(x))
SELECT symbol, id, CASE WHEN x = 'inf'::DOUBLE THEN hi WHEN x = '-inf'::DOUBLE THEN lo WHEN x IS NULL THEN {R('md')} ELSE x END AS x FROM a, s""")
def window_impute(spark, folder):
    inf = F.lit(float("inf"))
    raw = ticks(spark, folder).withColumn("x", F.when(F.col("qty") > 90, inf).when(F.col("qty") < 10, -inf)
                                          .when(F.col("qty") >= 20, F.col("price")))
    return W.impute(raw, ["x"]).select("symbol", "id", r("x").alias("x"))


@query("window_normalised", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS x, stddev_pop(price) OVER f AS sd
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING))
SELECT symbol, id, {R('list_sum(list_transform(x, lambda v: (v - x[1]) / sd))', 3)} AS zs_sum,
  {R('list_sum(list_transform(x, lambda v: v / x[1] - 1))', 3)} AS zero_base_sum FROM a WHERE pos >= 9""")
def window_normalised(spark, folder):
    out = _ticks(spark, folder).windowed(
        lambda df, w: W.sliding_window(df, w, F.col("price"), 10), before=9).filter("window IS NOT NULL")
    x = F.col("window")
    return out.select("symbol", "id", r(sum_of(W.normalised_window(x)), 3).alias("zs_sum"),
                      r(sum_of(W.normalised_window(x, "zero_base")), 3).alias("zero_base_sum"))


@query("interval_and_acf_features", f"""
WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS x, avg(price) OVER f AS mu
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 15 PRECEDING)),
b AS (SELECT *, x[3:8] AS p, list_transform(x, lambda v: v - mu) AS c FROM a WHERE pos >= 15)
SELECT symbol, id, {R('list_avg(p)')} AS iv_mean, {R('list_stddev_pop(p)', 5)} AS iv_std,
  {R('list_sum(list_transform(range(1, 7), lambda i: (i - 3.5) / 17.5 * p[i]))')} AS iv_slope,
  {R('list_sum(list_transform(range(1, 16), lambda i: c[i] * c[i + 1])) / list_sum(list_transform(c, lambda v: v * v))')} AS acf_1
FROM b""")
def interval_and_acf_features(spark, folder):
    out = _ticks(spark, folder).windowed(
        lambda df, w: W.sliding_window(df, w, F.col("price"), 16), before=15).filter("window IS NOT NULL")
    out = out.withColumns({"_iv": W.interval_features(F.col("window"), [(2, 6)]),
                           "_acf": W.window_acf(F.col("window"), 16, [1])})
    return out.select("symbol", "id", r(F.col("_iv")[0]).alias("iv_mean"), r(F.col("_iv")[1], 5).alias("iv_std"),
                      r(F.col("_iv")[2]).alias("iv_slope"), r(F.col("_acf")[0]).alias("acf_1"))


_WINDOW_16 = f"""WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos, list(price) OVER f AS x, avg(price) OVER f AS mu
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 15 PRECEDING)), w AS (SELECT *, list_transform(x, lambda v: v - mu) AS c FROM a WHERE pos >= 15)"""


def _windows_16(spark, folder):
    return _ticks(spark, folder).windowed(lambda df, w: W.sliding_window(df, w, F.col("price"), 16), before=15).filter("window IS NOT NULL")


@query("window_autoregression", f"""{_WINDOW_16},
g AS (SELECT symbol, id, list_sum(list_transform(c, lambda v: v * v)) AS g0, list_sum(list_transform(range(1, 16), lambda i: c[i] * c[i + 1])) AS g1,
  list_sum(list_transform(range(1, 15), lambda i: c[i] * c[i + 2])) AS g2 FROM w),
q AS (SELECT symbol, id, g1 / g0 AS r1, g2 / g0 AS r2 FROM g)
SELECT symbol, id, {R('r1 * (1 - r2) / (1 - r1 * r1)')} AS ar_1, {R('(r2 - r1 * r1) / (1 - r1 * r1)')} AS ar_2 FROM q""")
def window_autoregression(spark, folder):
    out = _windows_16(spark, folder).withColumn("_ar", W.autoregression(F.col("window"), 2))
    return out.select("symbol", "id", r(F.col("_ar")[0]).alias("ar_1"), r(F.col("_ar")[1]).alias("ar_2"))


@query("window_power_spectrum", f"""{_WINDOW_16}
SELECT symbol, id, CAST(k AS INTEGER) AS k, round(list_sum(list_transform(range(0, 16), lambda i: x[i + 1] * cos(2 * pi() * i * k / 16))) ** 2
  + list_sum(list_transform(range(0, 16), lambda i: x[i + 1] * sin(2 * pi() * i * k / 16))) ** 2, 5) + 0.0 AS power FROM w, range(0, 8) g(k)""")
def window_power_spectrum(spark, folder):
    out = _windows_16(spark, folder).withColumn("_ps", W.power_spectrum(F.col("window"), 16))
    return out.select("symbol", "id", F.posexplode("_ps").alias("k", "power")).withColumn("power", r("power", 5))


@query("seasonal_decomposition", f"""
WITH {TICKS_SQL},
a AS (SELECT *, CASE WHEN pos >= 30 AND pos + 30 < n THEN (sum(price) OVER f
        - (lag(price, 30) OVER {OW} + lead(price, 30) OVER {OW}) / 2) / 60 END AS trend, pos % 60 AS phase
  FROM t WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
m AS (SELECT symbol, phase, avg(price - trend) AS m FROM a GROUP BY ALL),
s AS (SELECT symbol, phase, m - avg(m) OVER (PARTITION BY symbol) AS seasonal FROM m)
SELECT symbol, id, {R('trend')} AS trend, {R('seasonal')} AS seasonal, {R('price - trend - seasonal')} AS resid
FROM a JOIN s USING (symbol, phase)""")
def seasonal_decomposition(spark, folder):
    out = W.seasonal_decompose(_ticks(spark, folder), "price", 60)
    return out.select("symbol", "id", r("trend").alias("trend"), r("seasonal").alias("seasonal"), r("resid").alias("resid"))


@query("autocorrelation_function", f"""
WITH {TICKS_SQL}, d AS (SELECT symbol, pos, price - avg(price) OVER (PARTITION BY symbol) AS d FROM t),
v AS (SELECT symbol, sum(d * d) AS v FROM d GROUP BY ALL)
SELECT a.symbol, k AS lag, {R('sum(a.d * b.d) / any_value(v)')} AS acf
FROM range(1, 49) g(k), d a JOIN d b ON a.symbol = b.symbol AND b.pos = a.pos - k JOIN v ON v.symbol = a.symbol GROUP BY a.symbol, k""")
def autocorrelation_function(spark, folder):
    return W.acf(_ticks(spark, folder), "price", range(1, 49)).withColumn("acf", r("acf"))


@query("partial_autocorrelation_function")
def partial_autocorrelation_function(spark, folder):
    return W.pacf(W.acf(_ticks(spark, folder), "price", range(1, 49)), TICK_KEYS)


@query("percent_rank_of_price", f"""
WITH {TICKS_SQL} SELECT symbol, id, {R('percent_rank() OVER (PARTITION BY symbol ORDER BY price)')} AS pct_rank FROM t""")
def percent_rank_of_price(spark, folder):
    series = lay_out(ticks(spark, folder), TICK_KEYS, ["price", "id"]).with_length()
    firsts = series.df.groupBy("symbol", "price").agg(F.min("_pos").alias("_rank"))
    return series.df.join(firsts, ["symbol", "price"]).select(
        "symbol", "id", r(F.col("_rank") / (F.col("_n") - 1)).alias("pct_rank"))
