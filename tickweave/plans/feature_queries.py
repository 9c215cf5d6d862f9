"""Fractional differences, unit-root tests, indicators, entropy, projections."""

from pyspark.sql import functions as F

from tickweave.functions.arrays import sum_of
from tickweave.operators import bars as B
from tickweave.operators import features as X
from tickweave.operators import matching as M
from tickweave.operators import warping as D
from tickweave.operators import windows as W
from tickweave.plans.registry import TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, ticks
from tickweave.series import lay_out

OW = "(PARTITION BY symbol ORDER BY pos)"
HOUR = 3_600_000_000


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


def _logs(spark, folder):
    return lay_out(ticks(spark, folder).withColumn("logp", F.log("price")), TICK_KEYS, TICK_ORDER)


def _weights_sql(weights):
    values = ", ".join(f"({k}, {float(w)!r}::DOUBLE)" for k, w in enumerate(weights))
    return f"wt(k, w) AS (VALUES {values})"


_W = X.fraction_weights(0.4, 1e-3)


@query("fraction_weights", f"""WITH RECURSIVE {TICKS_SQL}, m AS (SELECT max(n) AS top FROM t),
wt AS (SELECT CAST(0 AS BIGINT) AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM wt, m WHERE k + 1 < top)
SELECT symbol, id, k, round(w, 9) + 0.0 AS w FROM t JOIN wt ON wt.k = t.n - 1 - t.pos""")
def fraction_weights(spark, folder):
    return X.lag_weights(_ticks(spark, folder), 0.4).select("symbol", "id", "k", r("weight", 9).alias("w"))


@query("frac_diff_fixed_width", f"""WITH {TICKS_SQL}, {_weights_sql(_W)},
s AS (SELECT a.symbol, a.id, a.pos, sum(w * ln(b.price)) AS v FROM t a, wt JOIN t b ON true
  WHERE b.symbol = a.symbol AND b.pos = a.pos - wt.k AND a.pos >= {len(_W) - 1} GROUP BY ALL)
SELECT t.symbol, t.id, round(v, 6) + 0.0 AS frac_diff FROM t LEFT JOIN s USING (symbol, id)""".replace(
    "FROM t a, wt JOIN t b ON true\n  WHERE", "FROM t a CROSS JOIN wt JOIN t b ON"))
def frac_diff_fixed_width(spark, folder):
    return X.frac_diff(_logs(spark, folder), "logp", 0.4, 1e-3).select("symbol", "id", r("frac_diff").alias("frac_diff"))


_USERS_SQL = """u AS (SELECT user_id, event_id AS id, value AS price,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def _users(spark, folder):
    u = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
                                              F.col("event_id").alias("id"), F.log("value").alias("logp"))
    return lay_out(u, ["user_id"], ["ts", "id"])


def _expanding_sql(d):
    return f"""WITH RECURSIVE {_USERS_SQL}, m AS (SELECT max(pos) + 1 AS n FROM u),
wt AS (SELECT CAST(0 AS BIGINT) AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * ({d} - k) / (k + 1) FROM wt, m WHERE k + 1 < n),
sk AS (SELECT k, sum(abs(w)) OVER (ORDER BY k) / sum(abs(w)) OVER () AS share FROM wt),
s AS (SELECT count(*) FILTER (share > 0.98) AS skip FROM sk)
SELECT a.user_id, a.id, round(sum(w * ln(b.price)), 6) + 0.0 AS frac_diff FROM u a JOIN u b ON a.user_id = b.user_id AND b.pos <= a.pos
JOIN wt ON wt.k = a.pos - b.pos, s WHERE a.pos >= skip GROUP BY ALL"""


@query("frac_diff_expanding", _expanding_sql(0.4))
def frac_diff_expanding(spark, folder):
    out = X.frac_diff_expanding(_users(spark, folder), "logp", 0.4, loss=0.98)
    return out.select("user_id", "id", r("frac_diff").alias("frac_diff"))


@query("frac_diff_by_fft", f"""WITH RECURSIVE {TICKS_SQL}, m AS (SELECT max(n) AS top FROM t),
wt AS (SELECT CAST(0 AS BIGINT) AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.3 - k) / (k + 1) FROM wt, m WHERE k + 1 < top)
SELECT a.symbol, a.pos AS pos, round(sum(w * ln(b.price)), 6) + 0.0 AS frac_diff FROM t a JOIN t b ON a.symbol = b.symbol AND b.pos <= a.pos
  JOIN wt ON wt.k = a.pos - b.pos GROUP BY ALL""")
def frac_diff_by_fft(spark, folder):
    out = X.frac_diff_fft(_logs(spark, folder), "logp", 0.3)
    return out.select("symbol", F.col("_pos").alias("pos"), r("frac_diff").alias("frac_diff"))


@query("unit_root_statistic_no_lags", f"""WITH {TICKS_SQL}, a AS (SELECT symbol, ln(price) - lag(ln(price)) OVER {OW} AS dy, lag(ln(price)) OVER {OW} AS l FROM t),
g AS (SELECT symbol, count(dy) AS n, regr_slope(dy, l) AS b, regr_syy(dy, l) AS syy, regr_sxx(dy, l) AS sxx FROM a WHERE dy IS NOT NULL GROUP BY symbol)
SELECT symbol, n AS n_obs, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) + 0.0 AS adf_stat FROM g""")
def unit_root_statistic_no_lags(spark, folder):
    s = _logs(spark, folder)
    return X.adf(s.df, s, "logp", lags=0).select("symbol", "n_obs", r("adf_stat").alias("adf_stat"))


@query("unit_root_statistic_one_lag", f"""WITH {TICKS_SQL}, y AS (SELECT symbol, pos, ln(price) AS y FROM t),
a AS (SELECT symbol, pos, y - lag(y) OVER {OW} AS dy, lag(y) OVER {OW} AS l FROM y), b AS (SELECT *, lag(dy) OVER {OW} AS d1 FROM a),
c AS (SELECT * FROM b WHERE d1 IS NOT NULL), r AS (SELECT symbol, count(*) AS n, regr_slope(dy, d1) AS p, regr_intercept(dy, d1) AS q, regr_slope(l, d1) AS u, regr_intercept(l, d1) AS v FROM c GROUP BY symbol),
e AS (SELECT c.symbol, n, dy - q - p * d1 AS ey, l - v - u * d1 AS el FROM c JOIN r ON r.symbol = c.symbol),
g AS (SELECT symbol, any_value(n) AS n, sum(ey * el) / sum(el * el) AS b, sum(ey * ey) AS syy, sum(el * el) AS sll FROM e GROUP BY symbol)
SELECT symbol, n AS n_obs, round(b / sqrt((syy - b * b * sll) / (n - 3) / sll), 6) + 0.0 AS adf_stat FROM g""")
def unit_root_statistic_one_lag(spark, folder):
    s = _logs(spark, folder)
    return X.adf(s.df, s, "logp", lags=1).select("symbol", "n_obs", r("adf_stat").alias("adf_stat"))


@query("unit_root_test")
def unit_root_test(spark, folder):
    s = _logs(spark, folder)
    return X.adf(s.df, s, "logp", lags=1)


@query("smallest_difference_scan")
def smallest_difference_scan(spark, folder):
    daily = ticks(spark, folder).withColumn("day", F.floor(F.col("ts") / (24 * HOUR))).groupBy("symbol", "day").agg(
        F.log(F.max_by("price", F.struct("ts", "id"))).alias("logp"))
    s = lay_out(daily, ["symbol"], ["day"])
    return X.difference_scan(s, "logp", [i / 10 for i in range(11)], threshold=1e-2, pad=False)


@query("smallest_stationary_order")
def smallest_stationary_order(spark, folder):
    scan = X.difference_scan(_logs(spark, folder), "logp", [i / 99 for i in range(100)], threshold=1e-5)
    return X.smallest_order(scan, TICK_KEYS)


@query("cointegration_test")
def cointegration_test(spark, folder):
    day = (F.floor(F.col("ts") / (6 * HOUR))).alias("day")
    t = ticks(spark, folder)
    a = t.filter("symbol = 'click'").groupBy(day).agg(F.avg("price").alias("a"))
    b = t.filter("symbol = 'view'").groupBy(day).agg(F.avg("price").alias("b"))
    return X.cointegration(lay_out(a.join(b, "day"), [], ["day"]), "a", "b")


@query("backward_sup_unit_root", f"""WITH {TICKS_SQL}, a AS (SELECT symbol, pos, ts, ln(price) - lag(ln(price)) OVER {OW} AS dy, lag(ln(price)) OVER {OW} AS l FROM t),
g AS (SELECT symbol, pos, regr_count(dy, l) OVER w AS n, regr_slope(dy, l) OVER w AS b, regr_syy(dy, l) OVER w AS syy, regr_sxx(dy, l) OVER w AS sxx
  FROM a WHERE dy IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos DESC)),
e AS (SELECT symbol, max(ts) AS end_ts FROM t GROUP BY 1)
SELECT symbol, end_ts, round(max(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)), 6) + 0.0 AS bsadf, count(*) AS n_starts FROM g JOIN e USING (symbol) WHERE n >= 50 GROUP BY ALL""")
def backward_sup_unit_root(spark, folder):
    out = X.backward_sup_adf(_logs(spark, folder), "logp", "ts", 50, "c", lags=0)
    return out.select("symbol", "end_ts", r("bsadf").alias("bsadf"), "n_starts")


@query("backward_sup_unit_root_trend_lags")
def backward_sup_unit_root_trend_lags(spark, folder):
    return X.backward_sup_adf(_logs(spark, folder), "logp", "ts", 50, "ct", lags=2)


_HOURS_SQL = f"""{TICKS_SQL}, b AS (SELECT symbol, pos // 10 AS bar, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close FROM t GROUP BY ALL)"""


def _bars(spark, folder):
    s = _ticks(spark, folder).df.groupBy("symbol", F.floor(F.col("_pos") / 10).alias("bar")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_pos").alias("close"))
    return lay_out(s, ["symbol"], ["bar"])


@query("directional_strength_index", f"""WITH {_HOURS_SQL},
m AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
d AS (SELECT symbol, bar, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS u, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS v FROM m),
e AS (SELECT x.symbol, x.bar, sum(y.u * p) AS pos_di, sum(y.v * p) AS neg_di FROM (SELECT symbol, bar FROM d) x JOIN d y ON y.symbol = x.symbol AND y.bar <= x.bar,
  LATERAL (SELECT (1 - 2 / 15.0::DOUBLE) ** CAST(x.bar - y.bar AS DOUBLE) AS p) GROUP BY ALL)
SELECT symbol, bar, CASE WHEN bar >= 13 THEN round_even(pos_di * 100 / (pos_di + neg_di), 0) END AS rsi FROM e""".replace(
    ",\n  LATERAL (SELECT (1 - 2 / 15.0::DOUBLE) ** CAST(x.bar - y.bar AS DOUBLE) AS p)", "").replace(
    "y.u * p", "y.u * (1 - 2 / 15.0::DOUBLE) ** CAST(x.bar - y.bar AS DOUBLE)").replace(
    "y.v * p", "y.v * (1 - 2 / 15.0::DOUBLE) ** CAST(x.bar - y.bar AS DOUBLE)"))
def directional_strength_index(spark, folder):
    return X.directional_index(_bars(spark, folder), "high", "low", 14).select("symbol", "bar", "rsi")


_KEEP = "(1 - 2 / 21.0::DOUBLE) ** CAST(x.bar - y.bar AS DOUBLE)"


@query("bollinger_bands", f"""WITH {_HOURS_SQL},
e AS (SELECT x.symbol, x.bar, sum({_KEEP}) AS sw, sum(({_KEEP}) ** 2) AS sw2, sum({_KEEP} * y.close) AS s1, sum({_KEEP} * (y.close - 50) ** 2) AS s2
  FROM b x JOIN b y ON y.symbol = x.symbol AND y.bar <= x.bar GROUP BY ALL),
f AS (SELECT symbol, bar, s1 / sw AS m, CASE WHEN bar > 0 THEN sqrt((s2 / sw - (s1 / sw - 50) ** 2) * sw * sw / (sw * sw - sw2)) END AS sd FROM e)
SELECT symbol, bar, round(m, 6) + 0.0 AS band_mid, round(m + 2 * sd, 6) + 0.0 AS band_upper, round(m - 2 * sd, 6) + 0.0 AS band_lower FROM f""")
def bollinger_bands(spark, folder):
    out = X.bollinger(_bars(spark, folder), "close", 20, 2.0)
    return out.select("symbol", "bar", *[r(c).alias(c) for c in ("band_mid", "band_upper", "band_lower")])


@query("moving_average_crossover", f"""WITH {TICKS_SQL}, a AS (SELECT symbol, id, pos,
  CASE WHEN pos >= 19 THEN avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING) END AS f,
  CASE WHEN pos >= 49 THEN avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING) END AS s FROM t)
SELECT symbol, id, lag(CASE WHEN f >= s THEN 1 WHEN f < s THEN -1 END) OVER {OW} AS side FROM a""")
def moving_average_crossover(spark, folder):
    return X.crossover_side(_ticks(spark, folder), "price", 20, 50).select("symbol", "id", "side")


def _fm_sql():
    mom = ", ".join(f"price / lag(price, {k}) OVER w - 1 AS mom_{k}" for k in range(1, 6))
    logs = ", ".join(f"lag(lr, {k}) OVER w AS log_t{k}" for k in range(1, 6))
    vols = ", ".join(f"CASE WHEN count(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS {k - 1} PRECEDING) = {k} THEN "
                     f"stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS {k - 1} PRECEDING) END AS vol_{k}" for k in (15, 31, 50))
    names = [f"mom_{k}" for k in range(1, 6)] + [f"log_t{k}" for k in range(1, 6)] + ["vol_15", "vol_31", "vol_50"]
    out = ", ".join(f"round(lag({c}) OVER {OW}, 6) + 0.0 AS {c}" for c in names)
    return f"""WITH {TICKS_SQL}, l AS (SELECT *, ln(price / lag(price) OVER {OW}) AS lr FROM t),
f AS (SELECT symbol, id, pos, {mom}, {logs}, {vols} FROM l WINDOW w AS {OW}) SELECT symbol, id, {out} FROM f"""


@query("strategy_feature_matrix", _fm_sql())
def strategy_feature_matrix(spark, folder):
    out = X.feature_matrix(_ticks(spark, folder), "price")
    names = [f"mom_{k}" for k in range(1, 6)] + [f"log_t{k}" for k in range(1, 6)] + ["vol_15", "vol_31", "vol_50"]
    return out.select("symbol", "id", *[r(c).alias(c) for c in names])


@query("change_quantile_bins", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, id, price / lag(price) OVER {OW} - 1 AS change FROM t),
q AS (SELECT symbol, quantile_cont(change, [0.25, 0.5, 0.75]) AS q FROM c WHERE change IS NOT NULL GROUP BY symbol)
SELECT symbol, id, CAST(change > q[1] AS BIGINT) + CAST(change > q[2] AS BIGINT) + CAST(change > q[3] AS BIGINT) AS bin
FROM c JOIN q USING (symbol) WHERE change IS NOT NULL""")
def change_quantile_bins(spark, folder):
    return X.quantile_bins(_ticks(spark, folder), "price", 4).select("symbol", "id", "bin")


def _match_sql(near, points, reach):
    """Match lengths of a whole key: on the diagonal of each lag, the distance to the next mismatch."""
    return f"""WITH {TICKS_SQL}, d AS (SELECT symbol, pos AS i, n, CAST(floor(price / 50) AS BIGINT) AS s FROM t),
e AS (SELECT a.symbol, a.i, a.i - b.i AS k, a.n, a.s <> b.s AS miss FROM d a JOIN d b ON a.symbol = b.symbol AND b.i < a.i {near}),
x AS (SELECT symbol, i, k, n, coalesce(min(CASE WHEN miss THEN i END) OVER (PARTITION BY symbol, k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) - i AS len FROM e),
y AS (SELECT symbol, i, n, {reach} AS w, least(top, {reach}) + 1 AS best FROM (SELECT symbol, i, n, max(len) AS top FROM x WHERE {points} GROUP BY ALL)),
z AS (SELECT symbol, n, avg(log2(w + 1) / best) AS h, count(*) AS n_points FROM y GROUP BY ALL)
SELECT symbol, round(h, 6) + 0.0 AS entropy, round(1 - h / log2(n), 6) + 0.0 AS redundancy, n_points FROM z"""


def _entropy(spark, folder, window=None):
    out = M.sequence_entropy(_ticks(spark, folder), F.floor(F.col("price") / 50), window)
    return out.select("symbol", r("entropy").alias("entropy"), r("redundancy").alias("redundancy"), "n_points")


@query("sequence_entropy", _match_sql("", "i <= n // 2", "i"))
def sequence_entropy(spark, folder):
    return _entropy(spark, folder)


@query("windowed_sequence_entropy", _match_sql("AND a.i - b.i <= 20", "i BETWEEN 20 AND n - 20", "20"))
def windowed_sequence_entropy(spark, folder):
    return _entropy(spark, folder, 20)


@query("match_length_counts", _match_sql("", "i <= n // 2", "i").split(",\nz AS")[0] + """
SELECT symbol, CAST(best - 1 AS BIGINT) AS match_length, count(*) AS n_points FROM y GROUP BY ALL""")
def match_length_counts(spark, folder):
    found = M.match_lengths(_ticks(spark, folder), F.floor(F.col("price") / 50))
    return found.groupBy("symbol", F.col("_match").alias("match_length")).agg(F.count(F.lit(1)).alias("n_points"))


@query("dictionary_size", f"""WITH RECURSIVE {TICKS_SQL}, d AS (SELECT symbol, pos, n, CAST(CAST(floor(price / 50) AS BIGINT) AS VARCHAR) || ',' AS s FROM t),
f AS (SELECT symbol, pos, n, [s] AS lib, '' AS open FROM d WHERE pos = 0
  UNION ALL SELECT d.symbol, d.pos, d.n, CASE WHEN list_contains(lib, open || s) THEN lib ELSE list_append(lib, open || s) END,
    CASE WHEN list_contains(lib, open || s) THEN open || s ELSE '' END FROM f JOIN d ON d.symbol = f.symbol AND d.pos = f.pos + 1)
SELECT symbol, len(lib) AS n_phrases FROM f WHERE pos = n - 1""")
def dictionary_size(spark, folder):
    return X.dictionary_of(_ticks(spark, folder), F.floor(F.col("price") / 50))


@query("rolling_entropy_rate")
def rolling_entropy_rate(spark, folder):
    return X.entropy_rate(_ticks(spark, folder), F.floor(F.col("price") / 50), "ts", 24 * HOUR).select(
        "symbol", "id", "entropy_rate")


_LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("orthogonal_features")
def orthogonal_features(spark, folder):
    return X.orthogonal_features(table(spark, folder, "lineitem"), _LINE_COLS, 0.9, ["l_orderkey", "l_linenumber"])


@query("principal_components")
def principal_components(spark, folder):
    from pyspark.ml.functions import vector_to_array
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_COLS)
    out = X.pca_pipeline(_LINE_COLS, 2).fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", vector_to_array("components")[0].alias("pc_1"),
                      vector_to_array("components")[1].alias("pc_2"))


@query("relevant_features")
def relevant_features(spark, folder):
    s = X.feature_matrix(_ticks(spark, folder), "price", vols=(15,)).dropna().withColumn(
        "label", (F.col("price") > 50).cast("int"))
    names = [f"mom_{k}" for k in range(1, 6)] + [f"log_t{k}" for k in range(1, 6)] + ["vol_15"]
    kept = X.relevant_features(s, names, "label")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in kept])


def _windows(spark, folder, width):
    return _ticks(spark, folder).windowed(
        lambda df, w: W.sliding_window(df, w, F.col("price"), width), before=width - 1).filter("window IS NOT NULL")


@query("random_kernel_features")
def random_kernel_features(spark, folder):
    out = X.kernel_features(_windows(spark, folder, 32), "window", ["symbol", "id"], X.random_kernels(32, 1000))
    return out.select("symbol", "id", F.size("features").alias("n_features"), sum_of(F.col("features")).alias("total"))


@query("nearest_pattern_by_warping")
def nearest_pattern_by_warping(spark, folder):
    rising = [10.0 * i for i in range(12)]
    shapes = [("rising", rising), ("falling", rising[::-1]), ("flat", [50.0] * 12)]
    return X.nearest_by_warping(_windows(spark, folder, 12), "window", ["symbol", "id"], shapes)


def _panels(spark, folder, width=12):
    """Runs of ``width`` ticks, labelled by whether the next run's mean price is higher: the first two thirds of a key teach."""
    series = _ticks(spark, folder).with_length()
    runs = D.panel(series.df, TICK_KEYS, "_pos", "price", width, "id")
    mean = F.aggregate("series", F.lit(0.0), lambda a, x: a + x) / width
    after = runs.select(*TICK_KEYS, (F.col("part") - 1).alias("part"), mean.alias("next_mean"))
    lengths = series.df.select(*TICK_KEYS, "_n").distinct()
    rows = (runs.join(after, [*TICK_KEYS, "part"]).join(F.broadcast(lengths), TICK_KEYS)
            .withColumn("label", F.when(F.col("next_mean") > mean, "up").otherwise("down"))
            .withColumn("teaches", (F.col("part") + 2) * width <= F.col("_n") * 2 / 3))
    rows = D.stored(rows)
    return rows.filter("teaches"), rows.filter(~F.col("teaches"))


@query("nearest_labelled_by_warping")
def nearest_labelled_by_warping(spark, folder):
    train, test = _panels(spark, folder)
    return D.nearest_labelled(test, train, "id", "series", "label", k=3, band=3)


@query("warping_classifier_score")
def warping_classifier_score(spark, folder):
    train, test = _panels(spark, folder)
    predicted = D.voted(D.nearest_labelled(test, train, "id", "series", "label", k=1), "id")
    return test.join(predicted, "id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


@query("book_metrics", """
WITH q AS (SELECT event_id AS id, value AS bid, value + 0.5 AS ask, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS bq, user_id + 1.0::DOUBLE AS aq FROM events),
m AS (SELECT id, (bid + ask) / 2 AS mid, ask - bid AS spread, bq / nullif(bq - aq, 0) AS i1, bq / (bq + aq) AS i2 FROM q)
SELECT id, round(mid + 3e-7, 6) AS mid_price, round(spread + 3e-7, 6) AS spread, round(i1 + 3e-7, 6) AS imbalance_as_written, round(i2 + 3e-7, 6) AS imbalance,
  round(mid + spread * (i2 - 0.5) + 3e-7, 6) AS microprice FROM m""")
def book_metrics(spark, folder):
    from tickweave.operators.book import book_metrics as metrics
    k = F.get_json_object("props", "$.k").cast("double")
    q = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.array(F.struct(F.col("value").alias("price"), (k + 1).alias("qty"))).alias("bids"),
        F.array(F.struct((F.col("value") + 0.5).alias("price"), (F.col("user_id") + 1).cast("double").alias("qty"))).alias("asks"))
    out = metrics(q).join(metrics(q, "as_written").select("id", F.col("imbalance").alias("imbalance_as_written")), "id")
    eps = F.lit(3e-7)
    return out.select("id", *[F.round(F.col(c) + eps, 6).alias(c) for c in (
        "mid_price", "spread", "imbalance_as_written", "imbalance", "microprice")])
