"""Aggregations over trades, lines, returns and predictions."""

from pyspark.sql import functions as F

from tickweave.operators import aggregates as G
from tickweave.operators import bars as B
from tickweave.operators import windows as W
from tickweave.plans.cleaning_queries import LINES_SQL, lines
from tickweave.plans.registry import TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, ticks
from tickweave.series import lay_out
from tickweave.session import micros

OW = "(PARTITION BY symbol ORDER BY pos)"
KINDS = ("click", "error", "purchase", "signup", "view")
DAY = 86_400_000_000

# Predictions: one row per event; score in [0, 1] from value, outcome from the payload.
PRED_SQL = """pred AS (SELECT event_id AS id, event_type AS stock, epoch_us(ts) AS ts, 1 - exp(-value / 50) AS prob,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS actual,
  CASE WHEN 1 - exp(-value / 50) > 0.5 THEN 1 ELSE 0 END AS predicted,
  (CAST(json_extract_string(props, '$.k') AS DOUBLE) - 49) / 1000 AS ret,
  CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS INTEGER) AS cls,
  CAST(floor(value) AS BIGINT) % 3 AS cls_pred FROM events)"""


def predictions(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    prob = 1 - F.exp(-F.col("value") / 50)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("stock"), micros("ts").alias("ts"), prob.alias("prob"),
        (k % 3 == 0).cast("int").alias("actual"), (prob > 0.5).cast("int").alias("predicted"),
        ((k.cast("double") - 49) / 1000).alias("ret"), (k % 3).cast("int").alias("cls"),
        (F.floor("value") % 3).cast("long").alias("cls_pred"))


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


@query("vwap_merge", f"""WITH {LINES_SQL} SELECT symbol, ts, round(sum(price * qty) / sum(qty) + 3e-7, 6) + 0.0 AS vwap, sum(qty) AS volume FROM l GROUP BY ALL""")
def vwap_merge(spark, folder):
    return G.merge_trades(lines(spark, folder), ["symbol"], "ts", "price", "qty").withColumn("vwap", r(F.col("vwap") + 3e-7))


@query("book_level_merge", f"""WITH {LINES_SQL}
SELECT symbol, ts, l_linenumber AS level, round(sum(price * qty) / sum(qty) + 3e-7, 6) + 0.0 AS price, round(avg(qty) + 3e-7, 6) + 0.0 AS qty FROM l GROUP BY ALL""")
def book_level_merge(spark, folder):
    out = G.merge_book_levels(lines(spark, folder).withColumnRenamed("l_linenumber", "level"), ["symbol"], "ts", "level", "price", "qty")
    return out.withColumns({"price": r(F.col("price") + 3e-7), "qty": r(F.col("qty") + 3e-7)})


@query("class_counts", """SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM embeddings GROUP BY label""")
def class_counts(spark, folder):
    return G.class_counts(table(spark, folder, "embeddings"), [], "label").withColumn("share", r("share"))


@query("class_weights", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) + 0.0 AS balanced, round_even(max(n) OVER () / n, 2) AS majority_ratio FROM c""")
def class_weights(spark, folder):
    return G.class_weights(table(spark, folder, "labels"), "quality").withColumn("balanced", r("balanced"))


@query("feature_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) + 0.0 AS mean,
    round(stddev_pop({c}), 4) + 0.0 AS std FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def feature_stats(spark, folder):
    out = G.feature_stats(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumns({"mean": r("mean"), "std": r("std", 4)})


@query("tensor_position_stats", f"""WITH {TICKS_SQL},
c AS (SELECT symbol, pos, lag(price, 3 - CAST(s AS INTEGER)) OVER (PARTITION BY symbol, s ORDER BY pos) AS p,
        lag(qty, 3 - CAST(s AS INTEGER)) OVER (PARTITION BY symbol, s ORDER BY pos) AS q, s FROM t, range(0, 4) g(s)),
l AS (SELECT 0 AS feature, CAST(s AS INTEGER) AS step, p AS v FROM c WHERE pos >= 3 UNION ALL SELECT 1, CAST(s AS INTEGER), q FROM c WHERE pos >= 3)
SELECT feature, step, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, max(v) AS max, min(v) AS min FROM l GROUP BY ALL""".replace(
    "lag(price, 3 - CAST(s AS INTEGER))", "lag(price, 3 - s)").replace("lag(qty, 3 - CAST(s AS INTEGER))", "lag(qty, 3 - s)"))
def tensor_position_stats(spark, folder):
    tensor = W.feature_tensor(_ticks(spark, folder), ["price", "qty"], 4).filter("tensor IS NOT NULL")
    return G.tensor_stats(tensor, "tensor").withColumns({"mean": r("mean"), "std": r("std")})


_DAILY_SQL = """d AS (SELECT epoch_us(ts) // 86400000000 AS day, event_type AS asset, avg(value) AS ret FROM events GROUP BY ALL)"""


def _daily(spark, folder):
    return ticks(spark, folder).groupBy(F.floor(F.col("ts") / DAY).alias("day"), F.col("symbol").alias("asset")).agg(
        F.avg("price").alias("ret"))


@query("asset_correlation", f"""WITH {_DAILY_SQL}
SELECT a.asset AS asset_a, b.asset AS asset_b, round(covar_samp(a.ret, b.ret), 6) + 0.0 AS cov, round(corr(a.ret, b.ret), 6) + 0.0 AS corr,
  round(sqrt((1 - least(corr(a.ret, b.ret), 1)) / 2), 4) + 0.0 AS distance FROM d a JOIN d b USING (day) GROUP BY ALL""")
def asset_correlation(spark, folder):
    out = G.asset_moments(_daily(spark, folder), "day", "asset", "ret")
    return out.withColumns({"cov": r("cov"), "corr": r("corr"), "distance": r("distance", 4)})


@query("inverse_variance_weights", f"""WITH {_DAILY_SQL}, v AS (SELECT asset, var_samp(ret) AS variance FROM d GROUP BY 1)
SELECT asset, round(variance, 6) + 0.0 AS variance, round(1 / variance / sum(1 / variance) OVER (), 6) + 0.0 AS weight FROM v""")
def inverse_variance_weights(spark, folder):
    return G.inverse_variance(_daily(spark, folder), "asset", "ret").withColumns({"variance": r("variance"), "weight": r("weight")})


@query("cluster_variance", f"""WITH {_DAILY_SQL}, s AS (SELECT * FROM d WHERE asset IN ('click', 'view', 'error')),
w AS (SELECT asset, 1 / var_samp(ret) / sum(1 / var_samp(ret)) OVER () AS w FROM s GROUP BY asset),
c AS (SELECT a.asset AS x, b.asset AS y, covar_samp(a.ret, b.ret) AS cov FROM s a JOIN s b USING (day) GROUP BY ALL)
SELECT round(sum(p.w * cov * q.w), 6) + 0.0 AS variance FROM c JOIN w p ON p.asset = x JOIN w q ON q.asset = y""")
def cluster_variance(spark, folder):
    m = G.asset_moments(_daily(spark, folder), "day", "asset", "ret")
    return G.cluster_variance(m, ["click", "view", "error"]).withColumn("variance", r("variance"))


@query("hierarchical_risk_parity")
def hierarchical_risk_parity(spark, folder):
    weekly = _daily(spark, folder).withColumn("window", F.floor(F.col("day") / 10))
    return G.risk_parity(G.asset_moments(weekly, "day", "asset", "ret", KINDS, ["window"]), ["window"])


@query("bar_return_statistics", f"""WITH {TICKS_SQL},
a AS (SELECT symbol, pos, price / lag(price) OVER {OW} - 1 AS r FROM t), b AS (SELECT *, lag(r) OVER {OW} AS l FROM a),
m AS (SELECT symbol, avg(r) AS mu FROM a GROUP BY 1),
c AS (SELECT symbol, count(r) AS n, corr(r, l) AS autocorr, var_pop(r) AS variance, avg((r - mu) ** 3) AS m3, avg((r - mu) ** 4) AS m4
  FROM b JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY symbol)
SELECT symbol, n, round(autocorr, 6) + 0.0 AS autocorr, round(variance, 4) + 0.0 AS variance,
  round(log10(n / 6 * ((m3 / variance ** 1.5) ** 2 + (m4 / variance ** 2 - 3) ** 2 / 4)), 6) + 0.0 AS log_jarque_bera FROM c""")
def bar_return_statistics(spark, folder):
    out = G.return_statistics(_ticks(spark, folder), "price")
    return out.select("symbol", "n", r("autocorr").alias("autocorr"), r("variance", 4).alias("variance"),
                      r(F.log10("jarque_bera")).alias("log_jarque_bera"))


@query("bar_count_stability", f"""WITH {TICKS_SQL}
SELECT symbol, ts // {7 * DAY} * {7 * DAY} AS period, count(*) AS n_bars
FROM t WHERE pos % 10 = 0 AND pos > 0 GROUP BY ALL""")
def bar_count_stability(spark, folder):
    bars = B.tick_bars(_ticks(spark, folder), "ts", "id", "price", "qty", 10)
    return G.bar_stability(bars, "symbol", "bar_ts", 7 * DAY)


@query("summary_per_bar_type", """SELECT event_type AS symbol, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1""")
def summary_per_bar_type(spark, folder):
    return ticks(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"),
                                                      F.max("price").alias("high"), r(F.avg("price")).alias("mean"))


_PROFILE = ("o_orderkey", "o_custkey", "o_totalprice")


@query("table_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 3) + 0.0 AS std,
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing,
  (count(*) - count({c})) / count(*) AS missing_share FROM orders""" for c in _PROFILE))
def table_profile(spark, folder):
    return G.describe_table(table(spark, folder, "orders"), _PROFILE).withColumns({"mean": r("mean", 4), "std": r("std", 3)})


_WORDS_SQL = f"""{TICKS_SQL}, s AS (SELECT symbol, pos, CAST(floor(price / 25) AS BIGINT)::VARCHAR AS c FROM t),
w AS (SELECT symbol, pos, concat_ws('_', lag(c, 3) OVER {OW}, lag(c, 2) OVER {OW}, lag(c, 1) OVER {OW}) AS word FROM s),
p AS (SELECT symbol, word, count(*) AS c, sum(count(*)) OVER (PARTITION BY symbol) AS n FROM w WHERE pos >= 3 GROUP BY symbol, word)"""


@query("plug_in_entropy", f"""WITH {_WORDS_SQL}
SELECT symbol, count(*) AS n_words, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS entropy FROM p GROUP BY symbol""")
def plug_in_entropy(spark, folder):
    return G.word_entropy(_ticks(spark, folder), F.floor(F.col("price") / 25), 3).withColumn("entropy", r("entropy"))


@query("word_probabilities", f"""WITH {_WORDS_SQL} SELECT symbol, word, round(c / n, 8) + 0.0 AS p FROM p""")
def word_probabilities(spark, folder):
    return G.word_pmf(_ticks(spark, folder), F.floor(F.col("price") / 25), 3).withColumn("p", r("p", 8))


def _grid_sql(one_sided):
    low, n = (0.0, 100) if one_sided else (0.5, 50)
    down = "false" if one_sided else "1 - prob <= th"
    return f"""WITH {PRED_SQL}, g AS (SELECT {low} + {1 - low} * i / {float(n)}::DOUBLE AS th FROM range(0, {n + 1}) x(i)),
m AS (SELECT th, ret, prob >= th AS up, {down} AS down FROM g, pred)
SELECT round(th, 4) + 0.0 AS threshold, count(*) FILTER (up OR down) AS n_bets, round(coalesce(sum(ret) FILTER (up OR down), 0), 6) + 0.0 AS pnl,
  round(CASE WHEN count(*) FILTER (up OR down) < 2 THEN 0 ELSE avg(ret) FILTER (up OR down) / stddev_pop(ret) FILTER (up OR down) END, 6) + 0.0 AS sharpe,
  round(CASE WHEN count(*) FILTER (up) + count(*) FILTER (down) = 0 THEN 0 ELSE
    (count(*) FILTER (up AND ret > 0) + count(*) FILTER (down AND ret < 0)) / (count(*) FILTER (up) + count(*) FILTER (down)) END, 6) + 0.0 AS won_ratio
FROM m GROUP BY th"""


def _grid(spark, folder, one_sided):
    out = G.threshold_grid(predictions(spark, folder), "ret", "prob", 0.01, one_sided)
    return out.select(r("threshold", 4).alias("threshold"), "n_bets", *[r(c).alias(c) for c in ("pnl", "sharpe", "won_ratio")])


@query("threshold_performance", _grid_sql(False))
def threshold_performance(spark, folder):
    return _grid(spark, folder, False)


@query("threshold_performance_one_sided", _grid_sql(True))
def threshold_performance_one_sided(spark, folder):
    return _grid(spark, folder, True)


_FAIL_SQL = f"""WITH {PRED_SQL}, a AS (SELECT stock, avg(ret) FILTER (ret > 0) AS pt, avg(ret) FILTER (ret <= 0) AS sl,
  count(*) FILTER (ret > 0) / count(*) AS p FROM pred GROUP BY stock),
q AS (SELECT *, (252 + 4.0) * (pt - sl) ** 2 AS a, (pt - sl) * (2 * 252 * sl - 4.0 * (pt - sl)) AS b, 252 * sl ** 2 AS c FROM a)
SELECT stock, round(pt, 8) + 0.0 AS mean_win, round(sl, 8) + 0.0 AS mean_loss, round(p, 6) + 0.0 AS precision,
  round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6) + 0.0 AS required FROM q"""


@query("required_precision", _FAIL_SQL)
def required_precision(spark, folder):
    out = G.failure_probability(predictions(spark, folder), ["stock"], "ret", 252, 2.0)
    return out.select("stock", r("mean_win", 8).alias("mean_win"), r("mean_loss", 8).alias("mean_loss"),
                      r("precision").alias("precision"), r("required").alias("required"))


@query("strategy_failure_probability")
def strategy_failure_probability(spark, folder):
    return G.failure_probability(predictions(spark, folder), ["stock"], "ret", 252, 2.0)


@query("confusion_matrix", f"WITH {PRED_SQL} SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, folder):
    return G.confusion(predictions(spark, folder), "actual", "predicted")


@query("binary_scores", f"""WITH {PRED_SQL}
SELECT stock, round(avg(CAST(actual = predicted AS INTEGER)), 6) + 0.0 AS accuracy,
  round(count(*) FILTER (actual = 1 AND predicted = 1) / count(*) FILTER (predicted = 1), 6) + 0.0 AS precision,
  round(count(*) FILTER (actual = 1 AND predicted = 1) / count(*) FILTER (actual = 1), 6) + 0.0 AS recall,
  round(2 * count(*) FILTER (actual = 1 AND predicted = 1) / (count(*) FILTER (predicted = 1) + count(*) FILTER (actual = 1)), 6) + 0.0 AS f1,
  round(-avg(CASE WHEN actual = 1 THEN ln(greatest(least(prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)) END), 6) + 0.0 AS log_loss
FROM pred GROUP BY stock""")
def binary_scores(spark, folder):
    out = G.binary_scores(predictions(spark, folder), "actual", "predicted", "prob", group=["stock"])
    return out.select("stock", *[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "log_loss")])


@query("per_class_score_table", f"""WITH {PRED_SQL}, c AS (SELECT stock, CAST(k AS INTEGER) AS class, cls = k AS a, cls_pred = k AS p FROM pred, range(0, 3) g(k))
SELECT stock, class, round(100 * count(*) FILTER (a = p) / count(*), 4) + 0.0 AS accuracy,
  round(100 * count(*) FILTER (a AND p) / nullif(count(*) FILTER (p), 0), 4) + 0.0 AS precision,
  round(100 * count(*) FILTER (a AND p) / nullif(count(*) FILTER (a), 0), 4) + 0.0 AS recall,
  round(200 * count(*) FILTER (a AND p) / nullif(count(*) FILTER (a) + count(*) FILTER (p), 0), 4) + 0.0 AS f1
FROM c GROUP BY GROUPING SETS ((stock, class), (class))""")
def per_class_score_table(spark, folder):
    out = G.class_table(predictions(spark, folder), "stock", "cls", "cls_pred", [0, 1, 2])
    return out.select("stock", "class", *[r(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_ROC_SQL = f"""WITH {PRED_SQL}, s AS (SELECT prob, sum(actual) AS p, sum(1 - actual) AS n FROM pred GROUP BY prob),
c AS (SELECT prob, p, n, CAST(sum(p) OVER (ORDER BY prob DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY prob DESC) AS BIGINT) AS fp,
  sum(p) OVER () AS np, sum(n) OVER () AS nn FROM s)"""


@query("roc_points", f"""{_ROC_SQL} SELECT round(prob, 9) AS score, tp, fp, round(tp / np, 6) + 0.0 AS tpr, round(fp / nn, 6) + 0.0 AS fpr,
  round(tp / (tp + fp), 6) + 0.0 AS precision FROM c""")
def roc_points(spark, folder):
    out = G.curve_points(predictions(spark, folder), "prob", "actual")
    return out.select(F.round("prob", 9).alias("score"), "tp", "fp", *[r(c).alias(c) for c in ("tpr", "fpr", "precision")])


@query("roc_auc", f"""{_ROC_SQL} SELECT round(sum(n / nn * (2 * tp - p) / (2 * np)), 6) + 0.0 AS auc FROM c""")
def roc_auc(spark, folder):
    return G.curve_points(predictions(spark, folder), "prob", "actual").agg(r(F.sum("area")).alias("auc"))


@query("mean_roc_over_folds", f"""WITH {PRED_SQL}, s AS (SELECT stock, prob, sum(actual) AS p, sum(1 - actual) AS n FROM pred GROUP BY ALL),
c AS (SELECT stock, sum(p) OVER w / sum(p) OVER (PARTITION BY stock) AS tpr, sum(n) OVER w / sum(n) OVER (PARTITION BY stock) AS fpr FROM s WINDOW w AS (PARTITION BY stock ORDER BY prob DESC)),
k AS (SELECT stock, fpr, max(tpr) AS hi, min(tpr) AS lo FROM (SELECT * FROM c UNION ALL SELECT DISTINCT stock, 0, 0 FROM c) GROUP BY ALL),
g AS (SELECT stock, g, g / 99.0::DOUBLE AS x FROM (SELECT DISTINCT stock FROM c), range(0, 100) r(g)),
a AS (SELECT g.stock, g.g, g.x, k.fpr AS x0, k.hi AS y0 FROM g ASOF JOIN k ON g.stock = k.stock AND g.x >= k.fpr),
b AS (SELECT a.*, k.fpr AS x1, k.lo AS y1 FROM a ASOF LEFT JOIN k ON a.stock = k.stock AND a.x <= k.fpr)
SELECT CAST(g AS INTEGER) AS g, round(avg(CASE WHEN g = 0 THEN 0 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END), 6) + 0.0 AS mean_tpr FROM b GROUP BY g""")
def mean_roc_over_folds(spark, folder):
    points = G.curve_points(predictions(spark, folder), "prob", "actual", ["stock"])
    return G.mean_curve(points, "stock").withColumn("mean_tpr", r("mean_tpr"))


@query("prediction_correlation", f"""WITH {PRED_SQL}, a AS (SELECT stock, ret, prob, lead(prob) OVER (PARTITION BY stock ORDER BY ts, id) AS nx FROM pred)
SELECT stock, round(corr(ret, prob), 6) + 0.0 AS corr, round(corr(ret, nx), 6) + 0.0 AS corr_shifted FROM a GROUP BY stock""")
def prediction_correlation(spark, folder):
    series = lay_out(predictions(spark, folder), ["stock"], ["ts", "id"])
    return G.shifted_correlation(series, "ret", "prob").select("stock", r("corr").alias("corr"), r("corr_shifted").alias("corr_shifted"))
