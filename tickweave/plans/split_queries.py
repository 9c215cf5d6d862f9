"""Splits, scaling, ledgers, key figures and model evaluation."""

from itertools import combinations

from pyspark.sql import functions as F

from tickweave.functions import arrays as A
from tickweave.functions import scalars as S
from tickweave.operators import aggregates as G
from tickweave.operators import evaluation as EV
from tickweave.operators import features as X
from tickweave.operators import labels as L
from tickweave.operators import scaling as SC
from tickweave.operators import splits as SP
from tickweave.operators import windows as W
from tickweave.plans.join_queries import SPANS_SQL, spans
from tickweave.plans.registry import TAPE_SQL, TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, tape, ticks
from tickweave.series import Series, lay_out

OW = "(PARTITION BY symbol ORDER BY pos)"
HOUR = 3_600_000_000
DAY = 24 * HOUR


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


# Samples: the spans of the tape in start order, one series over all symbols and one per symbol.
def _samples(spark, folder, keys=()):
    _, sp = spans(spark, folder)
    cols = sp.select("symbol", "id", F.col("ts").alias("t0"), "t1")
    return lay_out(cols if keys else cols.drop("symbol"), keys, ["t0", "id"])


def _folds_sql(k, part="symbol"):
    over = f"PARTITION BY {part}" if part else ""
    return f"""{TICKS_SQL}, {SPANS_SQL},
s AS (SELECT {part + ',' if part else ''} id, t0, t1, row_number() OVER ({over} ORDER BY t0, id) - 1 AS pos, count(*) OVER ({over}) AS n FROM sp),
s2 AS (SELECT *, CASE WHEN pos < (n // {k} + 1) * (n % {k}) THEN pos // (n // {k} + 1)
  ELSE n % {k} + (pos - (n // {k} + 1) * (n % {k})) // greatest(n // {k}, 1) END AS fold FROM s),
fo AS (SELECT {part + ',' if part else ''} fold, min(pos) AS first, max(pos) + 1 AS stop, arg_min(t0, pos) AS f0, max(t1) AS f1 FROM s2 GROUP BY ALL)"""


def _kfold_sql(purge):
    over = """AND NOT EXISTS (SELECT 1 FROM s2 x WHERE x.symbol = r.symbol AND x.fold = f.fold AND r.t0 <= x.t1 AND r.t1 >= x.t0)""" if purge else ""
    return f"""WITH {_folds_sql(5)},
p AS (SELECT r.*, f.fold AS k, f.f0, f.f1, f.first, f.stop, (SELECT count(*) FROM s2 y WHERE y.symbol = r.symbol AND y.t0 < f.f1) AS reach FROM s2 r JOIN fo f USING (symbol))
SELECT symbol, id, CAST(k AS INTEGER) AS fold, CASE WHEN r.fold = k THEN 'test' ELSE 'train' END AS role FROM p r, LATERAL (SELECT r.k AS fold) f
WHERE r.fold = k OR ((r.pos < first AND r.t1 <= r.f0 OR r.pos >= reach + CAST(floor(n * 0.02) AS BIGINT) AND r.pos >= stop) {over})"""


@query("purged_kfold", _kfold_sql(True))
def purged_kfold(spark, folder):
    return SP.purged_kfold(_samples(spark, folder, TICK_KEYS), "t0", "t1", 5, embargo=0.02).select("symbol", "id", "fold", "role")


@query("embargoed_kfold_without_purge", _kfold_sql(False))
def embargoed_kfold_without_purge(spark, folder):
    return SP.purged_kfold(_samples(spark, folder, TICK_KEYS), "t0", "t1", 5, embargo=0.02, purge=False).select("symbol", "id", "fold", "role")


_COMBOS = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combinations(range(4), 2)))


@query("combinatorial_purged_kfold", f"""WITH {_folds_sql(4)}, cb(combo, tests) AS (VALUES {_COMBOS}),
z AS (SELECT r.symbol, r.id, x.fold AS bad FROM s2 r JOIN fo x ON x.symbol = r.symbol AND x.fold <> r.fold WHERE EXISTS (
  SELECT 1 FROM s2 y WHERE y.symbol = r.symbol AND y.fold = x.fold AND r.t0 <= y.t1 AND r.t1 >= y.t0)),
b AS (SELECT symbol, id, list(bad) AS bad FROM z GROUP BY ALL)
SELECT r.symbol, r.id, combo, CAST(r.fold AS INTEGER) AS fold, CASE WHEN list_contains(tests, r.fold) THEN 'test' ELSE 'train' END AS role
FROM s2 r LEFT JOIN b USING (symbol, id), cb WHERE list_contains(tests, r.fold) OR b.bad IS NULL OR NOT list_has_any(tests, b.bad)""")
def combinatorial_purged_kfold(spark, folder):
    out = SP.combinatorial_kfold(_samples(spark, folder, TICK_KEYS), "t0", "t1", 4, 2)
    return out.select("symbol", "id", "combo", "fold", "role")


@query("test_path_map", f"""WITH {_folds_sql(4)}, cb(combo, tests) AS (VALUES {_COMBOS}), u AS (SELECT combo, unnest(tests) AS fold FROM cb),
p AS (SELECT combo, fold, row_number() OVER (PARTITION BY fold ORDER BY combo) - 1 AS path FROM u)
SELECT CAST(path AS INTEGER) AS path, CAST(p.fold AS INTEGER) AS fold, combo, count(*) AS n_rows FROM p JOIN s2 ON s2.fold = p.fold GROUP BY ALL""")
def test_path_map(spark, folder):
    paths = spark.createDataFrame(SP.test_paths(4, 2), "combo int, fold int, path int")
    out = SP.combinatorial_kfold(_samples(spark, folder, TICK_KEYS), "t0", "t1", 4, 2).filter("role = 'test'")
    return out.join(F.broadcast(paths), ["combo", "fold"]).groupBy("path", "fold", "combo").agg(F.count(F.lit(1)).alias("n_rows"))


def _rounds():
    out = []
    for i, c in enumerate(reversed(list(combinations(range(4), 2)))):
        blocks = []
        for g in c:
            if blocks and blocks[-1][1] == g - 1:
                blocks[-1][1] = g
            else:
                blocks.append([g, g])
        for a, b in blocks:
            out.append((i, list(c), c[0], a, b))
    return ", ".join(f"({i}, {c}, {first}, {a}, {b})" for i, c, first, a, b in out)


@query("combinatorial_kfold_by_time", f"""WITH {_folds_sql(4, '')}, bl(round, tests, lead, a, b) AS (VALUES {_rounds()}),
e AS (SELECT round, tests, fa.f0, fb.stop, (SELECT max(f1) FROM fo WHERE fold BETWEEN lead AND b) AS reach FROM bl JOIN fo fa ON fa.fold = a JOIN fo fb ON fb.fold = b),
j AS (SELECT id, round, any_value(tests) AS tests, any_value(s2.fold) AS fold,
  bool_and((t1 < f0 OR pos >= stop) AND (pos < stop OR t0 > reach + {2 * HOUR})) AS ok FROM s2, e GROUP BY id, round)
SELECT id, round, CASE WHEN list_contains(tests, fold) THEN 'test' ELSE 'train' END AS role FROM j WHERE list_contains(tests, fold) OR ok""")
def combinatorial_kfold_by_time(spark, folder):
    return SP.combinatorial_by_time(_samples(spark, folder), "t0", "t1", 4, 2, 2 * HOUR).select("id", "round", "role")


def _walk_sql(fold):
    return f"""WITH {_folds_sql(6, '')}, w AS (SELECT id, t0, t1, {fold} AS f FROM s2),
st AS (SELECT f, min(t0) AS f0 FROM w GROUP BY f), rd AS (SELECT CAST(i AS INTEGER) AS c, (SELECT arg_min(f0, f) FROM st WHERE f >= i) AS t FROM range(2, 6) g(i))
SELECT id, c - 2 AS round, CASE WHEN f = c THEN 'test' ELSE 'train' END AS role FROM w, rd
WHERE f = c OR (f < c AND f >= CASE WHEN c > 3 THEN c - 3 ELSE 0 END AND t1 < t)"""


@query("walk_forward", _walk_sql("fold"))
def walk_forward(spark, folder):
    return SP.walk_forward(_samples(spark, folder), "t0", "t1", 6, 1, 2, 3).select("id", "round", "role")


@query("walk_forward_equal_time", _walk_sql(
    "least(5, CAST(floor((t0 - min(t0) OVER ()) * 6.0::DOUBLE / (max(t0) OVER () - min(t0) OVER ())) AS INTEGER))"))
def walk_forward_equal_time(spark, folder):
    return SP.walk_forward(_samples(spark, folder), "t0", "t1", 6, 1, 2, 3, by_time=True).select("id", "round", "role")


@query("purge_and_embargo_helpers", f"""WITH {_folds_sql(5, '')}, f AS (SELECT f0, stop, first, f1 FROM fo WHERE fold = 2)
SELECT id FROM s2, f WHERE (fold < 2 AND t1 < f0) OR (fold > 2 AND t0 > f1 + {HOUR})""")
def purge_and_embargo_helpers(spark, folder):
    series = _samples(spark, folder).with_length()
    rows = series.df.withColumn("fold", SP.fold_of(F.col("_pos"), F.col("_n"), 5))
    test = rows.filter("fold = 2").agg(F.min("t0"), F.max("t1"), F.max("_pos") + 1).first()  # one row
    before = SP.purge_before(rows.filter("fold < 2"), "t1", F.lit(test[0]))
    after = SP.embargo_after(rows.filter("fold > 2"), "t0", "_pos", test[2], F.lit(test[1]), HOUR)
    return before.unionByName(after).select("id")


@query("embargo_time_map", f"""WITH {TICKS_SQL}
SELECT symbol, id, coalesce(y.ts, m.ts) AS embargo_ts FROM t x
LEFT JOIN (SELECT symbol, pos, ts FROM t) y ON y.symbol = x.symbol AND y.pos = x.pos + CAST(floor(x.n * 0.01) AS BIGINT)
JOIN (SELECT symbol, max(ts) AS ts FROM t GROUP BY 1) m ON m.symbol = x.symbol""".replace("SELECT symbol, id, coalesce", "SELECT x.symbol, x.id, coalesce"))
def embargo_time_map(spark, folder):
    return SP.embargo_times(_ticks(spark, folder), "ts", 0.01).select("symbol", "id", "embargo_ts")


@query("ordered_split_with_context", f"""WITH {TICKS_SQL}, b AS (SELECT DISTINCT symbol, n - 30 AS m, CAST(round_even((n - 30) * 0.8, 0) AS BIGINT) AS stop FROM t),
c AS (SELECT *, CAST(round_even(stop * 0.8, 0) AS BIGINT) AS ts FROM b),
s AS (SELECT symbol, 'train' AS split, 0 AS a, ts AS b FROM c UNION ALL SELECT symbol, 'val', ts, stop FROM c UNION ALL SELECT symbol, 'test', stop, m FROM c)
SELECT t.symbol, id, split, CASE WHEN pos - 30 >= a THEN 0 ELSE 1 END AS is_context FROM t JOIN s ON s.symbol = t.symbol AND pos - 30 >= a - 30 AND pos - 30 < b""")
def ordered_split_with_context(spark, folder):
    return SP.ordered_split(_ticks(spark, folder), 30).select("symbol", "id", "split", "is_context")


@query("ordered_holdout", f"""WITH {TICKS_SQL} SELECT symbol, id, CASE WHEN pos >= n - ceil(n * 0.1) THEN 'test' ELSE 'train' END AS role FROM t""")
def ordered_holdout(spark, folder):
    return SP.holdout(_ticks(spark, folder), 0.1).select("symbol", "id", "role")


@query("gapped_split", f"""WITH {TICKS_SQL}, x AS (SELECT symbol, id, CASE WHEN pos < floor(n * 0.5) THEN 'train' WHEN pos >= floor(n * 0.6) AND pos < floor(n * 0.7) THEN 'val'
  WHEN pos >= floor(n * 0.8) THEN 'test' END AS role FROM t) SELECT * FROM x WHERE role IS NOT NULL""")
def gapped_split(spark, folder):
    return SP.gapped_split(_ticks(spark, folder), [("train", 0, 0.5), ("val", 0.6, 0.7), ("test", 0.8, 1.0)]).select("symbol", "id", "role")


_KDAYS = {"click": 10, "error": 15, "purchase": 20, "signup": 5, "view": 25}


@query("split_by_first_days", f"""WITH {TICKS_SQL}, d AS (SELECT symbol, id, dense_rank() OVER (PARTITION BY symbol ORDER BY ts // {DAY}) AS d FROM t)
SELECT symbol, id, CASE WHEN d <= CASE symbol {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _KDAYS.items())} END THEN 'train' ELSE 'test' END AS role FROM d""")
def split_by_first_days(spark, folder):
    rows = ticks(spark, folder).withColumn("day", F.floor(F.col("ts") / DAY))
    return SP.first_days(rows, "symbol", "day", _KDAYS).select("symbol", "id", "role")


@query("rows_of_a_fold", f"""WITH {_folds_sql(5)} SELECT symbol, id, t0, t1 FROM s2 WHERE fold = 3""")
def rows_of_a_fold(spark, folder):
    s = _samples(spark, folder, TICK_KEYS)
    splits = SP.purged_kfold(s, "t0", "t1", 5).filter("fold = 3")
    return SP.rows_of(s.df, splits, ["symbol", "id"], "test").select("symbol", "id", "t0", "t1")


# -- scaling ---------------------------------------------------------------------

def _scale_sql(expr):
    return f"""WITH {TICKS_SQL}, s AS (SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM t),
f AS (SELECT min(price) AS lo, max(price) AS hi, avg(price) AS mu, stddev_pop(price) AS sd FROM s WHERE split = 'train')
SELECT symbol, id, split, round({expr}, 6) + 0.0 AS price FROM s, f"""


def _scaled(spark, folder, kind, a=0.0, b=1.0):
    rows = SP.gapped_split(_ticks(spark, folder), [("train", 0, 0.8), ("test", 0.8, 1.0)]).withColumnRenamed("role", "split")
    return SC.train_fit_scale(rows, ["price"], "split", kind, a, b).select("symbol", "id", "split", r("price").alias("price"))


@query("train_fit_minmax", _scale_sql("(price - lo) / (hi - lo) * 2 - 1"))
def train_fit_minmax(spark, folder):
    return _scaled(spark, folder, "minmax", -1.0, 1.0)


@query("train_fit_zscore", _scale_sql("(price - mu) / sd"))
def train_fit_zscore(spark, folder):
    return _scaled(spark, folder, "zscore")


_TRAIL_SQL = """st AS (SELECT a.symbol, a.day, avg(b.price) AS mu, stddev_pop(b.price) AS sd, min(b.price) AS lo, max(b.price) AS hi
  FROM (SELECT DISTINCT symbol, day, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS k FROM d) a
  JOIN (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS k FROM d) b ON a.symbol = b.symbol AND (b.k BETWEEN a.k - 5 AND a.k - 1 OR a.k = 1 AND b.k = 1)
  GROUP BY ALL)"""


@query("trailing_scale_calendar", f"""WITH {TICKS_SQL}, d AS (SELECT symbol, id, price, ts // {DAY} - min(ts // {DAY}) OVER (PARTITION BY symbol) AS day FROM t), {_TRAIL_SQL}
SELECT symbol, id, day, round((price - mu) / sd, 6) + 0.0 AS price FROM d JOIN st USING (symbol, day)""")
def trailing_scale_calendar(spark, folder):
    rows = SC.number_days(_ticks(spark, folder), "ts", DAY, False, [])
    return SC.trailing_scale(rows, TICK_KEYS, ["price"], "zscore").select("symbol", "id", "day", r("price").alias("price"))


@query("trailing_scale_anchored", f"""WITH RECURSIVE {TICKS_SQL},
f AS (SELECT symbol, pos, id, price, ts AS anchor, false AS closed, CAST(0 AS BIGINT) AS day FROM t WHERE pos = 0
  UNION ALL SELECT t.symbol, t.pos, t.id, t.price, CASE WHEN f.closed THEN t.ts ELSE f.anchor END, NOT f.closed AND t.ts - f.anchor > {DAY}, f.day + CAST(f.closed AS BIGINT)
  FROM f JOIN t ON t.symbol = f.symbol AND t.pos = f.pos + 1), d AS (SELECT symbol, id, price, day FROM f), {_TRAIL_SQL}
SELECT symbol, id, day, round((price - lo) / (hi - lo), 6) + 0.0 AS price FROM d JOIN st USING (symbol, day)""")
def trailing_scale_anchored(spark, folder):
    rows = SC.number_days(_ticks(spark, folder), "ts", DAY, True, ["price"])
    return SC.trailing_scale(rows, TICK_KEYS, ["price"], "minmax").select("symbol", "id", "day", r("price").alias("price"))


@query("position_scaled_tensor", f"""WITH {TICKS_SQL}, w AS (SELECT symbol, id, pos, s, lag(price, 3 - s) OVER (PARTITION BY symbol, s ORDER BY pos) AS v FROM t, range(0, 4) g(s)),
x AS (SELECT * FROM w WHERE pos >= 3), st AS (SELECT s, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY s)
SELECT symbol, id, round(sum((v - mu) / sd * (s + 1)), 5) + 0.0 AS index_dot FROM x JOIN st USING (s) GROUP BY symbol, id""")
def position_scaled_tensor(spark, folder):
    tensor = W.feature_tensor(_ticks(spark, folder), ["price"], 4).filter("tensor IS NOT NULL")
    out = SC.position_scale(tensor, "tensor")
    return out.select("symbol", "id", r(A.index_dot(F.col("tensor")[0]), 5).alias("index_dot"))


@query("global_minmax", """WITH b AS (SELECT least(min(l_discount), min(l_tax)) AS lo, greatest(max(l_discount), max(l_tax)) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_discount - lo) / (hi - lo), 6) + 0.0 AS l_discount, round((l_tax - lo) / (hi - lo), 6) + 0.0 AS l_tax FROM lineitem, b""")
def global_minmax(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return SC.global_minmax(df, ["l_discount", "l_tax"]).withColumns({"l_discount": r("l_discount"), "l_tax": r("l_tax")})


@query("rescaled_volatility", f"""WITH {TICKS_SQL}, b AS (SELECT min(qty) AS lo, max(qty) AS hi FROM t)
SELECT symbol, id, round(0.001 + (qty - lo) / (hi - lo) * 0.004, 8) + 0.0 AS vol, round((SELECT avg(qty) FROM t) * 0.5, 6) + 0.0 AS cusum_threshold FROM t, b""")
def rescaled_volatility(spark, folder):
    df = ticks(spark, folder).withColumn("vol", F.col("qty"))
    mean = df.agg((F.avg("qty") * 0.5).alias("cusum_threshold"))
    out = SC.rescale(df, "vol", 0.001, 0.005).crossJoin(F.broadcast(mean))  # one row
    return out.select("symbol", "id", r("vol", 8).alias("vol"), r("cusum_threshold").alias("cusum_threshold"))


@query("feature_major_long", " UNION ALL ".join(
    f"SELECT event_id AS id, '{n}' AS feature, {e}::DOUBLE AS value FROM events" for n, e in (("price", "value"), ("user", "user_id"))))
def feature_major_long(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("user_id").alias("user"))
    return SC.feature_major(df, ["id"], ["price", "user"])


# -- ledgers ----------------------------------------------------------------------

_SIDES_SQL = f"""a AS (SELECT symbol, pos, ts, price, CAST(CAST(qty AS BIGINT) % 3 AS INTEGER) - 1 AS side, 0.3 + qty / 200 AS prob FROM t),
f AS (SELECT symbol, pos, CASE WHEN prob > P AND side <> 0 THEN side ELSE 0 END AS held, CASE WHEN prob > P AND side <> 0 THEN 1 ELSE 0 END AS action FROM a WHERE pos = 0
  UNION ALL SELECT a.symbol, a.pos, CASE WHEN NOT (prob > P AND side <> 0) THEN held WHEN held = 0 THEN side WHEN side <> held THEN 0 ELSE held END,
    CASE WHEN NOT (prob > P AND side <> 0) THEN 0 WHEN held = 0 THEN 1 WHEN side <> held THEN -1 ELSE 0 END
  FROM f JOIN a ON a.symbol = f.symbol AND a.pos = f.pos + 1),
q AS (SELECT symbol, pos, action, CAST(sum(CASE WHEN action = 1 THEN 1 ELSE 0 END) OVER {OW} AS BIGINT) - 1 AS trade FROM f),
l AS (SELECT symbol, trade, max(ts) FILTER (action = 1) AS open_ts, max(ts) FILTER (action = -1) AS close_ts, max(price) FILTER (action = 1) AS open_price,
  max(price) FILTER (action = -1) AS close_price, max(side) FILTER (action = 1)::DOUBLE AS side, max(prob) FILTER (action = 1) AS prob
  FROM q JOIN a USING (symbol, pos) WHERE action <> 0 GROUP BY ALL)"""


def _ledger(spark, folder, min_prob, size=None):
    side = F.col("qty").cast("long") % 3 - 1
    prob = 0.3 + F.col("qty") / 200
    return EV.trades(_ticks(spark, folder), "price", side, prob, "ts", size, min_prob)


@query("trade_ledger", f"""WITH RECURSIVE {TICKS_SQL}, {_SIDES_SQL.replace('> P', '> 0.5')} SELECT symbol, trade, open_ts, close_ts, open_price, close_price, side FROM l""")
def trade_ledger(spark, folder):
    return _ledger(spark, folder, 0.5).drop("size")


_BET = "least(0.2, (prob - 1 / 3.0::DOUBLE) / sqrt(prob * (1 - prob)) / 10) * side"


@query("trade_cash_path", f"""WITH RECURSIVE {TICKS_SQL}, {_SIDES_SQL.replace('> P', '> 0.5')},
m AS (SELECT symbol, trade, CASE WHEN side > 0 THEN 1 - {_BET} * 1.00075 + {_BET} * close_price / open_price * 0.99925
  ELSE 1 - {_BET} * 0.99925 + {_BET} * close_price / open_price * 1.00075 END AS factor, row_number() OVER (PARTITION BY symbol ORDER BY trade) AS k FROM l WHERE close_price IS NOT NULL),
c AS (SELECT symbol, trade, k, 10000.0::DOUBLE * factor AS cash, factor FROM m WHERE k = 1
  UNION ALL SELECT m.symbol, m.trade, m.k, c.cash * m.factor, m.factor FROM c JOIN m ON m.symbol = c.symbol AND m.k = c.k + 1)
SELECT symbol, trade, round(factor, 6) + 0.0 AS factor, round(cash / 10 ** floor(log10(greatest(abs(cash), 1e-300))), 5) + 0.0 AS cash_digits FROM c""")
def trade_cash_path(spark, folder):
    prob = 0.3 + F.col("qty") / 200
    size = F.least(F.lit(0.2), S.bet_z(prob, 3, root=True) / 10)
    out = EV.cash_path(_ledger(spark, folder, 0.5, size), TICK_KEYS, 10_000.0, 0.00075)
    digits = F.col("cash") / F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs("cash"), F.lit(1e-300)))))
    return out.select("symbol", "trade", r("factor").alias("factor"), r(digits, 5).alias("cash_digits"))


@query("prediction_round_trips", f"""WITH RECURSIVE {TICKS_SQL}, {_SIDES_SQL.replace('> P', '> 0')}
SELECT symbol, trade, round(CASE WHEN side > 0 THEN close_price / open_price ELSE open_price / close_price END, 6) + 0.0 AS ratio FROM l WHERE close_price IS NOT NULL""")
def prediction_round_trips(spark, folder):
    return EV.round_trips(_ledger(spark, folder, 0.0)).select("symbol", "trade", r("ratio").alias("ratio"))


_DAILY_SQL = f"""{TICKS_SQL}, rr AS (SELECT symbol, CAST(make_timestamp(ts) AS DATE) AS d, ln(1 + (qty - 49) / 10000) AS lg FROM t),
bd AS (SELECT symbol, d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS day, sum(lg) AS lg FROM rr GROUP BY ALL),
gr AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM bd GROUP BY symbol),
cu AS (SELECT gr.symbol, gr.day, exp(sum(coalesce(lg, 0)) OVER (PARTITION BY gr.symbol ORDER BY gr.day)) AS g FROM gr LEFT JOIN bd ON bd.symbol = gr.symbol AND bd.day = gr.day WHERE isodow(gr.day) < 6),
dr AS (SELECT symbol, day, g / lag(g) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM cu)"""


def _daily(spark, folder):
    df = ticks(spark, folder).withColumn("ret", (F.col("qty") - 49) / 10000)
    return EV.daily_returns(df, TICK_KEYS, "ts", "ret")


@query("daily_business_returns", f"WITH {_DAILY_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, round(ret, 8) + 0.0 AS daily_ret FROM dr")
def daily_business_returns(spark, folder):
    return _daily(spark, folder).select("symbol", F.col("day").cast("string").alias("day"), r("daily_ret", 8).alias("daily_ret"))


@query("strategy_key_figures", f"""WITH {_DAILY_SQL}, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS c FROM dr WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day)),
e AS (SELECT *, c / greatest(max(c) OVER (PARTITION BY symbol ORDER BY day), 1) - 1 AS dd FROM c)
SELECT symbol, round(arg_max(c, day) - 1, 6) + 0.0 AS total_return, round(arg_max(c, day) ** (252 / count(*)) - 1, 5) + 0.0 AS annual_return,
  round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS annual_volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown FROM e GROUP BY symbol""")
def strategy_key_figures(spark, folder):
    out = EV.key_figures(_daily(spark, folder), TICK_KEYS, "day", "daily_ret")
    return out.select("symbol", r("total_return").alias("total_return"), r("annual_return", 5).alias("annual_return"),
                      r("annual_volatility").alias("annual_volatility"), r("sharpe", 5).alias("sharpe"), r("max_drawdown").alias("max_drawdown"))


@query("meta_label_dataset", """SELECT event_id AS id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS primary_side,
  CASE WHEN value > 50 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS meta_label FROM events""")
def meta_label_dataset(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("value") > 50).cast("int").alias("primary_side"),
                                               (F.col("user_id") % 2 == 0).cast("int").alias("actual"))
    return EV.meta_dataset(df, "primary_side", "actual").drop("actual")


@query("price_by_label_colour", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, id, price, CAST(qty AS BIGINT) % 3 AS k FROM t)
SELECT symbol, id, CASE WHEN k = 0 THEN price END AS downs, CASE WHEN k = 1 THEN price END AS middles, CASE WHEN k = 2 THEN price END AS ups FROM c""")
def price_by_label_colour(spark, folder):
    df = ticks(spark, folder).withColumn("k", F.col("qty").cast("long") % 3)
    return EV.colour_series(df, "price", "k").select("symbol", "id", "downs", "middles", "ups")


@query("two_stage_side_then_size", f"""WITH {TICKS_SQL}, a AS (SELECT *, CASE WHEN lead(price, 5) OVER {OW} > price THEN 1 ELSE -1 END AS stage_one, lead(price, 5) OVER {OW} AS nx,
  CASE WHEN CAST(qty AS BIGINT) % 4 = 0 THEN -1 ELSE 1 END AS predicted FROM t)
SELECT symbol, id, predicted AS side, CASE WHEN (nx / price - 1) * predicted > 0 THEN 1 ELSE 0 END AS bin FROM a WHERE nx IS NOT NULL""")
def two_stage_side_then_size(spark, folder):
    # stage one predicts a side; stage two labels whether trading that side paid
    rows = _ticks(spark, folder).windowed(lambda df, w: df.withColumn("_nx", F.lead("price", 5).over(w)), after=5)
    sided = rows.filter("_nx IS NOT NULL").withColumn("side", F.when(F.col("qty").cast("long") % 4 == 0, -1).otherwise(1))
    sided = sided.withColumn("ret", (F.try_divide(F.col("_nx"), F.col("price")) - 1) * F.col("side"))
    return L.event_bins(sided, True).select("symbol", "id", "side", "bin")


# -- models ------------------------------------------------------------------------

_FEATURES = ["I_mom_1", "I_mom_3", "R_log_t1", "N_vol_15"]


def _model_rows(spark, folder):
    rows = X.feature_matrix(_ticks(spark, folder), "price", vols=(15,)).dropna().select(
        "symbol", "ts", "id", F.col("mom_1").alias("I_mom_1"), F.col("mom_3").alias("I_mom_3"), F.col("log_t1").alias("R_log_t1"),
        F.col("vol_15").alias("N_vol_15"), (F.col("price") > 40).cast("int").alias("target"), (F.col("qty") + 1).alias("w"),
        (F.col("ts") + HOUR).alias("t1"), (F.col("price") / 40 - 1).alias("ret"))
    return lay_out(rows, [], ["ts", "id"])


def _model_splits(spark, folder):
    return SP.purged_kfold(_model_rows(spark, folder), "ts", "t1", 3, embargo=0.01)


def _logistic(regParam=0.01, **_):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(maxIter=10, regParam=regParam, weightCol="weight")


@query("purged_cv_scores")
def purged_cv_scores(spark, folder):
    return EV.fold_scores(_model_splits(spark, folder), _FEATURES, "target", _logistic, weight="w")


@query("purged_grid_search")
def purged_grid_search(spark, folder):
    grid = [{"regParam": v} for v in EV.log_uniform(1e-3, 1.0, 6, seed=3)]
    return EV.grid_search(_model_splits(spark, folder), _FEATURES, "target", _logistic, grid)


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark, folder):
    return EV.out_of_fold(_model_splits(spark, folder), _FEATURES, "target", _logistic, ["ts", "id"], weight="w")


@query("two_stage_learned_side")
def two_stage_learned_side(spark, folder):
    return EV.two_stage(_model_splits(spark, folder), _FEATURES, "target", "ret", _logistic, ["ts", "id"])


@query("signals_per_path")
def signals_per_path(spark, folder):
    paths = spark.createDataFrame(SP.test_paths(4, 2), "combo int, fold int, path int")
    splits = SP.combinatorial_kfold(_model_rows(spark, folder), "ts", "t1", 4, 2, embargo=0.01)
    return EV.signals_by_path(splits, paths, _FEATURES, "target", _logistic, ["ts", "id"])


@query("impurity_importance")
def impurity_importance(spark, folder):
    from pyspark.ml.classification import RandomForestClassifier
    ready = EV.assembled(_model_splits(spark, folder).filter("fold = 0"), _FEATURES, "target", None, [])
    model = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1, featureSubsetStrategy="1").fit(ready)
    return EV.impurity_importance(model, _FEATURES, spark)


@query("permutation_importance")
def permutation_importance(spark, folder):
    return EV.permutation_importance(_model_splits(spark, folder), _FEATURES, "target", _logistic, ["ts", "id"])


@query("single_feature_importance")
def single_feature_importance(spark, folder):
    return EV.single_feature_importance(_model_splits(spark, folder), _FEATURES, "target", _logistic)


@query("importance_by_kind", """WITH p AS (SELECT p_brand AS feature, avg(p_retailprice) AS mean FROM part GROUP BY 1), k AS (SELECT substr(feature, 1, 1) AS kind, sum(mean) AS total, avg(mean) AS average FROM p GROUP BY 1)
SELECT kind, round(total, 4) + 0.0 AS total, round(average, 4) + 0.0 AS average, round(total / sum(total) OVER (), 6) + 0.0 AS share FROM k""")
def importance_by_kind(spark, folder):
    imp = table(spark, folder, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("mean"))
    return EV.importance_by_kind(imp).withColumns({"total": r("total", 4), "average": r("average", 4), "share": r("share")})
