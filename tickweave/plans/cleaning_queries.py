"""Projections, filters, duplicates, ordering and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.functions import arrays as A
from tickweave.operators import cleaning as C
from tickweave.plans.registry import TICK_KEYS, TICK_ORDER, TICKS_SQL, query, r, table, ticks
from tickweave.series import lay_out
from tickweave.session import micros

OW = "(PARTITION BY symbol ORDER BY pos)"
LINES_SQL = """l AS (SELECT l_returnflag AS symbol, epoch_us(l_shipdate) AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS qty, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_linestatus FROM lineitem)"""


def _ticks(spark, folder):
    return lay_out(ticks(spark, folder), TICK_KEYS, TICK_ORDER)


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), micros("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_linestatus")


@query("project_rename", "SELECT event_id AS id, event_type AS symbol, value AS close FROM events")
def project_rename(spark, folder):
    return table(spark, folder, "events").withColumnsRenamed(
        {"event_id": "id", "event_type": "symbol", "value": "close"}).drop("ts", "user_id", "props")


@query("epoch_digits_to_time", """
SELECT event_id AS id, epoch_us(ts) // 1000 * 1000 AS from_ms, epoch_us(ts) AS from_ns, epoch_us(ts) // 1000 AS back_ms FROM events""")
def epoch_digits_to_time(spark, folder):
    us = micros("ts")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), C.epoch_to_micros(C.micros_to_millis(us)).alias("from_ms"),
        C.epoch_to_micros(us * 1000).alias("from_ns"), C.micros_to_millis(us).alias("back_ms"))


@query("numeric_coercion", """
SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def numeric_coercion(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), C.to_number(F.get_json_object("props", "$.k")).alias("k"),
        C.to_number(F.col("event_type")).alias("bad"))


_GAPS_SQL = """g AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS a,
  CASE WHEN event_id % 35 = 0 THEN NULL ELSE value * 2 END AS b FROM events)"""


def _gaps(spark, folder):
    e = table(spark, folder, "events")
    nan = F.lit(float("nan"))
    return e.select(F.col("event_id").alias("id"),
                    F.when(F.col("event_id") % 7 == 0, nan).when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"),
                    F.when(F.col("event_id") % 35 != 0, F.col("value") * 2).alias("b"))


@query("drop_missing_any", f"WITH {_GAPS_SQL} SELECT * FROM g WHERE a IS NOT NULL AND NOT isnan(a) AND b IS NOT NULL")
def drop_missing_any(spark, folder):
    return C.drop_missing(_gaps(spark, folder), ["a", "b"])


@query("drop_missing_all", f"""WITH {_GAPS_SQL} SELECT id, CASE WHEN isnan(a) THEN NULL ELSE a END AS a, b
FROM g WHERE NOT ((a IS NULL OR isnan(a)) AND b IS NULL)""")
def drop_missing_all(spark, folder):
    return C.drop_missing(_gaps(spark, folder), ["a", "b"], how="all")


@query("rows_with_nan_in_array", f"WITH {_GAPS_SQL} SELECT id FROM g WHERE a IS NULL OR isnan(a) OR b IS NULL")
def rows_with_nan_in_array(spark, folder):
    return _gaps(spark, folder).filter(A.has_nan(F.array("a", "b"))).select("id")


@query("replace_infinite", """
SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS x FROM events""")
def replace_infinite(spark, folder):
    inf = F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("-inf"))
    df = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, inf).otherwise(F.col("value")).alias("x"))
    return C.replace_infinite(df, ["x"], 0.0)


_DEDUP = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, qty, l_linestatus"


def _dedup_sql(direction):
    order = ", ".join(f"{c.strip()} {direction}" for c in _DEDUP.split(","))
    return f"""WITH {LINES_SQL} SELECT symbol, ts, {R8('price')} AS price, qty, l_orderkey FROM l
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY {order}) = 1"""


def R8(e, d=8):
    return f"round({e}, {d}) + 0.0"


@query("first_row_per_time", _dedup_sql("ASC"))
def first_row_per_time(spark, folder):
    tie = [c.strip() for c in _DEDUP.split(",")]
    return C.first_per_time(lines(spark, folder), ["symbol"], "ts", tie).select(
        "symbol", "ts", r("price", 8).alias("price"), "qty", "l_orderkey")


@query("last_row_per_time", _dedup_sql("DESC"))
def last_row_per_time(spark, folder):
    tie = [c.strip() for c in _DEDUP.split(",")]
    return C.first_per_time(lines(spark, folder), ["symbol"], "ts", tie, keep="last").select(
        "symbol", "ts", r("price", 8).alias("price"), "qty", "l_orderkey")


@query("duplicate_times", f"""WITH {LINES_SQL} SELECT symbol, ts, count(*) AS n_rows FROM l GROUP BY ALL HAVING count(*) > 1""")
def duplicate_times(spark, folder):
    return C.duplicate_times(lines(spark, folder), ["symbol"], "ts")


@query("spread_duplicate_times", f"""WITH {LINES_SQL}
SELECT symbol, ts, l_orderkey, l_linenumber, l_extendedprice, ts + row_number() OVER (PARTITION BY symbol, ts
  ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS unique_ts FROM l""")
def spread_duplicate_times(spark, folder):
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    series = lay_out(lines(spark, folder).select("symbol", "ts", *cols), ["symbol"], ["ts", *cols])
    return C.spread_duplicates(series, "ts").select("symbol", "ts", *cols, "unique_ts")


@query("time_range", """SELECT event_id AS id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-19 23:59:59'""")
def time_range(spark, folder):
    e = table(spark, folder, "events")
    bound = lambda text: F.lit(text).cast("timestamp_ntz")
    return C.between(e, "ts", bound("2024-01-10"), bound("2024-01-19 23:59:59")).select(
        F.col("event_id").alias("id"), "value")


@query("rows_where_price_moved", f"""WITH {TICKS_SQL}, q AS (SELECT symbol, id, pos, round(price, -1) AS mid FROM t)
SELECT symbol, id, mid FROM q QUALIFY pos > 0 AND mid <> lag(mid) OVER {OW}""")
def rows_where_price_moved(spark, folder):
    series = _ticks(spark, folder).with_columns({"mid": F.round("price", -1)})
    return C.changed_rows(series, "mid").select("symbol", "id", "mid")


@query("rows_where_best_quote_moved", f"""WITH {TICKS_SQL},
q AS (SELECT symbol, id, pos, floor(price / 20) AS best_bid, floor(qty / 25) AS best_ask FROM t)
SELECT symbol, id, best_bid, best_ask FROM q
QUALIFY pos = 0 OR best_bid <> lag(best_bid) OVER {OW} OR best_ask <> lag(best_ask) OVER {OW}""")
def rows_where_best_quote_moved(spark, folder):
    series = _ticks(spark, folder).with_columns({
        "best_bid": F.floor(F.col("price") / 20).cast("double"), "best_ask": F.floor(F.col("qty") / 25).cast("double")})
    return C.changed_rows(series, "best_bid", "best_ask", emit_first=True).select("symbol", "id", "best_bid", "best_ask")


@query("threshold_side_lagged", f"""WITH {TICKS_SQL},
s AS (SELECT symbol, id, pos, CASE WHEN price >= 90 THEN -1 WHEN price <= 10 THEN 1 END AS s FROM t)
SELECT symbol, id, lag(s) OVER {OW} AS side FROM s""")
def threshold_side_lagged(spark, folder):
    return C.threshold_side(_ticks(spark, folder), "price", F.lit(10), F.lit(90)).select("symbol", "id", "side")


@query("drop_rare_labels", f"""WITH {TICKS_SQL}, b AS (SELECT symbol, id, CAST(least(floor(price / 50), 5) AS BIGINT) AS bin FROM t),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
o AS (SELECT bin, n, sum(n) OVER (ORDER BY n DESC, bin DESC) AS cum, row_number() OVER (ORDER BY n DESC, bin DESC) AS k FROM c)
SELECT b.* FROM b JOIN o USING (bin) WHERE k <= greatest(2, (SELECT max(k) FROM o WHERE n / cum > 0.05))""")
def drop_rare_labels(spark, folder):
    df = ticks(spark, folder).select(
        "symbol", "id", F.least(F.floor(F.col("price") / 50), F.lit(5)).cast("long").alias("bin"))
    return C.drop_rare_labels(df, "bin", 0.05)


@query("ordered_head", "SELECT event_id AS id, value FROM events ORDER BY ts, event_id LIMIT 500 OFFSET 100")
def ordered_head(spark, folder):
    return C.head_rows(table(spark, folder, "events"), ["ts", "event_id"], 500, skip=100).select(
        F.col("event_id").alias("id"), "value")


@query("depth_volume_columns", """SELECT vec_id, len(embedding[1:16]) // 2 AS n_cells,
  round(list_sum(list_transform(range(1, 9), lambda i: i * ln(1 + abs(embedding[2 * i]::DOUBLE)))), 6) + 0.0 AS index_dot FROM embeddings""")
def depth_volume_columns(spark, folder):
    cells = F.transform("embedding", lambda x: 1 + F.abs(x.cast("double")))
    v = C.depth_columns(cells, 4, volumes_only=True, log=True)
    return table(spark, folder, "embeddings").select(
        "vec_id", F.size(v).cast("long").alias("n_cells"), r(A.index_dot(v)).alias("index_dot"))


@query("reconcile_encodings", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events),
raw AS (SELECT event_id AS id, (value - mu) / sd + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS z, (value - mu) / sd AS implied FROM events, s)
SELECT id, CAST(abs(z - implied) > 0.5 AS INTEGER) AS corrected, round(CASE WHEN abs(z - implied) > 0.5 THEN implied ELSE z END, 6) + 0.0 AS value FROM raw""")
def reconcile_encodings(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), "value")
    s = e.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = e.crossJoin(F.broadcast(s)).select("id", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("implied"))  # one row
    raw = z.select("id", (F.col("implied") + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("z"))
    out = C.reconcile(raw, z, ["id"], "z", "implied", 0.5)
    return out.select("id", "corrected", r("value").alias("value"))


@query("order_by_update", "SELECT event_id AS id, epoch_us(ts) AS ts, value FROM events ORDER BY ts, event_id")
def order_by_update(spark, folder):
    return ticks(spark, folder).select("id", "ts", F.col("price").alias("value")).orderBy("ts", "id")


@query("book_side_ordering", """
SELECT l_orderkey, count(*) AS n, list(l_extendedprice ORDER BY l_extendedprice DESC)[1] AS best_bid,
  list(l_extendedprice ORDER BY l_extendedprice)[1] AS best_ask,
  round(list_sum(list_transform(range(1, count(*) + 1), lambda i: i * list(l_extendedprice ORDER BY l_extendedprice DESC)[i])), 4) + 0.0 AS bid_dot
FROM (SELECT l_orderkey, l_extendedprice FROM lineitem) GROUP BY l_orderkey""".replace(
    "list_transform(range(1, count(*) + 1), lambda i: i * list(l_extendedprice ORDER BY l_extendedprice DESC)[i])",
    "list_transform(list_zip(range(1, count(*) + 1), list(l_extendedprice ORDER BY l_extendedprice DESC)), lambda e: e[1] * e[2])"))
def book_side_ordering(spark, folder):
    # an order has a handful of lines, so the per-order array stays short
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("l_extendedprice"), asc=False).alias("bids"))
    return g.select("l_orderkey", "n", F.col("bids")[0].alias("best_bid"), F.element_at("bids", -1).alias("best_ask"),
                    r(A.index_dot(F.col("bids")), 4).alias("bid_dot"))


@query("top_depth_per_side", """
WITH x AS (SELECT DISTINCT l_suppkey, l_linestatus, l_extendedprice FROM lineitem)
SELECT l_suppkey, l_linestatus, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_extendedprice DESC) AS rank
FROM x QUALIFY rank <= 5""")
def top_depth_per_side(spark, folder):
    x = table(spark, folder, "lineitem").select("l_suppkey", "l_linestatus", F.col("l_extendedprice").alias("price")).distinct()
    return C.top_per_key(x, ["l_suppkey", "l_linestatus"], [F.desc("price")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("padded_depth", """
WITH g AS (SELECT user_id, list(value ORDER BY value DESC)[1:80] AS v FROM events GROUP BY user_id)
SELECT user_id, 80 AS n_levels, 80 - len(v) AS n_padded, round(list_sum(v), 6) + 0.0 AS total FROM g""")
def padded_depth(spark, folder):
    w = C.top_per_key(table(spark, folder, "events").select("user_id", "value", "event_id"), ["user_id"],
                      [F.desc("value"), F.col("event_id")], 80)
    g = w.groupBy("user_id").agg(F.sort_array(F.collect_list("value"), asc=False).alias("v"))
    padded = A.pad_to(F.col("v"), 80, F.lit(None).cast("double"))
    return g.select("user_id", F.size(padded).alias("n_levels"),
                    F.size(F.filter(padded, lambda x: x.isNull())).cast("long").alias("n_padded"),
                    r(A.sum_of(F.col("v"))).alias("total"))


@query("top_features_by_importance", """
SELECT p_type AS feature, round(avg(p_retailprice), 6) + 0.0 AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_features_by_importance(spark, folder):
    g = table(spark, folder, "part").groupBy(F.col("p_type").alias("feature")).agg(r(F.avg("p_retailprice")).alias("importance"))
    return g.orderBy(F.desc("importance"), "feature").limit(10)


@query("union_of_times", """SELECT DISTINCT t FROM (SELECT epoch_us(ts) AS t FROM events UNION ALL SELECT epoch_us(ts) + 86400000000 FROM events)""")
def union_of_times(spark, folder):
    t = ticks(spark, folder).select(F.col("ts").alias("t"))
    return t.union(t.select((F.col("t") + 86_400_000_000).alias("t"))).distinct()


@query("union_all_pieces", """SELECT event_id AS id, value FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, value FROM events WHERE event_type <> 'error'""")
def union_all_pieces(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), "value", "event_type")
    return e.filter("event_type = 'click'").unionByName(e.filter("event_type <> 'error'")).drop("event_type")


@query("intersect_days", """SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day FROM events WHERE event_type = 'click' AND value > 200
INTERSECT SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR FROM events WHERE event_type = 'view' AND value > 200""")
def intersect_days(spark, folder):
    e = table(spark, folder, "events").filter("value > 200").withColumn("day", F.to_date("ts").cast("string"))
    return e.filter("event_type = 'click'").select("day").intersect(e.filter("event_type = 'view'").select("day"))


@query("difference_users", """SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE value > 300""")
def difference_users(spark, folder):
    e = table(spark, folder, "events")
    return e.filter("event_type = 'click'").select("user_id").distinct().join(
        e.filter("value > 300").select("user_id"), "user_id", "left_anti")
