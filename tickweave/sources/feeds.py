"""Parsing of exchange messages held in string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.schemas import KLINE_FIELDS, KLINE_LONGS, SNAPSHOT_JSON


def levels(nested: Column) -> Column:
    """[[price, qty], ...] strings to [{price, qty}] doubles."""
    return F.transform(nested, lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("qty")))


def _fields(df: DataFrame, message: str) -> DataFrame:
    """Top-level fields as a text map: feeds use keys that differ only by case (``u`` and ``U``)."""
    return df.withColumn("_m", F.from_json(message, "map<string,string>"))


def _long(name: str) -> Column:
    return F.element_at("_m", name).cast("long")


def agg_trades(df: DataFrame, message: str = "value") -> DataFrame:
    """Aggregate-trade messages; prices and quantities arrive as text."""
    number = lambda name: F.element_at("_m", name).cast("double")
    return _fields(df, message).select(
        *[c for c in df.columns if c != message], _long("a").alias("aggregate_trade_id"), number("p").alias("price"),
        number("q").alias("quantity"), _long("f").alias("first_trade_id"), _long("l").alias("last_trade_id"),
        (_long("T") * 1000).alias("ts"), F.element_at("_m", "m").cast("boolean").alias("is_buyer_market_maker"))


def klines(df: DataFrame, message: str = "value") -> DataFrame:
    """Positional kline arrays to named columns."""
    cells = F.from_json(message, "array<string>")
    kind = lambda n: "long" if n in KLINE_LONGS else "double"
    return df.withColumn("_c", cells).select(
        *[c for c in df.columns if c != message],
        *[F.get("_c", F.lit(i)).cast(kind(n)).alias(n) for i, n in enumerate(KLINE_FIELDS)])


def depth_diffs(df: DataFrame, message: str = "value") -> DataFrame:
    """Depth messages: event and transaction time, update ids, level arrays."""
    side = lambda name: levels(F.from_json(F.element_at("_m", name), "array<array<string>>"))
    return _fields(df, message).select(
        *[c for c in df.columns if c != message], F.element_at("_m", "s").alias("symbol"),
        (_long("E") * 1000).alias("event_ts"), (_long("T") * 1000).alias("ts"), _long("U").alias("first_id"),
        _long("u").alias("last_id"), _long("pu").alias("previous_id"), side("b").alias("bids"), side("a").alias("asks"))


def snapshots(df: DataFrame, message: str = "value") -> DataFrame:
    out = df.withColumn("_m", F.from_json(message, SNAPSHOT_JSON))
    return out.select(*[c for c in df.columns if c != message], F.col("_m.lastUpdateId").alias("snapshot_id"),
                      levels(F.col("_m.bids")).alias("bids"), levels(F.col("_m.asks")).alias("asks"))


def route(df: DataFrame, message: str = "value") -> DataFrame:
    """Multiplexed messages to (symbol, kind, payload); klines are unwrapped from ``data.k``."""
    stream = F.get_json_object(message, "$.stream")
    parts = F.split(stream, "@")
    kind = F.element_at(parts, 2)
    data = F.when(kind.startswith("kline"), F.get_json_object(message, "$.data.k")).otherwise(
        F.get_json_object(message, "$.data"))
    return df.select(*[c for c in df.columns if c != message], F.upper(F.element_at(parts, 1)).alias("symbol"),
                     kind.alias("kind"), data.alias("payload"))


def level_updates(diffs: DataFrame, keep: tuple[str, ...] = ("symbol",), seq: str = "last_id") -> DataFrame:
    """One row per changed price level."""
    def side(name, column):
        return diffs.select(*keep, F.col(seq).alias("seq"), F.lit(name).alias("side"), F.inline(column))
    return side("bid", "bids").unionByName(side("ask", "asks"))


def pair_of_table(name: Column) -> Column:
    """Symbol part of a table name such as ``btcusdt_orderbook``."""
    return F.lower(F.element_at(F.split(name, "_"), 1))
