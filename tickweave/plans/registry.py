"""Registry of runnable queries, each with its SQL statement where one exists."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def r(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


# Ticks: one series per event type.
RAW_TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, epoch_us(ts) AS ts, event_id AS id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty
  FROM events)"""
TICKS_SQL = RAW_TICKS_SQL + """,
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1 AS pos,
             count(*) OVER (PARTITION BY symbol) AS n FROM ticks)"""

# One single long series.
TAPE_SQL = """tape AS (
  SELECT epoch_us(ts) AS ts, event_id AS id, event_type AS kind, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty
  FROM events),
t AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS pos, count(*) OVER () AS n FROM tape)"""


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), micros("ts").alias("ts"), F.col("event_id").alias("id"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))


def tape(spark: SparkSession, folder: str) -> DataFrame:
    return ticks(spark, folder).withColumnRenamed("symbol", "kind")


TICK_KEYS, TICK_ORDER = ["symbol"], ["ts", "id"]
