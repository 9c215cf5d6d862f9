"""Filters, coercions and duplicate handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.series import Series


def epoch_to_micros(value: Column) -> Column:
    """Epoch digits to microseconds: 13 digits are milliseconds, 19 nanoseconds."""
    n = F.length(value.cast("string"))
    v = value.cast("long")
    return F.when(n == 13, v * 1000).when(n == 19, F.call_function("div", v, F.lit(1000)))


def micros_to_millis(value: Column) -> Column:
    return F.floor(value / 1000).cast("long")


def to_number(value: Column, strict: bool = False) -> Column:
    """Numeric coercion; malformed text becomes null unless ``strict``."""
    return value.cast("double") if strict else value.try_cast("double")


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def drop_missing(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    return nan_to_null(df, columns).dropna(how=how, subset=list(columns))


def replace_infinite(df: DataFrame, columns: Sequence[str], value: float | None = 0.0) -> DataFrame:
    inf = float("inf")
    return df.withColumns({c: F.when(F.abs(F.col(c)) == inf, F.lit(value).cast("double")).otherwise(F.col(c))
                           for c in columns})


def first_per_time(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per (key, time), picked with a map-side combining aggregate instead of a sort."""
    group = [*keys, ts]
    rest = [c for c in df.columns if c not in group]
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*rest), F.struct(*tie)).alias("_row")
    return df.groupBy(*group).agg(row).select(*group, *[F.col(f"_row.{c}").alias(c) for c in rest])


def duplicate_times(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def spread_duplicates(series: Series, ts: str, name: str = "unique_ts") -> DataFrame:
    """Add 1, 2, ... microseconds to repeats of a time; the first occurrence stays.

    The position of each run's first row is a running maximum, so a time
    shared by very many rows is still handled in pieces.
    """
    flagged = series.windowed(lambda df, w: df.withColumn(
        "_start", F.when(F.lag(ts).over(w).eqNullSafe(F.col(ts)) & (F.col("_pos") > 0), None)
        .otherwise(F.col("_pos"))), before=1)
    run = series.derive(flagged).running(
        {"_first": ("max", F.col("_start"))})
    return run.withColumn(name, F.col(ts) + F.col("_pos") - F.col("_first")).drop("_start", "_first")


def between(df: DataFrame, ts: str, start: Column | int | None = None, end: Column | int | None = None) -> DataFrame:
    """Time range, both ends included."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    return df


def changed_rows(series: Series, *columns: str, emit_first: bool = False) -> DataFrame:
    """Rows where any of the columns differs from the previous row."""
    def build(df, w):
        moved = F.lit(False)
        for c in columns:
            moved = moved | ~F.lag(c).over(w).eqNullSafe(F.col(c))
        first = F.col("_pos") == 0
        return df.withColumn("_moved", F.when(first, emit_first).otherwise(moved))
    return series.windowed(build, before=1).filter("_moved").drop("_moved")


def threshold_side(series: Series, value: str, lower: Column, upper: Column) -> DataFrame:
    """+1 at or below ``lower``, -1 at or above ``upper``, else null; lagged one row."""
    def build(df, w):
        side = F.when(F.col(value) >= upper, -1).when(F.col(value) <= lower, 1)
        return df.withColumn("_s", side).withColumn("side", F.lag("_s").over(w)).drop("_s")
    return series.windowed(build, before=1)


def drop_rare_labels(df: DataFrame, label: str, min_share: float = 0.05) -> DataFrame:
    """Remove the least frequent class until its share exceeds ``min_share`` or two remain."""
    counts = [(row[0], row[1]) for row in df.groupBy(label).count().orderBy("count", label).collect()]
    kept = sorted(counts, key=lambda c: (c[1], c[0]))
    while len(kept) >= 3 and kept[0][1] / sum(n for _, n in kept) <= min_share:
        kept = kept[1:]
    return df.filter(F.col(label).isin([c for c, _ in kept]))


def head_rows(df: DataFrame, order: Sequence[str], n: int, skip: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(n)


def depth_columns(levels: Column, n_levels: int, volumes_only: bool = False, log: bool = False) -> Column:
    """First ``4 * n_levels`` cells of a flat depth row; optionally only volumes, optionally logged."""
    out = F.slice(levels, 1, 4 * n_levels)
    if volumes_only:
        out = F.filter(out, lambda x, i: i % 2 == 1)
    return F.transform(out, lambda x: F.log(x)) if log else out


def reconcile(raw: DataFrame, implied: DataFrame, on: Sequence[str], raw_value: str, implied_value: str,
              tolerance: float) -> DataFrame:
    """Keep the raw value where both encodings agree, else take the implied one and flag it."""
    both = raw.join(implied, list(on))
    wrong = F.abs(F.col(raw_value) - F.col(implied_value)) > tolerance
    return both.withColumns({"corrected": wrong.cast("int"),
                             "value": F.when(wrong, F.col(implied_value)).otherwise(F.col(raw_value))})


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top-n rows per key. Spark prunes each map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
