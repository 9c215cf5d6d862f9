"""Table scans and incremental loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, drop: Sequence[str] = (),
            rename: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    df = df.select(*columns) if columns else df
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def csv_by_file(spark: SparkSession, paths: Sequence[str] | str, schema: str, name: str = "bar_type") -> DataFrame:
    """CSV files as one table, tagged with the file's base name."""
    df = spark.read.schema(schema).csv(paths, header=True)
    base = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(\.csv)?(/part-[^/]*)?$", 1)
    return df.select("*", base.alias(name))


def jdbc_options(url: str, source: str, partition: str | None = None, bounds: tuple[int, int] | None = None,
                 partitions: int = 16, **extra: str) -> dict[str, str]:
    """Reader options: a query, or a table split into ranges of a numeric column."""
    out = {"url": url, **extra}
    if source.lstrip().lower().startswith("select"):
        return {**out, "query": source}
    out["dbtable"] = source
    if partition and bounds:
        out |= {"partitionColumn": partition, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                "numPartitions": str(partitions)}
    return out


def jdbc(spark: SparkSession, url: str, source: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, source, **options)).load()


def ordered(df: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def bounds_of(df: DataFrame, column: str) -> tuple:
    """Smallest and largest value: two numbers."""
    row = df.agg(F.min(column), F.max(column)).first()
    return row[0], row[1]


def between_bounds_of(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows within another table's range; literal bounds, so the filter reaches the scan."""
    low, high = bounds_of(other, other_column)
    return df.filter(F.col(column).between(F.lit(low), F.lit(high)))


def first_and_last(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First and last row by an order, as structs."""
    row, at = F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))


def outside_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Incremental pull: rows before the earliest or after the latest stored row of their key."""
    have = stored.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    joined = new.join(have, list(keys), "left")
    return joined.filter(F.col("_lo").isNull() | (F.col(ts) < F.col("_lo")) | (F.col(ts) > F.col("_hi"))).drop("_lo", "_hi")


def missing_opens(stored: DataFrame, keys: Sequence[str], ts: str, start: int, end: int, step: int) -> DataFrame:
    """Expected bar times in [start, end] that are not stored."""
    grid = stored.select(*keys).distinct().withColumn(ts, F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))))
    return grid.join(stored.select(*keys, ts), [*keys, ts], "left_anti")


def gap_ranges(missing: DataFrame, keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """Missing bar times merged into contiguous request ranges."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(ts)  # one row per missing bar of a key
    island = F.col(ts) - F.row_number().over(w) * step
    return missing.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(ts).alias("start"), F.max(ts).alias("end")).drop("_i")


def symbol_universe(info: DataFrame, selected: Sequence[str], margin_only: bool = True) -> DataFrame:
    """Listed symbols of an exchange-info document, restricted to a selection."""
    rows = info.select(F.inline("symbols")).filter("status = 'TRADING'")
    if margin_only:
        rows = rows.filter("isMarginTradingAllowed")
    return rows.filter(F.col("symbol").isin(list(selected))).select("symbol").dropDuplicates()


def numbered_matrices(spark: SparkSession, paths: Sequence[str] | str, n_features: int = 40,
                      horizons: Sequence[int] = (10, 20, 30, 50, 100)) -> DataFrame:
    """Benchmark depth files: one text line per feature, one column per event.

    Returns one row per (file, event) with the depth features as an array and
    a zero-based class per horizon. The line number inside a file is the rank
    of its byte offset, taken per file over a few dozen lines.
    """
    from pyspark.sql import Window
    lines = spark.read.text(paths).select(
        F.col("value"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    w = Window.partitionBy("file").orderBy("_block", "_id")
    numbered = lines.withColumn("line", F.row_number().over(w) - 1)
    cells = numbered.select("file", "line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("event", "cell"))
    n_labels = len(horizons)
    last = numbered.groupBy("file").agg(F.max("line").alias("_last"))
    tagged = cells.join(F.broadcast(last), "file").filter(  # one row per file
        (F.col("line") < n_features) | (F.col("line") > F.col("_last") - n_labels))
    value = F.col("cell").cast("double")
    packed = tagged.groupBy("file", "event").agg(
        F.array_sort(F.collect_list(F.when(F.col("line") < n_features, F.struct("line", value.alias("v"))))).alias("_f"),
        *[F.max(F.when(F.col("line") == F.col("_last") - n_labels + 1 + i, value)).alias(f"label_{h}") for i, h in enumerate(horizons)])
    return packed.select("file", "event", F.transform("_f", lambda e: e["v"]).alias("depth"),
                         *[(F.col(f"label_{h}") - 1).cast("int").alias(f"label_{h}") for h in horizons])


def synthetic_classes(spark: SparkSession, rows: int, informative: int, redundant: int, noise: int, seed: int = 0) -> DataFrame:
    """Seeded classification set with informative (I_), redundant (R_) and noise (N_) columns."""
    df = spark.range(rows).withColumns({f"I_{i}": F.randn(seed + i) for i in range(informative)})
    df = df.withColumns({f"R_{i}": F.col(f"I_{i % informative}") * (0.5 + i / 10) + F.randn(seed + 100 + i) * 0.01 for i in range(redundant)})
    df = df.withColumns({f"N_{i}": F.randn(seed + 200 + i) for i in range(noise)})
    score: Column = sum((F.col(f"I_{i}") for i in range(informative)), F.lit(0.0))
    return df.withColumns({"bin": (score > 0).cast("int"), "w": F.lit(1.0 / rows), "t1": F.col("id")})


def correlated_block(spark: SparkSession, rows: int, independent: int, copies: int, noise: float = 0.25, seed: int = 12345) -> DataFrame:
    df = spark.range(rows).withColumns({f"x{i}": F.randn(seed + i) for i in range(independent)})
    return df.withColumns({f"x{independent + j}": F.col(f"x{j % independent}") + F.randn(seed + 500 + j) * noise for j in range(copies)})


def timed_samples(spark: SparkSession, rows: int, step_us: int, max_length_us: int, seed: int = 0) -> DataFrame:
    """Samples with a prediction time and a random later evaluation time."""
    return spark.range(rows).select(
        "id", *[F.randn(seed + i).alias(n) for i, n in enumerate("ABC")], (F.col("id") * step_us).alias("pred_time"),
        (F.col("id") * step_us + F.floor(F.rand(seed + 9) * max_length_us)).cast("long").alias("eval_time"))
