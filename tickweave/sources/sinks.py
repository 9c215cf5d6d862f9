"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Snappy Parquet, optionally partitioned by columns."""
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    parquet(df, path, mode="append")


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent append for ``foreachBatch``: a replayed batch replaces its own folder."""
    parquet(df, f"{path}/batch={batch_id:012d}")


def jdbc_append(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()


def daily(df: DataFrame, path: str, ts: str, keys: Sequence[str] = ("symbol",)) -> None:
    """One folder per key and calendar day."""
    parquet(df.withColumn("date", F.to_date(F.timestamp_micros(ts))), path, by=[*keys, "date"])


def dataset_bundle(df: DataFrame, path: str, split: str = "split") -> None:
    """Train/validation/test in one table, a folder per split."""
    parquet(df, path, by=[split])


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
