"""Session helpers: where intermediate tables go, and how time is represented."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it up on first use.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder, because on a cluster a
    machine-local path would be lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickweave-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and freezes partition contents."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder.

    Like ``settle``, and columnar. Nothing of the plan that made it is kept, which matters in loops: a checkpoint
    remembers constraints and size estimates, and these multiply from round to round. Rows lie apart by ``by`` (few
    values), so that a filter on it reads no others.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def micros(column: Column | str) -> Column:
    """Epoch microseconds of a timestamp or timestamp_ntz column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))
