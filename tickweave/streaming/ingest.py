"""Streaming sources and sinks: replaces polling loops, buffers and per-symbol processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave.sources import sinks


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None,
          pattern: str | None = None, clean: str | None = None) -> DataFrame:
    """New files of a folder as a stream; ``clean="delete"`` removes finished ones."""
    reader = spark.readStream.schema(schema).format(fmt)
    for name, value in (("maxFilesPerTrigger", per_trigger), ("pathGlobFilter", pattern), ("cleanSource", clean)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)


def rocksdb(spark: SparkSession) -> None:
    """Keep operator state on local disk with a changelog instead of in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def to_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Exactly-once folder sink: each micro-batch owns one folder."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: sinks.append_batch(batch, path, number))
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", parts: int | None = None) -> None:
    """Process everything available now and stop.

    State lies in at most ``parts`` partitions, if given: each costs a task and a commit in every micro-batch, full or empty.
    """
    name, conf = "spark.sql.shuffle.partitions", df.sparkSession.conf
    kept = conf.get(name)
    if parts is not None:
        conf.set(name, str(min(parts, int(kept))))
    try:
        to_batches(df, path, checkpoint, mode).awaitTermination()
    finally:
        conf.set(name, kept)


def by_time(spark: SparkSession, paths: list[str]) -> bool:
    """Give files times of change in this order, as a file stream takes them; False where the file system does not keep them."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    files = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    first = jvm.java.lang.System.currentTimeMillis() // 1000 * 1000 - 1000 * len(files)
    try:
        for i, file in enumerate(files):
            file.getFileSystem(hadoop).setTimes(file, first + 1000 * i, -1)
    except Exception:  # noqa: BLE001  not every file system has times to set
        return False
    return all(file.getFileSystem(hadoop).getFileStatus(file).getModificationTime() == first + 1000 * i for i, file in enumerate(files))


def drain_windows(source: DataFrame, ts: str, build, path: str, checkpoint: str, beat: str) -> None:
    """Write the windows of a finished source in append mode, each once, the last ones included.

    ``build`` turns the stream into windowed rows. Windows close when the
    watermark passes them, so state stays bounded; after the source is drained
    one row far ahead in time, with nulls elsewhere, goes through the same
    query from the folder ``beat`` and closes those that are still open.
    Groups with a null key are the beat's and are never closed.
    """
    spark = source.sparkSession
    spark.createDataFrame([], source.schema).write.parquet(beat)
    query = build(source.unionByName(files(spark, beat, source.schema)))
    drain(query, path, checkpoint)
    row = spark.range(1).select(*[(F.lit("9999-01-01").cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name)
                                  for f in source.schema.fields])
    row.write.mode("append").parquet(beat)
    drain(query, path, checkpoint)
