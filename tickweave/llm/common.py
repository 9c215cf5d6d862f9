"""Helpers shared by the corpus operators: reading tables, text identities, word hashes, stored intermediates."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import checkpoint_folder

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
    bounded_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Documents are long rows: hand Python workers a thousand at a time, not Spark's ten thousand, unless the user chose a number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


@contextmanager
def batch_bytes(spark: SparkSession, most: str) -> Iterator[None]:
    """While this holds, Python workers are handed at most about so many bytes of rows at a time; the user's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Columnar, compressed and committed by Spark's writer, so it survives lost
    executors and later readers prune columns. Tables stay until the folder is
    cleared after the job.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote, when nothing will read it again; disk is held no longer than needed."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column | str) -> Column:
    """128-bit identity of a text (null counts as empty), made from two seeds of a 64-bit hash."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every output bit depends on every input bit (fixed constants of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash; words seen lately are kept, never more than ``most``."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes methods do exactly that and leave other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(text: str, size: int, border: re.Pattern) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or a little more, cut only before a match of ``border``."""
    at = 0
    while at < len(text):
        cut = border.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def batches(frames: Iterator, size: Callable, most: int) -> Iterator[list]:
    """Regroup an iterator of items into lists whose summed ``size`` passes ``most`` only by the last item."""
    held, total = [], 0
    for item in frames:
        held.append(item)
        total += size(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def parts_for(total: int, each: int, least: int = 1) -> int:
    """Number of parts of about ``each`` units that ``total`` units are dealt into."""
    return max(least, -(-int(total or 0) // each))


def set_apart(docs: DataFrame, **own: Column) -> tuple[DataFrame, Callable]:
    """``docs`` as one column of whole rows beside the columns ``own``, so that no column of the user can clash with them.

    The second value gives the rows back, with columns named after it in place of any that the user has by that name.
    """
    whole = f"row_{uuid.uuid4().hex}"
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), *[c.alias(name) for name, c in own.items()])

    def back(rows: DataFrame, *more: str) -> DataFrame:
        taken = {name.lower() for name in more}
        return rows.select(*[F.col(whole)[c].alias(c) for c in docs.columns if c.lower() not in taken], *more)

    return apart, back


BROADCAST_ROWS = 400_000     # key rows of a few dozen bytes that may be broadcast; more are joined by a shuffle


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df`` stored, marked for broadcast when its counted rows are at most ``most``; and the count."""
    df = stored(df)
    rows = df.count()
    return (F.broadcast(df) if rows <= most else df), rows


def joined_by_key(docs: DataFrame, keys: DataFrame, how: str, text_col: str) -> DataFrame:
    """Semi or anti join of ``docs`` with text keys (a, b): by broadcast when these are counted to be few, else by a shuffle."""
    keys, _ = small_enough(keys.select(F.col("a").alias("_key_a"), F.col("b").alias("_key_b")))
    own = text_key(text_col)
    apart, back = set_apart(docs, _own_a=own["a"], _own_b=own["b"])
    return back(apart.join(keys, (F.col("_own_a") == F.col("_key_a")) & (F.col("_own_b") == F.col("_key_b")), how))


def shared(spark: SparkSession, value) -> Callable:
    """Broadcast ``value``; calling the result in a task gives it back. Its classes travel along, so workers need not have the package."""
    import pickle

    from pyspark import cloudpickle
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)  # noqa: S301
