"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal texts form a group. Groups are placed in falling order of
their largest share of a shard, each into the shard whose residual capacity
has the highest dot product with the group's (bytes, tokens, rows), among the
shards that it fits into when there are any.

At scale: groups above a small fraction of a shard are few (their number is
bounded by shards * FRACTION * 3) and are placed first, by the driver. All
others are dealt into parts by hash; each part fills its share of what is left
of every shard, small groups last, so the parts' sums stay within a few small
documents of each other. A group larger than a whole shard cannot stay
together: its rows are dealt into pieces by a hash of the id.

Null texts count as empty, null ids are allowed (equal rows without id share a
piece), repeated rows are members of their group, an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import parts_for, set_apart, small_enough, stored, text_key
from tickweave.llm.mixing import token_count

FRACTION = 64                # groups above 1/64 of a shard in any dimension are placed by the driver
PART_GROUPS = 100_000        # groups that one task places
SLOT_ROWS = 50_000           # rows that one task numbers
_DIMENSIONS = ["size", "tokens", "n"]


def pack(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of every item: highest dot product with the residual capacity, the larger items first.

    ``items`` (m, 3) and ``residual`` (shards, 3) are in shares of a shard's
    capacity; ``residual`` is used up in place. Equal products go to the lower
    shard number.
    """
    out = np.empty(len(items), np.int32)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        item = items[i]
        product = residual @ item
        fits = (residual >= item).all(axis=1)
        if fits.any():
            product[~fits] = -np.inf
        best = int(np.argmax(product))
        residual[best] -= item
        out[i] = best
    return out


def _place_part(residual: np.ndarray, total: np.ndarray):
    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"], ignore_index=True)
        sums = frame[_DIMENSIONS].to_numpy(np.float64)
        own = sums.sum(axis=0)
        room = np.clip(residual, 0, None)
        weight = np.maximum(room.sum(axis=0), 1e-12)
        capacity = room / weight * own            # this part's share of every shard, in units
        unit = np.maximum(own / len(residual), 1e-12)
        return frame[["a", "b"]].assign(shard=pack(sums / unit, capacity / unit))
    return place


def shard_groups(groups: DataFrame, pieces: DataFrame, shards: int, total: np.ndarray) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """Placement of (a, b, size, tokens, n) groups: (a, b, piece, shard) of large ones and (a, b, shard) of the rest."""
    spark = groups.sparkSession
    capacity = np.maximum(total / shards, 1e-12)
    over = " or ".join(f"{d} > {float(c) / FRACTION!r}" for d, c in zip(_DIMENSIONS, capacity, strict=True))
    whole = groups.join(F.broadcast(pieces.select("a", "b").distinct()), ["a", "b"], "left_anti")
    # at most shards * FRACTION groups exceed the fraction in each dimension
    large = pd.concat([whole.where(over).withColumn("piece", F.lit(0)).select("a", "b", "piece", *_DIMENSIONS).toPandas(),
                       pieces.select("a", "b", "piece", *_DIMENSIONS).toPandas()], ignore_index=True)
    large = large.sort_values(["a", "b", "piece"], ignore_index=True)
    residual = np.ones((shards, 3))
    large["shard"] = pack(large[_DIMENSIONS].to_numpy(np.float64) / capacity, residual) if len(large) else np.empty(0, np.int32)
    placed = spark.createDataFrame(large[["a", "b", "piece", "shard"]], "a long, b long, piece int, shard int")
    light = whole.where(f"not ({over})")
    parts = parts_for(light.count(), PART_GROUPS)
    small = (light.groupBy(F.pmod("a", F.lit(parts)).alias("part")).applyInPandas(_place_part(residual, total), "a long, b long, shard int"))
    return placed, small, large


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, callable]:
    """(id, a, b, size, tokens, text_crc32, shard) of all rows, and a function that adds ``shard`` to rows of ``docs``.

    A column ``shard`` that the rows have already is replaced; other names never clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = text_key(text_col)
    digest = stored(docs.select(F.col(id_col).alias("id"), key["a"].alias("a"), key["b"].alias("b"),
                                (F.octet_length(text) + 8).cast("long").alias("size"), token_count(F.col(text_col)).alias("tokens"),
                                F.crc32(text.cast("binary")).alias("text_crc32")))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = stored(digest.groupBy("a", "b").agg(*sums))
    total = np.array([float(x or 0) for x in groups.agg(*[F.sum(d) for d in _DIMENSIONS]).first()])
    capacity = np.maximum(total / shards, 1e-12)
    share = F.greatest(*[F.col(d) / float(c) for d, c in zip(_DIMENSIONS, capacity, strict=True)])
    # groups larger than a shard: fewer than shards in each dimension
    split = F.broadcast(stored(groups.where(share > 1).select(F.col("a").alias("_split_a"), F.col("b").alias("_split_b"),
                                                              F.ceil(4 * share).cast("int").alias("_n_pieces"))))

    def pieced(rows: DataFrame, a, b, own_id) -> DataFrame:
        return (rows.join(split, (a == F.col("_split_a")) & (b == F.col("_split_b")), "left")
                .withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(own_id), F.col("_n_pieces")), F.lit(0)).cast("int")))

    in_pieces = pieced(digest, F.col("a"), F.col("b"), F.col("id")).where("_n_pieces is not null")
    pieces = stored(in_pieces.groupBy("a", "b", F.col("_piece").alias("piece")).agg(*sums))
    placed, small, _ = shard_groups(groups, pieces, shards, total)
    placed = F.broadcast(stored(placed.select(F.col("a").alias("_placed_a"), F.col("b").alias("_placed_b"),
                                              F.col("piece").alias("_placed_piece"), F.col("shard").alias("_large_shard"))))
    small, _ = small_enough(small.select(F.col("a").alias("_small_a"), F.col("b").alias("_small_b"), F.col("shard").alias("_small_shard")))

    def assign(rows: DataFrame, a, b, own_id) -> DataFrame:
        columns = rows.columns
        rows = pieced(rows, a, b, own_id).join(placed, (a == F.col("_placed_a")) & (b == F.col("_placed_b"))
                                               & (F.col("_piece") == F.col("_placed_piece")), "left")
        rows = rows.join(small, F.col("_large_shard").isNull() & (a == F.col("_small_a")) & (b == F.col("_small_b")), "left")
        return rows.select(*columns, F.coalesce("_large_shard", "_small_shard").alias("shard"))

    def onto(rows: DataFrame) -> DataFrame:
        apart, back = set_apart(rows, own_a=key["a"], own_b=key["b"], own_id=F.col(id_col))
        return back(assign(apart, F.col("own_a"), F.col("own_b"), F.col("own_id")), "shard")

    return assign(digest, F.col("a"), F.col("b"), F.col("id")), onto


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (id, a, b, shard, ...) with ``slot``: places without gaps from 0 inside each shard.

    Rows of a shard are numbered in buckets of bounded size; a bucket starts
    where the buckets before it end.
    """
    rows = stored(rows)
    buckets = parts_for(rows.count(), shards * SLOT_ROWS, least=8)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("id", "a"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = small_enough(counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("id", "b"))
    return (rows.withColumn("_place", place).join(starts, ["shard", "_bucket"])
            .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_bucket", "_place", "_start"))
