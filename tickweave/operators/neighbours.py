"""Exact nearest neighbours by blocks around pivots.

Each distinct vector belongs to its nearest pivot; the vectors of a pivot,
ordered by their distance to it, are cut into blocks, so a block is a narrow
ring. A query first searches the block it would lie in, which bounds the
distance of its k-th neighbour. By the triangle inequality no vector of a ring
is nearer than the query's distance to the pivot misses the ring by; so after
the bound only the rings that it reaches are searched. Pivots (a few hundred
vectors) only steer the pruning; results are exact, ties go to the smaller key.

Equal vectors count once in the search: of each distinct vector the ``k + 1``
smallest keys can be anybody's neighbours, so copies, however many, make no
large block. Vectors that are null, of another length or not finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.series import lay_out
from tickweave.session import stored

PIVOTS = 128               # at most, and one for PIVOT_ROWS distinct vectors
PIVOT_ROWS = 512
BLOCK_ROWS = 2048
MOST_BLOCKS = 200_000      # rings known to every task; larger inputs get larger blocks
QUERY_ROWS = 1024          # queries that meet a block in one task
PAIRS = 1 << 16            # pairs whose differences are held at once
VISITS = 1 << 13           # visits that are written at once, each with its query's vector


def _first_keys(rows: DataFrame, k: int) -> DataFrame:
    """``v`` and its ``members``: the k + 1 smallest (key, mark) of each distinct vector, gathered in three steps."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.sort_values("key")
            yield pdf.groupby(pdf["v"].map(lambda v: np.asarray(v, float).tobytes()), sort=False).head(k + 1)

    def gathered(df: DataFrame, *by: str) -> DataFrame:
        held = F.sort_array(F.flatten(F.collect_list("members")))
        return df.groupBy("v", *by).agg(F.slice(held, 1, k + 1).alias("members"))

    part = rows.mapInPandas(some, rows.schema).select("v", F.array(F.struct("key", "mark")).alias("members"),
                                                      (F.spark_partition_id() % 256).alias("part"))
    return gathered(gathered(part, "part"))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, by differences: equal vectors are exactly 0 apart."""
    return np.stack([((b - x) ** 2).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))


def _within(asked: np.ndarray, bounds: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of ``asked`` and ``have`` no further apart than the bound, and their distances.

    A matrix product finds the pairs that may be, within its rounding; those few are measured by differences.
    """
    sizes, found = (have**2).sum(axis=1), []
    step = max(1, PAIRS // len(have))
    for first in range(0, len(asked), step):
        some, bound = asked[first:first + step], bounds[first:first + step]
        own = (some**2).sum(axis=1)[:, None]
        rough = own + sizes - 2 * some @ have.T
        row, at = np.nonzero(~(rough > bound[:, None] ** 2 * (1 + 1e-9) + 1e-9 * (own + sizes)))
        distance = np.sqrt(((have[at] - some[row]) ** 2).sum(axis=1))
        near = distance <= bound[row]
        found.append((row[near] + first, at[near], distance[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(at: np.ndarray, distance: np.ndarray, members: list, k: int) -> list:
    """The k + 1 first (distance, key, mark) among the members of a few vectors."""
    order = np.argsort(distance, kind="stable")
    limit = distance[order[min(k, len(order) - 1)]]
    found = [(float(d), *m) for i, d in zip(at.tolist(), distance.tolist()) if d <= limit for m in members[i]]
    return sorted(found, key=lambda f: f[:2])[:k + 1]


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, mark: str) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest others among ``rows`` by Euclidean distance.

    Returns ``key``, ``rank`` (from 1), ``neighbour``, ``neighbour_mark`` (its column ``mark``) and ``distance``. Keys
    are distinct; a row is no neighbour of itself. A query among ``rows`` gets fewer than ``k`` if there are no more.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    plain = lambda df, *more: df.select(F.col(key).alias("key"), *more, F.col(vector).cast("array<double>").alias("v")).filter(
        "v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    base = stored(_first_keys(plain(rows, F.col(mark).alias("mark")), k))
    shape = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    near = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("key", rows.schema[key].dataType),
                         T.StructField("mark", rows.schema[mark].dataType)])
    out_schema = f"`{key}` {kinds[key]}, rank int, neighbour {kinds[key]}, neighbour_mark {kinds[mark]}, distance double"
    if shape is None:
        return spark.createDataFrame([], out_schema)
    width, total = shape
    base, asked = base.filter(F.size("v") == width), plain(queries).filter(F.size("v") == width)
    pivots = np.array([r["v"] for r in base.orderBy(F.xxhash64("v")).limit(
        min(PIVOTS, max(4, total // PIVOT_ROWS))).select("v").collect()])      # at most PIVOTS

    @F.pandas_udf("struct<pivot:int,away:double>")
    def home(batch: pd.Series) -> pd.DataFrame:
        d = _squared(np.stack(batch.to_list()).astype(float), pivots)
        at = d.argmin(axis=1)
        return pd.DataFrame({"pivot": at.astype(np.int32), "away": np.sqrt(d[np.arange(len(at)), at])})

    placed = lay_out(base.withColumn("h", home("v")).select("h.pivot", "h.away", "v", "members"), ["pivot"], ["away", "v"])
    size = max(BLOCK_ROWS, -(-placed.total // MOST_BLOCKS), k + 2)
    blocks = stored(placed.df.withColumn("block", F.floor(F.col("_pos") / size)).select("pivot", "block", "away", "v", "members"))
    # one row a block, at most MOST_BLOCKS and one for each pivot
    rings = blocks.groupBy("pivot", "block").agg(F.min("away").alias("low"), F.max("away").alias("high")).toPandas().sort_values(["pivot", "block"])
    ring_of = {int(p): (g["block"].to_numpy(), g["low"].to_numpy(), g["high"].to_numpy()) for p, g in rings.groupby("pivot")}
    vectors = stored(asked.select("v").distinct())

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks that each query must search: its own one, or with a bound all others within reach."""
        for pdf in frames:
            if not len(pdf):
                continue
            away = np.sqrt(_squared(np.stack(pdf["v"].to_list()).astype(float), pivots))

            def written(found: list) -> pd.DataFrame:
                row, pivot, block = (np.array(x, int) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
                bound = pdf["bound"].to_numpy()[row] if "bound" in pdf else np.full(len(row), np.inf)
                return pd.DataFrame({"pivot": pivot.astype(np.int32), "block": block, "q": pdf["v"].to_numpy()[row], "bound": bound})

            found = []
            for row, d in enumerate(away):
                while len(found) >= VISITS:
                    yield written(found[:VISITS])
                    found = found[VISITS:]
                own = min(ring_of, key=d.__getitem__)
                at = min(int(np.searchsorted(ring_of[own][2], d[own])), len(ring_of[own][0]) - 1)
                if "bound" not in pdf:
                    found.append((row, own, int(ring_of[own][0][at])))
                    continue
                reach = pdf["bound"].iloc[row] * (1 + 1e-9) + 1e-12          # rounding must not hide a tie
                for pivot, (block, low, high) in ring_of.items():
                    for i in range(np.searchsorted(high, d[pivot] - reach), np.searchsorted(low, d[pivot] + reach, side="right")):
                        if (pivot, i) != (own, at):
                            found.append((row, pivot, int(block[i])))
            for first in range(0, max(len(found), 1), VISITS):      # one row may visit all rings
                yield written(found[first:first + VISITS])

    def searched(plan: DataFrame) -> DataFrame:
        """The best of each visited block for each query vector; a block is copied to each group of its queries."""
        counts = plan.groupBy("pivot", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("groups"))
        dealt = plan.join(counts, ["pivot", "block"]).withColumn("group", F.pmod(F.xxhash64("q"), F.col("groups"))).drop("groups")
        copies = blocks.join(counts, ["pivot", "block"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

        def search(ask: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(ask) or not len(held):
                return pd.DataFrame(columns=["q", "found"])
            have = np.stack(held["v"].to_list()).astype(float)
            members = [[(m["key"], m["mark"]) for m in ms] for ms in held["members"]]
            row, at, distance = _within(np.stack(ask["q"].to_list()).astype(float), ask["bound"].to_numpy(), have)
            asking, found = [], []
            cuts = np.searchsorted(row, np.arange(len(ask) + 1))
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):      # a block without a vector in reach adds nothing
                if lo < hi:
                    asking.append(ask["q"].iloc[i])
                    found.append([{"distance": d, "key": a, "mark": b} for d, a, b in _best(at[lo:hi], distance[lo:hi], members, k)])
            return pd.DataFrame({"q": pd.Series(asking, dtype=object), "found": pd.Series(found, dtype=object)})

        schema = T.StructType([T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("found", T.ArrayType(near))])
        return dealt.select("pivot", "block", "group", "q", "bound").groupBy("pivot", "block", "group").cogroup(
            copies.select("pivot", "block", "group", "v", "members").groupBy("pivot", "block", "group")).applyInPandas(search, schema)

    visit_schema = "pivot int, block long, q array<double>, bound double"
    first = stored(searched(stored(vectors.mapInPandas(visits, visit_schema))))
    bound = F.when(F.size("found") > k, F.element_at("found", -1)["distance"]).otherwise(F.lit(float("inf")))
    more = stored(first.select(F.col("q").alias("v"), bound.alias("bound")).mapInPandas(visits, visit_schema))
    merged = first.unionByName(searched(more)).groupBy("q").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["key"] != F.col("key")), 1, k)
    listed = asked.join(merged, F.col("v") == F.col("q")).select("key", F.posexplode(others).alias("at", "f"))
    return listed.select(F.col("key").alias(key), (F.col("at") + 1).alias("rank"), F.col("f.key").alias("neighbour"),
                         F.col("f.mark").alias("neighbour_mark"), F.col("f.distance").alias("distance"))
