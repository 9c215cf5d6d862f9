"""Exact quantiles by refining histograms: no task gathers the values of a key.

Counting passes narrow each wanted rank to a range of values: the range is cut
into ``BINS`` equal bins, counted with a map-side combine, and the bin that
holds the rank, from its smallest to its largest value, is the next range. Once
a range holds at most ``SMALL`` values, or one value however often, the rank is
read off it. Equal values never split, so heavy ties end a range at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.session import stored

BINS = 2048
SMALL = 4096


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with the bin that holds their rank as their new range."""
    ranges = targets.select(*keys, "lo", "hi").distinct()
    # a value belongs to few of the ranges of its key: they are bins of the last round, with one value each left out
    inside = rows.join(F.broadcast(ranges), keys) if keys else rows.crossJoin(F.broadcast(ranges))  # one row a range
    inside = inside.filter(F.col("v").between(F.col("lo"), F.col("hi")))
    # halves keep the width finite for ranges that span the number line
    share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    # ends too close for a width are told apart by being the upper one
    number = F.when(share.isNotNull(), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise((F.col("v") == F.col("hi")).cast("long"))
    found = inside.groupBy(*keys, "lo", number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
    before = Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)   # at most BINS rows
    bins = found.withColumn("under", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = targets.select(*keys, "rank", "lo", "under").withColumnRenamed("under", "base").join(bins, [*keys, "lo"])
    rank = F.col("rank") - F.col("base")
    return met.filter((rank >= F.col("under")) & (rank < F.col("under") + F.col("n"))).select(
        *keys, "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("base") + F.col("under")).alias("under"), "n")


def values_at_ranks(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value`` at each ``rank`` (from 0) of ``targets`` (keys, rank, lo, hi, under, n) among ``rows`` (keys, v)."""
    keys, done = list(keys), None
    targets = stored(targets)
    while True:
        ready = targets.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        done = ready if done is None else done.unionByName(ready)
        rest = targets.filter("lo < hi")
        if not rest.filter(F.col("n") > SMALL).limit(1).count():
            break
        targets = stored(_narrowed(rows, rest.filter(F.col("n") > SMALL), keys).unionByName(rest.filter(F.col("n") <= SMALL)))
    ranges = rest.select(*keys, "lo", "hi").distinct()
    inside = (rows.join(F.broadcast(ranges), keys) if keys else rows.crossJoin(F.broadcast(ranges))).filter(
        F.col("v").between(F.col("lo"), F.col("hi")))
    packed = inside.groupBy(*keys, "lo").agg(F.sort_array(F.collect_list("v")).alias("vs"))      # at most SMALL values
    read = rest.join(packed, [*keys, "lo"]).select(*keys, "rank", F.element_at("vs", (F.col("rank") - F.col("under") + 1).cast("int")).alias("value"))
    return done.unionByName(read)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """``name``: for each key the quantiles at ``shares``, between neighbours by linear interpolation, as an array.

    Nulls and NaN do not count; a key without values is left out. The ranges, a few rows a key, are broadcast, so keys
    may be many but not as many as rows.
    """
    keys = list(keys)
    rows = stored(df.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"))
    whole = stored(rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 0"))
    place = whole.select(*whole.columns, F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("at", "share")).withColumn(
        "exact", F.col("share") * (F.col("n") - 1))
    asked = place.select(*keys, "at", F.col("exact") - F.floor("exact"), F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.floor("exact").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("exact").alias("rank"))))).toDF(
        *keys, "at", "part", "side", "rank")
    targets = asked.select(*keys, "rank").distinct()
    targets = (targets.join(whole, keys) if keys else targets.crossJoin(whole)).withColumn("under", F.lit(0).cast("long"))
    got = asked.join(values_at_ranks(rows, targets.select(*keys, "rank", "lo", "hi", "under", "n"), keys), [*keys, "rank"])
    low, high = (F.max(F.when(F.col("side") == s, F.col("value"))) for s in (0, 1))
    made = got.groupBy(*keys, "at").agg(low.alias("low"), high.alias("high"), F.max("part").alias("part"))
    between = F.when(F.col("part") > 0, F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")).otherwise(F.col("low"))
    return made.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", between.alias("q")))), lambda e: e["q"]).alias(name))


def discrete_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """``name``: for each key the smallest value that at least ``share`` of its values do not exceed. Nulls do not count."""
    keys = list(keys)
    rows = stored(df.select(*keys, F.col(value).alias("v")).filter("v IS NOT NULL"))
    whole = stored(rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 0"))
    rank = F.greatest(F.ceil(F.col("n") * F.lit(float(share))) - 1, F.lit(0)).cast("long")
    targets = whole.select(*keys, rank.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("under"), "n")
    return values_at_ranks(rows, targets, keys).select(*keys, F.col("value").alias(name))
