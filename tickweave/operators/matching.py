"""Longest earlier matches in whole symbol sequences, and the entropy rate they give.

``match_lengths`` sorts all suffixes of a key by prefix doubling: the first
ranks order ``GRAM`` symbols, and each round orders pairs of ranks, so ranks of
twice the length follow from one sort and one join. Of the earlier suffixes the
two nearest in that order share the longest beginning with a suffix. They are
found inside blocks of positions by one pass over the ranks, and between blocks
by doubling: the right half of each pair of blocks looks its ranks up among the
left half's by a running last value. Lengths are then read off the stored ranks,
longest first. Rounds follow the logarithm of the longest repeat and of the
number of blocks; no task holds a key.

A null symbol is a symbol of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.series import Series, lay_out
from tickweave.session import stored

GRAM = 16                  # symbols that the first ranks order
BLOCK_ROWS = 1 << 20       # positions of a block
NO_SYMBOL = -(1 << 63)


def _ranked(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, bool]:
    """``_at``, ``_rank`` (rows of the key that sort before) of rows ordered by ``by``; and whether all ranks differ."""
    series = lay_out(rows, keys, [*by, "_at"])

    def first_of_equals(df, w):
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        return df.withColumn("_first", F.when((F.row_number().over(w) == 1) & (F.col("_pos") == 0) | ~same, F.col("_pos")))

    marked = series.derive(stored(series.windowed(first_of_equals, before=1).select(*keys, "_at", "_pos", "_first")))
    ranks = stored(marked.running({"_rank": ("last", F.col("_first"))}).select(*keys, "_at", "_rank"))
    leaders = marked.df.agg(F.count("_first")).first()[0]
    return ranks, leaders == series.total


def _looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], at: Column, names: dict[str, str]) -> DataFrame:
    """Columns ``names`` of ``table`` at position ``at``, null where there is none."""
    found = table.select(*keys, F.col("_at").alias("_there"), *[F.col(c).alias(n) for c, n in names.items()])
    return rows.withColumn("_there", at).join(found, [*keys, "_there"], "left").drop("_there")


def suffix_ranks(grams: DataFrame, keys: Sequence[str], longest: int) -> list[tuple[int, DataFrame]]:
    """Ranks of all positions by their next 16, 32, 64 ... symbols, until all differ or ``longest`` is reached."""
    ranks, distinct = _ranked(grams, keys, ["_gram"])
    levels = [(GRAM, ranks)]
    while not distinct and levels[-1][0] < longest:
        length, ranks = levels[-1]
        pairs = _looked_up(ranks, ranks, keys, F.col("_at") + length, {"_rank": "_next"})
        # a suffix that ends sorts before those that go on
        ranks, distinct = _ranked(pairs.withColumn("_next", F.coalesce("_next", F.lit(-1))), keys, ["_rank", "_next"])
        levels.append((2 * length, ranks))
    return levels


def _nearest_before(at: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller entry to the left of each entry; -1: none."""
    found, stack = np.full(len(at), -1), []
    for i, value in enumerate(at.tolist()):
        while stack and at[stack[-1]] > value:
            stack.pop()
        if stack:
            found[i] = stack[-1]
        stack.append(i)
    return found


def earlier_neighbours(ranks: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    """For every row the earlier positions nearest to it in rank: ``_below`` and ``_above`` as (rank, at), null if none.

    ``ranks`` has distinct ranks in each key; ``last`` is its largest position.
    """
    keys = list(keys)
    kinds = dict(ranks.dtypes)
    near = "struct<rank:bigint,at:bigint>"
    fields = "".join(f"`{c}` {kinds[c]}, " for c in keys)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", kind="stable").reset_index(drop=True)
        at, rank = pdf["_at"].to_numpy(), pdf["_rank"].to_numpy()
        below = _nearest_before(at)
        above = _nearest_before(at[::-1])[::-1]
        out = pdf[[*keys, "_at", "_rank"]].copy()
        for name, found in (("below", below), ("above", np.where(above >= 0, len(at) - 1 - above, -1))):
            out[f"_{name}_rank"] = pd.array(np.where(found < 0, 0, rank[found]), "Int64")
            out[f"_{name}_at"] = pd.array(np.where(found < 0, 0, at[found]), "Int64")
            out.loc[found < 0, [f"_{name}_rank", f"_{name}_at"]] = pd.NA
        return out

    names = ["_below_rank", "_below_at", "_above_rank", "_above_at"]
    width = BLOCK_ROWS
    rows = (ranks.withColumn("_block", F.floor(F.col("_at") / width)).groupBy(*keys, "_block")
            .applyInPandas(within, f"{fields}_at long, _rank long, " + ", ".join(f"{n} long" for n in names)))
    rows = stored(rows.select(*keys, "_at", "_rank", *[
        F.when(F.col(f"_{n}_rank").isNotNull(), F.struct(F.col(f"_{n}_rank").alias("rank"), F.col(f"_{n}_at").alias("at"))).cast(near)
        .alias(f"_{n}") for n in ("below", "above")]))
    while width <= last:
        pair = F.floor(F.col("_at") / (2 * width))
        in_left = F.floor(F.col("_at") / width) % 2 == 0
        mine = F.when(in_left, F.struct(F.col("_rank").alias("rank"), F.col("_at").alias("at")))
        for name, sign, pick in (("_below", 1, F.greatest), ("_above", -1, F.least)):
            series = lay_out(rows.withColumns({"_pair": pair, "_by": sign * F.col("_rank")}).drop("_pos"), [*keys, "_pair"], ["_by"])
            seen = series.running({"_seen": ("last", mine)})
            rows = stored(seen.withColumn(name, F.when(in_left, F.col(name)).otherwise(pick(F.col(name), F.col("_seen"))))
                          .select(*keys, "_at", "_rank", "_below", "_above"))
        width *= 2
    return rows


def common_lengths(pairs: DataFrame, levels: list[tuple[int, DataFrame]], grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_length``: the number of symbols that positions ``_at`` and ``_other`` have in common from there on."""
    rows = pairs.withColumn("_length", F.lit(0).cast("long"))
    # equal ranks of a level that runs past the end never come from different positions, so a step is never too long
    for length, ranks in reversed(levels):
        rows = _looked_up(rows, ranks, keys, F.col("_at") + F.col("_length"), {"_rank": "_one"})
        rows = _looked_up(rows, ranks, keys, F.col("_other") + F.col("_length"), {"_rank": "_two"})
        rows = stored(rows.withColumn("_length", F.col("_length") + F.when(F.col("_one") == F.col("_two"), length).otherwise(0))
                      .drop("_one", "_two"))
    rows = _looked_up(rows, grams, keys, F.col("_at") + F.col("_length"), {"_gram": "_one"})
    rows = _looked_up(rows, grams, keys, F.col("_other") + F.col("_length"), {"_gram": "_two"})
    differ = F.array_position(F.zip_with("_one", "_two", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    rest = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("_one"), F.size("_two")))
    return rows.withColumn("_length", F.col("_length") + F.when(F.col("_one").isNull() | F.col("_two").isNull(), 0).otherwise(rest)).drop(
        "_one", "_two")


def match_lengths(series: Series, symbol: Column) -> DataFrame:
    """For positions from 1 to half the key: ``_match``, the longest run from there that also starts earlier.

    Runs may overlap; a match is at most as long as the position it starts at.
    """
    keys = list(series.keys)
    plain = series.derive(series.df.select(*keys, "_pos", F.coalesce(symbol.cast("long"), F.lit(NO_SYMBOL)).alias("_symbol")))
    grams = stored(plain.windowed(lambda df, w: df.withColumn("_gram", F.collect_list("_symbol").over(w.rowsBetween(0, GRAM - 1))),
                                  after=GRAM - 1).select(*keys, F.col("_pos").alias("_at"), "_gram"))
    lengths = stored(series.lengths() if keys else series.df.agg(F.count(F.lit(1)).alias("_n")))
    longest = lengths.agg(F.max("_n")).first()[0] or 0
    levels = suffix_ranks(grams, keys, longest)
    early = series.attach(levels[-1][1], lengths).filter(F.col("_at") <= F.floor(F.col("_n") / 2)).drop("_n")
    near = earlier_neighbours(early, keys, longest // 2)
    pairs = near.select(*keys, "_at", F.explode(F.array("_below.at", "_above.at")).alias("_other")).filter("_other IS NOT NULL")
    matched = common_lengths(stored(pairs), levels, grams, keys)
    return matched.groupBy(*keys, "_at").agg(F.least(F.max("_length"), F.col("_at")).alias("_match")).withColumnRenamed("_at", "_pos")


def windowed_match_lengths(series: Series, symbol: Column, window: int) -> DataFrame:
    """``_match``: the longest run of up to ``window`` symbols that also starts in the ``window`` rows before.

    Only rows with a whole window before and after them are kept. A row's match depends on its neighbours alone.
    """
    keys = list(series.keys)
    fields = "".join(f"`{c}` {t}, " for c, t in series.df.select(*keys).dtypes)
    rows = series.with_columns({"_symbol": F.coalesce(symbol.cast("long"), F.lit(NO_SYMBOL))})

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        data, n = pdf["_symbol"].to_numpy(), len(pdf)
        best = np.zeros(n, np.int64)
        for lag in range(1, min(window, n - 1) + 1):
            differ = np.append(np.flatnonzero(data[lag:] != data[:-lag]), n - lag)
            run = differ[np.searchsorted(differ, np.arange(n - lag))] - np.arange(n - lag)
            np.maximum(best[lag:], np.minimum(run, window), out=best[lag:])
        out = pdf[[*keys, "_pos"]].copy()
        out["_match"], out["_whole"] = best, np.arange(n) <= n - window
        return out[(pdf["_own"] & out["_whole"]).to_numpy() & (pdf["_pos"] >= window).to_numpy()].drop(columns="_whole")

    return rows.per_chunk(measure, ["_symbol"], f"{fields}_pos long, _match long", before=window, after=window)


def sequence_entropy(series: Series, symbol: Column, window: int | None = None) -> DataFrame:
    """Entropy rate and redundancy of each key's whole sequence from its match lengths (a match counts one more).

    Without ``window`` a position looks back on all earlier ones, and positions
    from 1 to half the key count. With it, positions look back ``window`` rows
    (at most half of the longest key); keys without such a position are left out.
    """
    keys = list(series.keys)
    lengths = series.lengths() if keys else series.df.agg(F.count(F.lit(1)).alias("_n"))
    if window is None:
        reach, matches = F.col("_pos"), match_lengths(series, symbol)
    else:
        reach, matches = F.lit(window), windowed_match_lengths(series, symbol, window)
    rates = matches.groupBy(*keys).agg(F.avg(F.log2(reach + 1) / (F.col("_match") + 1)).alias("entropy"), F.count(F.lit(1)).alias("n_points"))
    joined = rates.join(lengths, keys) if keys else rates.crossJoin(F.broadcast(lengths))  # one row each
    return joined.withColumn("redundancy", 1 - F.col("entropy") / F.log2("_n")).select(*keys, "entropy", "redundancy", "n_points")
