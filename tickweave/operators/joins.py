"""Point-in-time, interval and barrier joins.

As-of joins are a union of both sides, one ordered layout and a running last
value. Interval questions are answered with running sums, running maxima and
position look-ups, so no operator here compares all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.series import Series, lay_out
from tickweave.session import stored

FAN = 64                # children of a node in the tree of extremes
HOME_ROWS = 1 << 15     # of a chunk at most; with one event a row a chunk's own events are fewer than SEARCHES, so it is not copied
SEARCHES = 50_000       # events that one task looks for in a chunk
SCAN = 8                # rows that every event tries before blocks are asked
STRIDE = 64             # rows of a block, blocks of a larger block
PIECE = 1 << 13         # events that are searched at once


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str,
              take: Sequence[str], tie: str | None = None, forward: bool = False,
              allow_exact: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """Attach to each left row the nearest right row at or before (after) it.

    ``take`` lists right columns (their names must not clash with the left
    side); ``tie`` orders right rows that share a time.
    """
    sign = -1 if forward else 1
    tie_col = F.lit(0).cast("long") if tie is None else (F.col(tie) * sign).cast("long")
    near = right.select(*keys, (F.col(right_on) * sign).alias("_at"), F.lit(0).alias("_src"),
                        tie_col.alias("_tie"), F.struct(*take).alias("_near"))
    rank = 1 if allow_exact else -1
    stashed = left.withColumnRenamed("_pos", "_left_pos")  # the joint layout numbers rows anew
    probe = stashed.withColumns({"_at": F.col(left_on) * sign, "_src": F.lit(rank),
                              "_tie": F.lit(0).cast("long")})
    both = probe.unionByName(near, allowMissingColumns=True)
    series = lay_out(both, keys, ["_at", "_src", "_tie"], chunk_rows)
    joined = series.running({"_hit": ("last", F.col("_near"))})
    return (joined.filter(F.col("_src") == rank)
            .select(*[F.col("_left_pos" if c == "_pos" else c).alias(c) for c in left.columns],
                    *[F.col(f"_hit.{c}").alias(c) for c in take]))


def trades_with_book(trades: DataFrame, book: DataFrame, keys: Sequence[str], ts: str,
                     take: Sequence[str], tie: str | None = None, drop_open_tail: bool = False) -> DataFrame:
    """Latest book row at each trade. ``drop_open_tail`` blanks trades after the last book row."""
    joined = asof_join(trades, book, keys, ts, ts, take, tie)
    if not drop_open_tail:
        return joined
    last = book.groupBy(*keys).agg(F.max(ts).alias("_last_book"))
    kept = joined.join(last, list(keys), "left") if keys else joined.crossJoin(F.broadcast(last))
    open_tail = F.col("_last_book").isNull() | (F.col(ts) > F.col("_last_book"))
    return kept.withColumns({c: F.when(~open_tail, F.col(c)) for c in take}).drop("_last_book")


def vertical_barrier(bars: DataFrame, events: DataFrame, keys: Sequence[str], ts: str, delta_us: int,
                     take: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """First bar at or after ``ts + delta`` as ``t1``; events past the end are dropped."""
    shifted = events.withColumn("_due", F.col(ts) + F.lit(delta_us))
    ahead = bars.select(*keys, F.col(ts).alias("t1"), *take, *([tie] if tie and tie not in take else []))
    out = asof_join(shifted, ahead, keys, "_due", "t1", ["t1", *take], tie, forward=True)
    return out.filter(F.col("t1").isNotNull()).drop("_due")


def price_at(bars: DataFrame, points: DataFrame, keys: Sequence[str], ts: str, at: str, price: str,
             name: str, tie: str | None = None) -> DataFrame:
    """Next known price at or after ``at`` (back-fill look-up)."""
    known = bars.select(*keys, F.col(ts).alias("_known_at"), F.col(price).alias(name),
                        *([F.col(tie).alias("_known_tie")] if tie else []))
    return asof_join(points, known, keys, at, "_known_at", [name], "_known_tie" if tie else None, forward=True)


def lookback_return(bars: DataFrame, keys: Sequence[str], ts: str, price: str, delta_us: int,
                    variant: str = "at_or_after", tie: str | None = None,
                    chunk_rows: int | None = None) -> DataFrame:
    """Return against the price ``delta`` ago.

    ``at_or_after`` uses the first row at or after ``t - delta`` and keeps one
    row per distinct earlier row; ``before`` uses the last row strictly before.
    Rows whose earlier row is the key's first row (resp. missing) are dropped.
    """
    series = lay_out(bars, keys, [ts, *([tie] if tie else [])], chunk_rows)
    numbered = series.df
    ref = numbered.select(*keys, F.col(ts).alias("_ref_ts"), F.col("_pos").alias("ref_pos"),
                          F.col(price).alias("ref_price"))
    probe = numbered.withColumn("_due", F.col(ts) - F.lit(delta_us))
    if variant == "before":
        out = asof_join(probe, ref, keys, "_due", "_ref_ts", ["ref_pos", "ref_price"], "ref_pos",
                        allow_exact=False)
        out = out.filter(F.col("ref_pos").isNotNull())
    else:
        out = asof_join(probe, ref, keys, "_due", "_ref_ts", ["ref_pos", "ref_price"], "ref_pos", forward=True)
        out = out.filter(F.col("ref_pos") > 0)
        firsts = out.groupBy(*keys, "ref_pos").agg(F.min("_pos").alias("_pos"))
        out = out.join(firsts, [*keys, "ref_pos", "_pos"], "left_semi")
    return out.withColumn("ret", ratio(F.col(price), F.col("ref_price")) - 1).drop("_due")


def overlap_anti_join(train: DataFrame, test: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Drop train intervals that touch any test interval (both closed).

    A train interval [a, b] is touched exactly when the largest end among the
    test intervals starting at or before b is at least a: one running maximum.
    """
    marks = test.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_src"), F.col(end).alias("_reach"))
    probe = train.withColumns({"_at": F.col(end), "_src": F.lit(1)})
    both = probe.unionByName(marks, allowMissingColumns=True)
    series = lay_out(both, keys, ["_at", "_src"])
    seen = series.running({"_far": ("max", F.col("_reach"))})
    return (seen.filter((F.col("_src") == 1) & (F.col("_far").isNull() | (F.col("_far") < F.col(start))))
            .select(*train.columns))


def concurrency(series: Series, spans: DataFrame, start: str = "p0", end: str = "p1") -> DataFrame:
    """Number of events covering each bar; ``spans`` holds closed position intervals.

    A sweep: +1 where a span starts, -1 one past its end, running sum.
    """
    keys = list(series.keys)
    ups = spans.select(*keys, F.col(start).alias("_pos"), F.lit(1).alias("_d"))
    downs = spans.select(*keys, (F.col(end) + 1).alias("_pos"), F.lit(-1).alias("_d"))
    steps = ups.unionByName(downs).groupBy(*keys, "_pos").agg(F.sum("_d").alias("_d"))
    stepped = series.derive(series.df.join(steps, [*keys, "_pos"], "left"))
    return stepped.running({"n_active": ("sum", F.coalesce(F.col("_d"), F.lit(0)))}).drop("_d")


def indicator_pairs(spans: DataFrame, keys: Sequence[str], event: str, start: str = "p0", end: str = "p1",
                    block: int | None = None) -> DataFrame:
    """Long (bar position, event) pairs of the 0/1 indicator matrix.

    With ``block`` the matrix is cut into blocks of so many bars and the ones of an event in a block are one run: a row
    for each event and block it meets, ``bar_block``, with the first and last bar there, ``bar_lo`` and ``bar_hi``.
    """
    if block is None:
        return spans.select(*keys, event, F.explode(F.sequence(F.col(start), F.col(end))).alias("bar_pos"))
    low, high = F.least(start, end), F.greatest(start, end)
    met = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys, event, low.alias("_lo"), high.alias("_hi"), F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("bar_block"))
    return met.select(*keys, event, "bar_block", F.greatest(F.col("_lo"), F.col("bar_block") * block).alias("bar_lo"),
                      F.least(F.col("_hi"), (F.col("bar_block") + 1) * block - 1).alias("bar_hi"))


def active_signals(signals: DataFrame, keys: Sequence[str], start: str, end: str, signal: str) -> DataFrame:
    """Mean of signals with ``start <= t < end`` (or open) at every start and end time."""
    opens = signals.select(*keys, F.col(start).alias("t"), F.col(signal).alias("_s"), F.lit(1).alias("_c"))
    closes = (signals.filter(F.col(end).isNotNull())
              .select(*keys, F.col(end).alias("t"), (-F.col(signal)).alias("_s"), F.lit(-1).alias("_c")))
    steps = opens.unionByName(closes).groupBy(*keys, "t").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    run = lay_out(steps, keys, ["t"]).running({"_ss": ("sum", F.col("_s")), "n_active": ("sum", F.col("_c"))})
    return run.select(*keys, "t", "n_active",
                      F.when(F.col("n_active") > 0, F.col("_ss") / F.col("n_active")).otherwise(0.0).alias("signal"))


def align_by_position(left: Series, right: Series, take: Sequence[str]) -> DataFrame:
    """n-th row with n-th row, trimmed to the shorter side."""
    return left.df.join(right.df.select(*right.keys, "_pos", *take), [*left.keys, "_pos"])


# -- barriers ----------------------------------------------------------------

def _kids(extremes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows (node, lo, hi) gathered by parent: ``parent`` and the ``kids`` in order."""
    return extremes.groupBy(*keys, F.floor(F.col(name) / FAN).alias("parent")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(name, "lo", "hi"))), lambda k: k.dropFields(name)).alias("kids"))


def first_touch(series: Series, events: DataFrame, ids: Sequence[str], price: str, ts: str,
                p0: str = "p0", p1: str = "p1", entry: str = "entry", side: str = "side",
                lower: str = "lower", upper: str = "upper") -> DataFrame:
    """First time the sided path return leaves (-lower, +upper) inside [p0, p1], and the price there.

    ``p1`` null means "to the end of the series"; a null width, like an entry
    of zero, switches its barrier off. Each barrier is looked for in the event's home chunk. Where it
    is not met, a tree of the chunks' lowest and highest prices, ``FAN``
    children to a node and one table a level, leads to the only later chunk
    that can hold the touch: up from the home chunk until a later sibling
    crosses, then down to the first crossing child, one join a level. A chunk
    that many events lead to is searched by several tasks.
    """
    keys, size = list(series.keys), min(series.chunk_rows, HOME_ROWS)
    bars = series.df.select(*keys, "_pos", F.col(ts).alias("_ts"), F.col(price).cast("double").alias("_price"),
                            F.floor(F.col("_pos") / size).cast("long").alias("_chunk"))
    extremes = stored(bars.groupBy(*keys, "_chunk").agg(F.min("_price").alias("lo"), F.max("_price").alias("hi")))
    ends = extremes.groupBy(*keys).agg(F.max("_chunk").alias("_end")) if keys else extremes.agg(F.max("_chunk").alias("_end"))
    longest = ends.agg(F.max("_end")).first()[0] or 0
    width = lambda name: F.when(F.col(entry) != 0, F.col(name).cast("double"))       # noqa: E731  no return on nothing
    plain = events.select(*keys, *ids, F.col(p0).alias("_p0"), F.col(p1).alias("_p1"), F.col(entry).alias("_entry"),
                          F.coalesce(F.col(side).cast("double"), F.lit(float("nan"))).alias("_side"),
                          width(lower).alias("_lower"), width(upper).alias("_upper"))
    last = F.least(F.coalesce(F.floor(F.col("_p1") / size), F.col("_end")), F.col("_end")).cast("long")
    wanted = series.attach(plain, ends, "left").withColumns({"_chunk": F.floor(F.col("_p0") / size).cast("long"), "_last": last}).drop("_end")
    home = stored(_searched(wanted, bars, [*keys, *ids], keys))
    if not longest:
        return _by_event(home, [*keys, *ids])
    levels, nodes = [], extremes.withColumnRenamed("_chunk", "_node")
    while True:
        levels.append(stored(_kids(nodes, keys, "_node")))
        if longest < FAN ** len(levels):
            break
        nodes = levels[-1].select(*keys, F.col("parent").alias("_node"), F.array_min(F.transform("kids", lambda k: k["lo"])).alias("lo"),
                                  F.array_max(F.transform("kids", lambda k: k["hi"])).alias("hi"))

    def crossing(kid: Column) -> Column:
        best = F.when((F.col("_side") >= 0) == F.col("_up"), kid["hi"]).otherwise(kid["lo"])
        move = (ratio(best, F.col("_entry")) - 1) * F.col("_side")
        return F.when(F.col("_up"), move > F.col("_width")).otherwise(move < -F.col("_width"))

    def first_kid(rows: DataFrame, level: int, parent: Column, after: Column) -> DataFrame:
        """``_hit``: the first crossing node of the level below, later than ``after`` and not beyond the last; else null."""
        table = levels[level].withColumnRenamed("parent", "_parent")
        base, stop = F.col("_parent") * FAN, F.floor(F.col("_last") / FAN ** level)
        marks = F.transform("kids", lambda k, i: (base + i > after) & (base + i <= stop) & F.coalesce(crossing(k), F.lit(False)))
        at = F.array_position(marks, True)
        return rows.withColumn("_parent", parent).join(table, [*keys, "_parent"], "left").withColumn(
            "_hit", F.when(at > 0, base + at - 1)).drop("kids", "_parent")

    sides = [F.struct(F.lit(up).alias("_up"), F.col(f"_{n}").alias("_width"), F.col(f"t_{n}").alias("_t"))
             for up, n in ((False, "lower"), (True, "upper"))]
    open_rows = (home.filter("_last > _chunk").select(*[c for c in wanted.columns if c not in ("_lower", "_upper")], F.inline(F.array(*sides)))
                 .filter("_t IS NULL AND _width IS NOT NULL").drop("_t"))
    rows = open_rows.withColumns({"_level": F.lit(None).cast("int"), "_node": F.lit(None).cast("long")})
    for level in range(len(levels)):
        here = F.floor(F.col("_chunk") / FAN ** level)
        rows = first_kid(rows, level, F.when(F.col("_node").isNull(), F.floor(here / FAN)), here)
        new = F.col("_node").isNull() & F.col("_hit").isNotNull()
        rows = rows.withColumns({"_level": F.when(new, level).otherwise(F.col("_level")),
                                 "_node": F.when(new, F.col("_hit")).otherwise(F.col("_node"))}).drop("_hit")
    rows = stored(rows.filter("_node IS NOT NULL"))
    for level in range(len(levels) - 2, -1, -1):
        below = F.col("_level") == level + 1
        rows = first_kid(rows, level, F.when(below, F.col("_node")), F.lit(-1))
        rows = rows.filter(~below | F.col("_hit").isNotNull()).withColumns({
            "_level": F.when(below, level).otherwise(F.col("_level")), "_node": F.when(below, F.col("_hit")).otherwise(F.col("_node"))}).drop("_hit")
    found = rows.withColumns({"_chunk": F.col("_node"), "_lower": F.when(~F.col("_up"), F.col("_width")), "_upper": F.when(F.col("_up"), F.col("_width"))})
    later = _searched(found.select(*wanted.columns), bars, [*keys, *ids], keys)
    return _by_event(home.unionByName(later), [*keys, *ids])


def _first_hits(prices: np.ndarray, first: np.ndarray, stop: np.ndarray, entry: np.ndarray, side: np.ndarray,
                width: np.ndarray, up: bool) -> np.ndarray:
    """Index of the first price in [first, stop) at which each event's return leaves its barrier; -1: none.

    A few prices are tried one by one; then blocks of ``STRIDE`` prices, blocks of blocks and so on are asked whether
    their lowest or highest price crosses. A return rises or falls with the price, so one of the two crosses whenever any does.
    """
    levels = [(prices, prices)]
    while len(levels[-1][0]) > STRIDE:
        cuts = np.arange(0, len(levels[-1][0]), STRIDE)
        levels.append((np.fmin.reduceat(levels[-1][0], cuts), np.fmax.reduceat(levels[-1][1], cuts)))

    def crosses(price: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = rows if price.ndim == 1 else rows[:, None]
        move = (price / entry[at] - 1) * side[at]
        return move > width[at] if up else move < -width[at]

    def first_of(level: int, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The first crossing node from ``node`` to the end of its block and not beyond the last; -1: none."""
        low, high = levels[level]
        last = np.minimum((node // STRIDE + 1) * STRIDE - 1, (stop[rows] - 1) // STRIDE ** level)
        nodes = node[:, None] + np.arange(min(STRIDE, len(low)))
        at = np.minimum(nodes, len(low) - 1)
        hit = crosses(low[at], rows)
        if level:
            hit |= crosses(high[at], rows)
        hit &= nodes <= last[:, None]
        return np.where(hit.any(axis=1), node + hit.argmax(axis=1), -1)

    found = np.full(len(first), -1)
    with np.errstate(all="ignore"):
        rows = np.flatnonzero(~np.isnan(width) & (first < stop))
        at = first[rows]
        for _ in range(SCAN):
            hit = crosses(prices[at], rows)
            found[rows[hit]] = at[hit]
            go = ~hit & (at + 1 < stop[rows])
            rows, at = rows[go], at[go] + 1
        for begin in range(0, len(rows), PIECE):
            some, node = rows[begin:begin + PIECE], at[begin:begin + PIECE]
            for level in range(len(levels)):
                if not len(some):
                    break
                hit = first_of(level, some, node)
                down, below = some[hit >= 0], hit[hit >= 0]
                for lower in range(level - 1, -1, -1):
                    below = first_of(lower, down, below * STRIDE)       # -1 where the block crosses only past the stop
                    down, below = down[below >= 0], below[below >= 0]
                found[down] = below
                node = node // STRIDE + 1
                go = (hit < 0) & (node <= (stop[some] - 1) // STRIDE ** (level + 1))
                some, node = some[go], node[go]
    return found


def _searched(wanted: DataFrame, bars: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``wanted`` with time and price of the first crossing of either barrier inside its chunk; null: none."""
    wanted = stored(wanted)
    counts = wanted.groupBy(*keys, "_chunk").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).alias("_groups"))
    dealt = wanted.join(counts, [*keys, "_chunk"]).withColumn("_group", F.pmod(F.xxhash64(*names), F.col("_groups"))).drop("_groups")
    copies = bars.join(counts, [*keys, "_chunk"]).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)))

    def search(asked: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        path = path.sort_values("_pos", kind="stable")
        pos, prices, times = (path[c].to_numpy() for c in ("_pos", "_price", "_ts"))
        out = asked.drop(columns="_group")
        number = lambda c: asked[c].to_numpy(dtype=float, na_value=np.nan)       # noqa: E731
        if len(pos) and len(asked):
            start, close = number("_p0") - pos[0], number("_p1") - pos[0] + 1
            first = np.maximum(start, 0).astype(np.int64)
            stop = np.where(np.isnan(close), len(pos), np.minimum(close, len(pos))).astype(np.int64)
        for name, up in (("lower", False), ("upper", True)):
            if len(pos) and len(asked):
                found = _first_hits(prices.astype(float), first, stop, number("_entry"), number("_side"), number(f"_{name}"), up)
            else:
                found = np.full(len(asked), -1)
            none = pd.Series(found < 0, index=out.index)
            at = np.maximum(found, 0)
            out[f"t_{name}"] = pd.Series(times[at] if len(pos) else 0, index=out.index).astype("Int64").mask(none)
            out[f"price_{name}"] = pd.Series(prices[at] if len(pos) else 0.0, index=out.index).astype("Float64").mask(none)
        return out[columns]

    schema = dealt.drop("_group").withColumns({f"{kind}_{n}": F.lit(None).cast(t) for n in ("lower", "upper")
                                               for kind, t in (("t", "long"), ("price", "double"))}).schema
    columns = [f.name for f in schema]
    return dealt.groupBy(*keys, "_chunk", "_group").cogroup(
        copies.select(*keys, "_chunk", "_group", "_pos", "_ts", "_price").groupBy(*keys, "_chunk", "_group")).applyInPandas(search, schema)


def _by_event(touches: DataFrame, names: Sequence[str]) -> DataFrame:
    return touches.groupBy(*names).agg(*[F.max(c).alias(c) for c in ("t_lower", "t_upper", "price_lower", "price_upper")])


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key and time; Spark picks the strategy from sizes."""
    return left.join(right, list(on), how)
