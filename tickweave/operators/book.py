"""Limit-order-book operators: sequencing, rebuild from updates, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.arrays import flat_from_pairs
from tickweave.series import Series, lay_out

BOOK_ROWS = 1 << 16     # updates that one task replays

def book_metrics(df: DataFrame, imbalance_mode: str = "standard", bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Mid, spread, queue imbalance and microprice from sorted level arrays.

    ``as_written`` divides by bid minus ask quantity (null when equal).
    """
    bid, ask = F.col(bids)[0], F.col(asks)[0]
    other = bid["qty"] - ask["qty"] if imbalance_mode == "as_written" else bid["qty"] + ask["qty"]
    out = df.withColumns({
        "best_bid": bid["price"], "best_ask": ask["price"], "mid_price": (bid["price"] + ask["price"]) / 2,
        "spread": ask["price"] - bid["price"], "imbalance": bid["qty"] / F.nullif(other, F.lit(0.0))})
    return out.withColumn("microprice", F.col("mid_price") + F.col("spread") * (F.col("imbalance") - 0.5))


def depth_row(bids: Column, asks: Column, n: int) -> Column:
    """Flat [bid prices, bid quantities, ask prices, ask quantities] of the first ``n`` levels."""
    def part(levels, field):
        return F.transform(F.slice(levels, 1, n), lambda x: x[field])
    return F.flatten(F.array(part(bids, "price"), part(bids, "qty"), part(asks, "price"), part(asks, "qty")))


def after_snapshot(diffs: DataFrame, snapshots: DataFrame, keys: Sequence[str], last: str, snapshot_last: str) -> DataFrame:
    """Updates newer than each key's snapshot."""
    return diffs.join(snapshots.select(*keys, snapshot_last), list(keys)).filter(F.col(last) > F.col(snapshot_last))


def sequence_gaps(series: Series, first: str, last: str, previous: str, chained: str = "previous") -> DataFrame:
    """Flag breaks in the update chain and number the unbroken segments.

    ``previous``: each update names its predecessor's last id. ``contiguous``:
    each update starts right after its predecessor's last id.
    """
    def build(df, w):
        before = F.lag(last).over(w)
        ok = F.col(previous) == before if chained == "previous" else F.col(first) == before + 1
        return df.withColumn("gap", F.when(F.col("_pos") == 0, 0).otherwise((~ok).cast("int")))
    flagged = series.windowed(build, before=1)
    base = series.derive(flagged)
    return base.running({"segment": ("sum", F.col("gap"))})


def level_lifetimes(updates: DataFrame, keys: Sequence[str], side: str, price: str, qty: str, seq: str) -> DataFrame:
    """Validity interval [seq, next seq) of every resting quantity of a price level.

    The key is one price level of one side, so frames are short; a level
    updated extremely often still runs in chunks.
    """
    level_keys = [*keys, side, price]
    series = lay_out(updates, level_keys, [seq])
    lives = series.windowed(lambda df, w: df.withColumn("until", F.lead(seq).over(w)), after=1)
    return lives.filter(F.col(qty) > 0)


def book_at(updates: DataFrame, keys: Sequence[str], side: str, price: str, qty: str, seq: str,
            at: int | None, depth: int) -> DataFrame:
    """Top-``depth`` levels per side as of an update id (``None``: after the last one).

    Only the latest quantity of each level matters, which is a combining
    aggregate; deleted levels (quantity 0) drop out.
    """
    seen = updates if at is None else updates.filter(F.col(seq) <= at)
    latest = seen.groupBy(*keys, side, price).agg(F.max_by(qty, seq).alias(qty)).filter(F.col(qty) > 0)
    # asks ascending, bids descending
    signed = latest.withColumn("_rank_by", F.when(F.col(side) == "ask", F.col(price)).otherwise(-F.col(price)))
    w = Window.partitionBy(*keys, side).orderBy("_rank_by")
    return signed.withColumn("level", F.row_number().over(w)).filter(F.col("level") <= depth).drop("_rank_by")


def _best_resting(resting: DataFrame, chunks: DataFrame, keys: Sequence[str], side: str, price: str, qty: str, last: int) -> DataFrame:
    """The best level of each side among those that rest through a chunk: from ``_from`` to ``_to``, both included.

    Each span is cut into at most two blocks a size, of 1, 2, 4 and more chunks; a chunk lies in one block of each size.
    """
    sizes, cuts = range(max(last, 1).bit_length() + 1), []
    for k in sizes:
        low, high = F.ceil(F.col("_from") / (1 << k)), F.floor((F.col("_to") + 1) / (1 << k))      # blocks of this size inside the span
        up, down = F.ceil(low / 2) * 2, F.floor(high / 2) * 2                                      # what blocks twice as large cover
        for at, on in ((low, (low < high) & (low < up)), (high - 1, (low < high) & (down < high) & (high - 1 >= up))):
            cuts.append(F.when(on, F.struct(F.lit(k).alias("_size"), at.cast("long").alias("_block"))))
    pieces = resting.select(*keys, side, price, "_q", F.inline(F.array_compact(F.array(*cuts))))
    best = lambda df, value, *by: df.groupBy(*by).agg(F.max_by(F.struct(price, value), F.when(F.col(side) == "ask", -F.col(price)).otherwise(F.col(price))).alias("_b"))
    blocks = best(pieces, "_q", *keys, side, "_size", "_block").select(*keys, side, "_size", "_block", "_b.*")
    inside = chunks.select(*keys, "_chunk", F.inline(F.array(*[
        F.struct(F.lit(k).alias("_size"), F.floor(F.col("_chunk") / (1 << k)).cast("long").alias("_block")) for k in sizes])))
    met = inside.join(blocks, [*keys, "_size", "_block"])
    return best(met, "_q", *keys, "_chunk", side).select(*keys, "_chunk", side, f"_b.{price}", F.col("_b._q").alias(qty))


def top_of_book(updates: DataFrame, keys: Sequence[str], side: str, price: str, qty: str, seq: str,
                chunk_rows: int | None = None) -> DataFrame:
    """Best bid and ask after every update id.

    Each chunk of the update sequence, at most ``BOOK_ROWS`` long, replays its
    own updates. It starts from the levels that it touches, as they stand at
    its border; of the levels that rest through it untouched only the best of
    each side can show, which a dyadic cover of their chunks finds. So no table
    holds more than a few rows for each update, however many levels rest.
    """
    import heapq

    import pandas as pd

    keys = list(keys)
    series = lay_out(updates.select(*keys, side, price, qty, seq), keys, [seq, side, price], chunk_rows)
    size = chunk_rows or min(series.chunk_rows, BOOK_ROWS)
    chunk = F.floor(F.col("_pos") / size).cast("long")
    rows = series.df.withColumn("_chunk", chunk)
    touched = rows.groupBy(*keys, side, price, "_chunk").agg(F.max_by(qty, "_pos").alias("_q"))
    w = Window.partitionBy(*keys, side, price).orderBy("_chunk")
    spans = touched.withColumn("_next", F.lead("_chunk").over(w)).filter("_q > 0")
    ends = rows.groupBy(*keys).agg(F.max("_chunk").alias("_end"))
    spans = series.attach(spans, ends)
    entering = spans.filter("_next IS NOT NULL").select(*keys, F.col("_next").alias("_chunk"), side, price, F.col("_q").alias(qty))
    resting = spans.select(*keys, side, price, "_q", (F.col("_chunk") + 1).alias("_from"),
                           F.coalesce(F.col("_next") - 1, F.col("_end")).alias("_to")).filter(
        F.col("_from") <= F.col("_to")).filter(F.col(price).isNotNull() & ~F.isnan(price))
    alive = entering.unionByName(_best_resting(resting, rows.select(*keys, "_chunk").distinct(), keys, side, price, qty, series.total // size))
    alive = alive.toDF(*alive.columns)  # fresh column identities: both sides of the cogroup share a source
    fields = "".join(f"`{c}` {t}, " for c, t in updates.select(*keys).dtypes)

    def replay(history: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        levels: dict[str, dict[float, float]] = {"bid": {}, "ask": {}}
        heaps: dict[str, list[float]] = {"bid": [], "ask": []}
        sign = {"bid": -1.0, "ask": 1.0}

        def put(side_, price_, qty_):
            if qty_ > 0:
                if price_ not in levels[side_]:
                    heapq.heappush(heaps[side_], sign[side_] * price_)
                levels[side_][price_] = qty_
            else:
                levels[side_].pop(price_, None)

        def best(side_):
            heap = heaps[side_]
            while heap and sign[side_] * heap[0] not in levels[side_]:
                heapq.heappop(heap)
            if not heap:
                return None, None
            top = sign[side_] * heap[0]
            return top, levels[side_][top]

        for side_, price_, qty_ in zip(start[side], start[price], start[qty]):
            put(side_, price_, qty_)
        history = history.sort_values("_pos", kind="stable")
        out = []
        for side_, price_, qty_, seq_, pos_ in zip(history[side], history[price], history[qty], history[seq], history["_pos"]):
            put(side_, price_, qty_)
            out.append((seq_, pos_, *best("bid"), *best("ask")))
        made = pd.DataFrame(out, columns=["seq", "_pos", "best_bid", "bid_qty", "best_ask", "ask_qty"])
        source = history if len(history) else start
        for c in keys:
            made[c] = source[c].iloc[0]
        return made[[*keys, "seq", "_pos", "best_bid", "bid_qty", "best_ask", "ask_qty"]]

    replayed = (rows.groupBy(*keys, "_chunk").cogroup(alive.groupBy(*keys, "_chunk")).applyInPandas(
        replay, f"{fields}seq long, _pos long, best_bid double, bid_qty double, best_ask double, ask_qty double"))
    # one row per update id: the state after its last level change
    return replayed.groupBy(*keys, "seq").agg(F.max_by(
        F.struct("best_bid", "bid_qty", "best_ask", "ask_qty"), "_pos").alias("_s")).select(*keys, "seq", "_s.*")
