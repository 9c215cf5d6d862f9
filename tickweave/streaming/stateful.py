"""Keyed streaming operators. Each key's state is a few values or one map of price levels.

Without a lateness a micro-batch of one key is sorted before it is folded; its
size is set by the source's rate limit, and the feed must be in order from
batch to batch. With one, rows wait in the state, in buckets of event time,
until the watermark has passed their bucket; a timer then folds the bucket in
order. Rows may so come in any order within the lateness, and a bucket, not a
batch, is what is held in memory.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.streaming.ingest import rocksdb

FOLD_ROWS = 1 << 16     # messages of the order book that are Python objects at a time


def time_bars(df: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, qty: str, width: str, late: str) -> DataFrame:
    """Tumbling bars labelled by their right edge; ``ts`` is a timestamp column."""
    at = F.struct(ts, tie)
    return (df.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum(qty).alias("volume"))
        .withColumn("bar_ts", F.unix_micros("window.end")).drop("window"))


class _Fold(StatefulProcessor):
    """Runs a scalar fold per key; state is one array of doubles."""

    def __init__(self, step: Callable, start: Sequence[float], order: Sequence[str]):
        self.step, self.start, self.order = step, list(start), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "s array<double>")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = list(self.state.get()[0]) if self.state.exists() else list(self.start)
        out, state = self.step(key, state, pdf)
        self.state.update((state,))
        yield out

    def close(self) -> None:
        pass


class _OrderedFold(StatefulProcessor):
    """``_Fold`` over rows put in event-time order: buckets of rows in the state, folded by timers of the watermark."""

    def __init__(self, step: Callable, start: Sequence[float], order: Sequence[str], columns: Sequence[str], bucket_us: int):
        self.step, self.start, self.order, self.columns, self.bucket_us = step, list(start), list(order), list(columns), bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "s array<double>")
        self.held = handle.getMapState("held", "bucket long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:                                  # one Arrow batch after the other
            pdf = pdf[self.columns].dropna(subset=[self.order[0]])
            for bucket, part in pdf.groupby(pdf[self.order[0]].astype("int64") // self.bucket_us):
                bucket, new = int(bucket), [part[c].tolist() for c in self.columns]
                if self.held.containsKey((bucket,)):
                    new = [a + b for a, b in zip(pickle.loads(bytes(self.held.getValue((bucket,))[0])), new)]
                else:
                    self.handle.registerTimer((bucket + 1) * self.bucket_us // 1000)
                self.held.updateValue((bucket,), (pickle.dumps(new),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        for bucket in sorted(k[0] for k in self.held.keys()):
            if (bucket + 1) * self.bucket_us // 1000 > now:
                break
            pdf = pd.DataFrame(dict(zip(self.columns, pickle.loads(bytes(self.held.getValue((bucket,))[0]))))).sort_values(self.order, kind="stable")
            out, state = self.step(key, list(self.state.get()[0]) if self.state.exists() else list(self.start), pdf)
            self.state.update((state,))
            self.held.removeKey((bucket,))
            yield out

    def close(self) -> None:
        pass


def _folded(df: DataFrame, key: str, step: Callable, start: Sequence[float], order: Sequence[str], columns: Sequence[str], schema: str,
            at: str | None, late: str | None, bucket_us: int) -> DataFrame:
    if late is None:
        return df.groupBy(key).transformWithStateInPandas(_Fold(step, start, order), outputStructType=schema, outputMode="Append", timeMode="None")
    # the beat that ends a source lies beyond the times that pandas knows; it moves the watermark and is no row
    kept = df.withWatermark(at, late).filter(F.col(at) < F.lit("2262-01-01").cast("timestamp")).select(at, key, *dict.fromkeys([*order, *columns]))
    return kept.groupBy(key).transformWithStateInPandas(
        _OrderedFold(step, start, order, list(dict.fromkeys([*order, *columns])), bucket_us),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")


def amount_bars(df: DataFrame, key: str, ts: str, tie: str, price: str, qty: str, amount: str, threshold: float,
                at: str | None = None, late: str | None = None, bucket_us: int = 60_000_000) -> DataFrame:
    """Bars closed when the accumulated ``amount`` reaches the threshold; the open bar lives in the state.

    With ``late`` (and the timestamp column ``at`` of ``ts``) rows may come that much out of order.
    """
    rocksdb(df.sparkSession)
    columns = [key, "bar", "open", "high", "low", "close", "volume", "amount", "bar_ts"]

    def step(name, state, pdf):
        acc, o, h, low, vol, bar = state
        made = []
        for t, p, q, v in zip(pdf[ts], pdf[price], pdf[qty], pdf[amount]):
            if o != o:
                o = h = low = p
            h, low, vol, acc = max(h, p), min(low, p), vol + q, acc + v
            if acc >= threshold:
                made.append((name[0], int(bar), o, h, low, p, vol, acc, int(t)))
                acc, o, h, low, vol, bar = 0.0, float("nan"), float("nan"), float("nan"), 0.0, bar + 1
        return pd.DataFrame(made, columns=columns), [acc, o, h, low, vol, bar]

    nan = float("nan")
    return _folded(df, key, step, [0.0, nan, nan, nan, 0.0, 0.0], [ts, tie], [price, qty, amount],
                   f"{key} string, bar long, open double, high double, low double, close double, volume double, amount double, bar_ts long",
                   at, late, bucket_us)


def cusum(df: DataFrame, key: str, ts: str, tie: str, price: str, threshold: float, at: str | None = None, late: str | None = None,
          bucket_us: int = 60_000_000) -> DataFrame:
    """Cumulative-sum events of raw moves, falling side first; ``late`` as in ``amount_bars``."""
    rocksdb(df.sparkSession)

    def step(name, state, pdf):
        up, down, last = state
        made = []
        for t, i, p in zip(pdf[ts], pdf[tie], pdf[price]):
            if last == last:
                up, down = max(0.0, up + p - last), min(0.0, down + p - last)
                if down < -threshold:
                    down = 0.0
                    made.append((name[0], int(t), int(i), -1))
                elif up > threshold:
                    up = 0.0
                    made.append((name[0], int(t), int(i), 1))
            last = p
        return pd.DataFrame(made, columns=[key, ts, tie, "side"]), [up, down, last]

    return _folded(df, key, step, [0.0, 0.0, float("nan")], [ts, tie], [price], f"{key} string, {ts} long, {tie} long, side int", at, late, bucket_us)


def _messages(rows):
    """A key's messages of a micro-batch by ``last_id``, snapshots first: lists of their columns and of the prices and quantities
    of their levels, bids before asks, for ``FOLD_ROWS`` messages at a time. Levels without a price are left out.
    """
    heads, levels = [], []
    for pdf in rows:                                      # one Arrow batch after the other; only flat arrays are kept
        if not len(pdf):
            continue
        counts = np.fromiter(map(len, pdf["levels"]), np.int64, len(pdf)) // 2
        n_bids = pdf["n_bids"].to_numpy()
        flat = np.concatenate(pdf["levels"].tolist()).astype(float).reshape(-1, 2)      # bids before asks
        known = flat[:, 0] == flat[:, 0]
        if not known.all():
            message = np.repeat(np.arange(len(pdf)), counts)
            bid = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(n_bids, counts)
            n_bids, counts = np.bincount(message[known & bid], minlength=len(pdf)), np.bincount(message[known], minlength=len(pdf))
            flat = flat[known]
        heads.append([pdf[c].to_numpy() for c in ("is_snapshot", "first_id", "last_id", "previous_id")] + [n_bids, counts - n_bids])
        levels.append((flat[:, 0], flat[:, 1]))
    if not heads:
        return
    heads = [np.concatenate(x) for x in zip(*heads)]
    levels = [np.concatenate(x) for x in zip(*levels)]
    order = np.lexsort((~heads[0].astype(bool), heads[2]))
    ends = np.cumsum(heads[4] + heads[5])
    for at in range(0, len(order), FOLD_ROWS):
        some = order[at:at + FOLD_ROWS]
        counts = heads[4][some] + heads[5][some]
        upto = np.cumsum(counts)
        places = np.repeat(ends[some] - upto, counts) + np.arange(upto[-1] if len(upto) else 0)
        yield *(h[some].tolist() for h in heads), *(x[places].tolist() for x in levels)


class _Book(StatefulProcessor):
    """Price levels per side in map states; sequence position in a value state.

    The first update after a snapshot must straddle its id; later ones must
    chain. A break drops the levels and waits for the next snapshot. Levels
    are written back only where they changed.
    """

    def __init__(self, chained: bool):
        self.chained = chained

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {s: handle.getMapState(s, "price double", "qty double") for s in ("bid", "ask")}
        self.position = handle.getValueState("position", "last long, snapshot long, synced boolean")

    def handleInputRows(self, key, rows, timerValues):
        last, snapshot, synced = self.position.get() if self.position.exists() else (-1, -1, False)
        kept = {s: {k[0]: v[0] for k, v in state.iterator()} for s, state in self.sides.items()}
        bids, asks = dict(kept["bid"]), dict(kept["ask"])
        low, high = [-p for p in bids], list(asks)         # heaps; the best bid is the least of the negated ones
        heapq.heapify(low)
        heapq.heapify(high)

        def best():
            while low and -low[0] not in bids:
                heapq.heappop(low)
            while high and high[0] not in asks:
                heapq.heappop(high)
            return -low[0] if low else None, high[0] if high else None

        made, shown = [], best()
        for is_snapshot, first_id, last_id, previous_id, n_bids, n_asks, prices, quantities in _messages(rows):
            at = 0
            for snap, first, here, previous, n_bid, n_ask in zip(is_snapshot, first_id, last_id, previous_id, n_bids, n_asks):
                start, middle = at, at + n_bid
                at = middle + n_ask
                if here != here:
                    continue                                # without an id it has no place
                if snap:
                    if synced and here <= last:
                        continue
                    for held in (bids, asks, low, high):
                        held.clear()
                    snapshot, last, synced = int(here), int(here), False
                else:
                    if snapshot < 0 or here <= snapshot:
                        continue  # stale, or nothing to build on yet
                    fits = (first <= snapshot + 1 <= here + 1) if not synced else (
                        previous == last if self.chained else first == last + 1)
                    if not fits:
                        made.append((key[0], int(here), "gap", None, None, None, None))
                        for held in (bids, asks, low, high):
                            held.clear()
                        snapshot, synced = -1, False
                        continue
                    last, synced = int(here), True
                for i in range(start, middle):
                    price = prices[i]
                    if quantities[i] > 0:
                        if price not in bids:
                            heapq.heappush(low, -price)
                        bids[price] = quantities[i]
                    else:
                        bids.pop(price, None)
                for i in range(middle, at):
                    price = prices[i]
                    if quantities[i] > 0:
                        if price not in asks:
                            heapq.heappush(high, price)
                        asks[price] = quantities[i]
                    else:
                        asks.pop(price, None)
                now = best()
                if now != shown:
                    shown = now
                    made.append((key[0], int(here), "book", now[0], bids.get(now[0]), now[1], asks.get(now[1])))
            if made:
                yield pd.DataFrame(made, columns=["symbol", "last_id", "kind", "best_bid", "bid_qty", "best_ask", "ask_qty"])
                made = []
        for side, levels in (("bid", bids), ("ask", asks)):
            for price, qty in levels.items():
                if kept[side].get(price) != qty:
                    self.sides[side].updateValue((price,), (qty,))
            for price in kept[side].keys() - levels.keys():
                self.sides[side].removeKey((price,))
        self.position.update((last, snapshot, synced))

    def close(self) -> None:
        pass


def rebuild_book(messages: DataFrame, chained: bool = True) -> DataFrame:
    """Best-price changes and gaps from snapshots and depth updates.

    ``messages``: symbol, is_snapshot, first_id, last_id, previous_id, bids,
    asks (arrays of price/qty). Runs on many symbols at once.
    """
    rocksdb(messages.sparkSession)
    none = F.array().cast("array<struct<price:double,qty:double>>")
    bids, asks = (F.coalesce(F.col(side).cast("array<struct<price:double,qty:double>>"), none) for side in ("bids", "asks"))
    flat = messages.select("symbol", "is_snapshot", "first_id", "last_id", "previous_id", F.size(bids).cast("long").alias("n_bids"),
                           F.flatten(F.transform(F.concat(bids, asks), lambda x: F.array(x["price"], x["qty"]))).alias("levels"))
    return flat.groupBy("symbol").transformWithStateInPandas(
        _Book(chained),
        outputStructType="symbol string, last_id long, kind string, best_bid double, bid_qty double, best_ask double, ask_qty double",
        outputMode="Append", timeMode="None")
