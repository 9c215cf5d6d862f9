"""Removal of long repeated strings with run-length compressed suffix indexes.

A byte goes when it lies in a string of ``length`` bytes that also starts
anywhere else in the corpus. Texts are UTF-8 bytes (null: empty); strings
never cross texts and are judged on the input.

Sharding: every window of ``length`` bytes has an anchor, the leftmost place
inside it whose ``GRAM``-byte hash is smallest. Equal windows have equal
anchors, so windows need to be compared only with windows of the same anchor.
Neighbouring windows with the same anchor make one context (the bytes from the
first window's start to the last one's end); each window lies in exactly one
context, and equal contexts are kept once with their number, as runs of equal
suffixes would be. Anchors that occur once are dismissed, a context that
occurs several times repeats as a whole.

Index: the contexts of a shard are joined, in pieces of whole anchors, their suffixes sorted, and the
Burrows-Wheeler transform is stored by runs with the text place sampled at both ends
of each run and the length that the suffix there shares with its neighbour
beyond the run. Inside a run that length shrinks by one with each step through
the text, so streaming a context past the samples gives the matching
statistic of every place (the longest match starting there with any other
suffix); matches of at least ``length`` bytes are marked.

Anchors with very many different contexts (the edge of a passage that a large
part of all texts share) would make one shard too large. Their contexts are
cut into single windows, each its own anchor, and counted like all others:
same result, no large group.

Texts shorter than ``length`` keep everything; repeated rows repeat each
other's strings; ties play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import BROADCAST_ROWS, mix, parts_for, small_enough, stored, text_key

LENGTH = 400
GRAM = 32
CHUNK = 1 << 20                 # windows handled at a time in very long texts
SHARD_BYTES = 2_000_000         # bytes of contexts in one index
PIECE_BYTES = 500_000           # bytes of contexts that are sorted together; an anchor with more makes a piece of its own
ROWS_HELD = 30_000              # rows that a task gathers before it hands them on
BODIES_HELD = 4_000             # and of those that carry a context's bytes
CROWDED = 2_000                 # contexts of one anchor above which they are cut into single windows
_BYTE_CODES = np.random.default_rng(37).integers(1, 2**63, size=256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each place on."""
    h, width = _BYTE_CODES[data], 1
    while width < gram:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def contexts_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first window, bytes of context, anchor's place in it) for runs of windows with one anchor."""
    span = length - gram + 1
    for base in range(0, len(data) - length + 1, CHUNK):
        piece = data[base:base + CHUNK + length - 1]
        h = _gram_hashes(piece, gram)
        key = (h & np.uint64(0xFFFFFFFFFFE00000)) | np.arange(len(h), dtype=np.uint64)     # 21 low bits: the place
        low, width = key, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = span - width
        low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
        place = (low & np.uint64(0x1FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        for f, e, p in zip(first.tolist(), last.tolist(), place[first].tolist(), strict=True):
            yield int(h[p]), base + f, e - f + length, p - f


def _context_rows(length: int, gram: int):
    def run(frames):
        import xxhash
        for frame in frames:
            rows = []
            for a, b, text in zip(frame["a"], frame["b"], frame["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    for anchor, first, size, at in contexts_of(np.frombuffer(raw, np.uint8), length, gram):
                        rows.append((a, b, anchor, xxhash.xxh3_64_intdigest(raw[first:first + size], seed=at), first, size))
                if len(rows) > ROWS_HELD:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)
    return run


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["a", "b", "anchor", "context", "first", "size"])
    for c in ("anchor", "context"):
        out[c] = np.array(out[c].to_numpy(), np.uint64).view(np.int64)
    return out


def _cut(columns: list[str], whole: bool, length: int):
    """Rows of texts with the contexts wanted from them, to the contexts' bytes (or to their single windows' hashes)."""
    def run(frames):
        import xxhash
        for frame in frames:
            rows = []
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    body = raw[w["first"]:w["first"] + w["size"]]
                    if whole:
                        rows.append((w["anchor"], w["context"], body))
                    else:
                        for i in range(len(body) - length + 1):
                            rows.append((w["anchor"], w["context"], i, xxhash.xxh3_64_intdigest(body[i:i + length])))
                    if len(rows) > (ROWS_HELD if not whole else BODIES_HELD):
                        yield _typed(rows, columns)
                        rows = []
            yield _typed(rows, columns)
    return run


def _typed(rows, columns) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    if "window" in columns:
        out["window"] = np.array(out["window"].to_numpy(), np.uint64).view(np.int64)
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with samples at the ends of runs."""

    STEP = 7        # symbols of nine bits packed into one number

    def __init__(self, strings: list[bytes], least: int = 0):
        """``least``: shared lengths below it need not be exact (they stay too small)."""
        self.least = least
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        symbols = np.zeros(int((lengths + 1).sum()) + self.STEP, np.int64)      # 0 ends a string
        for start, s in zip(self.starts, strings, strict=True):
            symbols[start:start + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        n = len(symbols) - self.STEP
        self.n, self.owner = n, np.repeat(np.arange(len(strings)), lengths + 1)
        self.ends = (self.starts + lengths)[self.owner]
        packed = np.zeros(n, np.int64)
        ended = np.zeros(n, bool)
        for j in range(self.STEP):
            s = np.where(ended, 0, symbols[j:j + n])
            ended |= s == 0
            packed = (packed << 9) | s
        self.packed, self.symbols = packed, symbols
        order = self._sorted_suffixes(packed)
        before = np.where(order == self.starts[self.owner[order]], -1 - self.owner[order], symbols[order - 1])
        change = before[1:] != before[:-1]
        head = np.flatnonzero(np.concatenate([[True], change]))
        tail = np.append(head[1:], n) - 1
        self.run_symbols, self.run_lengths = before[head], tail - head + 1
        self.head_places, self.tail_places = order[head], order[tail]
        # what the suffix at a run's end shares with the neighbour beyond the run
        self.head_shared = np.concatenate([[0], self._shared(order[head[1:]], order[head[1:] - 1])])
        self.tail_shared = np.concatenate([self._shared(order[tail[:-1]], order[tail[:-1] + 1]), [0]])

    def _sorted_suffixes(self, packed: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; only suffixes that still tie are sorted again. Ends order by string."""
        n = self.n
        order = np.argsort(packed)
        flag = np.concatenate([[True], packed[order][1:] != packed[order][:-1]])
        start = np.maximum.accumulate(np.where(flag, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = start
        tied = np.bincount(start, minlength=n)[start] > 1
        open_, width, strings = order[tied], self.STEP, len(self.starts)
        while len(open_):
            follow = open_ + width
            inside = follow <= self.ends[open_]
            second = np.where(inside, strings + rank[np.minimum(follow, n - 1)], self.owner[open_])
            key = rank[open_].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
            o = np.argsort(key)
            open_, key = open_[o], key[o]
            old = rank[open_]
            at = np.arange(len(open_))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
            sub = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
            rank[open_] = old + (sub - group)
            open_ = open_[np.bincount(sub, minlength=len(open_))[sub] > 1]
            width *= 2
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def _shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y (ends match nothing)."""
        out = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):                                   # seven symbols at a time
            i, j = x[live] + out[live], y[live] + out[live]
            ok = (i + self.STEP <= self.ends[x[live]]) & (j + self.STEP <= self.ends[y[live]])
            ok[ok] = self.packed[i[ok]] == self.packed[j[ok]]
            live = live[ok]
            out[live] += self.STEP
        live = np.flatnonzero(out + self.STEP >= self.least)
        for _ in range(self.STEP):                          # then the rest one by one
            i, j = x[live] + out[live], y[live] + out[live]
            live = live[(self.symbols[i] == self.symbols[j]) & (self.symbols[i] != 0)]
            out[live] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """By place of the joined strings: longest match that starts there with any other suffix."""
        best = np.zeros(self.n, np.int64)
        places = np.arange(self.n)
        for sampled, shared in ((self.head_places, self.head_shared), (self.tail_places, self.tail_shared)):
            by_place = np.full(self.n, -1)
            by_place[sampled] = shared
            at = np.maximum.accumulate(np.where(by_place >= 0, places, 0))      # every string's start is sampled
            best = np.maximum(best, by_place[at] - (places - at))
        return best

    def long_matches(self, length: int) -> list[list[tuple[int, int]]]:
        """By string: (start, end) of what strings of ``length`` symbols with a second occurrence cover."""
        hits = np.flatnonzero(self.matching_statistics() >= length)
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        if len(hits):
            cut = np.flatnonzero(np.concatenate([[True], (hits[1:] - hits[:-1] > length) | (self.owner[hits[1:]] != self.owner[hits[:-1]])]))
            for i, j in zip(cut, np.append(cut[1:], len(hits)) - 1, strict=True):
                k = self.owner[hits[i]]
                out[k].append((int(hits[i] - self.starts[k]), int(hits[j] - self.starts[k] + length)))
        return out


_SPANS = "anchor long, context long, spans array<struct<start:int,stop:int>>"


def index_pieces(anchors: np.ndarray, sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges that hold whole anchors (ascending) and at most ``most`` bytes, or one anchor alone."""
    if not len(anchors):
        return []
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    bounds, held = [], 0
    for start, size in zip(first.tolist(), np.add.reduceat(sizes, first).tolist(), strict=True):
        if not bounds or held + size > most:
            bounds.append(start)
            held = 0
        held += size
    return list(zip(bounds, [*bounds[1:], len(anchors)], strict=True))


def _index_shard(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["anchor", "context"]).sort_values("anchor", kind="stable", ignore_index=True)
        sizes, found = frame["body"].map(len).to_numpy(np.int64), []
        for i, j in index_pieces(frame["anchor"].to_numpy(), sizes, PIECE_BYTES):       # equal windows have equal anchors
            found.extend(RunLengthIndex(list(frame["body"].iloc[i:j]), length).long_matches(length))
        some = [i for i, spans in enumerate(found) if spans]
        return pd.DataFrame({"anchor": frame["anchor"].iloc[some], "context": frame["context"].iloc[some],
                             "spans": [[{"start": s, "stop": e} for s, e in found[i]] for i in some]})
    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(s, e) for s, e in out]


def _texts_with(rows: DataFrame, wanted: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(text, wanted): one row for each text that any of the ``wanted`` contexts is to be cut from, however many rows hold it."""
    lists = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("anchor", "context", "first", "size")).alias("wanted"))
    keys, n = small_enough(wanted.select("a", "b").distinct(), most)       # lists are longer than keys, and are not broadcast
    if n <= most:
        rows = rows.join(keys, ["a", "b"], "left_semi")              # texts that nothing is cut from are not shuffled
    # copies are folded before the shuffle, so those of a frequent text never meet in one task
    return rows.dropDuplicates(["a", "b"]).join(lists, ["a", "b"]).select("text", "wanted")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   crowded: int = CROWDED) -> DataFrame:
    """(a, b, spans): by text key the byte ranges that repeated strings of ``length`` bytes cover, unmerged."""
    key = text_key(text_col)
    rows = docs.select(key["a"].alias("a"), key["b"].alias("b"), F.col(text_col).alias("text"))
    table = stored(rows.mapInPandas(_context_rows(length, gram), "a long, b long, anchor long, context long, first int, size int"))
    contexts = stored(table.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("a", "b", "first", "size")).alias("where")))
    anchors = contexts.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1")
    rivals = stored(contexts.join(anchors, "anchor").select("anchor", "context", "times", "rivals", "where.*"))
    # contexts with rivals under their anchor: shared parts come from the index
    size = rivals.where(f"rivals <= {crowded}").agg(F.sum("size")).first()[0] or 0
    shards = parts_for(size, SHARD_BYTES)
    bodies = (_texts_with(rows, rivals.where(f"rivals <= {crowded}"))
              .mapInPandas(_cut(["anchor", "context", "body"], True, length), "anchor long, context long, body binary"))
    indexed = (bodies.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
               .applyInPandas(_index_shard(length), _SPANS))
    spans = indexed.select("anchor", "context", F.explode("spans").alias("s")).select("anchor", "context", "s.start", "s.stop")
    # over-full anchors: each window counts by itself
    over = rivals.where(f"rivals > {crowded}")
    if not over.isEmpty():
        windows = stored(_texts_with(rows, over).mapInPandas(_cut(["anchor", "context", "at", "window"], False, length),
                                                             "anchor long, context long, at int, window long").distinct())
        again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
        more = windows.join(again, "window").select("anchor", "context", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
        spans = spans.unionByName(more)
    spans = spans.join(contexts.where("times > 1").select("anchor", "context"), ["anchor", "context"], "left_anti")
    whole = contexts.where("times > 1").select("anchor", "context", F.lit(0).alias("start"), F.col("where.size").alias("stop"))
    placed = (table.join(spans.unionByName(whole), ["anchor", "context"])
              .select("a", "b", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")).distinct())
    return placed.groupBy("a", "b").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _kept(frames):
    for frame in frames:
        out = []
        for i, text, spans in zip(frame["id"], frame["text"], frame["spans"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs = _merged([(s["start"], s["stop"]) for s in spans]) if spans is not None else []
            digest, at = hashlib.sha256(), 0
            for start, stop in runs:
                digest.update(raw[at:start])
                at = stop
            digest.update(raw[at:])
            out.append((i, len(raw), sum(e - s for s, e in runs), len(runs), digest.hexdigest(), [{"start": s, "stop": e} for s, e in runs]))
        out = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        out["id"] = out["id"].astype("Int64")
        yield out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                    crowded: int = CROWDED) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row: what is cut out and the digest of what stays."""
    spans, _ = small_enough(repeated_spans(docs, text_col, length, gram, crowded)
                            .select(F.col("a").alias("_span_a"), F.col("b").alias("_span_b"), "spans"), 100_000)
    key = text_key(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key["a"].alias("a"), key["b"].alias("b"))
    joined = rows.join(spans, (F.col("a") == F.col("_span_a")) & (F.col("b") == F.col("_span_b")), "left").select("id", "text", "spans")
    return joined.mapInPandas(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                     "spans array<struct<start:int,stop:int>>")
