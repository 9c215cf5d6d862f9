"""Trie of conversation prefixes: balanced parentheses in each shard, spines shared between shards merged.

A conversation is the sequence of its turns (role, text), ordered by turn
number (null first; equal numbers by digest). Sequences are range-partitioned
by (turn digests, id), so each shard holds a run of the trie's depth-first
order, whatever the skew: copies of one conversation are split by id. A shard
writes its part of the trie as balanced parentheses. The excess of the
parentheses is kept in blocks with a tree of block minima; ``findclose`` on it
delimits every subtree, the rank of "()" pairs counts leaves, and cumulative
arrays give members and savings of a subtree. Only nodes on a shard's first or
last path can also exist in other shards: these spines (a few rows a shard)
are summed by node key, and their own weights are added along the merged spine.

Nulls: role and text count as empty, rows without id are left out. Repeated
rows are turns of their own. Extra columns are ignored, whatever their names.
An empty table gives no node. Texts are only read for their digest and length,
so their size does not matter; a conversation is one row of 28 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import parts_for, small_enough, stored

SHARD_TURNS = 500_000      # turns of a shard; its arrays take some 200 bytes a turn
BLOCK = 64                 # parentheses of an excess block
PIECE_IDS = 4096           # ids of a piece of a spine node's member list
NO_ENDS = hashlib.sha256(b"").hexdigest()
LONGS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
SHARD_SCHEMA = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
                "ends_sha256 string, node_key binary, parent_key binary, tokens long, ids string")
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE, SPINE, PIECE = 0, 1, 2


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id``, ``path`` (two longs a turn) and ``lengths`` (code points a turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
                    F.char_length(text).alias("n"))
    turns = (conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    return turns.select("conv_id", F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"]))).alias("path"),
                        F.transform("t", lambda t: t["n"]).alias("lengths"))


def with_shared_heads(paths: DataFrame, period: int, heads: int) -> DataFrame:
    """Replace the first h turns of each conversation c by those of conversation c - c % period, h = crc32(c) % heads."""
    c = F.col("conv_id")
    lead = c % period == 0
    # a leading conversation gets its own turns back
    h = F.when(lead, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    head = paths.where(lead).select(c.alias("lead_id"), F.slice("path", 1, 2 * (heads - 1)).alias("head_path"),
                                    F.slice("lengths", 1, heads - 1).alias("head_lengths"))
    joined = paths.withColumns({"h": h, "lead_id": c - c % period}).join(head, "lead_id", "left")

    def spliced(own: str, given: str, width: int):
        first = F.coalesce(F.slice(given, F.lit(1), F.col("h") * width), F.slice(own, 1, 0))
        return F.concat(first, F.slice(own, F.col("h") * width + 1, F.size(own))).alias(own)

    return joined.select("conv_id", spliced("path", "head_path", 2), spliced("lengths", "head_lengths", 1))


class ExcessBlocks:
    """Excess of a parenthesis sequence in blocks, with a tree of block minima over them."""

    def __init__(self, bits: np.ndarray):
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(excess) // BLOCK)
        self.excess = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.excess[:len(excess)] = excess
        self.minima = [self.excess.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = low if len(low) % 2 == 0 else np.append(low, np.iinfo(np.int64).max)
            self.minima[-1] = low
            self.minima.append(low.reshape(-1, 2).min(axis=1))

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """Place of the closing parenthesis of each opening one: the first place after it with a smaller excess."""
        return np.concatenate([self._close(part) for part in np.array_split(opened, -(-len(opened) // 32768))])

    def _in_block(self, block: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        places = block[:, None] * BLOCK + np.arange(BLOCK)
        hit = (self.excess[places] < below[:, None]) & (places > after[:, None])
        return np.where(hit.any(axis=1), places[:, 0] + hit.argmax(axis=1), -1)

    def _close(self, opened: np.ndarray) -> np.ndarray:
        below = self.excess[opened]
        found = self._in_block(opened // BLOCK, opened, below)
        left = np.flatnonzero(found < 0)
        if not len(left):
            return found
        node, want = opened[left] // BLOCK, below[left]
        height = np.full(len(left), -1)
        for level, low in enumerate(self.minima[:-1]):      # climb until a right sibling has a smaller excess
            even = (height < 0) & (node % 2 == 0)
            hit = np.flatnonzero(even)
            hit = hit[low[node[hit] + 1] < want[hit]]
            height[hit], node[hit] = level, node[hit] + 1
            node = np.where(height < 0, node // 2, node)
        for level in range(len(self.minima) - 2, 0, -1):    # and descend to the first such block
            down = np.flatnonzero(height == level)
            child = node[down] * 2
            node[down] = child + (self.minima[level - 1][child] >= want[down])
            height[down] = level - 1
        found[left] = self._in_block(node, np.full(len(left), -1), want)
        return found


class ShardTrie:
    """The trie of consecutive sequences, sorted by (path, id): arrays by node in depth-first order, the root first."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, turns: np.ndarray, tokens: np.ndarray):
        rows, starts = len(ids), np.cumsum(lengths) - lengths
        common = np.zeros(rows, np.int64)
        both = np.minimum(lengths[1:], lengths[:-1])
        step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        before, own = np.repeat(starts[:-1], both) + step, np.repeat(starts[1:], both) + step
        differ = np.flatnonzero((turns[before] != turns[own]).any(axis=1))
        common[1:] = both
        np.minimum.at(common, np.repeat(np.arange(1, rows), both)[differ], step[differ])
        new = lengths - common
        closed = np.r_[0, lengths[:-1] - common[1:]]
        runs = np.r_[1, np.stack([closed, new], 1).ravel(), lengths[-1] + 1]
        bits = np.repeat(np.r_[1, np.tile([0, 1], rows), 0], runs).astype(bool)
        blocks = ExcessBlocks(bits)
        opened = np.flatnonzero(bits)
        closes = blocks.findclose(opened)
        count = len(opened)
        self.depth = blocks.excess[opened] - 1
        self.beyond = np.arange(count) + (closes - opened + 1) // 2      # first node after the subtree
        self.ends = np.bincount(np.cumsum(new), minlength=count)         # conversations that end at the node
        ended = np.r_[0, np.cumsum(self.ends)]
        self.first_row = ended[:-1]
        self.n_convs = ended[self.beyond] - self.first_row
        spans = np.stack([self.first_row, self.first_row + self.n_convs], 1).ravel()
        self.smallest = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), spans)[::2]
        by_depth = np.argsort(self.depth, kind="stable")
        ranked = self.depth[by_depth] * count + by_depth
        self.parent = by_depth[np.searchsorted(ranked, (self.depth - 1) * count + np.arange(count)) - 1]
        self.parent[0] = -1
        self.tokens = np.zeros(count, np.int64)
        within = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new)
        self.tokens[1:] = tokens[np.repeat(starts + common, new) + within]
        self.spine = (self.first_row == 0) | (self.first_row + self.n_convs == rows)
        inner = ~self.spine
        pairs = np.zeros(len(bits), np.int64)                            # "()" of nodes that no other shard can extend
        pairs[opened[inner]] = ~bits[opened[inner] + 1]
        rank = np.cumsum(pairs)
        self.n_leaves = rank[closes] - rank[opened] + pairs[opened]
        saved = np.r_[0, np.cumsum(np.where(inner, (self.n_convs - 1) * self.tokens, 0))]
        self.saved = saved[self.beyond] - saved[:-1]
        self.n_children = np.bincount(self.parent[1:][inner[1:]], minlength=count)


def _prefix_keys(turns: np.ndarray) -> list[bytes]:
    """Key of every prefix of one sequence, the empty one first."""
    digest = hashlib.blake2b(digest_size=16)
    keys = [digest.copy().digest()]
    for turn in turns:
        digest.update(turn.tobytes())
        keys.append(digest.copy().digest())
    return keys


def _decimal(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False),
             b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False))
            for b in batches if b.num_rows]
    if not held:
        return
    ids, lengths, path, tokens = (np.concatenate(x).astype(np.int64) for x in zip(*held))
    turns, starts = path.reshape(-1, 2), np.cumsum(lengths) - lengths
    trie = ShardTrie(ids, lengths, turns, tokens)
    spine = np.flatnonzero(trie.spine)
    keys: dict[int, bytes] = {}
    for row, nodes in ((0, spine[trie.first_row[spine] == 0]), (len(ids) - 1, spine[(trie.first_row + trie.n_convs)[spine] == len(ids)])):
        made = _prefix_keys(turns[starts[row]:starts[row] + lengths[row]])
        keys.update((int(n), made[trie.depth[n]]) for n in nodes)
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in LONGS], ("ends_sha256", pa.string()),
                        ("node_key", pa.binary()), ("parent_key", pa.binary()), ("tokens", pa.int64()), ("ids", pa.string())])

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["kind"] = np.full(n, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                          schema=schema)

    inner = np.flatnonzero(~trie.spine)
    for lo in range(0, len(inner), 20_000):
        at = inner[lo:lo + 20_000]
        up = trie.parent[at]
        digests = [hashlib.sha256(_decimal(ids[s:s + n]).encode()).hexdigest() if n else NO_ENDS
                   for s, n in zip(trie.first_row[at].tolist(), trie.ends[at].tolist())]
        yield rows(NODE, conv_id=trie.smallest[at], depth=trie.depth[at], n_convs=trie.n_convs[at], n_children=trie.n_children[at],
                   n_leaves=trie.n_leaves[at], saved_tokens=trie.saved[at], ends_sha256=digests,
                   parent_conv_id=pa.array(trie.smallest[up], pa.int64(), mask=trie.spine[up]), parent_key=[keys.get(int(u)) for u in up])
    for lo in range(0, len(spine), 20_000):
        at = spine[lo:lo + 20_000]
        yield rows(SPINE, conv_id=trie.smallest[at], depth=trie.depth[at], n_convs=trie.n_convs[at], n_children=trie.n_children[at],
                   n_leaves=trie.n_leaves[at], saved_tokens=trie.saved[at], tokens=trie.tokens[at],
                   node_key=[keys[int(n)] for n in at], parent_key=[keys.get(int(u)) for u in trie.parent[at]])
    for n in spine[trie.ends[spine] > 0]:
        first, beyond = trie.first_row[n], trie.first_row[n] + trie.ends[n]
        for lo in range(first, beyond, PIECE_IDS):
            piece = ids[lo:min(lo + PIECE_IDS, beyond)]
            yield rows(PIECE, conv_id=piece[:1], node_key=[keys[int(n)]], ids=[_decimal(piece)])


def _joined_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each node's pieces, which follow each other in id order; only the running digest is held."""
    key = digest = None
    for pdf in frames:
        done = []
        for node, ids in zip(pdf["node_key"].map(bytes), pdf["ids"]):
            if node != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["node_key", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["node_key", "ends_sha256"])


def _along_spine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the spine nodes' own leaves and savings to all their ancestors, deepest level first."""
    held = [f for f in frames if len(f)]
    if not held:
        return
    spine = pd.concat(held, ignore_index=True)
    place = {bytes(k): i for i, k in enumerate(spine["node_key"])}
    parent = np.array([-1 if k is None else place[bytes(k)] for k in spine["parent_key"]])
    depth, convs, smallest = (spine[c].to_numpy() for c in ("depth", "n_convs", "conv_id"))
    children = spine["n_children"].to_numpy() + np.bincount(parent[parent >= 0], minlength=len(spine))
    leaves = spine["n_leaves"].to_numpy() + (children == 0)
    saved = spine["saved_tokens"].to_numpy() + (convs - 1) * spine["tokens"].to_numpy()
    # what a spine node gains over its shard-local sums goes to every ancestor
    more = np.stack([(children == 0).astype(np.int64), (convs - 1) * spine["tokens"].to_numpy()])
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        for row, total in ((0, leaves), (1, saved)):
            np.add.at(total, parent[level], more[row, level])
            np.add.at(more[row], parent[level], more[row, level])
    spine["parent_conv_id"] = pd.array(np.where(parent < 0, 0, smallest[parent]), dtype="Int64")
    spine.loc[parent < 0, "parent_conv_id"] = pd.NA
    yield spine.assign(n_children=children, n_leaves=leaves, saved_tokens=saved)[
        ["node_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (see ``sequences``), each known by its smallest member and its depth."""
    spark = paths.sparkSession
    paths = stored(paths)
    turns = paths.agg(F.sum(F.size("lengths") + 1)).first()[0] or 0
    shards = max(parts_for(turns, SHARD_TURNS), min(2 * spark.sparkContext.defaultParallelism, parts_for(turns, 5_000)))
    dealt = paths.select("conv_id", "path", "lengths").repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = stored(dealt.mapInArrow(_shard, SHARD_SCHEMA))
    merged = parts.where(F.col("kind") == SPINE).groupBy("node_key").agg(
        F.first("parent_key", ignorenulls=True).alias("parent_key"), F.first("depth").alias("depth"), F.first("tokens").alias("tokens"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    spine, _ = small_enough(merged.coalesce(1).mapInPandas(
        _along_spine, "node_key binary, " + ", ".join(f"{c} long" for c in LONGS)))
    ends = (parts.where(F.col("kind") == PIECE).select("node_key", "conv_id", "ids").repartition("node_key")
            .sortWithinPartitions("node_key", "conv_id").mapInPandas(_joined_pieces, "node_key binary, ends_sha256 string"))
    shared = spine.join(ends, "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*NODE_COLUMNS)
    above = spine.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above_id"))
    own = (parts.where(F.col("kind") == NODE).join(above, "parent_key", "left")
           .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id")).select(*NODE_COLUMNS))
    return own.unionByName(shared)
