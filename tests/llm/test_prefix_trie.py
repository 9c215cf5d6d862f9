import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import prefix_trie, queries

COLUMNS = prefix_trie.NODE_COLUMNS


def brute_force(rows, spliced=True):
    """Node rows from a dictionary of prefixes; ``rows`` are (conv_id, turn, role, text) with distinct turn numbers."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    if spliced:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - int(math.fmod(c, 100)), [])[:h[c]] + ts[h[c]:] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        path = tuple(own[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("turns", [1_000_000, 30])
def test_equals_brute_force(spark, folder, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)       # 30: many shards, most nodes on spines
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.parenthesis_prefix_trie(spark, folder)) == brute_force(rows)


@pytest.mark.parametrize("turns", [1_000_000, 40])
def test_copies_prefixes_and_odd_rows(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 4)
    rows = [(c, t, "user" if t % 2 else None, f"same {t}") for c in range(1000, 1060) for t in range(3)]          # a third: copies
    rows += [(c, t, "user", f"{c * 7 % (t + 1)}é" * (t + 1)) for c in range(100, 160) for t in range(c % 9)]       # prefixes of each other
    rows += [(-5, None, None, None), (-5, 0, "a", None), (0, 1, "", ""), (7, 0, "ab", "c"), (8, 0, "a", "bc"), (None, 0, "x", "y")]
    rows += [(5000, t, "deep", "x" * (t % 5)) for t in range(700)] + [(5001, t, "deep", "x" * (t % 5)) for t in range(650)]
    table = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows],
                                  "conv_id long, turn long, role string, text string, path long, node_key string, lead_id string")
    paths = prefix_trie.sequences(table)
    assert found(prefix_trie.prefix_trie(paths)) == brute_force(rows, spliced=False)
    assert found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(paths, 100, 6))) == brute_force(rows)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(table.limit(0))).count() == 0


def test_equal_turn_numbers_and_repeated_rows_have_one_order(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = found(prefix_trie.prefix_trie(prefix_trie.sequences(table)))
    assert len(got) == 4 and all(r[3] == 2 for r in got)          # root and three turns, both conversations in each


def test_findclose_against_a_stack():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 3000):
        bits, level = [], 0
        for left in range(2 * n, 0, -1):
            up = level == 0 or (level < left and rng.random() < (0.5 if n < 3000 else 0.52))
            bits.append(up)
            level += 1 if up else -1
        bits, stack, want = np.array([True, *bits, *[False] * level, False]), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened = np.flatnonzero(bits)
        assert [want[i] for i in opened] == list(prefix_trie.ExcessBlocks(bits).findclose(opened))


def test_hot_node_is_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 200)
    table = spark.range(2000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("hi").alias("text"))
    got = found(prefix_trie.prefix_trie(prefix_trie.sequences(table)))
    ends = hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest()
    assert got == [(0, 0, None, 2000, 1, 1, 1999 * 2, prefix_trie.NO_ENDS), (0, 1, 0, 2000, 0, 1, 1999 * 2, ends)]
