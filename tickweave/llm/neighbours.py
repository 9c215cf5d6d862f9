"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard of vectors.

Equal vectors are one point that knows its smallest ids, so copies neither
crowd a graph nor hide each other. Points are dealt into shards of bounded
size by hash. A shard's graph starts from random edges; every point is then
searched for greedily, and of the points met on the way those are kept as
neighbours that no kept, closer one covers: candidate c goes when
``RELAX * d(kept, c) <= d(point, c)``. Edges are offered backwards too, and
lists that grow too long are pruned by the same rule. A query runs a beam
search in every shard and merges what it finds; distances of the result are
exact, in double precision, on the original vectors.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do null ids; vectors of different lengths never meet; ties go to
the smaller id; repeated (id, vector) rows count once; with fewer candidates
than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import parts_for, stored

DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 48, 96, 1.2
SHARD_POINTS = 4_000
BATCH = 128
QUERY_BLOCK = 256
EXPAND = 4                     # nodes that a search step opens


def _squared(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the points in its row of ``ids``."""
    dot = np.matmul(points[ids], queries[:, :, None])[:, :, 0]
    return norms[ids] - 2 * dot + (queries * queries).sum(axis=1)[:, None]


def beam_search(points, norms, edges, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest points met by each query, nearest first; and all opened points (-1: none)."""
    count, n = len(queries), len(points)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True                                    # a missing edge leads to place n
    ids = np.full((count, beam), n)
    dist = np.full((count, beam), np.inf)
    opened = np.ones((count, beam), bool)
    ids[:, 0], opened[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = _squared(points, norms, queries, np.full((count, 1), entry))[:, 0]
    met = []
    while True:
        pick = np.argsort(np.where(opened, np.inf, dist), axis=1)[:, :EXPAND]
        chosen = np.where(opened[rows, pick], n, ids[rows, pick])
        if (chosen == n).all():
            break
        opened[rows, pick] = True
        met.append(np.where(chosen == n, -1, chosen))
        near = edges[chosen].reshape(count, -1)
        near = np.where(seen[rows, near], n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n     # the same point by two ways
        seen[rows, near] = True
        d = _squared(points, norms, queries, np.minimum(near, n - 1))
        d[near == n] = np.inf
        all_ids, all_d = np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1)
        all_open = np.concatenate([opened, near == n], axis=1)
        o = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = all_ids[rows, o], all_d[rows, o], all_open[rows, o]
    return ids, dist, np.concatenate(met, axis=1)


def robust_prune(points, norms, at: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
    """(m, DEGREE) neighbours of the points ``at`` out of ``candidates`` (-1 and n: none), padded with n."""
    n = len(points)
    c = np.sort(np.where((candidates < 0) | (candidates == at[:, None]), n, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    safe = np.minimum(c, n - 1)
    d = _squared(points, norms, points[at], safe)
    d[c == n] = np.inf
    o = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(at))[:, None]
    c, d, safe = c[rows, o], np.maximum(d[rows, o], 0), safe[rows, o]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(points[safe], points[safe].transpose(0, 2, 1))
    covers = relax * relax * between <= d[:, None, :]
    alive = np.isfinite(d)
    out = np.full((len(at), DEGREE), n)
    line = np.arange(len(at))
    for k in range(DEGREE):
        best = alive.argmax(axis=1)                      # candidates stand in order of distance
        some = alive[line, best]
        if not some.any():
            break
        out[some, k] = c[line, best][some]
        alive &= ~covers[line, best] | ~some[:, None]
        alive[line, best] = False
    return out


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (n + 1, DEGREE; n: none) and the entry point."""
    n = len(points)
    norms = (points * points).sum(axis=1)
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    rng = np.random.default_rng(seed)
    edges = np.full((n + 1, DEGREE), n)
    if n > 1:
        start = min(DEGREE // 2, n - 1)
        edges[:n, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
        _, _, met = beam_search(points, norms, edges, entry, points[at], BUILD_BEAM)
        edges[at] = robust_prune(points, norms, at, np.concatenate([met, np.where(edges[at] == n, -1, edges[at])], axis=1), RELAX)
        # offer the edges backwards
        source, target = np.repeat(at, DEGREE), edges[at].ravel()
        source, target = source[target < n], target[target < n]
        o = np.argsort(target, kind="stable")
        source, target = source[o], target[o]
        heads, first, many = np.unique(target, return_index=True, return_counts=True)
        offered = np.full((len(heads), int(many.max(initial=0))), -1)
        offered[np.repeat(np.arange(len(heads)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        for part in np.array_split(np.arange(len(heads)), max(1, len(heads) // BATCH)):
            if len(part):
                own = np.where(edges[heads[part]] == n, -1, edges[heads[part]])
                edges[heads[part]] = robust_prune(points, norms, heads[part], np.concatenate([own, offered[part]], axis=1), RELAX)
    return edges, entry


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, keep: Column | None = None) -> DataFrame:
    """(id, v) rows that take part, components in double precision."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows


def _graph_of(frame: pd.DataFrame) -> pd.DataFrame:
    exact = np.stack(frame["v"].to_numpy())
    edges, entry = build_graph(exact.astype(np.float32))
    ids = frame["ids"].to_list()
    return pd.DataFrame([(int(frame["dim"].iloc[0]), int(frame["shard"].iloc[0]), entry, exact.tobytes(), edges.astype(np.int32).tobytes(),
                          np.concatenate(ids).astype(np.int64).tobytes(), np.array([len(i) for i in ids], np.int64).tobytes())],
                        columns=["dim", "shard", "entry", "vectors", "edges", "ids", "copies"])


_GRAPH = "dim int, shard int, entry int, vectors binary, edges binary, ids binary, copies binary"


def index(vectors: DataFrame, copies: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each shard: its graph, its vectors and, for each vector, its ``copies`` smallest ids."""
    rows = valid_vectors(vectors, id_col, vector_col).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    # the rank limit is applied before the shuffle as well, so a vector that many rows share reaches its task in few rows
    points = stored(rows.distinct().withColumn("r", rank).where(F.col("r") <= copies)
                    .groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    shards = parts_for(points.count(), SHARD_POINTS)
    dealt = points.withColumns({"dim": F.size("v"), "shard": F.pmod("b", F.lit(shards)).cast("int")})
    return stored(dealt.groupBy("dim", "shard").applyInPandas(_graph_of, _GRAPH))


def _search(k: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                exact = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
                n = len(exact)
                points = exact.astype(np.float32)
                edges = np.frombuffer(row.edges, np.int32).reshape(n + 1, DEGREE).astype(np.int64)
                ids, copies = np.frombuffer(row.ids, np.int64), np.frombuffer(row.copies, np.int64)
                first = np.cumsum(copies) - copies
                queries, names = np.stack([np.asarray(q) for q in row.q]), np.asarray(row.q_ids, np.int64)
                found, _, _ = beam_search(points, (points * points).sum(axis=1), edges, row.entry, queries.astype(np.float32), SEARCH_BEAM)
                out = []
                for q, name, near in zip(queries, names, found, strict=True):
                    near = near[near < n]
                    d = np.sqrt(((exact[near] - q) ** 2).sum(axis=1))
                    o = np.argsort(d, kind="stable")[:k + 1]           # one more, should the nearest be the query alone
                    # ties at the end of the list matter for ids: keep all points as near as the last
                    o = np.flatnonzero(d <= d[o[-1]]) if len(o) else o
                    held = [(ids[first[near[i]]:first[near[i]] + copies[near[i]]], d[i]) for i in o]
                    members = np.concatenate([h[0] for h in held])
                    scores = np.repeat([h[1] for h in held], [len(h[0]) for h in held])
                    scores, members = scores[members != name], members[members != name]
                    best = np.lexsort((members, scores))[:k]
                    out.extend(zip([name] * len(best), members[best], scores[best], strict=True))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query's vector, its own id left out."""
    graphs = index(vectors, k + 1, id_col, vector_col)
    asked = valid_vectors(queries, id_col, vector_col).distinct()
    # blocks of queries meet every shard of their dimension; blocks and shards are rows of bounded size
    blocks = parts_for(asked.count(), QUERY_BLOCK)
    packed = (asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
              .agg(F.collect_list(F.struct("id", "v")).alias("s")).select("dim", "block", F.col("s.id").alias("q_ids"), F.col("s.v").alias("q")))
    shards = graphs.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    met = packed.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    pairs = met.join(graphs, ["dim", "shard"]).repartition(parts_for(blocks * graphs.count(), 2), "shard", "block")
    found = pairs.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
