"""Train/test splitting without leakage.

Folds are contiguous in position. Everything a row needs to know about the
folds of its key (bounds, first start time, largest end time) is one small
array per key, so purging and embargo are row-local expressions and rows are
only multiplied when the (fold, row, role) table itself is written out.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.series import Series


def fold_of(pos: Column, n: Column, folds: int) -> Column:
    """Fold number of a position; the first ``n % folds`` folds are one row longer."""
    q, extra = F.floor(n / folds), n % folds
    long_part = (q + 1) * extra
    return F.when(pos < long_part, F.floor(pos / (q + 1))).otherwise(
        extra + F.floor((pos - long_part) / F.greatest(q, F.lit(1)))).cast("int")


def fold_bound(n: Column, folds: int, index: int | Column) -> Column:
    """First position of a fold."""
    i = F.lit(index) if isinstance(index, int) else index
    return (F.floor(n / folds) * i + F.least(i, n % folds)).cast("long")


def _with_folds(series: Series, start: str, end: str, folds: int) -> DataFrame:
    """Rows with ``_fold`` and ``_folds``: array of (fold, first, stop, t0, t1) of their key."""
    keys = list(series.keys)
    rows = series.with_length().df.withColumn("_fold", fold_of(F.col("_pos"), F.col("_n"), folds))
    table = rows.groupBy(*keys, "_fold").agg(
        F.min("_pos").alias("first"), (F.max("_pos") + 1).alias("stop"),
        F.min_by(start, "_pos").alias("t0"), F.max(end).alias("t1"))
    packed = table.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col("_fold").alias("fold"), "first", "stop", "t0", "t1"))).alias("_folds"))
    return series.attach(rows, packed)  # one row per key


def purged_kfold(series: Series, start: str, end: str, folds: int, embargo: float = 0.0,
                 purge: bool = True) -> DataFrame:
    """Long (fold, row, role) table of purged, embargoed k-fold splits.

    Train rows end before the test block starts, or come ``embargo`` (share
    of rows) after the first row at or past the block's largest end time.
    """
    keys = list(series.keys)
    rows = _with_folds(series, start, end, folds)
    # position of the first row at or past each fold's largest end
    ends = rows.select(*keys, F.col(start).alias("_s"), F.explode("_folds").alias("_f")).filter(F.col("_s") < F.col("_f.t1"))
    reach = ends.groupBy(*keys, F.col("_f.fold").alias("fold")).agg(F.count(F.lit(1)).alias("_reach"))
    packed = reach.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fold", "_reach"))).alias("_reach"))
    rows = series.attach(rows, packed, "left")
    wide = rows.withColumn("_f", F.explode("_folds"))
    gap = F.floor(F.col("_n") * embargo)
    before = (F.col(end) < F.col("_f.t0")) if purge else (F.col(end) <= F.col("_f.t0"))
    after = F.col("_pos") >= F.coalesce(F.element_at("_reach", F.col("_f.fold")), F.lit(0)) + gap
    after = after & (F.col("_pos") >= F.col("_f.stop"))
    if purge:
        after = after & (F.col(start) > F.col("_f.t1"))
    role = F.when(F.col("_fold") == F.col("_f.fold"), "test").when(
        ((F.col("_pos") < F.col("_f.first")) & before) | after, "train")
    drop = ["_fold", "_folds", "_reach", "_f", "_n"]
    return wide.withColumns({"fold": F.col("_f.fold"), "role": role}).filter("role IS NOT NULL").drop(*drop)


def _clash(f: Column, pos: Column, start: Column, end: Column, embargo_rows: Column) -> Column:
    """Does a row outside fold ``f`` overlap it or fall into its embargo?"""
    early = (pos < f["first"]) & (end >= f["t0"])
    late = (pos >= f["stop"]) & ((start <= f["t1"]) | (pos < f["stop"] + embargo_rows))
    return early | late


def combinatorial_kfold(series: Series, start: str, end: str, folds: int, tests: int, embargo: float = 0.0,
                        purge: bool = True) -> DataFrame:
    """All ways to choose ``tests`` of ``folds`` folds as the test set.

    Whether a row clashes with a fold does not depend on the combination, so
    it is worked out once per row and fold.
    """
    rows = _with_folds(series, start, end, folds)
    gap = F.floor(F.col("_n") * embargo)
    if purge:
        bad = F.transform(F.filter("_folds", lambda f: _clash(f, F.col("_pos"), F.col(start), F.col(end), gap)),
                          lambda f: f["fold"])
    else:
        bad = F.array().cast("array<int>")
    combos = F.array(*[F.struct(F.lit(i).alias("combo"), F.array(*[F.lit(g) for g in c]).alias("tests"))
                       for i, c in enumerate(combinations(range(folds), tests))])
    wide = rows.withColumn("_bad", bad).withColumn("_c", F.explode(combos))
    role = F.when(F.array_contains(F.col("_c.tests"), F.col("_fold")), "test").when(
        ~F.arrays_overlap("_c.tests", "_bad"), "train")
    return wide.withColumns({"combo": F.col("_c.combo"), "fold": F.col("_fold"), "role": role}).filter(
        "role IS NOT NULL").drop("_fold", "_folds", "_bad", "_c", "_n")


def test_paths(folds: int, tests: int) -> list[tuple[int, int, int]]:
    """(combination, fold, path): each fold's k-th appearance as test belongs to path k."""
    seen: dict[int, int] = {}
    out = []
    for combo, members in enumerate(combinations(range(folds), tests)):
        for fold in members:
            out.append((combo, fold, seen.get(fold, 0)))
            seen[fold] = seen.get(fold, 0) + 1
    return out


def combinatorial_by_time(series: Series, start: str, end: str, folds: int, tests: int, embargo_us: int = 0) -> DataFrame:
    """Combinatorial purged splits with a time embargo; rounds run in reversed order.

    Neighbouring test folds form one block. A train row must end before each
    block starts or come after it, and past a block it must start later than
    the largest end seen from the first test fold to the block's end, plus
    the embargo.
    """
    rows = _with_folds(series, start, end, folds)
    f = lambda i: F.col("_folds")[i]
    roles = []
    for number, members in enumerate(reversed(list(combinations(range(folds), tests)))):
        blocks: list[list[int]] = []
        for g in members:
            if blocks and blocks[-1][1] == g - 1:
                blocks[-1][1] = g
            else:
                blocks.append([g, g])
        ok = F.lit(True)
        for a, b in blocks:
            reach = F.greatest(*[f(i)["t1"] for i in range(members[0], b + 1)], F.lit(-(1 << 62)))
            ok = ok & ((F.col(end) < f(a)["t0"]) | (F.col("_pos") >= f(b)["stop"]))
            ok = ok & ((F.col("_pos") < f(b)["stop"]) | (F.col(start) > reach + embargo_us))
        role = F.when(F.col("_fold").isin(list(members)), "test").when(ok, "train")
        roles.append(F.struct(F.lit(number).alias("round"), role.alias("role")))
    wide = rows.select(*[c for c in rows.columns if c not in ("_folds", "_n", "_fold")], F.inline(F.array(*roles)))
    return wide.filter("role IS NOT NULL")


def walk_forward(series: Series, start: str, end: str, folds: int, tests: int = 1, min_train: int = 2,
                 max_train: int | None = None, by_time: bool = False) -> DataFrame:
    """Purged walk-forward rounds: preceding folds train, following folds test.

    Folds hold equal row counts, or equal time spans with ``by_time``.
    """
    keys, max_train = list(series.keys), max_train or folds - tests
    rows = series.with_length().df
    if by_time:
        span = rows.groupBy(*keys).agg(F.min(start).alias("_lo"), F.max(start).alias("_hi"))
        rows = series.attach(rows, span)
        edge = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(i) / folds
        fold = F.lit(-1)
        for i in range(folds):
            fold = fold + F.when(F.col(start) >= edge(i), 1).otherwise(0)
        rows = rows.withColumn("_fold", fold).drop("_lo", "_hi")
    else:
        rows = rows.withColumn("_fold", fold_of(F.col("_pos"), F.col("_n"), folds))
    firsts = rows.groupBy(*keys, "_fold").agg(F.min(start).alias("_t0"))
    # a fold without rows starts where the next fold with rows does
    packed = firsts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_fold", "_t0"))).alias("_starts"))
    rows = series.attach(rows, packed)
    rounds = []
    for c in range(min_train, folds - tests + 1):
        low = c - max_train if c > max_train else 0
        t0 = F.coalesce(*[F.element_at("_starts", F.lit(i)) for i in range(c, folds)])
        role = F.when((F.col("_fold") >= c) & (F.col("_fold") < c + tests), "test").when(
            (F.col("_fold") >= low) & (F.col("_fold") < c) & (F.col(end) < t0), "train")
        rounds.append(F.struct(F.lit(c - min_train).alias("round"), role.alias("role")))
    kept = [c for c in rows.columns if c not in ("_fold", "_n", "_starts")]
    return rows.select(*kept, F.inline(F.array(*rounds))).filter("role IS NOT NULL")


def purge_before(train: DataFrame, end: str, test_start: Column) -> DataFrame:
    """Drop train rows whose label is not known before the test set starts."""
    return train.filter(F.col(end) < test_start)


def embargo_after(train: DataFrame, start: str, pos: str, test_stop: int, last_test_end: Column, embargo_us: int) -> DataFrame:
    """Drop rows after the test block that start within the embargo of its last end."""
    return train.filter((F.col(pos) < test_stop) | (F.col(start) > last_test_end + embargo_us))


def embargo_times(series: Series, ts: str, share: float) -> DataFrame:
    """Each row's time mapped to the row ``share`` of the rows later (the last one near the end).

    The offset grows with the data, so it is a join on positions, not a frame.
    """
    keys = list(series.keys)
    rows = series.with_length().df.withColumn("_step", F.floor(F.col("_n") * share))
    ahead = rows.select(*keys, (F.col("_pos") - F.col("_step")).alias("_pos"), F.col(ts).alias("_ahead")).filter("_pos >= 0")
    last = rows.groupBy(*keys).agg(F.max(ts).alias("_last"))
    out = rows.join(ahead, [*keys, "_pos"], "left")
    out = series.attach(out, last)
    return out.withColumn("embargo_ts", F.coalesce("_ahead", "_last")).drop("_step", "_n", "_ahead", "_last")


def ordered_split(series: Series, window: int, share: float = 0.8) -> DataFrame:
    """Train, validation and test by position, each preceded by ``window`` context rows.

    The first ``window`` rows have no full window and carry no label.
    """
    rows = series.with_length().df
    n = F.col("_n") - window
    stop = F.bround(n * share).cast("long")
    train_stop = F.bround(stop * share).cast("long")
    bounds = {"train": (F.lit(0), train_stop), "val": (train_stop, stop), "test": (stop, n)}
    index = F.col("_pos") - window
    parts = [F.struct(F.lit(name).alias("split"), F.when((index >= a) & (index < b), 0)
                      .when((index < a) & (index >= a - window), 1).alias("is_context"))
             for name, (a, b) in bounds.items()]
    return rows.select(*[c for c in rows.columns if c != "_n"], F.inline(F.array(*parts))).filter("is_context IS NOT NULL")


def holdout(series: Series, test_share: float) -> DataFrame:
    """Ordered holdout: the last ``test_share`` of each key is the test set."""
    rows = series.with_length().df
    cut = F.ceil(F.col("_n") * test_share)
    return rows.withColumn("role", F.when(F.col("_pos") >= F.col("_n") - cut, "test").otherwise("train")).drop("_n")


def gapped_split(series: Series, ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Named position ranges with gaps between them; rows in a gap are left out."""
    rows = series.with_length().df
    role = F.lit(None).cast("string")
    for name, a, b in reversed(list(ranges)):
        role = F.when((F.col("_pos") >= F.floor(F.col("_n") * a)) & (F.col("_pos") < F.floor(F.col("_n") * b)), name).otherwise(role)
    return rows.withColumn("role", role).filter("role IS NOT NULL").drop("_n")


def first_days(df: DataFrame, stock: str, day: str, train_days: dict) -> DataFrame:
    """The first k days of each stock train, later ones test (k per stock)."""
    from pyspark.sql import Window
    ranks = df.select(stock, day).distinct().withColumn(
        "_d", F.dense_rank().over(Window.partitionBy(stock).orderBy(day)))  # one row per stock and day
    k = F.element_at(F.create_map(*[F.lit(x) for kv in train_days.items() for x in kv]), F.col(stock))
    return df.join(ranks, [stock, day]).withColumn("role", F.when(F.col("_d") <= k, "train").otherwise("test")).drop("_d")


def rows_of(df: DataFrame, splits: DataFrame, ids: Sequence[str], role: str) -> DataFrame:
    return df.join(splits.filter(F.col("role") == role).select(*ids), list(ids), "left_semi")
