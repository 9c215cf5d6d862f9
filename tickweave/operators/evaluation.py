"""Strategy evaluation: ledgers, daily returns, key figures, model scores and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.operators.aggregates import binary_scores
from tickweave.series import Series, lay_out
from tickweave.session import settle, stored


def position_clock(min_prob: float):
    """Open on the first non-zero side while flat, close on an opposite one; never both on a row."""
    def kernel(state, fresh, arrays):
        held = state[0]
        sides, probs = arrays["_side"].tolist(), arrays["_prob"].tolist()
        action = np.zeros(len(sides), dtype="int32")
        opened = np.zeros(len(sides), dtype="int32")
        for i, (side, prob) in enumerate(zip(sides, probs)):
            if not prob > min_prob or not side:
                continue
            if not held:
                held, action[i], opened[i] = side, 1, 1
            elif side != held:
                held, action[i] = 0.0, -1
        return (float(held),), {"action": action, "_hits": opened}
    return kernel


def trades(series: Series, price: str, side: Column, prob: Column, ts: str, size: Column | None = None,
           min_prob: float = 0.5) -> DataFrame:
    """One row per position: opening and closing time and price, side, bet size."""
    keys = list(series.keys)
    rows = series.with_columns({"_side": side.cast("double"), "_prob": prob.cast("double"),
                                "_size": (size if size is not None else F.lit(1.0)).cast("double")}).fold(
        position_clock(min_prob), (0.0,), ["_side", "_prob"], {"action": "int", "_hits": "int"},
        keep=list(dict.fromkeys([*series.order, price, "_side", "_size"]))).filter("action <> 0")
    trade = F.when(F.col("action") == 1, F.col("_seq")).otherwise(F.col("_seq") - 1)
    opened, closed = F.col("action") == 1, F.col("action") == -1
    return rows.groupBy(*keys, trade.alias("trade")).agg(
        F.max(F.when(opened, F.col(ts))).alias("open_ts"), F.max(F.when(closed, F.col(ts))).alias("close_ts"),
        F.max(F.when(opened, F.col(price))).alias("open_price"), F.max(F.when(closed, F.col(price))).alias("close_price"),
        F.max(F.when(opened, F.col("_side"))).alias("side"), F.max(F.when(opened, F.col("_size"))).alias("size"))


def cash_path(ledger: DataFrame, keys: Sequence[str], cash: float, fee: float) -> DataFrame:
    """Cash after each closed trade when a signed share ``side * size`` of cash is traded, with a fee per leg.

    Each trade multiplies cash by a factor, so the path is a running product
    (log-sum, sign count and zero count).
    """
    bet = F.col("side") * F.col("size")
    move = ratio(F.col("close_price"), F.col("open_price"))
    factor = F.when(F.col("side") > 0, 1 - bet * (1 + fee) + bet * move * (1 - fee)).otherwise(
        1 - bet * (1 - fee) + bet * move * (1 + fee))
    closed = ledger.filter(F.col("close_price").isNotNull()).withColumn("factor", factor)
    series = lay_out(closed, keys, ["trade"])
    run = series.running({
        "_log": ("sum", F.when(F.col("factor") != 0, F.log(F.abs("factor"))).otherwise(0.0)),
        "_neg": ("sum", (F.col("factor") < 0).cast("int")), "_zero": ("sum", (F.col("factor") == 0).cast("int"))})
    sign = F.when(F.col("_zero") > 0, 0.0).when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return run.withColumn("cash", cash * sign * F.exp("_log")).drop("_log", "_neg", "_zero", "_pos")


def round_trips(ledger: DataFrame) -> DataFrame:
    """Profit ratio of each closed long (close / open) or short (open / close) position."""
    profit = F.when(F.col("side") > 0, ratio(F.col("close_price"), F.col("open_price"))).otherwise(
        ratio(F.col("open_price"), F.col("close_price")))
    return ledger.filter(F.col("close_price").isNotNull()).withColumn("ratio", profit)


def daily_returns(df: DataFrame, keys: Sequence[str], ts: str, ret: str) -> DataFrame:
    """Business-day returns from intraday returns; weekend rows count to Friday, gaps carry the last value.

    Days are one row each, so everything after the first aggregate is small.
    """
    keys = list(keys)
    day = F.to_date(F.timestamp_micros(ts))
    business = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    per = df.groupBy(*keys, business.alias("day")).agg(F.sum(F.log1p(ret)).alias("_l"))
    span = per.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day")).filter(F.weekday("day") < 5)
    w = Window.partitionBy(*keys).orderBy("day")
    full = grid.join(per, [*keys, "day"], "left")
    growth = F.exp(F.sum(F.coalesce("_l", F.lit(0.0))).over(w))
    return full.withColumn("_g", growth).withColumn("daily_ret", ratio(F.col("_g"), F.lag("_g").over(w)) - 1).drop("_l", "_g")


def key_figures(daily: DataFrame, keys: Sequence[str], day: str, ret: str, periods: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe, largest drawdown, total return."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(day)  # one row per day
    curve = daily.filter(F.col(ret).isNotNull()).withColumn("_c", F.exp(F.sum(F.log1p(ret)).over(w)))
    curve = curve.withColumn("_dd", F.col("_c") / F.greatest(F.max("_c").over(w), F.lit(1.0)) - 1)
    n = F.count(F.lit(1))
    total = F.max_by("_c", day)
    return curve.groupBy(*keys).agg(
        (total - 1).alias("total_return"), (F.pow(total, periods / n) - 1).alias("annual_return"),
        (F.stddev_samp(ret) * float(np.sqrt(periods))).alias("annual_volatility"),
        (ratio(F.avg(ret), F.stddev_samp(ret)) * float(np.sqrt(periods))).alias("sharpe"), F.min("_dd").alias("max_drawdown"))


def meta_dataset(df: DataFrame, primary: str, actual: str) -> DataFrame:
    """Append the primary prediction as a feature; the label is whether it was a true positive."""
    return df.withColumn("meta_label", ((F.col(primary) == 1) & (F.col(actual) == 1)).cast("int"))


def colour_series(df: DataFrame, price: str, label: str) -> DataFrame:
    """One price column per label class: downs (0), middles (1), ups (2)."""
    return df.withColumns({name: F.when(F.col(label) == i, F.col(price))
                           for i, name in enumerate(("downs", "middles", "ups"))})


# -- models -----------------------------------------------------------------------------

def assembled(df: DataFrame, features: Sequence[str], label: str, weight: str | None, keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    cols = [*keep, F.col(label).cast("double").alias("label"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), *features]
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df.select(*cols))


def _test_predictions(ready: DataFrame, make_model: Callable, fold: str, keep: Sequence[str], on_test: Callable | None = None) -> DataFrame:
    """One fit per fold on the train rows of ``ready`` (assembled, stored); predictions of its test rows."""
    from functools import reduce

    from pyspark.ml.functions import vector_to_array
    pieces = []
    for number in sorted(row[0] for row in ready.select(fold).distinct().collect()):       # folds are few
        part = ready.filter(F.col(fold) == number)
        model = make_model().fit(part.filter("role = 'train'"))
        test = part.filter("role = 'test'")
        pieces.append(model.transform(on_test(test) if on_test else test).select(
            *keep, F.lit(number).alias(fold), F.col("label").cast("int").alias("actual"),
            F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("prob"), "weight"))
    return reduce(DataFrame.unionByName, pieces)


def out_of_fold(splits: DataFrame, features: Sequence[str], label: str, make_model: Callable, ids: Sequence[str],
                weight: str | None = None, fold: str = "fold") -> DataFrame:
    """Each test row's prediction by the model of its fold, which never saw it: ``ids``, fold, actual, predicted, prob."""
    ready = stored(assembled(splits, features, label, weight, [*ids, fold, "role"]), [fold, "role"])
    return _test_predictions(ready, make_model, fold, ids).drop("weight")


def signals_by_path(splits: DataFrame, paths: DataFrame, features: Sequence[str], label: str, make_model: Callable,
                    ids: Sequence[str], combo: str = "combo", fold: str = "fold") -> DataFrame:
    """One out-of-fold signal for every row and path of combinatorial splits.

    One fit per combination; ``paths`` (combination, fold, path) says to which
    path a test fold of a combination belongs, so each path holds every row
    once: ``ids``, path, combo, fold and the signal, twice the probability less one.
    """
    ready = stored(assembled(splits, features, label, None, [*ids, combo, fold, "role"]), [combo, "role"])
    made = _test_predictions(ready, make_model, combo, [*ids, fold])
    placed = made.join(F.broadcast(paths.select(combo, fold, "path")), [combo, fold])      # one row a combination and test fold
    return placed.select(*ids, "path", combo, fold, "actual", (2 * F.col("prob") - 1).alias("signal"))


def two_stage(splits: DataFrame, features: Sequence[str], label: str, ret: str, make_model: Callable, ids: Sequence[str],
              fold: str = "fold") -> DataFrame:
    """A learned side, and a second model that learns whether trading that side pays.

    Stage one predicts ``label`` (1: up) out of fold; its side becomes a column
    of stage two, whose label is 1 where ``ret`` on that side is positive.
    Returns ``ids``, side, bin and the out-of-fold probability ``size``.
    """
    splits = settle(splits)
    side = (2 * F.col("predicted") - 1).cast("double")
    first = out_of_fold(splits, features, label, make_model, ids, fold=fold).select(*ids, side.alias("side"))
    second = splits.join(first, list(ids)).withColumn("bin", (F.col(ret) * F.col("side") > 0).cast("int"))
    sized = out_of_fold(second, [*features, "side"], "bin", make_model, ids, fold=fold)
    return sized.join(first, list(ids)).select(*ids, F.col("side").cast("int").alias("side"), F.col("actual").alias("bin"), F.col("prob").alias("size"))


def fold_scores(splits: DataFrame, features: Sequence[str], label: str, make_model: Callable, weight: str | None = None,
                fold: str = "fold", on_test: Callable | None = None) -> DataFrame:
    """Fit per fold on its train rows, score its test rows (weighted on both sides).

    ``splits`` is a (fold, role) table with features; every fit is a
    distributed one.
    """
    ready = stored(assembled(splits, features, label, weight, [fold, "role"]), [fold, "role"])  # every fit reads its rows many times
    return binary_scores(_test_predictions(ready, make_model, fold, [], on_test), "actual", "predicted", "prob", "weight", [fold])


def grid_search(splits: DataFrame, features: Sequence[str], label: str, make_model: Callable, grid: Sequence[dict],
                weight: str | None = None, fold: str = "fold", metric: str = "log_loss") -> DataFrame:
    """Mean fold score of every parameter setting, best first; all settings read one stored table."""
    from functools import reduce
    ready, pieces = stored(assembled(splits, features, label, weight, [fold, "role"]), [fold, "role"]), []
    for i, params in enumerate(grid):
        made = _test_predictions(ready, lambda p=params: make_model(**p), fold, [])
        scores = binary_scores(made, "actual", "predicted", "prob", "weight", [fold])
        pieces.append(scores.agg(F.avg(metric).alias("score")).select(
            F.lit(i).alias("setting"), F.lit(str(sorted(params.items()))).alias("params"), "score"))
    return reduce(DataFrame.unionByName, pieces).orderBy("score" if metric == "log_loss" else F.desc("score"))


def log_uniform(low: float, high: float, count: int, seed: int = 0) -> list[float]:
    """Seeded log-uniform draws for a random search."""
    rng = np.random.default_rng(seed)
    return np.exp(rng.uniform(np.log(low), np.log(high), count)).tolist()


def impurity_importance(forest_model, features: Sequence[str], spark, root: bool = False) -> DataFrame:
    """Mean and scaled deviation over trees of each feature's impurity decrease.

    A zero means the feature was not offered to the tree and is ignored. The
    deviation is scaled by n^-1/2 (``root=False``) or n^1/2.
    """
    rows = [(features[i], t, float(tree.featureImportances[i]))
            for t, tree in enumerate(forest_model.trees) for i in range(len(features))]
    table = spark.createDataFrame(rows, "feature string, tree int, value double")
    n = len(forest_model.trees)
    value = F.nullif(F.col("value"), F.lit(0.0))
    out = table.groupBy("feature").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) * n ** (0.5 if root else -0.5)).alias("std"))
    total = F.sum("mean").over(Window.partitionBy(F.lit(0)))  # one row per feature
    return out.withColumns({"std": ratio(F.col("std"), total), "mean": ratio(F.col("mean"), total)})


def permuted(df: DataFrame, columns: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """``df`` and ``_moved_<column>`` for each column: rows in id order get the values in a hash order."""
    a = lay_out(df, [], ids)
    b = lay_out(df.select(*ids, *[F.col(c).alias(f"_moved_{c}") for c in columns]).withColumn("_h", F.xxhash64(F.lit(seed), *ids)), [], ["_h", *ids])
    return a.df.join(b.df.select("_pos", *[f"_moved_{c}" for c in columns]), "_pos").drop("_pos")


def permute(df: DataFrame, column: str, ids: Sequence[str], seed: int) -> DataFrame:
    """Shuffle one column: rows in id order get the values in a hash order."""
    return permuted(df, [column], ids, seed).drop(column).withColumnRenamed(f"_moved_{column}", column)


def permutation_importance(splits: DataFrame, features: Sequence[str], label: str, make_model: Callable, ids: Sequence[str],
                           fold: str = "fold", seed: int = 0) -> DataFrame:
    """Relative worsening of the log loss in each test fold after shuffling one feature, all by the same order."""
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    splits = stored(splits, [fold, "role"])
    folds = sorted(row[0] for row in splits.select(fold).distinct().collect())
    pieces = []
    for number in folds:
        part = splits.filter(F.col(fold) == number)
        ready = assembled(part, features, label, None, [*ids, "role"])
        model = make_model().fit(ready.filter("role = 'train'"))
        test = stored(permuted(ready.filter("role = 'test'").drop("features"), features, ids, seed))
        for feature in [None, *features]:
            shuffled = test if feature is None else test.withColumn(feature, F.col(f"_moved_{feature}"))
            vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(shuffled)
            scored = model.transform(vec).select(
                F.lit(number).alias(fold), F.lit(feature or "").alias("feature"), F.col("label").cast("int").alias("actual"),
                F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("prob"))
            pieces.append(scored)
    scores = binary_scores(reduce(DataFrame.unionByName, pieces), "actual", "predicted", "prob", group=[fold, "feature"])
    base = scores.filter("feature = ''").select(fold, F.col("log_loss").alias("_base"))
    drop = scores.filter("feature <> ''").join(base, fold).withColumn("_d", 1 - ratio(F.col("_base"), F.col("log_loss")))
    return drop.groupBy("feature").agg(F.avg("_d").alias("mean"), (F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).alias("std"))


def single_feature_importance(splits: DataFrame, features: Sequence[str], label: str, make_model: Callable,
                              fold: str = "fold", metric: str = "log_loss") -> DataFrame:
    """Fold score of a model that sees one feature only, for each feature."""
    from functools import reduce
    sign, splits = (-1 if metric == "log_loss" else 1), stored(splits.select(*features, label, fold, "role"), [fold, "role"])
    made = lambda c: _test_predictions(assembled(splits, [c], label, None, [fold, "role"]), make_model, fold, [])       # noqa: E731
    pieces = [binary_scores(made(c), "actual", "predicted", "prob", "weight", [fold]).agg(
        (sign * F.avg(metric)).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(F.lit(1)))).alias("std")
    ).select(F.lit(c).alias("feature"), "mean", "std") for c in features]
    return reduce(DataFrame.unionByName, pieces)


def importance_by_kind(importance: DataFrame, feature: str = "feature", value: str = "mean") -> DataFrame:
    """Share of importance per kind, the kind being the first letter of the feature name."""
    kinds = importance.groupBy(F.substring(feature, 1, 1).alias("kind")).agg(F.sum(value).alias("total"), F.avg(value).alias("average"))
    return kinds.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))))  # one row per kind
