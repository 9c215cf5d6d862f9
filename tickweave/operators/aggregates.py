"""Aggregations: merges, counts, statistics, scores and portfolio tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import normal_cdf, ratio
from tickweave.series import Series, lay_out
from tickweave.session import settle


def merge_trades(df: DataFrame, keys: Sequence[str], ts: str, price: str, qty: str) -> DataFrame:
    """One row per (key, time): volume-weighted price and total volume."""
    return df.groupBy(*keys, ts).agg(ratio(F.sum(F.col(price) * F.col(qty)), F.sum(qty)).alias("vwap"),
                                     F.sum(qty).alias("volume"))


def merge_book_levels(df: DataFrame, keys: Sequence[str], ts: str, level: str, price: str, qty: str) -> DataFrame:
    """Per (key, time, level): quantity is the mean, price the quantity-weighted mean."""
    return df.groupBy(*keys, ts, level).agg(ratio(F.sum(F.col(price) * F.col(qty)), F.sum(qty)).alias("price"),
                                            F.avg(qty).alias("qty"))


def class_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) and majority / count rounded to two places."""
    everything = Window.partitionBy(F.lit(0))  # one row per class
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        label, "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("balanced"),
        F.bround(F.max("n").over(everything) / F.col("n"), 2).alias("majority_ratio"))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (feature, min, max, mean, population std) from one pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.min(c).alias("min"), F.max(c).alias("max"),
                               F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns])
    return df.agg(parts.alias("_s")).select(F.inline("_s"))


def tensor_stats(df: DataFrame, tensor: str) -> DataFrame:
    """Mean, deviation, min and max per cell of a [feature][time] tensor column."""
    cells = df.select(F.posexplode(tensor).alias("feature", "_row")).select(
        "feature", F.posexplode("_row").alias("step", "v"))
    return cells.groupBy("feature", "step").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                                F.max("v").alias("max"), F.min("v").alias("min"))


def asset_moments(returns: DataFrame, time: str, asset: str, value: str, assets: Sequence[str] | None = None,
                  group: Sequence[str] = ()) -> DataFrame:
    """Covariance, correlation and correlation distance of every asset pair with common times.

    Assets come from the data unless listed. Values of one time meet in a join
    on the time; pairs are summed up before they are shuffled, and only one
    order of each pair is worked out.
    """
    rows = returns if assets is None else returns.filter(F.col(asset).isin(list(assets)))
    one = rows.groupBy(*group, time, asset).agg(F.max(value).alias("_x"))
    left = one.select(*group, time, F.col(asset).alias("asset_a"), "_x")
    right = one.select(*group, time, F.col(asset).alias("asset_b"), F.col("_x").alias("_y"))
    upper = (left.join(right, [*group, time]).filter("asset_a <= asset_b").groupBy(*group, "asset_a", "asset_b")
             .agg(F.covar_samp("_x", "_y").alias("cov"), F.corr("_x", "_y").alias("corr")))
    lower = upper.filter("asset_a < asset_b").withColumns({"asset_a": F.col("asset_b"), "asset_b": F.col("asset_a")})
    return upper.unionByName(lower).withColumn("distance", F.sqrt((1 - F.least(F.col("corr"), F.lit(1.0))) / 2))


def inverse_variance(returns: DataFrame, asset: str, value: str) -> DataFrame:
    var = returns.groupBy(asset).agg(F.var_samp(value).alias("variance"))
    inverse = ratio(F.lit(1.0), F.col("variance"))
    return var.withColumn("weight", inverse / F.sum(inverse).over(
        Window.partitionBy(F.lit(0))))  # one row per asset


def cluster_variance(moments: DataFrame, members: Sequence[str]) -> DataFrame:
    """w' S w of a group of assets under inverse-variance weights."""
    inside = moments.filter(F.col("asset_a").isin(list(members)) & F.col("asset_b").isin(list(members)))
    diag = inside.filter("asset_a = asset_b").select(F.col("asset_a").alias("_m"), ratio(F.lit(1.0), F.col("cov")).alias("_iv"))
    weights = diag.withColumn("_w", F.col("_iv") / F.sum("_iv").over(Window.partitionBy(F.lit(0)))).drop("_iv")
    a = weights.select(F.col("_m").alias("asset_a"), F.col("_w").alias("_wa"))
    b = weights.select(F.col("_m").alias("asset_b"), F.col("_w").alias("_wb"))
    return inside.join(a, "asset_a").join(b, "asset_b").agg(
        F.sum(F.col("_wa") * F.col("cov") * F.col("_wb")).alias("variance"))


def risk_parity(moments: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hierarchical risk parity weights per group of one covariance table.

    Single-linkage order on the correlation distance, then recursive
    bisection by inverse cluster variance. One group is one asset universe in
    one window (assets squared rows); groups run in parallel.
    """
    group = list(group)
    fields = ", ".join(f"`{c}` {t}" for c, t in moments.select(*group).dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = pdf.pivot(index="asset_a", columns="asset_b", values="cov")
        corr = pdf.pivot(index="asset_a", columns="asset_b", values="corr").to_numpy()
        names, cov = list(cov.index), cov.to_numpy()
        # rows of the distance matrix are observations, as the linkage input is the square matrix
        points = np.sqrt(np.clip((1 - corr) / 2, 0, None))
        gap = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
        groups = {i: [i] for i in range(len(names))}
        while len(groups) > 1:
            ids = sorted(groups)
            best = min(((gap[np.ix_(groups[a], groups[b])].min(), a, b)
                        for x, a in enumerate(ids) for b in ids[x + 1:]))
            groups[max(ids) + 1] = groups.pop(best[1]) + groups.pop(best[2])
        ordered = next(iter(groups.values()))
        weight = np.ones(len(names))

        def spread(items):
            inverse = 1 / np.diag(cov)[items]
            w = inverse / inverse.sum()
            return w @ cov[np.ix_(items, items)] @ w

        stack = [ordered]
        while stack:
            items = stack.pop()
            if len(items) < 2:
                continue
            left, right = items[:len(items) // 2], items[len(items) // 2:]
            v0, v1 = spread(left), spread(right)
            weight[left] *= v1 / (v0 + v1)
            weight[right] *= v0 / (v0 + v1)
            stack += [left, right]
        out = pd.DataFrame({"asset": names, "weight": weight})
        for c in group:
            out[c] = pdf[c].iloc[0]
        return out[[*group, "asset", "weight"]]

    grouped = moments.groupBy(*group)
    return grouped.applyInPandas(solve, f"{fields}{', ' if group else ''}asset string, weight double")


def return_statistics(series: Series, price: str) -> DataFrame:
    """Per key: count, lag-1 autocorrelation, population variance and Jarque-Bera of percent changes."""
    def build(df, w):
        df = df.withColumn("_r", ratio(F.col(price), F.lag(price).over(w)) - 1)
        return df.withColumn("_l", F.lag("_r").over(w))
    rows = series.windowed(build, before=2).filter("_r IS NOT NULL")
    out = rows.groupBy(*series.keys).agg(
        F.count("_r").alias("n"), F.corr("_r", "_l").alias("autocorr"), F.var_pop("_r").alias("variance"),
        F.skewness("_r").alias("_sk"), F.kurtosis("_r").alias("_ku"))
    jb = F.col("n") / 6 * (F.col("_sk") ** 2 + F.col("_ku") ** 2 / 4)
    return out.withColumn("jarque_bera", jb).drop("_sk", "_ku")


def bar_stability(bars: DataFrame, kind: str, ts: str, period_us: int) -> DataFrame:
    return bars.groupBy(kind, (F.floor(F.col(ts) / period_us) * period_us).cast("long").alias("period")).agg(
        F.count(F.lit(1)).alias("n_bars"))


def describe_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max, distinct, missing count and share per column, long form."""
    def one(c):
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(v).alias("mean"),
                        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                        F.count_distinct(F.col(c)).alias("n_unique"),
                        F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
                        (F.count(F.when(F.col(c).isNull(), 1)) / F.count(F.lit(1))).alias("missing_share"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("_c")).select(F.inline("_c"))


def word_entropy(series: Series, symbol: Column, width: int) -> DataFrame:
    """Plug-in entropy of overlapping words; the last word of a series is left out."""
    rows = series.with_columns({"_symbol": symbol.cast("string")})

    def build(df, w):
        letters = [F.lag("_symbol", k).over(w) for k in range(width, 0, -1)]
        return df.withColumn("word", F.when(F.col("_pos") >= width, F.concat_ws("_", *letters)))
    words = rows.windowed(build, before=width).filter("word IS NOT NULL")
    pmf = words.groupBy(*series.keys, "word").agg(F.count(F.lit(1)).alias("c"))
    # with c occurrences of N: H = log2 N - sum(c log2 c) / N, so no per-word total is joined back
    return pmf.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("n_words"),
        (F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("entropy"))


def word_pmf(series: Series, symbol: Column, width: int) -> DataFrame:
    rows = series.with_columns({"_symbol": symbol.cast("string")})

    def build(df, w):
        letters = [F.lag("_symbol", k).over(w) for k in range(width, 0, -1)]
        return df.withColumn("word", F.when(F.col("_pos") >= width, F.concat_ws("_", *letters)))
    words = rows.windowed(build, before=width).filter("word IS NOT NULL")
    pmf = words.groupBy(*series.keys, "word").agg(F.count(F.lit(1)).alias("c"))
    totals = pmf.groupBy(*series.keys).agg(F.sum("c").alias("_n"))
    joined = series.attach(pmf, totals)
    return joined.select(*series.keys, "word", (F.col("c") / F.col("_n")).alias("p"))


def threshold_grid(df: DataFrame, ret: str, prob: str, step: float = 0.01, one_sided: bool = False) -> DataFrame:
    """P&L, Sharpe and win ratio for each probability threshold.

    A row is long at the thresholds up to its probability and short at those
    from its complement on, so rows are first summed per pair of grid
    indices; only that small table meets the grid.
    """
    low = 0.0 if one_sided else 0.5
    last = int((1 - low) / step + 1e-9)

    def at(i: Column) -> Column:
        return low + (1 - low) * i / float(last)

    def exact_floor(x: Column) -> Column:
        guess = F.floor((x - low) / ((1 - low) / last)).cast("long")
        return F.when(at(guess + 1) <= x, guess + 1).when(at(guess) > x, guess - 1).otherwise(guess)

    r, p = F.col(ret), F.col(prob)
    up_to = exact_floor(p)
    below = exact_floor(1 - p)
    down_from = F.lit(last + 1).cast("long") if one_sided else F.when(at(below) == 1 - p, below).otherwise(below + 1)
    parts = df.groupBy(up_to.alias("_up"), F.greatest(down_from, F.lit(0)).alias("_down")).agg(
        F.count(r).alias("_n"), F.sum(r).alias("_s"), F.sum(r * r).alias("_ss"),
        F.count(F.when(r > 0, 1)).alias("_won"), F.count(F.when(r < 0, 1)).alias("_lost"))
    rows = parts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    up, down = F.col("_i") <= F.col("_up"), F.col("_i") >= F.col("_down")

    def total(cond, value):
        return F.sum(F.when(cond, F.col(value)).otherwise(0))
    n, s, ss = (total(up | down, c) for c in ("_n", "_s", "_ss"))
    out = rows.groupBy("_i").agg(n.alias("n_bets"), s.alias("pnl"), ss.alias("_ss"),
                                 (total(up, "_won") + total(down, "_lost")).alias("_w"),
                                 (total(up, "_n") + total(down, "_n")).alias("_sides"))
    mean = ratio(F.col("pnl"), F.col("n_bets"))
    sharpe = ratio(mean, F.sqrt(F.greatest(ratio(F.col("_ss"), F.col("n_bets")) - mean * mean, F.lit(0.0))))
    return out.select(at(F.col("_i")).alias("threshold"), "n_bets", F.col("pnl").cast("double").alias("pnl"),
                      F.when(F.col("n_bets") < 2, 0.0).otherwise(sharpe).alias("sharpe"),
                      F.when(F.col("_sides") == 0, 0.0).otherwise(ratio(F.col("_w"), F.col("_sides"))).alias("won_ratio"))


def required_precision(profit: Column, loss: Column, freq: float, target: float, risk_free: float = 0.0) -> Column:
    """Precision at which a two-outcome bet reaches the target Sharpe ratio."""
    diff = profit - loss
    a = (freq + target ** 2) * diff * diff
    b = diff * (2 * freq * (loss - risk_free) - target ** 2 * diff)
    c = freq * (loss - risk_free) * (loss - risk_free)
    return ratio(-b + F.sqrt(b * b - 4 * a * c), 2 * a)


def failure_probability(df: DataFrame, keys: Sequence[str], ret: str, freq: float, target: float) -> DataFrame:
    """Mean win, mean loss, observed and required precision, chance to miss the target."""
    r = F.col(ret)
    out = df.groupBy(*keys).agg(
        F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r <= 0, r)).alias("mean_loss"),
        (F.count(F.when(r > 0, 1)) / F.count(r)).alias("precision"))
    out = out.withColumn("required", required_precision(F.col("mean_win"), F.col("mean_loss"), freq, target))
    scale = F.col("precision") * (1 - F.col("precision"))
    return out.withColumn("failure", normal_cdf(ratio(F.col("required") - F.col("precision"), scale)))


def confusion(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def binary_scores(df: DataFrame, actual: str, predicted: str, prob: str | None = None,
                  weight: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and (with probabilities) weighted log loss."""
    w = F.col(weight) if weight else F.lit(1.0)
    a, p = F.col(actual), F.col(predicted)
    def total(cond):
        return F.sum(F.when(cond, w).otherwise(0.0))
    tp, fp = total((a == 1) & (p == 1)), total((a == 0) & (p == 1))
    fn, tn = total((a == 1) & (p == 0)), total((a == 0) & (p == 0))
    aggs = [((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), (tp / F.nullif(tp + fp, F.lit(0.0))).alias("precision"),
            (tp / F.nullif(tp + fn, F.lit(0.0))).alias("recall"),
            (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0))).alias("f1")]
    if prob:
        q = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-15)), F.lit(1e-15))
        aggs.append((-F.sum(w * F.when(a == 1, F.log(q)).otherwise(F.log(1 - q))) / F.sum(w)).alias("log_loss"))
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def class_table(df: DataFrame, stock: str, actual: str, predicted: str, classes: Sequence[int]) -> DataFrame:
    """Per class accuracy, precision, recall and F1 in percent, per stock and overall (null stock)."""
    cells = df.groupBy(stock, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    a, p, c, n = F.col(actual), F.col(predicted), F.col("class"), F.col("n")
    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))
    tp, fp, fn = total((a == c) & (p == c)), total((a != c) & (p == c)), total((a == c) & (p != c))
    tn = total((a != c) & (p != c))
    scores = [(100.0 * (tp + tn) / F.sum(n)).alias("accuracy"), (100.0 * tp / F.nullif(tp + fp, F.lit(0))).alias("precision"),
              (100.0 * tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
              (200.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1")]
    sets = rows.groupingSets([[F.col(stock), F.col("class")], [F.col("class")]], F.col(stock), F.col("class"))
    return sets.agg(*scores)


def curve_points(df: DataFrame, score: str, actual: str, group: Sequence[str] = (),
                 chunk_rows: int | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score (best first), and trapezoid area parts."""
    group = list(group)
    per = df.groupBy(*group, score).agg(F.sum(F.col(actual).cast("long")).alias("pos_n"),
                                        F.sum(1 - F.col(actual).cast("long")).alias("neg_n"))
    per = per.withColumn("_down", -F.col(score))
    run = lay_out(per, group, ["_down"], chunk_rows).running(
        {"tp": ("sum", F.col("pos_n")), "fp": ("sum", F.col("neg_n"))})
    totals = per.groupBy(*group).agg(F.sum("pos_n").alias("_p"), F.sum("neg_n").alias("_n"))
    out = run.join(totals, group) if group else run.crossJoin(F.broadcast(totals))  # one row
    tpr, fpr = ratio(F.col("tp"), F.col("_p")), ratio(F.col("fp"), F.col("_n"))
    area = ratio(F.col("neg_n") * (2 * F.col("tp") - F.col("pos_n")), F.col("_n") * 2 * F.col("_p"))
    return out.select(*group, score, "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), area.alias("area"))


def mean_curve(points: DataFrame, fold: str, grid_points: int = 100) -> DataFrame:
    """Average true-positive rate over folds on an even false-positive grid.

    Linear interpolation between neighbouring points; the grid times folds
    look-ups run as an as-of join on both sides.
    """
    from tickweave.operators.joins import asof_join
    points = settle(points.select(fold, "fpr", "tpr"))  # read four times below
    folds = points.select(fold).distinct()
    grid = folds.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1)))).withColumn(
        "x", F.col("g") / F.lit(float(grid_points - 1)))
    corner = folds.select(fold, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    last = points.select(fold, "fpr", "tpr").unionByName(corner).groupBy(fold, "fpr").agg(
        F.max("tpr").alias("hi"), F.min("tpr").alias("lo"))
    left = last.select(fold, F.col("fpr").alias("x0"), F.col("hi").alias("y0"))
    right = last.select(fold, F.col("fpr").alias("x1"), F.col("lo").alias("y1"))
    a = asof_join(grid, left.withColumn("_x0", F.col("x0")), [fold], "x", "_x0", ["x0", "y0"])
    b = asof_join(a, right.withColumn("_x1", F.col("x1")), [fold], "x", "_x1", ["x1", "y1"], forward=True)
    share = F.when(F.col("x1") > F.col("x0"), (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    y = F.when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(
        F.col("y0") + share * (F.col("y1") - F.col("y0")))
    return b.withColumn("_y", F.when(F.col("g") == 0, F.lit(0.0)).otherwise(y)).groupBy("g").agg(F.avg("_y").alias("mean_tpr"))


def shifted_correlation(series: Series, actual: str, predicted: str) -> DataFrame:
    rows = series.windowed(lambda df, w: df.withColumn("_next", F.lead(predicted).over(w)), after=1)
    return rows.groupBy(*series.keys).agg(F.corr(actual, predicted).alias("corr"),
                                          F.corr(actual, "_next").alias("corr_shifted"))
