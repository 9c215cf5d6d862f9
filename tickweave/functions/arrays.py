"""Array expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def mean_of(a: Column) -> Column:
    return sum_of(a) / F.size(a)


def std_pop_of(a: Column) -> Column:
    mean = mean_of(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / F.size(a))


def median_of(a: Column) -> Column:
    ordered, n = F.array_sort(a), F.size(a)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (lower + upper) / 2


def transpose(a: Column, width: int) -> Column:
    """[time][feature] to [feature][time]."""
    def pick(j):
        return F.transform(a, lambda row: row[j])
    return F.array(*[pick(j) for j in range(width)])


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x) | x.isNull())


def pairs_from_flat(a: Column) -> Column:
    """[p, q, p, q] to [{price, qty}]."""
    n = (F.size(a) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        a[i * 2].alias("price"), a[i * 2 + 1].alias("qty")))).otherwise(
        F.array().cast("array<struct<price:double,qty:double>>"))


def flat_from_pairs(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array(x["price"], x["qty"])))


def argmax_one_hot(a: Column, classes: int) -> Column:
    """Probabilities to a one-hot array at the first largest entry."""
    at = F.array_position(a, F.array_max(a))
    return F.array(*[(at == i + 1).cast("int") for i in range(classes)])


def one_hot(index: Column, classes: int) -> Column:
    return F.array(*[(index == i).cast("int") for i in range(classes)])


def pad_to(a: Column, n: int, filler: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(filler, n)), 1, n)


def index_dot(a: Column) -> Column:
    """Sum of value times 1-based index: a compact fingerprint of an array."""
    return F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
