import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import evaluation as EV
from tickweave.session import stored


def _logistic(regParam=0.01):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(maxIter=3, regParam=regParam, weightCol="weight")


@pytest.fixture(scope="module")
def splits(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, 240), rng.normal(0, 1, 240)
    rows = [(i, f, "test" if i % 2 == f else "train", float(a[i]), float(b[i]), int(a[i] + rng.normal(0, 0.5) > 0)) for i in range(240) for f in (0, 1)]
    return spark.createDataFrame(rows, "id long, fold int, role string, a double, b double, y int")


@pytest.fixture
def counted(monkeypatch):
    calls = {"stored": 0, "lay_out": 0}
    for name in calls:
        def spied(*args, _name=name, _keep=getattr(EV, name), **more):
            calls[_name] += 1
            return _keep(*args, **more)
        monkeypatch.setattr(EV, name, spied)

    def refuse(*_):
        raise AssertionError("a checkpoint is read whole by every fit")
    monkeypatch.setattr(EV, "settle", refuse)
    return calls


def test_rows_of_a_fold_lie_apart(spark, splits):
    table = stored(splits, ["fold", "role"])
    assert table.schema == splits.schema and sorted(table.collect()) == sorted(splits.collect())
    names = table.select(F.input_file_name().alias("f"), "fold", "role").distinct().collect()
    assert all(f"/fold={r.fold}/role={r.role}/" in r.f for r in names)


def test_features_are_permuted_once_a_fold(splits, counted):
    got = {r.feature: r["mean"] for r in EV.permutation_importance(splits, ["a", "b"], "y", _logistic, ["id"]).collect()}
    assert counted["lay_out"] == 2 * 2 and set(got) == {"a", "b"} and got["a"] > abs(got["b"])


def test_permuted_columns_equal_single_permutations(splits):
    test = splits.filter("fold = 0 AND role = 'test'").select("id", "a", "b")
    both = {r.id: r for r in EV.permuted(test, ["a", "b"], ["id"], 3).collect()}
    plain = {r.id: r for r in test.collect()}
    assert all(both[i].a == plain[i].a and both[i].b == plain[i].b for i in plain)
    for c in ("a", "b"):
        single = {r.id: r[c] for r in EV.permute(test, c, ["id"], 3).collect()}
        assert single == {i: both[i][f"_moved_{c}"] for i in both} and sorted(single.values()) == sorted(r[c] for r in plain.values())


def test_splits_are_stored_once_for_all_fits(splits, counted):
    single = {r.feature: r["mean"] for r in EV.single_feature_importance(splits, ["a", "b"], "y", _logistic).collect()}
    assert counted["stored"] == 1 and single["a"] > single["b"]
    found = EV.grid_search(splits, ["a", "b"], "y", _logistic, [{"regParam": 0.01}, {"regParam": 50.0}]).collect()
    assert counted["stored"] == 2 and [r.setting for r in found] == [0, 1]
