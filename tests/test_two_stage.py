import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import evaluation as EV
from tickweave.operators import splits as SP
from tickweave.series import lay_out


def logistic(regParam=0.01):
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(maxIter=20, regParam=regParam, weightCol="weight")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    up = (a + 0.3 * rng.normal(0, 1, 400) > 0).astype(int)
    ret = np.where(up, 1.0, -1.0) * np.where(b > 0, 1.0, rng.choice([-1.0, 1.0], 400))
    data = [(i, i, i + 5, float(x), float(y), int(u), float(r)) for i, (x, y, u, r) in enumerate(zip(a, b, up, ret))]
    return spark.createDataFrame(data, "id long, ts long, t1 long, a double, b double, up int, ret double")


def test_every_row_is_predicted_by_a_model_that_never_saw_it(spark, rows):
    splits = SP.purged_kfold(lay_out(rows, [], ["ts", "id"]), "ts", "t1", 4, embargo=0.02)
    got = EV.out_of_fold(splits, ["a", "b"], "up", logistic, ["id"]).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(400)) and got["fold"].tolist() == sorted(got["fold"])
    assert (got["predicted"] == got["actual"]).mean() > 0.85
    # one fold again, fitted by hand
    ready = EV.assembled(splits.filter("fold = 2"), ["a", "b"], "up", None, ["id", "role"])
    want = logistic().fit(ready.filter("role = 'train'")).transform(ready.filter("role = 'test'")).toPandas().set_index("id")
    mine = got[got["fold"] == 2].set_index("id")
    assert all(abs(mine.at[i, "prob"] - want.at[i, "probability"][1]) < 1e-9 for i in want.index)
    scores = EV.fold_scores(splits, ["a", "b"], "up", logistic).toPandas()
    assert len(scores) == 4 and scores["log_loss"].max() < 0.5


def test_second_stage_learns_when_the_side_pays(spark, rows):
    splits = SP.purged_kfold(lay_out(rows, [], ["ts", "id"]), "ts", "t1", 4)
    got = EV.two_stage(splits, ["a", "b"], "up", "ret", logistic, ["id"]).toPandas().set_index("id").sort_index()
    first = EV.out_of_fold(splits, ["a", "b"], "up", logistic, ["id"]).toPandas().set_index("id").sort_index()
    base = rows.toPandas().set_index("id").sort_index()
    assert (got["side"] == 2 * first["predicted"] - 1).all()
    assert (got["bin"] == (base["ret"] * got["side"] > 0).astype(int)).all()
    assert got["size"][base["b"] > 0.5].mean() > got["size"][base["b"] < -0.5].mean() + 0.1


def test_each_path_holds_every_row_once(spark, rows):
    series = lay_out(rows, [], ["ts", "id"])
    paths = spark.createDataFrame(SP.test_paths(4, 2), "combo int, fold int, path int")
    splits = SP.combinatorial_kfold(series, "ts", "t1", 4, 2, embargo=0.03)
    got = EV.signals_by_path(splits, paths, ["a", "b"], "up", logistic, ["id"]).toPandas()
    assert sorted(got["path"].unique()) == [0, 1, 2] and got["signal"].between(-1, 1).all()
    for _, part in got.groupby("path"):
        assert sorted(part["id"]) == list(range(400)) and ((part["signal"] > 0) == (part["actual"] == 1)).mean() > 0.85
    # the embargo keeps rows after a test fold out of training, also at the end of the data
    roles = splits.toPandas()
    folds = series.df.count() // 4
    for combo, part in roles.groupby("combo"):
        tests = set(part[part["role"] == "test"]["fold"])
        train = set(part[part["role"] == "train"]["id"])
        for f in tests:
            after = range((f + 1) * folds, min((f + 1) * folds + 12, 400))
            assert not train & set(after)


def test_grid_on_one_table(spark, rows):
    splits = SP.purged_kfold(lay_out(rows, [], ["ts", "id"]), "ts", "t1", 3)
    grid = [{"regParam": v} for v in (0.001, 0.1, 10.0)]
    got = EV.grid_search(splits, ["a", "b"], "up", logistic, grid).collect()
    assert [r.setting for r in got][-1] == 2 and got[0].score < got[-1].score
    alone = EV.fold_scores(splits, ["a", "b"], "up", lambda: logistic(10.0)).agg(F.avg("log_loss")).first()[0]
    assert abs([r.score for r in got if r.setting == 2][0] - alone) < 1e-12
