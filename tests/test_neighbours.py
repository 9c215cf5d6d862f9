import numpy as np
import pytest

from tickweave.operators import neighbours as NB
from tickweave.operators import weights as WT

SCHEMA = "id long, y int, v array<double>"


def table(seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 6, (7, 4))
    rows = [(i, int(i % 5 == 0), (middles[i % 7] + rng.normal(0, 1, 4)).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, int(i % 2), [1.0, 2.0, 3.0, 4.0]) for i in range(300)]                     # one vector, many copies
    rows += [(2000 + i, 1, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)]                      # ties
    return rows + [(3000, 1, None), (3001, 1, [1.0, None, 0.0, 0.0]), (3002, 1, [float("nan")] * 4), (3003, 1, [1.0]), (3004, 1, [])]


def usable(rows):
    return [r for r in rows if r[2] and len(r[2]) == 4 and all(x is not None and np.isfinite(x) for x in r[2])]


def brute_force(rows, queries, k):
    ids, vs = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    found = {}
    for key, _, v in queries:
        d = np.sqrt(((vs - np.array(v)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort([ids, d]) if ids[i] != key][:k]
        found[key] = [(int(ids[i]), rows[i][1], round(float(d[i]), 9)) for i in order]
    return found


def listed(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["id"], [])) + 1
        found[r["id"]].append((r["neighbour"], r["neighbour_mark"], round(r["distance"], 9)))
    return found


@pytest.mark.parametrize("small", [False, True])
def test_all_nearest_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(NB, "BLOCK_ROWS", 8)
        monkeypatch.setattr(NB, "PIVOTS", 9)
        monkeypatch.setattr(NB, "PIVOT_ROWS", 20)
        monkeypatch.setattr(NB, "QUERY_ROWS", 16)
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    minority = [r for r in usable(rows) if r[1] == 1]
    assert listed(NB.nearest(frame, frame.filter("y = 1"), "id", "v", 5, "y")) == brute_force(usable(rows), minority, 5)
    alone = frame.filter("y = 1")
    assert listed(NB.nearest(alone, alone, "id", "v", 5, "y")) == brute_force(minority, minority, 5)


def test_few_rows(spark):
    frame = spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, 1, [0.0, 3.0]), (3, 1, [5.0, 1.0])], SCHEMA)
    assert listed(NB.nearest(frame, frame, "id", "v", 5, "y"))[1] == [(2, 1, 2.0), (3, 1, 5.0)]
    assert NB.nearest(frame.limit(1), frame.limit(1), "id", "v", 5, "y").count() == 0
    assert NB.nearest(frame.limit(0), frame, "id", "v", 5, "y").count() == 0


def test_synthetic_rows_lie_between_true_neighbours(spark):
    rows = table(2)
    frame = spark.createDataFrame(rows, SCHEMA)
    minority = {r[0]: r[2] for r in usable(rows) if r[1] == 1}
    near = brute_force([(i, 1, v) for i, v in minority.items()], [(i, 1, v) for i, v in minority.items()], 5)
    for density in (False, True):
        got = WT.synthetic_minority(frame, "v", "y", 1, "id", k=5, per_row=2, density=density).collect()
        usual = len(minority) * 2
        assert len(got) == (usual if density else 2 * len([i for i in minority if near[i]]))
        for r in got:
            assert r["neighbour"] in [n for n, *_ in near[r["id"]]]
            a, b, p = (np.array(x) for x in (minority[r["id"]], minority[r["neighbour"]], r["v"]))
            assert abs(np.linalg.norm(p - a) + np.linalg.norm(b - p) - np.linalg.norm(b - a)) < 1e-9


def test_visits_are_written_in_small_frames(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK_ROWS", 8)
    monkeypatch.setattr(NB, "PIVOT_ROWS", 20)
    monkeypatch.setattr(NB, "VISITS", 3)
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert listed(NB.nearest(frame, frame.filter("y = 1"), "id", "v", 5, "y")) == brute_force(usable(rows), [r for r in usable(rows) if r[1] == 1], 5)
