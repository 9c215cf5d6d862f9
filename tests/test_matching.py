import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import features as X
from tickweave.operators import matching
from tickweave.series import lay_out


def plain_matches(data, window=None):
    n, found = len(data), {}
    points = range(1, n // 2 + 1) if window is None else range(window, n - window + 1)
    for i in points:
        reach = i if window is None else window
        best = 0
        for j in range(i - reach, i):
            length = 0
            while length < reach and i + length < n and data[j + length] == data[i + length]:
                length += 1
            best = max(best, length)
        found[i] = best
    return found


def sequences():
    rng = np.random.default_rng(4)
    return {"random": rng.integers(0, 3, 700).tolist(), "constant": [5] * 150, "period": [1, 2, 3, 1, 2] * 40, "short": [1, 1], "one": [4],
            "copied": (lambda x: x + [9] + x + [8] + x)(rng.integers(0, 5, 120).tolist()), "nulls": [None, 1, None, 1, None, 1, 2, None]}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, i, v, "x") for k, data in sequences().items() for i, v in enumerate(data)]
    return lay_out(spark.createDataFrame(rows, "symbol string, ts long, s long, _gram string"), ["symbol"], ["ts"], parts=7)


@pytest.mark.parametrize("gram,block", [(16, 1 << 20), (2, 32)])
def test_matches_of_whole_keys(series, monkeypatch, gram, block):
    monkeypatch.setattr(matching, "GRAM", gram)
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)
    got = {(r.symbol, r._pos): r._match for r in matching.match_lengths(series, F.col("s")).collect()}
    want = {(k, i): m for k, data in sequences().items() for i, m in plain_matches(data).items()}
    assert got == want


def test_matches_in_windows(spark):
    data = sequences()
    rows = [(k, i, v) for k, d in data.items() for i, v in enumerate(d)]
    small = lay_out(spark.createDataFrame(rows, "symbol string, ts long, s long"), ["symbol"], ["ts"], chunk_rows=64)
    got = {(r.symbol, r._pos): r._match for r in matching.windowed_match_lengths(small, F.col("s"), 20).collect()}
    assert got == {(k, i): m for k, d in data.items() for i, m in plain_matches(d, 20).items()}


def test_entropy_of_a_long_key(spark):
    data = np.random.default_rng(8).integers(0, 4, 5000).tolist()
    data[3000:3400] = data[100:500]
    rows = spark.createDataFrame(list(enumerate(data)), "ts long, s long")
    got = matching.sequence_entropy(lay_out(rows, [], ["ts"]), F.col("s")).first()
    text = "".join(map(str, data))
    total = 0.0
    for i in range(1, 2501):
        best = 0
        while best < i and text.find(text[i:i + best + 1], 0, i + best) >= 0:
            best += 1
        total += math.log2(i + 1) / (best + 1)
    assert got.n_points == 2500 and abs(got.entropy - total / 2500) < 1e-9
    assert abs(got.redundancy - (1 - got.entropy / math.log2(5000))) < 1e-12


def test_no_rows(spark):
    rows = spark.createDataFrame([], "symbol string, ts long, s long")
    assert matching.sequence_entropy(lay_out(rows, ["symbol"], ["ts"]), F.col("s")).count() == 0
    assert matching.sequence_entropy(lay_out(rows, ["symbol"], ["ts"]), F.col("s"), 5).count() == 0


@pytest.mark.parametrize("rows", [40, 1 << 20])
def test_dictionary_is_handed_on_from_run_to_run(series, rows):
    from tickweave.operators import features as X
    got = {r.symbol: r.n_phrases for r in X.dictionary_of(series, F.col("s"), rows).collect()}
    assert got == {k: X.dictionary_size(data) for k, data in sequences().items()}


def test_windows_that_share_matches_equal_one_at_a_time():
    rng = np.random.default_rng(1)
    for symbols, n in ((2, 60), (5, 300), (30, 200), (1, 50)):
        data = rng.integers(0, symbols, n)
        data[n // 3:n // 3 + 20] = data[:20]
        end = np.sort(rng.integers(0, n + 1, 80))
        first = np.minimum(np.maximum(0, end - rng.integers(0, n, 80)), end)
        got = X.window_entropies(data, first, end)
        assert np.array_equal(got, [X.match_entropy(data[a:b])[0] for a, b in zip(first, end)], equal_nan=True)


def test_entropy_rate_of_trailing_time(spark):
    rows = [("x", (i // 2) * 10, None if i % 9 == 4 else i * i % 5) for i in range(80)] + [("y", 0, 1), ("x", None, 2)]
    series = lay_out(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "symbol string, ts long, s long, id long"), ["symbol"], ["ts", "id"])
    got = {r.id: r.entropy_rate for r in X.entropy_rate(series, F.col("s"), "ts", 100).collect()}
    assert set(got) == {i for i in range(80) if rows[i][1] >= 100}
    for i, rate in got.items():
        t = rows[i][1]
        held = [s for _, u, s in rows[:80] if t - 100 <= u <= t and s is not None]
        assert rate == X.match_entropy(held)[0]
