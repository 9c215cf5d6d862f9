import hashlib
from collections import Counter

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from tickweave.llm import queries, repeats
from tickweave.llm.common import text_key
from tickweave.llm.repeats import RunLengthIndex, contexts_of, without_repeats


def brute(rows, length=400):
    raws = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(raw[i:i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = Counter()
    for doc, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got_of(df):
    return Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_whole_table_against_all_strings(spark, folder, documents):
    got = Counter(tuple(r) for r in queries.run_length_repeats(spark, folder).collect())
    assert got == brute([(r.doc_id, r.text) for r in documents])


def test_shared_passages_periods_and_crowded_anchors(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij "), 30))
    passage = "".join(word() for _ in range(12))
    other = "".join(word() for _ in range(5))
    rows = [(i, word() + passage[:360 + 20 * (i % 4)] + word()) for i in range(12)]
    rows += [(20, "ab" * 700), (21, "x" * 1200), (22, "x" * 399), (23, "x" * 400), (24, passage + other), (25, other + passage), (26, other), (26, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 100)
    assert got_of(without_repeats(docs, length=100, gram=16)) == want
    assert got_of(without_repeats(docs, length=100, gram=16, crowded=2)) == want        # edges counted window by window
    assert got_of(without_repeats(docs)) == brute(rows)


def test_copies_of_a_text_are_cut_once(spark):
    docs = spark.createDataFrame([(i, "copy " * 100) for i in range(40)] + [(90, "other " * 90), (91, "not wanted")], "doc_id long, text string").repartition(4)
    rows = docs.select(text_key("text")["a"].alias("a"), text_key("text")["b"].alias("b"), "text")
    wanted = rows.where("text <> 'not wanted'").distinct().select(
        "a", "b", F.lit(1).cast("long").alias("anchor"), F.col("a").alias("context"), F.lit(0).alias("first"), F.lit(400).alias("size"))
    for most in (30_000, 0):                    # lists broadcast, lists joined by a shuffle
        got = repeats._texts_with(rows, wanted, most).collect()
        assert sorted((r.text, len(r.wanted)) for r in got) == [("copy " * 100, 1), ("other " * 90, 1)]


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got_of(without_repeats(odd_docs)) == brute(rows)
    assert without_repeats(no_docs).count() == 0


def test_matching_statistics_against_all_suffixes():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.choice(list(b"ab"), int(n)).tolist()) for n in rng.integers(1, 40, 12)] + [b"abab" * 8] * 3
    index = RunLengthIndex(strings)
    got = index.matching_statistics()
    suffixes = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i in suffixes:
        best = 0
        for m, j in suffixes:
            if (m, j) != (k, i):
                x, y, n = strings[k][i:], strings[m][j:], 0
                while n < min(len(x), len(y)) and x[n] == y[n]:
                    n += 1
                best = max(best, n)
        assert got[index.starts[k] + i] == best
    assert index.run_lengths.sum() == index.n and len(index.run_symbols) < index.n


def test_every_window_is_in_one_context():
    data = np.frombuffer(bytes(np.random.default_rng(6).integers(97, 105, 3000).tolist()), np.uint8)
    places = [f + i for _, f, size, _ in contexts_of(data) for i in range(size - 400 + 1)]
    assert places == list(range(3000 - 400 + 1))


def test_texts_that_nothing_is_cut_from_are_not_shuffled(spark):
    """Above 30,000 texts with contexts all texts went through the shuffle; their keys are still few enough to filter by."""
    rows = spark.range(40_000).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").cast("string").alias("text"))
    wanted = rows.where("a < 35000").select("a", "b", F.lit(1).alias("anchor"), F.lit(1).alias("context"), F.lit(0).alias("first"),
                                            F.lit(1).alias("size"))
    got = repeats._texts_with(rows, wanted)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 35_000


def test_a_shard_is_indexed_in_pieces_of_whole_anchors(monkeypatch):
    rng = np.random.default_rng(5)
    shared = [rng.integers(97, 123, 120, np.uint8).tobytes() for _ in range(30)]
    bodies = [(anchor, k, bytes([65 + k]) + shared[anchor] + bytes([75 + k]) * 50) for k in range(4) for anchor in range(30)]
    frame = pd.DataFrame(bodies, columns=["anchor", "context", "body"])
    whole = RunLengthIndex(list(frame["body"]), 100).long_matches(100)
    sizes, make = [], repeats.RunLengthIndex
    monkeypatch.setattr(repeats, "RunLengthIndex", lambda strings, *a: sizes.append(sum(map(len, strings))) or make(strings, *a))
    monkeypatch.setattr(repeats, "PIECE_BYTES", 2_000, raising=False)
    got = repeats._index_shard(100)(frame)
    assert max(sizes) <= 2_000 and sum(sizes) == frame["body"].map(len).sum()
    # every body shares its passage with the others of its anchor
    assert whole == [[(1, 121)]] * len(bodies) and len(got) == len(bodies)
    assert all([(s["start"], s["stop"]) for s in spans] == [(1, 121)] for spans in got["spans"])
    assert repeats.index_pieces(np.array([1, 1, 2, 3, 3]), np.array([5, 5, 3, 9, 9]), 12) == [(0, 2), (2, 3), (3, 5)]
    assert repeats.index_pieces(np.array([], np.int64), np.array([], np.int64), 12) == []


def test_few_rows_are_gathered_at_a_time():
    text = "".join(np.random.default_rng(6).choice(list("abcdefghij "), 700))
    wanted = [[{"anchor": 1, "context": 2, "first": 0, "size": 700} for _ in range(200)]]
    frames = list(repeats._cut(["anchor", "context", "at", "window"], False, 400)(iter([pd.DataFrame({"text": [text], "wanted": wanted})])))
    assert sum(map(len, frames)) == 200 * 301 and max(map(len, frames)) <= 31_000
