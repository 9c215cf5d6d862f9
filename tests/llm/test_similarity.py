from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickweave.llm import queries, similarity
from tickweave.llm.graph import connected_components
from tickweave.llm.similarity import folded, keep_one_per_class, near_duplicate_classes, parity_sketch, prefix_signatures


def sets_of(rows):
    out = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(rows):
    sets = sets_of(rows)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(sets)), 2):
        x, y = sets[i][1], sets[j][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[max(top(i), top(j))] = min(top(i), top(j))
    names = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            names[top(i)] = min(names.get(top(i), doc), doc)
    return Counter((doc, len(s), names.get(top(i), doc) if s else doc) for i, (doc, s) in enumerate(sets))


def test_whole_table_against_all_pairs(spark, folder, documents):
    got = queries.ngram_jaccard_join(spark, folder).collect()
    assert Counter(tuple(r) for r in got) == brute([(r.doc_id, r.text) for r in documents])


def test_chains_of_edited_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows, n = [], 0
    for family in range(6):
        words = [f"f{family}_{w}" for w in base]
        for _ in range(40):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            words[int(rng.integers(0, 60))] = f"new{n}"
    rows += [(n + i, "one two three four") for i in range(3)] + [(n + 10, "one two three five"), (n + 11, "one"), (n + 12, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicate_classes(docs).select("id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_frequent_tokens_are_indexed_in_pairs_without_losing_links(spark):
    """Every set shares its frequent shingles with hundreds of others, so links are found through pairs."""
    rng = np.random.default_rng(5)
    pool = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = pool * 8
        for j in rng.integers(0, len(words), 6):
            words[int(j)] = f"q{int(rng.integers(0, 3))}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicate_classes(docs).select("id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 17, 40, 200, 700):
        for df in (5, 500):
            for _ in range(20):
                x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
                n_x = len(x)
                lost = int(rng.integers(0, n_x // 9 + 1))
                y = np.unique(np.concatenate([x[lost:], rng.integers(1, 2**63, lost).astype(np.uint64)]))
                if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
                    continue
                freq = {t: df + int(t % np.uint64(7)) for t in np.union1d(x, y)}
                a = prefix_signatures(x, np.array([freq[t] for t in x]), n_x, 80)
                b = prefix_signatures(y, np.array([freq[t] for t in y]), len(y), 80)
                assert set(a) & set(b)


def test_odd_documents(spark, odd_docs, no_docs):
    got = near_duplicate_classes(odd_docs).select("id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    kept = keep_one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect() if r.doc_id is not None)
    assert (1, "word0") in ids and (2, "word0") not in ids and (7, "word0") not in ids and (10, "same ") in ids
    assert near_duplicate_classes(no_docs).count() == 0 and keep_one_per_class(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 200), (300, 301), (None, 5)], "u long, v long")
    roots = {r.node: r.root for r in connected_components(edges, "u", "v").collect()}
    assert {roots[i] for i in range(101)} == {0} and roots[200] == 200 and roots[301] == 300


def test_signatures_of_the_same_sets_are_folded(spark):
    """Two sets that share a hundred signatures are one candidate pair, not a hundred."""
    rows = [(sig, sid.encode(), 9) for sig in range(100) for sid in ("x", "y")] + [(100, b"x", 9), (100, b"z", 9), (101, b"x", 9)]
    got = folded(spark.createDataFrame(rows, "sig long, sid binary, n int")).groupBy("sig").agg(F.collect_set("sid").alias("s")).collect()
    assert sorted(sorted(bytes(x) for x in r.s) for r in got) == [[b"x", b"y"], [b"x", b"z"]]


def test_sketches_never_differ_in_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(7)
    for n in (3, 40, 400, 4000):
        x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        for lost in (0, 1, n // 9, n):
            y = np.unique(np.concatenate([x[lost:], rng.integers(1, 2**63, lost).astype(np.uint64)]))
            bits = int(np.bitwise_count((parity_sketch(x) ^ parity_sketch(y)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (lost > 0)


def test_messages_of_repeats_do_not_grow_with_the_parts():
    """A hash took up to 24 bytes when a message named its sets anew for each part."""
    rng = np.random.default_rng(9)
    sets = [(i, -i, rng.integers(1, 2**63, 200).astype(np.uint64)) for i in range(100)]
    sent = {parts: sum(f[["owners", "hashes", "known", "own"]].map(len).to_numpy().sum() for f in similarity._repeat_messages(iter(sets), parts))
            for parts in (8, 2000)}
    assert sent[2000] == sent[8] <= 7 * 100 * 200


def test_heavily_edited_copies_of_one_text_make_few_rows(spark, monkeypatch):
    """Copies that share their base and seldom link: bounds leave few pairs, blocks of a crowded signature lose none."""
    monkeypatch.setattr(similarity, "BLOCK_SETS", 16)
    rng = np.random.default_rng(11)
    base, rows = [f"b{i}" for i in range(200)], []
    for n in range(90):
        words = list(base)
        for j in rng.integers(0, 200, int(rng.integers(2, 12))):
            words[int(j)] = f"e{int(rng.integers(0, 40))}"
        rows.append((n, " ".join(words)))
    kept = []
    real = similarity._close_pairs
    monkeypatch.setattr(similarity, "_close_pairs", lambda percent: kept.append(percent) or real(percent))
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_shingles", "component_id").collect()
    assert kept and Counter(tuple(r) for r in got) == brute(rows)
    sids = [bytes([i]) for i in range(60)]
    far = [np.unique(rng.integers(1, 2**63, 300).astype(np.uint64)) for _ in sids]
    frame = pd.DataFrame({"sig": 1, "low": 0, "high": 0, "block": 0, "sid": sids, "n": [len(x) for x in far], "root": sids,
                          "sketch": [parity_sketch(x) for x in far]})
    assert len(real(80)(frame)) == 0
    frame.at[5, "sketch"] = frame.at[9, "sketch"]
    assert real(80)(frame).values.tolist() == [[sids[5], sids[9]]]


def test_close_pairs_of_a_crowd_take_little_memory():
    import tracemalloc
    names = [bytes([i % 251, i // 251]) * 8 for i in range(1_000)]
    sketch = similarity.parity_sketch(np.arange(50, dtype=np.uint64))
    frame = pd.DataFrame({"sig": 1, "low": 0, "high": 0, "block": 0, "sid": names, "n": 50, "root": names, "sketch": [sketch] * len(names)})
    tracemalloc.start()
    got = similarity._close_pairs(80)(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    names.sort()
    assert len(got) == 1_000 * 999 // 2 and (got["u"] < got["v"]).all()
    assert set(zip(got["u"][:2_000], got["v"][:2_000])) <= {(u, v) for i, u in enumerate(names) for v in names[i + 1:]}
    assert peak < 80 * len(got)
