import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickweave.llm import decontamination, mixing, neighbours, queries, sharding


def test_shards_are_balanced_and_whole(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.vector_bin_packing(spark, folder).toPandas()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(got["doc_id"]) == sorted(docs) and set(got["shard"]) <= set(range(24))
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = got.groupby("shard")[["size", "n_tokens"]].sum()
    assert (sums["size"].max() - sums["size"].min()) / sums["size"].mean() < 0.05
    assert got["shard"].value_counts().max() <= 1.3 * len(got) / 24
    assert got.groupby(got["doc_id"].map(docs))["shard"].nunique().max() == 1


def test_large_groups_are_split_and_odd_rows_kept(spark, odd_docs, no_docs):
    rows = [(i, "copy " * 50) for i in range(600)] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed, _ = sharding.sharded(docs, 24)
    got = sharding.with_slots(placed, 24).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 1500 and len(sums) == 24 and (sums.max() - sums.min()) / sums.mean() < 0.12
    placed, assign = sharding.sharded(odd_docs, 3)
    assert sharding.with_slots(placed, 3).count() == odd_docs.count()
    assert sharding.sharded(no_docs, 3)[0].count() == 0
    assert assign(odd_docs.drop("shard")).where("shard is null").count() == 0


def test_packing_takes_the_highest_dot_product():
    residual = np.array([[1.0, 0.2, 1.0], [0.5, 1.0, 1.0]])
    assert list(sharding.pack(np.array([[0.0, 0.5, 0.0]]), residual.copy())) == [1]
    assert list(sharding.pack(np.array([[0.6, 0.0, 0.0]]), residual.copy())) == [0]


def test_mixture_matches_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.execute(queries.ORACLES["op5_raked_mixture"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.raked_mixture(spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got["kept"] == want["kept"]).all() and (got["topic"] == want["topic"]).all() and (got["n_tokens"] == want["n_tokens"]).all()
    assert np.allclose(got["probability"], want["probability"], atol=1e-9) and got["probability"].max() == 1


def test_raked_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame([("a", "x", 50.0), ("a", "y", 10.0), ("b", "x", 20.0), ("b", "y", 20.0), (None, "y", 5.0)], "source string, lang string, mass double")
    targets = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.5), (None, 0.2)], "source string, target double"),
               "lang": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "lang string, target double")}
    got = mixing.rake(cells, targets, rounds=60).toPandas()
    assert np.allclose(got.groupby("lang")["weight"].sum(), [0.4, 0.6], atol=1e-6)
    assert np.allclose(got.groupby("source", dropna=False)["weight"].sum(), [0.3, 0.5, 0.2], atol=1e-6)


def test_mixture_of_odd_documents(spark, odd_docs, no_docs):
    got = mixing.mixed(odd_docs)
    assert got.count() == odd_docs.count() and got.where("probability is null or kept is null").count() == 0
    kept = mixing.sampled_mixture(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == got.where("kept").count()
    assert mixing.mixed(no_docs).count() == 0 and mixing.sampled_mixture(no_docs).count() == 0


def brute_overlaps(docs, items):
    """Documents and items with a window of 13 words of which 11 agree, by comparing all windows."""
    hashes = decontamination.PlainWordHashes()
    words = lambda t: hashes.words_of(t)
    out = set()
    for item, text in items:
        w = words(text)
        k = min(len(w), 13)
        if k < 5:
            continue
        need = 11 if k == 13 else k
        windows = np.lib.stride_tricks.sliding_window_view(w, k)
        for doc, body in docs:
            d = words(body)
            if len(d) >= k:
                own = np.lib.stride_tricks.sliding_window_view(d, k)
                if any(((own == x).sum(axis=1) >= need).any() for x in windows):
                    out.add((doc, item))
    return out


def test_contamination_against_all_windows(spark, folder, documents):
    got = {(r.doc_id, r.item_id) for r in queries.spaced_seed_decontamination(spark, folder).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == brute_overlaps([(r.doc_id, r.text) for r in documents], items) and got


def test_two_substitutions_are_tolerated_anywhere(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(13)]
    rows, n = [], 0
    for i in range(13):
        for j in range(i + 1, 13):
            body = list(words)
            body[i], body[j] = "X", "Y"
            rows.append((n, "before it " + " ".join(body).upper() + ". After"))
            n += 1
    rows += [(900, " ".join(["Z", "Z", "Z", *words[3:]])), (901, "short item of five"), (902, "a short item, of five words"), (903, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short item of five words"), (3, "short item"), (4, None), (5, "")], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(i, 1) for i in range(n)} | {(902, 2)}
    assert {r.doc_id for r in decontamination.clean_documents(docs, bench).collect()} == {900, 901, 903}
    assert decontamination.clean_documents(odd_docs, bench).count() == odd_docs.count()
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.clean_documents(odd_docs, bench.limit(0)).columns == odd_docs.columns


def exact_neighbours(rows, queries_, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in queries_:
        near = sorted((float(np.sqrt(((np.array(v, float) - x) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = near[:k]
    return out


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = exact_neighbours(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = queries.pruned_graph_neighbours(spark, folder).toPandas()
    hits = sum(len({i for _, i in near} & set(got.loc[got["query_id"] == q, "vec_id"])) for q, near in want.items())
    assert hits >= 0.95 * 10 * len(want) and (got.groupby("query_id").size() == 10).all()
    exact = {(q, i): d for q, near in want.items() for d, i in near}
    for r in got.itertuples():
        assert (r.query_id, r.vec_id) not in exact or abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(300 + i, [float(i), 0.5]) for i in range(1, 40)]
    rows += [(500, None), (501, [0.0, 0.0]), (502, [1.0, None]), (503, [float("nan"), 1.0]), (504, [1.0, 2.0, 3.0]), (505, []), (None, [1.0, 1.0]), (0, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v) and any(v)})
    asked = vectors.where("vec_id % 100 = 0")
    got = neighbours.nearest(vectors, asked, 10).toPandas()
    want = exact_neighbours(good, [r for r in good if r[0] % 100 == 0], 10)
    for q, near in want.items():
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["vec_id"]) == [i for _, i in near] and np.allclose(mine["score"], [d for d, _ in near])
    assert neighbours.nearest(vectors.limit(0), asked.limit(0), 10).count() == 0
    three = vectors.where("vec_id in (0, 310, 311)")
    assert neighbours.nearest(three, three.where("vec_id = 0"), 10).count() == 2


def test_pipeline_stages_take_effect(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before
    done = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in done.collect()) == Counter(r.doc_id for r in kept.collect())
    assert done.where("shard is null or shard < 0 or shard > 23").count() == 0
    # by brute force: near duplicates and contaminated documents are gone
    from test_similarity import brute
    texts = {r.doc_id: r.text for r in documents}
    left = [r.doc_id for r in done.collect()]
    assert len({c for _, _, c in brute([(d, texts[d]) for d in left])}) == len(left)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not brute_overlaps([(d, texts[d]) for d in left], items)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_no_documents(spark, folder, odd_docs, no_docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = odd_docs.drop("shard") if stage == "sharding" else odd_docs
    got = run(spark, plain, folder)
    assert got.columns[:len(plain.columns)] == plain.columns and got.count() <= plain.count()
    assert run(spark, no_docs.drop("shard"), folder).count() == 0
    assert F is not None


def test_columns_named_like_internal_ones_stay_as_they_are(spark, odd_docs):
    """Stages keep every column of the user; only ``shard`` is replaced by the sharding stage."""
    from tickweave.llm import similarity
    names = ["_own_a", "_own_b", "_own_id", "_kept_id", "_key_a", "_cell_source", "_keep_p", "topic", "drawn_id", "_split_a", "_placed_a",
             "_piece", "_large_shard", "own_a", "a", "b", "part"]
    docs = odd_docs.select("*", *[F.concat(F.lit(n), F.col("n").cast("string")).alias(n) for n in names])
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    benchmark = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    stages = [similarity.keep_one_per_class(docs), decontamination.clean_documents(docs, benchmark), mixing.sampled_mixture(docs),
              corpus_pipeline.into_shards(spark, docs, "")]
    for i, out in enumerate(stages):
        rows = out.collect()
        assert rows and {(r["doc_id"], r["text"]) for r in rows} <= before
        assert sorted(out.columns) == sorted(docs.columns)
        assert all(r[n] == f"{n}{r['n']}" for r in rows for n in names)
        if i == 3:
            assert len(rows) == docs.count() and {r["shard"] for r in rows} <= set(range(24)) and len({r["shard"] for r in rows}) > 1
