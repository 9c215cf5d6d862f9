import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tickweave.llm import queries, toxicity


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.subword_bag_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    rest = [(got[d].predicted, t) for d, t in labels.items() if d in got and held_out(d)]
    # some labels of this table are wrong on purpose
    assert np.mean([p == t for p, t in rest]) > 0.95 and np.mean([p for p, t in rest if t]) > 0.6
    assert np.mean([p for p, t in rest if not t]) < 0.01


def taught(spark, clean=300, bad=80):
    words = [f"{a}{b}{c}" for a in ("lo", "ma", "ti", "ru", "se") for b in ("ran", "vel", "nok", "pim") for c in ("ta", "do", "lis", "ge")]
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(words, 10 + i % 90)), 0) for i in range(clean)]
    for i in range(clean, clean + bad):
        text = list(rng.choice(words, 10 + i % 90))
        text[i % 10] = ("horrible", "nasty", "wretched")[i % 3]
        docs.append((i, " ".join(text), 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    return frame.drop("toxic"), frame.drop("text"), words


def test_scores_are_those_of_the_most_toxic_window(spark):
    docs, labels, words = taught(spark)
    logits, slope, height = model = toxicity.learn(docs, labels, F.lit(True))
    texts = ["Nasty, " + " ".join(words[:30]), " ".join(words[:40]), "wretchedd " + " ".join(words[:9]), "horribl3", "", None, "...", " ".join(words * 50) + " horrible"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.score for r in toxicity.scored(frame, model).collect()}
    for i, text in enumerate(texts):
        seen = list(dict.fromkeys(w.strip(toxicity.TRIM) for w in (text or "").lower().split()))
        seen = [w for w in seen if w]
        z = [np.mean([logits[p] for p in toxicity.subwords([w])[1]]) for w in seen]
        starts = sorted({*range(0, max(len(z) - toxicity.WINDOW, 0), toxicity.WINDOW), max(len(z) - toxicity.WINDOW, 0)})
        best = max((np.mean(z[s:s + toxicity.WINDOW]) for s in starts), default=None) if z else None
        want = 0 if best is None else 1 / (1 + math.exp(-np.clip(slope * (best + logits[-1]) + height, -500, 500)))
        assert abs(got[i] - want) < 1e-5
    assert got[0] > 0.5 > got[1] and got[2] > 0.5 and got[7] > 0.5 and got[4] == got[5] == got[6] < 0.01


def test_subwords_by_hand():
    rows, places = toxicity.subwords(["abcd", "é", "abce"])
    assert list(np.bincount(rows)) == [1 + 4 + 3 + 2, 1 + 1, 1 + 4 + 3 + 2]
    of = [set(places[rows == i]) for i in range(3)]
    assert len(of[0] & of[2]) == 2 + 1           # <ab, abc and <abc
    assert all(set(toxicity.subwords([w])[1]) == s for w, s in zip(["abcd", "é", "abce"], of))


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    docs, labels, _ = taught(spark)
    first = toxicity.learn(docs, labels, F.lit(True))
    noisy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (4, None), (5, 7), (99999, 1)], labels.schema))
    again = toxicity.learn(docs.unionByName(docs.limit(100)), noisy, F.lit(True))
    assert np.allclose(first[0], again[0]) and first[1:] == again[1:]
    got = toxicity.toxicity_scores(odd_docs, labels.withColumn("toxic", F.col("doc_id").cast("int") % 2), F.lit(True)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(no_docs, labels, F.lit(True)).count() == 0
    alone = toxicity.toxicity_scores(odd_docs, labels.limit(0), F.lit(True)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]
    only = toxicity.toxicity_scores(docs, labels.where("toxic = 0"), F.lit(True)).agg(F.max("score")).first()[0]
    assert only < 0.01


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXT_PIECE", 20)
    text = " ".join(f"Word{i % 50}," for i in range(500))
    assert toxicity.words_of(text) == [f"word{i}" for i in range(50)]
