import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickweave.llm import language, quality, queries, scoring


def fold(doc, parts):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % parts == 2


def test_base_scores_and_better_model(spark, folder, documents):
    got = {r.doc_id: r for r in queries.bloom_filter_scores(spark, folder).collect()}
    lists = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in documents}
    c = Counter(w for doc, words in lists.items() if not fold(doc, 7) for w in words)
    n, v = sum(c.values()), len(c)
    base = model = 0
    for doc, words in lists.items():
        r = got[doc]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(doc, 7), len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_filter_never_reads_a_pair_too_low(spark, documents):
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in documents], "doc_id long, text string")
    model = scoring.learn(docs)
    hashes = scoring.WordHashes()
    blocks = [scoring.tokens_of(r.text, hashes) for r in documents]
    pairs = np.concatenate([scoring.pair_hashes(t, np.array([0])) for t in blocks])
    values, counts = np.unique(pairs, return_counts=True)
    read = scoring.pair_levels(model, values)
    right = scoring.levels(counts)
    assert (read >= right).all() and (read == right).mean() > 0.95
    absent = np.random.default_rng(1).integers(1, 2**63, 20_000).astype(np.uint64)
    assert (scoring.pair_levels(model, absent) > 0).mean() < 0.01


def _taught(spark, documents):
    """The model of the rows that teach, its exact pair counts and word counts."""
    train = [r for r in documents if not fold(r.doc_id, 7)]
    model = scoring.learn(spark.createDataFrame([(r.doc_id, r.text) for r in train], "doc_id long, text string"))
    lists = [(r.text or "").encode().lower().split() for r in train]
    words, pairs = Counter(w for ws in lists for w in ws), Counter(p for ws in lists for p in zip(ws, ws[1:]))
    return model, words, pairs


def test_probabilities_after_a_word_sum_to_at_most_one_on_average(spark, documents):
    model, words, _ = _taught(spark, documents)
    hashes = scoring.WordHashes()
    vocabulary = np.append(hashes.of(list(words)), np.uint64(scoring.END))
    c = scoring.word_counts(model, vocabulary)
    sums = []
    for v, n in [*words.most_common(30), *words.most_common()[-30:]]:
        run = np.repeat(hashes.of([v]), 2 * len(vocabulary))
        run[1::2] = vocabulary
        read = scoring.least_count(scoring.pair_levels(model, scoring.pair_hashes(run, np.array([0]))[1::2]))
        read = np.minimum(read, np.minimum(c, n))
        word_p = (c + 1) / (model.total + model.distinct + 1)
        total = ((read + scoring.PRIOR * word_p).sum() + scoring.PRIOR / (model.total + model.distinct + 1)) / (
            n + scoring.PRIOR + model.rate * (model.distinct + 2 * n))
        assert 0.5 < total <= 1 + 5 / (n + scoring.PRIOR), v       # half a false answer is expected, five hardly ever
        sums.append(total)
    assert np.mean(sums) <= 1


def test_scores_follow_those_of_exact_counts(spark, folder, documents):
    """No pair is read above its count but by a false answer, none below half of it."""
    got = {r.doc_id: r for r in queries.bloom_filter_scores(spark, folder).collect()}
    model, words, pairs = _taught(spark, documents)
    taught = [r for r in documents if not fold(r.doc_id, 7)]
    ends = Counter(((r.text or "").encode().lower().split() or [None])[-1] for r in taught)
    starts = Counter(((r.text or "").encode().lower().split() or [None])[0] for r in taught)
    exact = read = tokens = 0
    for r in documents:
        if not fold(r.doc_id, 7):
            continue
        ws = (r.text or "").encode().lower().split()
        before = [(len(taught), None), *[(words[w], w) for w in ws]]
        for i, (n, v) in enumerate(before):
            last, first = i == len(ws), i == 0
            count = len(taught) if last else words[ws[i]]
            pair = (ends[v] if last else starts[ws[i]] if first else pairs[(v, ws[i])]) if ws else ends[None]
            exact += math.log10((pair + 50 * (count + 1) / (model.total + model.distinct + 1)) / (n + 50))
        read, tokens = read + got[r.doc_id].score, tokens + len(ws) + 1
    assert exact - 0.15 * tokens < read < exact + 0.002 * tokens


def test_scoring_asks_the_parts_and_reads_what_the_whole_model_holds(spark, documents, odd_docs, monkeypatch):
    """No table of the model goes to every task; blocks of a few texts get the counts that a look-up in the model gives."""
    rows = [(r.doc_id, r.text) for r in documents[:120]] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = language.held_out("doc_id", 7, 2)
    model, hashes = scoring.learn(docs.where(~held)), scoring.WordHashes()
    n_docs = docs.where(~held).count()
    want = []
    for r in docs.withColumn("held", held).collect():
        tokens = scoring.tokens_of(r.text, hashes)
        c = scoring.word_counts(model, tokens)
        before = np.append(n_docs, c[:-1])
        word_p = (c + 1) / (model.total + model.distinct + 1)
        pair = np.minimum(scoring.least_count(scoring.pair_levels(model, scoring.pair_hashes(tokens, np.array([0])))), np.minimum(before, c))
        p = (pair + scoring.PRIOR * word_p) / (before + scoring.PRIOR + model.rate * (model.distinct + 2 * before))
        want.append((str(r.doc_id), r.held, len(tokens), int((c > 0).sum()), round(np.log10(word_p).sum(), 6), round(np.log10(p).sum(), 6)))

    def refuse(*args):
        raise AssertionError("a table of the model is broadcast")
    monkeypatch.setattr(scoring, "_broadcast", refuse)
    for size in (scoring.BLOCK_BYTES, 20_000):
        monkeypatch.setattr(scoring, "BLOCK_BYTES", size)
        got = scoring.score_texts(docs, held).collect()
        assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_scores_of_odd_documents(spark, odd_docs, no_docs):
    got = scoring.score_texts(odd_docs, language.held_out("doc_id", 7, 2)).collect()
    assert len(got) == odd_docs.count() and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert scoring.score_texts(no_docs, language.held_out("doc_id", 7, 2)).count() == 0
    alone = scoring.score_texts(odd_docs.where("doc_id = 4"), F.lit(True)).collect()       # nothing to learn from
    assert (alone[0].train_tokens, alone[0].n_known, alone[0].base_score) == (0, 0, 0.0)


def test_language_of_held_out_documents(spark, folder, documents):
    got = {r.doc_id: r for r in queries.kneser_ney_language(spark, folder).collect()}
    held = [r for r in documents if fold(r.doc_id, 4)]
    assert all(got[r.doc_id].held_out == fold(r.doc_id, 4) for r in documents)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kneser_ney_sums_to_one():
    words, counts = ["abab", "abc", "ba", "cab", "a"], np.array([5, 3, 2, 2, 9])
    levels = language.fit_language(words, counts)
    frame_rows = [("xx", k, a.tobytes(), b.tobytes(), c.tobytes(), d.tobytes()) for k, (a, b, c, d) in enumerate(levels, 1)]
    import pandas as pd
    models = language._joined(pd.DataFrame(frame_rows, columns=["lang", "k", "keys", "value", "contexts", "passes"]), language.ORDER)
    from itertools import product
    every = ["".join(w) for n in range(7) for w in product("abc", repeat=n)]
    p = dict(zip(every, 2 ** -language.word_costs(models, every)[:, 0], strict=True))
    assert 0.6 < sum(p.values()) <= 1 + 1e-6       # words make up a distribution; long and unseen ones share the rest
    assert p["abab"] > p["bbbb"] and p["a"] > p["ccc"]


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    models = language.fit(odd_docs, F.lit(True))
    got = odd_docs.select("text", language.predictor(spark, models)(F.col("text")).alias("p")).collect()
    for r in got:
        letters = any(ch.isalpha() for ch in r.text or "")
        assert (r.p.lang_pred == "und") == (not letters) and 0 <= r.p.score <= 1
    kept = language.accepted_languages(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 9}
    assert language.fit(no_docs, F.lit(True)) is None and language.accepted_languages(no_docs).count() == 0


def test_quality_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.co_trained_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels}
    right = sum(got[d].keep == g for d, g in good.items() if d in got)
    assert right >= 0.93 * len(good) and all(0 <= r.quality <= 1 for r in got.values())


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (8, 0, None), (9, 1, 1), (None, 1, 0), (4, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert {r.quality for r in quality.quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_every_unlabelled_document_may_be_passed_on(spark):
    rng = np.random.default_rng(8)
    plain = lambda good: [0.0] * 7 + [1.0 if good else 2.0, 0.0, 0.3]
    bag = lambda good, extra: np.array(sorted({5 if good else 6, 7, extra}), np.int32).tobytes()
    import pandas as pd
    goods = rng.random(400) < 0.5
    sample = pd.DataFrame({"bag": [bag(g, 9) for g in goods], "plain": [plain(g) for g in goods], "good": goods})
    rows = [(bytearray(bag(i % 2 == 0, 50 if i % 2 else 51)), plain(i % 2 == 0)) for i in range(12_000)]
    pool = spark.createDataFrame(rows, "bag binary, plain array<double>").repartition(5)
    model = quality.co_train(sample, pool)
    assert model.words[50] >= 0 and model.words[51] >= 0       # words no labelled document holds
    words = quality.choose_words(quality.bucket_counts([np.frombuffer(b, np.int32) for b in sample["bag"]], goods), float((~goods).sum()), float(goods.sum()))
    models = {view: quality.Logistic().fit(quality._matrix(view, sample, words), goods.astype(float), 1.0) for view in ("text", "page")}
    passed = quality.surest(pool, models, words, 0.05, 0.5)
    assert passed.where("text_label is not null").count() == passed.where("page_label is not null").count() == 12_000      # ties pass together
    assert passed.where("text_label <> page_label").count() == 0


def test_newton_sums_over_rows_elsewhere_fit_the_same_model():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    whole = quality.Logistic().fit(x, y, 2.0)
    split = quality.Logistic().fit(x[:200], y[:200], 2.0, lambda sums: sums(x[200:], y[200:]))
    assert np.allclose(whole.logit(x), split.logit(x), atol=1e-6)


def language_texts():
    """Texts of two languages; ten documents of gibberish and two of a language nobody learned are planted under either label."""
    rng = np.random.default_rng(12)
    words = {"en": "the quick brown fox jumps over lazy dogs while seven small children walk home from school and talk about their friends".split(),
             "de": "der schnelle braune fuchs springt ueber den faulen hund und sieben kleine kinder gehen nach hause von ihrer schule".split(),
             "xx": ["".join(rng.choice("ка то ри ме но шу ля ве зо пи".split(), 3)) for _ in range(400)]}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzqxzwvk"), 7)) for _ in range(n))
    clean = [(lang, say(lang, int(rng.choice([3, 25, 90])))) for lang in ("en", "de") for _ in range(1000)]
    planted = [(lang, noise(60)) for lang in ("en", "de") for _ in range(10)] + [(lang, say("xx", 60)) for lang in ("en", "de") for _ in range(2)]
    return [(i, lang, text) for i, (lang, text) in enumerate(clean + planted)], len(clean)


def test_planted_gibberish_goes_and_short_clean_texts_stay(spark):
    rows, n_clean = language_texts()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    kept = {r.doc_id for r in language.accepted_languages(docs).collect()}
    gone = set(range(len(rows))) - kept
    assert len(gone & set(range(n_clean))) == 0
    assert len(gone - set(range(n_clean))) >= 20                        # of 24; one that taught may look known


def test_bounds_ignore_mislabelled_documents():
    rng = np.random.default_rng(13)
    own = np.column_stack([rng.normal(2, 0.1, 800), rng.normal(4, 0.1, 800)])
    own[:6] = [7.5, 7.8]                                                 # garbage that looks least unlike the language
    bound = language.ceilings(own, np.zeros(800, int), np.full(800, 300))
    assert (bound[0] < 4).all() and (bound[0] > own[6:, 0].max()).all() and np.isinf(bound[1]).all()
    own[:6] = [7.5, 3.0]                                                 # of another language
    assert (language.ceilings(own, np.zeros(800, int), np.full(800, 300))[0] < 4).all()


def test_rare_languages_teach_with_all_documents(spark):
    rows, n_clean = language_texts()
    few = [(5000 + i, f"l{i}", f"{w} " * 8) for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel".split())]
    models = language.fit(spark.createDataFrame(rows[:n_clean] + few, "doc_id long, lang string, text string"), F.lit(True))
    assert models.languages == sorted({"de", "en", *(lang for _, lang, _ in few)})
    h, _ = language.Scorer(models).entropies([text for _, _, text in few])
    assert [models.languages[i] for i in h.argmin(axis=1)] == [lang for _, lang, _ in few]
    assert np.isfinite(models.ceiling[[models.languages.index("de"), models.languages.index("en")]]).all()
