import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickweave.llm import queries, spelling


def brute_force(rows, shortest=7, least=2, stronger=10, damaged=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    holes = defaultdict(set)                       # words by what is left without one place
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= stronger * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())



def ordered(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("chunk", [8192, 16])
def test_equals_brute_force(spark, folder, documents, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK_BLOCKS", chunk)
    monkeypatch.setattr(spelling, "PASS_BYTES", 64 << 20 if chunk == 8192 else 16 * 8 * 20)        # 16: several passes
    got = ordered(found_rows(queries.bloom_guided_spelling(spark, folder)))
    assert got == ordered(brute_force([(r.doc_id, r.text) for r in documents]))


def found_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_chains_ties_long_words_and_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(spelling, "TEXT_PIECE", 50)
    long = "abcdefghij" * 400
    text = " ".join(["planted"] * 2000 + ["plantes"] * 200 + ["plantess"] * 20 + ["plantesse"] * 2 + ["Éplantes"] * 2 + ["plantfs"] * 2 + ["plantee"] * 200
                    + [long] * 30 + [long[:-1]] * 3 + ["x" + long] * 2 + ["aaaaaaaa"] * 20 + ["aaaaaaa"] * 2 + ["ÀÀÀÀÀÀÀ"] * 3 + ["àÀÀÀÀÀÀ"] * 2 + ["short"] * 9)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(90, text), (91, "planted×÷" * 5), (None, "sixteen sixteen"), (92, "sixteen")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n long, word string")
    assert ordered(found_rows(spelling.variant_groups(docs, damaged=31))) == ordered(brute_force(rows))
    got = {r[0]: r for r in found_rows(spelling.variant_groups(docs))}
    assert got["plantesse"][1:3] == ("plantess", "planted") and got["plantfs"][1] == "plantes"
    assert spelling.variant_groups(docs.limit(0), damaged=31).count() == 0
    assert spelling.variant_groups(docs.where("doc_id = 4"), damaged=31).count() == 0


def test_filters_know_every_word_and_few_others(spark):
    words = [f"w{'abcdefghij'[i % 10]}{'x' * (i % 5)}{i}".translate(str.maketrans("0123456789", "klmnopqrst")) for i in range(20_000)]
    words = sorted({w for w in words if len(w) >= 5})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    plan = spelling.FilterPlan(Counter(len(w) for w in words))
    blocks = np.zeros((-(-plan.total // spelling.CHUNK_BLOCKS), spelling.CHUNK_BLOCKS), np.uint64)
    for r in spelling.filter_chunks(table, plan).collect():
        blocks[r.chunk] = np.frombuffer(r.bits, np.uint64)
    blocks, false, tried = blocks.ravel(), 0, 0
    for size, part in spelling.by_length(words):
        mine = [words[i] for i in part]
        hashes = spelling.letter_hashes(np.arange(size), spelling.code_points(mine, size)).sum(axis=1, dtype=np.uint64)
        block, bits = plan.places(size, hashes)
        assert (blocks[block] & bits == bits).all()
        block, bits = plan.places(size, np.random.default_rng(size).integers(1, 2**63, 50_000).astype(np.uint64))
        false, tried = false + (blocks[block] & bits == bits).sum(), tried + 50_000
    assert false < 0.01 * tried
