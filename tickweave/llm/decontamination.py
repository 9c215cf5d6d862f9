"""Benchmark decontamination by spaced-seed hashing.

Texts are read as lower-case words without surrounding punctuation. A window
is ``WINDOW`` words of a benchmark item; it is cut into four blocks, and each
fixed mask keeps two blocks and ignores the words of the others. Up to
``WINDOW - NEEDED`` substituted words spoil two blocks at most, so one of the
six masks still sees only unchanged words: every window that differs in so few
places is hit for certain.

Test side: one row for each item, window and mask. Training side: whole texts
are scanned; a position becomes a candidate when one of its masked hashes
passes a Bloom filter of the test hashes (fixed size, so it may be broadcast
for any benchmark; false passes end at the join). Candidates join the test
hashes, and the words around the hit are compared one by one: ``NEEDED`` of
``WINDOW`` must agree.

Items shorter than a window but of ``SHORTEST`` words or more match as a whole
and word for word; still shorter ones are no evidence and match nothing. Null
and empty texts and items match nothing; repeated rows are reported once with
each id; ties play no part; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import WordHashes, batches, joined_by_key, lowered_words, mix, odd_multipliers, text_key

WINDOW, NEEDED, SHORTEST = 13, 11, 5
FILTER_BITS = 2**25
_PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


class PlainWordHashes(WordHashes):
    """Hashes of words without ASCII punctuation around them; 0 for words that are nothing else."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        core = word.strip(_PUNCTUATION)
        value = (xxhash.xxh3_64_intdigest(core) | 1) if core else 0
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def words_of(self, text: str | None) -> np.ndarray:
        words = self.of(lowered_words(text))
        return words[words != 0]


def masks(window: int = WINDOW) -> list[np.ndarray]:
    """Kept places of each mask: two of the four blocks of a window."""
    blocks = np.array_split(np.arange(window), 4)
    return [np.concatenate(pair) for pair in combinations(blocks, 2)]


def masked_hashes(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(positions, masks) hashes of all windows; no rows when there are fewer words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty((0, 6), np.uint64)
    multipliers = odd_multipliers(window, seed=23)
    blocks = np.array_split(np.arange(window), 4)
    sums = []
    for block in blocks:
        s = np.zeros(n, np.uint64)
        for j in block:
            s += words[j:j + n] * multipliers[j]
        sums.append(s)
    return np.stack([mix(sums[i] + sums[j] + np.uint64(m + 1)) for m, (i, j) in enumerate(combinations(range(4), 2))], axis=1)


def whole_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of exactly ``length`` words, for short items."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    multipliers = odd_multipliers(WINDOW, seed=29)
    h = np.full(n, 1000 + length, np.uint64)
    for j in range(length):
        h += words[j:j + n] * multipliers[j]
    return mix(h)


def _bit_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.uint64(FILTER_BITS - 1)
    return (h & size).astype(np.int64), ((h >> np.uint64(20)) & size).astype(np.int64), ((h >> np.uint64(39)) & size).astype(np.int64)


_WINDOW_ROW = "item_id long, at int, length int, hash long, words array<long>"


def _item_windows(frames):
    hashes = PlainWordHashes()
    for frame in frames:
        for item, text in zip(frame["item_id"], frame["text"], strict=True):
            words = hashes.words_of(text)
            signed = words.view(np.int64)
            if len(words) >= WINDOW:
                got = masked_hashes(words).view(np.int64)
                yield pd.DataFrame([(item, i, WINDOW, h, signed[i:i + WINDOW]) for i in range(len(got)) for h in got[i]],
                                   columns=["item_id", "at", "length", "hash", "words"])
            elif len(words) >= SHORTEST:
                yield pd.DataFrame([(item, 0, len(words), whole_hashes(words, len(words)).view(np.int64)[0], signed)],
                                   columns=["item_id", "at", "length", "hash", "words"])


def _filter_of(index: DataFrame) -> np.ndarray:
    """Bloom filter of the index hashes; partial filters of a few tasks are joined, each of fixed size."""
    def bits(frames):
        filled = np.zeros(FILTER_BITS, bool)
        for frame in frames:
            for places in _bit_places(frame["hash"].to_numpy(np.int64).view(np.uint64)):
                filled[places] = True
        yield pd.DataFrame({"bits": [np.packbits(filled).tobytes()]})
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in index.select("hash").coalesce(8).mapInPandas(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _scan(filter_, lengths):
    def run(frames):
        filled = np.unpackbits(filter_.value).view(bool)
        hashes = PlainWordHashes()
        passes = lambda h: np.logical_and.reduce([filled[p] for p in _bit_places(h)])
        for frame in frames:
            rows = []
            for doc, a, b, text in zip(frame["id"], frame["a"], frame["b"], frame["text"], strict=True):
                words = hashes.words_of(text)
                signed = words.view(np.int64)
                if len(words) >= WINDOW:
                    h = masked_hashes(words)
                    seen = passes(h.ravel()).reshape(h.shape)
                    for i in np.flatnonzero(seen.any(axis=1)):
                        rows.append((doc, a, b, i, WINDOW, h[i][seen[i]].view(np.int64), signed[i:i + WINDOW]))
                for length in lengths:
                    h = whole_hashes(words, length)
                    for i in np.flatnonzero(passes(h)) if len(h) else ():
                        rows.append((doc, a, b, i, length, h[i:i + 1].view(np.int64), signed[i:i + length]))
            for part in batches(iter(rows), lambda r: 1, 20_000):
                out = pd.DataFrame(part, columns=["id", "a", "b", "doc_at", "length", "hashes", "doc_words"])
                out["id"] = out["id"].astype("Int64")
                yield out
    return run


def verified_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, a, b, item_id, doc_at, item_at, matched, length): windows of documents that agree with windows of items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    index = items.mapInPandas(_item_windows, _WINDOW_ROW).distinct()
    lengths = [r[0] for r in index.where(f"length < {WINDOW}").select("length").distinct().collect()]     # at most WINDOW values
    filter_ = spark.sparkContext.broadcast(_filter_of(index))
    key = text_key(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key["a"].alias("a"), key["b"].alias("b"), F.col(text_col).alias("text"))
    hits = (rows.mapInPandas(_scan(filter_, lengths), "id long, a long, b long, doc_at int, length int, hashes array<long>, "
                                                      "doc_words array<long>")
            .withColumn("hash", F.explode("hashes")).drop("hashes"))
    pairs = hits.join(index.withColumnRenamed("at", "item_at"), ["hash", "length"])
    agree = F.aggregate(F.zip_with("doc_words", "words", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (pairs.withColumn("matched", agree)
            .where(F.when(F.col("length") < WINDOW, F.col("matched") == F.col("length")).otherwise(F.col("matched") >= NEEDED))
            .select("id", "a", "b", "item_id", "doc_at", "item_at", "matched", "length").distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(id, a, b, item_id, n_windows, best, first_at): documents with the benchmark items they contain."""
    return (verified_overlaps(docs, benchmark, **columns).groupBy("id", "a", "b", "item_id")
            .agg(F.count_distinct("doc_at").alias("n_windows"), F.max("matched").alias("best"), F.min("doc_at").alias("first_at")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, columns unchanged."""
    bad = contaminated(docs, benchmark, text_col=text_col, **columns).select("a", "b").distinct()
    return joined_by_key(docs, bad, "left_anti", text_col)
