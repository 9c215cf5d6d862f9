"""Spelling variants of the words of a corpus: Bloom-guided neighbourhoods of one edit.

Words are counted over all texts. Their hashes are sums of one mixed number a
(place, letter), so the hash of an edited word follows from its own without
building it. All words go into blocked Bloom filters (one 64-bit block a word,
24 bits a word), sharded by word length and built in pieces of 64 KB on the
executors. Every word then probes its deletions and its replacements by later
letters: a pair that differs by an insertion is met from the longer word, one
that differs by a replacement from the word with the earlier letter, so each
pair is met once. Only positive probes are written out; an exact join with the
vocabulary removes the false ones. Filters are broadcast ``PASS_BYTES`` at a
time, so memory does not grow with the vocabulary; more filters make more passes.

A word has at most some 200 neighbours a letter, so no key of the join is hot.
Nulls: a null text has no words; a null id counts as empty. Repeated rows count
each time. Ties of the most frequent neighbour go to the first in code-point
order. Texts of any length are read in pieces cut between words. Extra columns
are ignored, whatever their names. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import mix, parts_for, pieces, shared, stored

RUN = re.compile("[a-zÀ-ÿ]+")          # after lower-casing A-Z
BORDER = re.compile("[^a-zA-ZÀ-ÿ]")
TEXT_PIECE = 1 << 20
HELD_WORDS = 200_000       # distinct words a task counts before it passes them on
BLOCK_BITS, WORD_BITS = 64, 24
CHUNK_BLOCKS = 8192        # blocks of a filter piece: 64 KB, about 22,000 words
PASS_BYTES = 64 << 20      # filters broadcast at once
LONGEST_SHARD = 64         # longer words share a shard
PROBES = 1 << 20           # edits hashed at once
STEP, LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(docs: DataFrame, shortest: int, least: int, damaged: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: letter runs of at least ``shortest`` code points that occur ``least`` times or more.

    With ``damaged`` a run loses a letter where crc32 of "id:run" is divisible by that number, at place crc32 % length.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for piece in pieces(text, TEXT_PIECE, BORDER):
                    runs = Counter(RUN.findall(piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                    for run, n in runs.items():
                        size = len(run)
                        if size < shortest:
                            continue
                        if damaged:
                            h = zlib.crc32(run.encode(), start)
                            if h % damaged == 0:
                                if size == shortest:
                                    continue
                                at = h % size
                                run = run[:at] + run[at + 1:]
                        total[run] += n
                    if len(total) >= HELD_WORDS:
                        yield passed_on()
                        total.clear()
        if total:
            yield passed_on()

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    return (texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def letter_hashes(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return mix((places.astype(np.uint64) + np.uint64(1)) * STEP ^ letters.astype(np.uint64) * LETTER)


def code_points(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)


class FilterPlan:
    """Where the blocks of each length's filter start; ``counts`` are the words of each length."""

    def __init__(self, counts: dict[int, int]):
        self.start, self.blocks, at = {}, {}, 0
        for size, n in sorted(counts.items()):
            self.start[size], self.blocks[size] = at, max(1, -(-n * WORD_BITS // BLOCK_BITS))
            at += self.blocks[size]
        self.total = at

    def places(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block number and bit pattern (4 of 64 bits) of word hashes of one length."""
        shard = min(size, LONGEST_SHARD)
        h = mix(hashes)
        block = self.start[shard] + ((h >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)).astype(np.int64)
        one, six = np.uint64(1), np.uint64(63)
        bits = one << (h & six)
        for k in (6, 12, 18):
            bits |= one << (h >> np.uint64(k) & six)
        return block, bits


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(part):
            yield int(sizes[part[0]]), part


def filter_chunks(words: DataFrame, plan: FilterPlan) -> DataFrame:
    """The filter in pieces: ``chunk`` number and ``bits``."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            for size, part in by_length(held):
                for rows in np.array_split(part, -(-len(part) * size // PROBES)):
                    points = code_points([held[i] for i in rows], size)
                    block, bits = plan.places(size, letter_hashes(np.arange(size), points).sum(axis=1, dtype=np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(block // CHUNK_BLOCKS), pa.array((block % CHUNK_BLOCKS).astype(np.int32)),
                                                      pa.array(bits.view(np.int64))], ["chunk", "block", "bits"])

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = np.zeros(CHUNK_BLOCKS, np.uint64)
        np.bitwise_or.at(blocks, pdf["block"].to_numpy(), pdf["bits"].to_numpy().view(np.uint64))
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [blocks.tobytes()]})

    return words.select("word").mapInArrow(marked, "chunk long, block int, bits long").groupBy("chunk").applyInPandas(built, "chunk long, bits binary")


class Edits:
    """Hashes of the edits of words of one length, some places of the words at a time."""

    def __init__(self, points: np.ndarray, alphabet: np.ndarray):
        self.points, self.alphabet = points, alphabet
        places = np.arange(points.shape[1])
        self.own = letter_hashes(places, points)
        self.whole = self.own.sum(axis=1, dtype=np.uint64)
        self.left = np.cumsum(self.own, axis=1, dtype=np.uint64) - self.own
        moved = letter_hashes(places - 1, points)            # each letter one place further left
        self.right = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)

    def replaced(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Rows, places, letters and hashes of the replacements by later letters at places lo to hi."""
        row, place, letter = np.nonzero(self.alphabet > self.points[:, lo:hi, None])
        place += lo
        change = letter_hashes(np.arange(lo, hi)[:, None], self.alphabet)
        return row, place, self.alphabet[letter], self.whole[row] - self.own[row, place] + change[place - lo, letter]

    def deleted(self) -> tuple[np.ndarray, ...]:
        """Rows, places and hashes of the deletions; of equal neighbouring letters only the last is deleted."""
        last = np.ones(self.points.shape, bool)
        last[:, :-1] = self.points[:, 1:] != self.points[:, :-1]
        row, place = np.nonzero(last)
        return row, place, (self.left + self.right)[row, place]


def probed(words: DataFrame, plan: FilterPlan, alphabet: np.ndarray, filters, first: int, shortest: int) -> DataFrame:
    """Edits of ``words`` that the broadcast filter blocks, from ``first`` on, know: ``edit``, ``of``, ``of_n``."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.frombuffer(filters(), np.uint64)

        def known(size: int, hashes: np.ndarray) -> np.ndarray:
            if min(size, LONGEST_SHARD) not in plan.start:
                return np.zeros(0, np.int64)
            block, bits = plan.places(size, hashes)
            inside = np.flatnonzero((block >= first) & (block < first + len(blocks)))
            return inside[blocks[block[inside] - first] & bits[inside] == bits[inside]]

        for batch in batches:
            held, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for size, part in by_length(held):
                for rows in np.array_split(part, -(-len(part) * size * len(alphabet) // PROBES)) if len(part) > 1 else [part]:
                    if not len(rows):
                        continue
                    mine = [held[i] for i in rows]
                    edits = Edits(code_points(mine, size), alphabet)
                    found = []
                    if size > shortest:
                        row, place, hashes = edits.deleted()
                        hit = known(size - 1, hashes)
                        found += [(mine[r][:p] + mine[r][p + 1:], r) for r, p in zip(row[hit].tolist(), place[hit].tolist())]
                    width = max(1, PROBES // (len(mine) * len(alphabet)))
                    for lo in range(0, size, width):
                        row, place, letter, hashes = edits.replaced(lo, min(lo + width, size))
                        hit = known(size, hashes)
                        found += [(mine[r][:p] + chr(c) + mine[r][p + 1:], r)
                                  for r, p, c in zip(row[hit].tolist(), place[hit].tolist(), letter[hit].tolist())]
                    if found:
                        edit, row = zip(*found)
                        row = rows[np.array(row)]
                        yield pa.RecordBatch.from_arrays([pa.array(edit, pa.string()), pa.array([held[i] for i in row], pa.string()),
                                                          pa.array(counts[row], pa.int64())], ["edit", "of", "of_n"])

    return words.select("word", "n").mapInArrow(probe, "edit string, of string, of_n long")


def near_words(words: DataFrame, shortest: int) -> DataFrame:
    """Pairs of words one edit apart, each once: ``a``, ``a_n``, ``b``, ``b_n``. ``words`` must be stored."""
    spark = words.sparkSession
    size = F.least(F.char_length("word"), F.lit(LONGEST_SHARD))
    counts = {r["size"]: r["count"] for r in words.groupBy(size.alias("size")).count().collect()}     # at most 64 rows
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # at most 90 rows
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)
    plan = FilterPlan(counts)
    chunks = stored(filter_chunks(words, plan))
    spread = words.repartition(parts_for(sum(counts.values()), 20_000))
    found, per_pass = None, PASS_BYTES // (CHUNK_BLOCKS * 8)
    for lo in range(0, -(-plan.total // CHUNK_BLOCKS), per_pass):
        blocks = np.zeros((per_pass, CHUNK_BLOCKS), np.uint64)
        for r in chunks.where(F.col("chunk").between(lo, lo + per_pass - 1)).collect():       # at most PASS_BYTES
            blocks[r["chunk"] - lo] = np.frombuffer(r["bits"], np.uint64)
        held = blocks.ravel()[:plan.total - lo * CHUNK_BLOCKS].tobytes()
        part = probed(spread, plan, alphabet, shared(spark, held), lo * CHUNK_BLOCKS, shortest)
        part = part.join(words.select(F.col("word").alias("edit"), F.col("n").alias("b_n")), "edit")
        part = stored(part.select(F.col("of").alias("a"), F.col("of_n").alias("a_n"), F.col("edit").alias("b"), "b_n"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "a string, a_n long, b string, b_n long")


def last_forms(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of each chain of ``forms`` (word, form), by pointer doubling until nothing moves."""
    reached = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while reached.where("moved").limit(1).count():
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = stored(reached.select("word", "root").join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return reached.select("word", "root")


def variant_groups(docs: DataFrame, shortest: int = 7, least: int = 2, stronger: int = 10, damaged: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its near words' number, its form and its root.

    The form of a word is its most frequent near word, where that is at least
    ``stronger`` times as frequent; the root is where following forms ends.
    """
    words = stored(word_counts(docs, shortest, least, damaged, id_col, text_col))
    pairs = near_words(words, shortest)
    sides = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")).alias("to")),
                    F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("w")).alias("to")))
    best = (pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("best")))
    strong: Column = -F.col("best.m") >= stronger * F.col("n")
    known = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.w")).alias("form"),
        F.when(strong, -F.col("best.m")).alias("form_n")))
    roots = last_forms(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
