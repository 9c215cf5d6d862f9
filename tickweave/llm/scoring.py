"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting runs over every training text: tasks count words and word pairs of
blocks of documents and deal them out by hash; each part sums its words
exactly and puts its pairs into a Bloom filter. A pair of count c enters at
levels 1 to 1 + floor(log2 c); a count is read back by probing level after
level until one is missing, and stands for the least count of its level.
Read counts of one context thus never add up to more than the context has,
but for false answers of the filter.

Each context meets every word of the vocabulary, so what counts is the number
of its false answers, rate times vocabulary. The filter takes as many probes
as keep that below a hundredth of the prior, and the denominator holds the mass
that false answers are expected to take. Probability of word w after v,
smoothed by a Dirichlet prior on the add-one word model:
``(c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR + false(v))``, where c(v) and p(w)
come from exact word counts, c(v, w) from the filter, never above c(v) or c(w)
(so 0 for a word never seen), and ``false(v) = rate * (V + 2 * c(v))``. Over
the vocabulary and the unseen word these sum to at most 1 in expectation. A
text is its words, then one end; a start stands before them.

Scoring asks the parts by a shuffle, so no task reads more of the model than
its own part. Texts are packed into blocks, stored once; a block deals its
distinct words and pairs out to the parts, those it learns from and those it
only asks for in the same rows. A part sums what is learned, puts its pairs
into its filter, reads every pair that is asked for back from it, and answers
each block in the order in which that asked. Blocks meet their answers in one
more shuffle.

``learn`` gives the same model to callers that look counts up themselves: the
parts' tables as broadcast segments of bounded size, of which a worker holds
one at a time. All of it has to fit on a worker's disk.

Null texts count as empty: one end token. Without training rows every count
is 0. Repeated rows count as often as they occur; ties play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import WordHashes, batch_bytes, batches, discard, lowered_words, mix, parts_for, stored

COUNT_WORDS = 1_000_000        # words that a task counts at a time
BLOCK_BYTES = 3_000_000        # of the texts of a block, about half a million words
ROW_BYTES = 6                  # that a text counts for besides its own, for its end
BLOCKS_A_TASK = 4              # scored by a task
BATCH_BYTES = "4m"             # of rows that a worker is handed at a time
PART_WORDS = 500_000           # corpus words for each part of the tables
SEGMENT_BYTES = 4 * 2**20      # broadcast at a time
PRIOR = 50.0
FALSE_SHARE = 0.01             # false answers of a context, as a share of the prior
LEAST_PROBES, MOST_PROBES = 4, 48
PAIR_BITS = 48                 # of a pair's hash, within its part
START, END = 0x5374617274, 0x456E64      # hashes that stand for the marks; words never hash to so small a number in practice


def tokens_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = lowered_words(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = hashes.of(words)
    out[-1] = END
    return out


def pair_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; ``starts`` are the places of first tokens."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _blocks(frames, columns, words):
    hashes = WordHashes()
    rows = ((*row[:-1], tokens_of(row[-1], hashes)) for frame in frames for row in zip(*[frame[c] for c in columns], strict=True))
    yield from batches(rows, lambda r: len(r[-1]), words)


def _joined(block) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate([r[-1] for r in block])
    lengths = np.fromiter((len(r[-1]) for r in block), np.int64, len(block))
    return tokens, np.cumsum(lengths) - lengths


def _dealt(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each value (ascending values give ascending parts) and its place of PAIR_BITS inside the part."""
    step = np.uint64(2**64 // parts + 1)
    part = values // step
    shift = np.uint64(max(0, int(step).bit_length() - PAIR_BITS))
    return part.astype(np.int64), (values - part * step) >> shift


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, all first bytes first: ascending places and small counts compress well so."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(body: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


_COUNTS = "kind string, part int, hashes binary, counts binary"


def _count(parts: int):
    def run(frames):
        for block in _blocks(frames, ["text"], COUNT_WORDS):
            tokens, starts = _joined(block)
            rows = []
            for kind, values in (("word", tokens), ("pair", pair_hashes(tokens, starts))):
                values, counts = np.unique(values, return_counts=True)
                part, places = _dealt(values, parts)
                ends = np.searchsorted(part, np.arange(parts + 1))
                for p in range(parts):
                    i, j = ends[p], ends[p + 1]
                    if j > i:
                        held = planes(values[i:j], 8) if kind == "word" else planes(places[i:j], PAIR_BITS // 8)
                        rows.append((kind, p, held, planes(counts[i:j], 4)))
            yield pd.DataFrame(rows, columns=["kind", "part", "hashes", "counts"])
    return run


def _bit_places(values: np.ndarray, level: int, size, probe: int) -> np.ndarray:
    """Bit place below ``size`` of each pair at a level, for one probe."""
    h = mix(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level << 8))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low + np.uint64(probe) * high) % size).astype(np.int64)


def probes_for(distinct: int, prior: float) -> int:
    """Probes that keep a context's expected false answers, rate times vocabulary, below FALSE_SHARE of the prior."""
    wanted = math.ceil(math.log2(max(2.0, (distinct + 1) / max(FALSE_SHARE * prior, 1e-6))))
    return min(MOST_PROBES, max(LEAST_PROBES, wanted))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def least_count(level: np.ndarray) -> np.ndarray:
    """Smallest of the counts that share a level; 0 at level 0."""
    return np.where(level > 0, 2.0 ** (level - 1), 0.0)


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    """A part's distinct hashes, with exact counts of words and levels of pairs."""
    kind, part = frame["kind"].iloc[0], int(frame["part"].iloc[0])
    hashes = np.concatenate([from_planes(x, 8 if kind == "word" else PAIR_BITS // 8) for x in frame["hashes"]])
    counts = np.concatenate([from_planes(x, 4) for x in frame["counts"]]).astype(np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    hashes, counts = hashes[first], np.add.reduceat(counts, first)
    if kind == "word":
        body, extra = hashes.tobytes(), counts.tobytes()
    else:
        body, extra = planes(hashes, PAIR_BITS // 8), levels(counts).astype(np.uint8).tobytes()
    return pd.DataFrame([(kind, part, len(hashes), int(counts.sum()), body, extra)],
                        columns=["kind", "part", "entries", "total", "body", "extra"])


def _filter(places: np.ndarray, level: np.ndarray, probes: int) -> tuple[np.ndarray, float]:
    """Bits of a part's pairs (at least one) entered at all levels up to their own, and the rate of false answers."""
    size = max(64, math.ceil(int(level.sum()) * (probes / math.log(2)) / 64) * 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max()) + 1):
        entered = places[level >= q]
        for probe in range(probes):
            bits[_bit_places(entered, q, np.uint64(size), probe)] = True
    return bits, float(bits.mean()) ** probes + len(places) / 2.0**PAIR_BITS


def _filters(probes: int):
    """Bloom filter of each part's pairs, and the rate of its false answers."""
    def run(frames):
        for frame in frames:
            rows = []
            for part, body, extra in zip(frame["part"], frame["body"], frame["extra"], strict=True):
                bits, rate = _filter(from_planes(body, PAIR_BITS // 8), np.frombuffer(extra, np.uint8), probes)
                rows.append((part, len(bits), rate, np.packbits(bits, bitorder="little").tobytes()))
            yield pd.DataFrame(rows, columns=["part", "size", "rate", "body"])
    return run


class CorpusModel:
    """Segments of the word table and of the pair filter, as broadcasts, and the totals."""

    def __init__(self, parts: int, words: list, pairs: list, total: int, distinct: int, train_docs: int, probes: int, rate: float):
        self.parts, self.words, self.pairs = parts, words, pairs
        self.total, self.distinct, self.train_docs = total, distinct, train_docs
        self.probes, self.rate = probes, rate


def _loaded(segment, release: bool):
    value = segment.value
    if release:
        vars(segment).pop("_value", None)     # read again from the worker's disk when next needed
    return value


def _broadcast(tables: DataFrame, columns: list[str]) -> list:
    """(first part, last part, broadcast) of each run of parts of at most SEGMENT_BYTES; each column is one flat byte string."""
    spark = tables.sparkSession
    sizes = tables.select("part", sum(F.length(c) for c in columns).alias("bytes")).orderBy("part").collect()   # one number a part
    bounds, held = [[]], 0
    for row in sizes:
        if held + row["bytes"] > SEGMENT_BYTES and bounds[-1]:
            bounds.append([])
            held = 0
        bounds[-1].append(row["part"])
        held += row["bytes"]
    segments = []
    for group in bounds:
        if group:
            rows = tables.where(F.col("part").between(group[0], group[-1])).select("part", *columns).collect()
            rows.sort(key=lambda r: r["part"])
            value = [r["part"] for r in rows], *[b"".join(r[c] for r in rows) for c in columns]
            del rows
            segment = spark.sparkContext.broadcast(value)
            vars(segment).pop("_value", None)     # the driver need not keep its copy
            segments.append((group[0], group[-1], segment))
    return segments


def learn(docs: DataFrame, text_col: str = "text", prior: float = PRIOR) -> CorpusModel:
    """Count all rows of ``docs`` and broadcast the tables segment by segment."""
    size = docs.agg(F.sum(F.length(text_col)), F.count("*")).first()
    parts = parts_for((size[0] or 0) // 6, PART_WORDS, least=8)
    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(_count(parts), _COUNTS)
    tables = stored(counted.groupBy("kind", "part").applyInPandas(
        _finish, "kind string, part int, entries long, total long, body binary, extra binary"))
    totals = {r["kind"]: r for r in tables.groupBy("kind").agg(F.sum("entries").alias("entries"), F.sum("total").alias("total")).collect()}
    word = totals.get("word")
    distinct = word["entries"] if word else 0
    probes = probes_for(distinct, prior)
    filters = stored(tables.where("kind = 'pair'").mapInPandas(_filters(probes), "part int, size long, rate double, body binary"))
    shape = {r["part"]: r for r in filters.select("part", "size", "rate").collect()}     # two numbers a part
    pairs = [(first, last, segment, np.array([shape[p]["size"] if p in shape else 0 for p in range(first, last + 1)], np.uint64))
             for first, last, segment in _broadcast(filters, ["body"])]
    words = _broadcast(tables.where("kind = 'word'"), ["body", "extra"])
    discard(tables)
    discard(filters)
    return CorpusModel(parts, words, pairs, word["total"] if word else 0,
                       distinct, int(size[1]), probes, max((r["rate"] for r in shape.values()), default=0.0))


def word_counts(model: CorpusModel, tokens: np.ndarray) -> np.ndarray:
    """Exact count of every token."""
    values, inverse = np.unique(tokens, return_inverse=True)
    out = np.zeros(len(values), np.int64)
    for first, last, segment in model.words:
        lo, hi = np.searchsorted(_dealt(values, model.parts)[0], [first, last + 1])
        _, body, extra = _loaded(segment, len(model.words) + len(model.pairs) > 4)
        hashes, counts = np.frombuffer(body, np.uint64), np.frombuffer(extra, np.int64)
        at = np.searchsorted(hashes, values[lo:hi])
        at[at == len(hashes)] = 0
        out[lo:hi] = np.where(hashes[at] == values[lo:hi], counts[at], 0)
    return out[inverse]


def pair_levels(model: CorpusModel, pairs: np.ndarray) -> np.ndarray:
    """Level of every pair's count, read by probing one level after the other."""
    values, inverse = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(values), np.int64)
    part, held = _dealt(values, model.parts)
    for first, last, segment, size in model.pairs:
        lo, hi = np.searchsorted(part, [first, last + 1])
        _, body = _loaded(segment, len(model.words) + len(model.pairs) > 4)
        bits, start = np.frombuffer(body, np.uint8), np.cumsum(size).astype(np.int64) - size.astype(np.int64)
        live = lo + np.flatnonzero(size[part[lo:hi] - first] > 0)
        level = 1
        while len(live):
            for probe in range(model.probes):
                p = part[live] - first
                places = _bit_places(held[live], level, size[p], probe) + start[p]
                live = live[(bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1]
            out[live] = level
            level += 1
    return out[inverse]


def _pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts in blocks, one row a block, numbered by task; ``docs`` and ``chars`` are those to learn from."""
    from pyspark import TaskContext
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def packed():
        rows = pa.Table.from_batches(held)
        learned = rows.filter(rows["learns"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows)
        chars = pc.sum(pc.utf8_length(learned["text"])).as_py() or 0
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "docs": pa.array([len(learned)], pa.int64()),
                                           "chars": pa.array([chars], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in frames:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        at = before = 0
        while at < len(batch):
            end = min(int(np.searchsorted(upto, before + BLOCK_BYTES - size)) + 1, len(batch))
            held.append(batch.slice(at, end - at))
            size, before, at = size + int(upto[end - 1]) - before, int(upto[end - 1]), end
            if size >= BLOCK_BYTES:
                yield packed()
                number, held, size = number + 1, [], 0
    if held:
        yield packed()


def _opened(body: bytes, hashes: WordHashes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a block, its tokens and the places of first tokens."""
    rows = pa.ipc.open_stream(body).read_all()
    return rows, *_joined([(tokens_of(text, hashes),) for text in rows["text"].to_pylist()])


_ASKED = "part int, block long, hashes binary, counts binary"
_ANSWERED = "kind string, part int, block long, entries long, total long, rate double, answer binary"
WIDTHS = {"word": (8, 6), "pair": (PAIR_BITS // 8, 1)}       # bytes of a hash that is dealt out, and of an answer


def _ask(kind: str, parts: int):
    """Distinct words or pairs of each block for each part, and how often they are learned here (0: only asked for)."""
    width = WIDTHS[kind][0]

    def run(frames):
        hashes = WordHashes()
        for frame in frames:
            for block, body in zip(frame["block"], frame["body"], strict=True):
                rows, tokens, starts = _opened(body, hashes)
                learns = np.repeat(rows["learns"].to_numpy(), np.diff(np.append(starts, len(tokens))))
                values, inverse = np.unique(tokens if kind == "word" else pair_hashes(tokens, starts), return_inverse=True)
                counts = np.bincount(inverse[learns], minlength=len(values))
                part, places = _dealt(values, parts)
                held, ends = values if kind == "word" else places, np.searchsorted(part, np.arange(parts + 1))
                asked = [(p, block, planes(held[i:j], width), planes(counts[i:j], 4))
                         for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
                yield pd.DataFrame(asked, columns=["part", "block", "hashes", "counts"])
    return run


def _read_levels(places: np.ndarray, bits: np.ndarray, probes: int) -> np.ndarray:
    """Level of every pair's count, read from its part's filter by probing one level after the other."""
    out, size = np.zeros(len(places), np.uint8), np.uint64(len(bits))
    live, level = np.arange(len(places)), 1
    while len(live):
        for probe in range(probes):
            live = live[bits[_bit_places(places[live], level, size, probe)]]
        out[live] = level
        level += 1
    return out


def _answer(kind: str, probes: int = 0):
    """What a part answers each block: exact counts of its words, or levels of its pairs as the part's filter has them."""
    width, answer_width = WIDTHS[kind]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([from_planes(x, width) for x in frame["hashes"]])
        values, inverse = np.unique(hashes, return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, inverse, np.concatenate([from_planes(x, 4) for x in frame["counts"]]).astype(np.int64))
        learned, rate, answers = counts > 0, 0.0, counts
        if kind == "pair":
            answers = np.zeros(len(values), np.uint8)
            if learned.any():
                bits, rate = _filter(values[learned], levels(counts[learned]), probes)
                answers = _read_levels(values, bits, probes)
        cuts = np.cumsum([len(x) // width for x in frame["hashes"]])[:-1]
        rows = [(kind, part, block, 0, 0, rate, planes(answer, answer_width)) for part, block, answer in
                zip(frame["part"], frame["block"], np.split(answers[inverse], cuts), strict=True)]
        rows[0] = (*rows[0][:3], int(learned.sum()), int(counts.sum()), *rows[0][5:])
        return pd.DataFrame(rows, columns=["kind", "part", "block", "entries", "total", "rate", "answer"])
    return run


def _score(total: int, distinct: int, train_docs: int, rate: float, prior: float):
    denominator = total + distinct + 1

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        made, answers = [], answers.sort_values("part")
        given = {kind: [from_planes(x, WIDTHS[kind][1]) for x in answers["answer"][answers["kind"] == kind]] for kind in WIDTHS}
        for body in blocks["body"]:
            rows, tokens, starts = _opened(body, WordHashes())
            c, level = (np.concatenate(given[kind])[np.unique(values, return_inverse=True)[1]].astype(np.int64)
                        for kind, values in (("word", tokens), ("pair", pair_hashes(tokens, starts))))
            word_p = (c + 1) / denominator
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[starts] = train_docs
            pair = np.minimum(least_count(level), np.minimum(before, c))
            p = (pair + prior * word_p) / (before + prior + rate * (distinct + 2 * before))
            lengths = np.diff(np.append(starts, len(tokens)))
            made.append(pd.DataFrame({
                "id": pd.array(rows["id"].to_pylist(), "Int64"), "held_out": pd.Series(rows["held_out"].to_pylist(), dtype=object),
                "n_tokens": lengths, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": total,
                "base_score": np.add.reduceat(np.log10(word_p), starts), "score": np.add.reduceat(np.log10(p), starts)}))
        return pd.concat(made)
    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows not held out are learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"),
                       F.coalesce(~held_out, F.lit(False)).alias("learns"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_pack, "block long, docs long, chars long, body binary"))
    size = blocks.agg(F.sum("chars"), F.sum("docs"), F.count("*")).first()
    parts = parts_for((size[0] or 0) // 6, PART_WORDS, least=8)

    def answered(kind: str, probes: int = 0) -> DataFrame:
        asked = blocks.select("block", "body").mapInPandas(_ask(kind, parts), _ASKED)
        with batch_bytes(docs.sparkSession, BATCH_BYTES):       # a row is a whole block
            return stored(asked.groupBy("part").applyInPandas(_answer(kind, probes), _ANSWERED), compression="zstd")

    words = answered("word")
    total, distinct = (int(x or 0) for x in words.agg(F.sum("total"), F.sum("entries")).first())
    pairs = answered("pair", probes_for(distinct, prior))
    rate = pairs.agg(F.max("rate")).first()[0] or 0.0
    # few bytes but long work: not to be put together by size
    tasks = max(min(size[2], 4 * docs.sparkSession.sparkContext.defaultParallelism), size[2] // BLOCKS_A_TASK, 1)
    answers = words.unionByName(pairs).select("block", "kind", "part", "answer").repartition(tasks, "block")
    return blocks.select("block", "body").repartition(tasks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(total, distinct, int(size[1] or 0), rate, prior),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
