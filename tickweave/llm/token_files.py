"""Token-id files compressed with a static range asymmetric numeral system.

Documents are dealt into ranges of ascending id, one per file; a file is a
sequence of blocks of BLOCK ids. Every text is tokenised once, and its ids are
kept as blocks in a stored table. A pass over them counts every id; the counts,
scaled to 2**PRECISION, are the one frequency table that all blocks share. A
block is coded by itself with LANES interleaved states: id k belongs to lane k
mod LANES, all lanes share one stream of 32-bit words. Every CHECKPOINT steps
the states and the place in the stream are written down, so a block can be
decoded from several places at once. Each block holds checksums of its payload and of its ids.

On disk a data set is a folder with two Parquet tables, so files are committed
and read by Spark on any file system: ``table`` (symbol, frequency) and
``blocks`` (file, block, first, n_tokens, first_doc, doc_head, doc_ids, doc_tokens,
ids_crc32, payload_crc32, payload), written uncompressed. ``payload`` is the
binary block: header, stream places and states of the checkpoints, words.

Null texts count as empty and have the end id alone; null ids come first,
repeated ids stay separate documents (ordered by their texts), and an empty
table gives a data set without blocks.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import discard, parts_for, shared, stored
from tickweave.session import checkpoint_folder

PRECISION = 20                 # the table's frequencies add up to 2**20
LOW = np.uint64(1 << 31)       # states stay at or above this
LANES, STEPS, CHECKPOINT = 16, 1024, 256
BLOCK = LANES * STEPS
TOGETHER = 96                  # blocks that a task codes side by side
FILE_CHARS = 64_000_000        # characters of text for each file: a longer one meets fewer new words
HELD_WORDS, HELD_LENGTH = 800_000, 64
MARKS = "<|", "\u03a3", "\u0130"         # begin of special tokens; letters whose lower case depends on their neighbours or on the library
_HEADER = "<4sIHHI"      # magic, ids, lanes, checkpoints, words


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: the byte's own, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in own else next(free)) for b in range(256)}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes; words met lately are remembered.

    A tokenizer that lower-cases, drops white space and codes the matches of
    its split pattern one by one (read from its file) gives a text's ids as
    those of its words, and a word's as those of its pieces. Words with marks
    of special tokens, or with letters whose lower case depends on their
    neighbours, are coded whole; texts of any other tokenizer as well.
    """

    def __init__(self, path: str, end_id: int):
        import json

        import regex
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        split, rest = splits[0], splits[1:]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True
        self.pattern = regex.compile(split["pattern"]["Regex"]) if self.by_word else None
        byte_level = [r for r in rest if r["type"] == "ByteLevel" and r.get("add_prefix_space") is False and r.get("use_regex") is False]
        merges = len(rest) == len(byte_level) == 1 and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
        # pieces written with letters that stand for bytes need the merges alone
        self.merged, self.letters = self.tokenizer.model.tokenize if merges else None, byte_letters()
        # words of letters alone are one piece, if the pattern has it so
        self.plain = self.by_word and self.pattern.findall("abc xyz") == ["abc", "xyz"] and "[\\p{L}]+" in split["pattern"]["Regex"].split("|")

    def __missing__(self, word: bytes) -> bytes:
        ids = self._coded(word)
        if len(word) <= HELD_LENGTH:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def _coded(self, word: bytes) -> bytes:
        if self.plain:
            if word.isalpha():
                return self._piece(word.lower().decode("ascii"))
            if word[:-1].isalpha() and word[-1] < 128:          # a mark or digit at the end is a piece of its own
                return self[word[:-1].lower()] + self[word[-1:]]
        text = word.decode("utf-8", "replace")
        if any(mark in text for mark in MARKS):
            return self._whole(text)
        text = unicodedata.normalize("NFC", text).lower()
        if self.plain and text.isalpha() and max(text) < "\u0250":
            return self._piece(text)
        found = self.pattern.findall(text)
        return self._piece(found[0]) if len(found) == 1 else b"".join(self[piece.encode()] for piece in found)

    def _piece(self, piece: str) -> bytes:
        if not self.merged:
            return self._whole(piece)
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.merged(letters)]
        return struct.pack(f"<{len(found)}I", *found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str | None) -> list[bytes]:
        """What the ids of a text are put together from."""
        text = text or ""
        if self.by_word and not any(mark in text for mark in MARKS):
            text = unicodedata.normalize("NFC", text).lower()         # all words at once
        raw = text.encode("utf-8", "replace")
        return raw.split() if self.by_word else [raw]

    def word_ids(self, word: bytes) -> bytes:
        if self.by_word:
            return self[word]
        return self._whole(word.decode())

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__ if self.by_word else self.word_ids, self.words(text))) + self.end


def packed(tokens: np.ndarray) -> bytes:
    """Ids in two bytes each when all fit, else in four."""
    return tokens.astype("<u2" if len(tokens) and tokens.max() < 1 << 16 else "<u4").tobytes()


def unpacked(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype(np.uint32)


def count_ids(raw: DataFrame) -> DataFrame:
    """(symbol, n): occurrences of each id over all blocks of uncoded ids."""
    def count(frames):
        totals = np.zeros(1, np.int64)
        for frame in frames:
            for body, n in zip(frame["ids"], frame["n_tokens"], strict=True):
                more = np.bincount(unpacked(body, n))
                totals = np.concatenate([totals, np.zeros(max(0, len(more) - len(totals)), np.int64)])
                totals[:len(more)] += more
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"symbol": used, "n": totals[used]})
    return raw.select("ids", "n_tokens").mapInPandas(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).where("n > 0")


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**PRECISION, nearly in proportion to ``counts``."""
    total = 1 << PRECISION
    spare = total - len(counts)
    exact = counts / counts.sum() * spare
    out = np.floor(exact).astype(np.int64) + 1
    most = np.argsort(-(exact - np.floor(exact)), kind="stable")[:total - int(out.sum())]
    out[most] += 1
    return out


class FrequencyTable:
    """Frequencies and where they start, by symbol; the symbol of every slot."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.frequency, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.frequency[symbols] = frequencies
        self.start[symbols] = np.cumsum(frequencies) - frequencies
        self.slots = np.repeat(symbols, frequencies).astype(np.uint32)
        self.commonest = int(symbols[np.argmax(frequencies)]) if len(symbols) else 0


def encode_blocks(tokens: np.ndarray, table: FrequencyTable) -> list[bytes]:
    """Payloads of equally long blocks: ``tokens`` is (blocks, n)."""
    blocks, n = tokens.shape
    steps = -(-n // LANES)
    grid = np.full((blocks, steps * LANES), table.commonest, tokens.dtype)
    grid[:, :n] = tokens
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.empty((steps, blocks, LANES), np.uint32)
    moved = np.empty((steps, blocks, LANES), bool)
    marks = range(0, steps, CHECKPOINT)
    saved = {}
    limit, shift, low32 = np.uint64(int(LOW) >> PRECISION << 32), np.uint64(PRECISION), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        f, c = table.frequency[grid[s]], table.start[grid[s]]
        over = state >= limit * f
        words[s], moved[s] = state.astype(np.uint32), over
        state = np.where(over, state >> low32, state)
        q = state // f
        state = (q << shift) + (state - q * f) + c
        if s % CHECKPOINT == 0:
            saved[s] = state
    at = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(moved.sum(axis=2), axis=0)])
    out = []
    for b in range(blocks):
        stream = words[:, b][moved[:, b]]
        out.append(struct.pack(_HEADER, b"RNS1", n, LANES, len(marks), len(stream)) + at[list(marks), b].astype("<u4").tobytes()
                   + np.stack([saved[s][b] for s in marks]).astype("<u8").tobytes() + stream.astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes], table: FrequencyTable) -> list[np.ndarray]:
    """Ids of each payload; all checkpoints of all payloads are decoded side by side."""
    heads = [struct.unpack_from(_HEADER, p) for p in payloads]
    states, places, streams, want, base = [], [], [], [], 0
    for payload, (magic, n, lanes, marks, words) in zip(payloads, heads, strict=True):
        if magic != b"RNS1" or lanes != LANES:
            raise ValueError("not a block of this format")
        at = struct.calcsize(_HEADER)
        places.append(np.frombuffer(payload, "<u4", marks, at).astype(np.int64) + base)
        states.append(np.frombuffer(payload, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes))
        streams.append(np.frombuffer(payload, "<u4", words, at + 4 * marks + 8 * marks * lanes))
        steps = -(-n // LANES)
        want.append(np.minimum(CHECKPOINT, steps - np.arange(marks) * CHECKPOINT))
        base += words
    state, place, want = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(want)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    out = np.empty((int(want.max()), len(want), LANES), np.uint32)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    order = np.argsort(-want, kind="stable")            # longest first: finished sections fall off the end
    state, place, want = state[order], place[order], want[order]
    for s in range(len(out)):
        live = int(np.searchsorted(-want, -s))          # sections with more than s steps
        x = state[:live]
        slot = x & mask
        symbol = table.slots[slot]
        out[s, :live] = symbol
        x = table.frequency[symbol] * (x >> shift) + slot - table.start[symbol]
        under = x < LOW
        taken = np.cumsum(under, axis=1)
        word = stream[place[:live, None] + taken - under]
        state[:live] = np.where(under, (x << np.uint64(32)) | word, x)
        place[:live] += taken[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    result, section = [], 0
    for _, n, _, marks, _ in heads:
        parts = [out[:want[back[k]], back[k]].reshape(-1) for k in range(section, section + marks)]
        result.append(np.concatenate(parts)[:n])
        section += marks
    return result


_BLOCKS = ("file int, block int, first long, n_tokens int, first_doc long, doc_head int, doc_ids array<long>, doc_tokens array<long>, "
           "ids_crc32 long, payload_crc32 long, payload binary")


_RAW = "file int, block int, first long, n_tokens int, first_doc long, doc_head int, doc_ids binary, doc_null binary, doc_tokens binary, ids binary"


def _raw_blocks(tokenizer: str, end_id: int):
    """Texts of one file, in their order, to its blocks of ids, not yet coded."""
    def run(frames):
        from pyspark import TaskContext
        encoder, file = Encoder(tokenizer, end_id), TaskContext.get().partitionId()
        held: list[bytes] = []
        size = first = block = docs = 0
        starts: list[tuple[int, object, int]] = []       # place in the file, id, number of ids

        def rows(tokens: np.ndarray, each: int):
            nonlocal first, block, starts, docs
            out = []
            for row in tokens.reshape(-1, each):
                begun = [s for s in starts if s[0] < first + each]
                starts = starts[len(begun):]
                out.append((file, block, first, each, docs, begun[0][0] - first if begun else each,
                            np.array([s[1] or 0 for s in begun], np.int64).tobytes(), bytes(s[1] is None for s in begun),
                            np.array([s[2] for s in begun], np.int64).tobytes(), packed(row)))
                first, block, docs = first + each, block + 1, docs + len(begun)
            return pd.DataFrame(out, columns=[c.split()[0] for c in _RAW.split(", ")])

        place = 0
        for frame in frames:
            for doc, text in zip(frame["id"].astype(object).where(frame["id"].notna(), None), frame["text"], strict=True):
                ids = encoder.ids(text)
                starts.append((place, None if doc is None else int(doc), len(ids) // 4))
                place += len(ids) // 4
                held.append(ids)
                size += len(ids) // 4
                if size >= TOGETHER * BLOCK:
                    tokens = np.frombuffer(b"".join(held), "<u4")
                    whole = size // BLOCK * BLOCK
                    for part in range(0, whole, TOGETHER * BLOCK):
                        yield rows(tokens[part:min(part + TOGETHER * BLOCK, whole)], BLOCK)
                    held, size = [tokens[whole:].tobytes()], size - whole
        tokens = np.frombuffer(b"".join(held), "<u4")
        whole = size // BLOCK * BLOCK
        if whole:
            yield rows(tokens[:whole], BLOCK)
        if size > whole:
            yield rows(tokens[whole:], size - whole)
    return run


def _coded_blocks(table_of):
    def run(frames):
        table = table_of()
        for frame in frames:
            for n, same in frame.groupby("n_tokens"):
                for i in range(0, len(same), TOGETHER):
                    part, out = same.iloc[i:i + TOGETHER], []
                    tokens = np.stack([unpacked(body, n) for body in part["ids"]])
                    for row, ids, payload in zip(part.itertuples(index=False), tokens, encode_blocks(tokens, table), strict=True):
                        docs = np.frombuffer(row.doc_ids, np.int64).tolist()
                        out.append((row.file, row.block, row.first, n, row.first_doc, row.doc_head,
                                    [None if null else doc for doc, null in zip(docs, row.doc_null, strict=True)],
                                    np.frombuffer(row.doc_tokens, np.int64).tolist(),
                                    zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload), payload))
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCKS.split(", ")])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise all texts, append ``end_id`` to each, and write the ids in ascending id order under ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    files = parts_for(docs.agg(F.sum(F.length(text_col))).first()[0], FILE_CHARS, least=8)
    ordered = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    # tokenising is nearly all of the work, so ids are kept until they are counted and coded
    raw = stored(ordered.mapInPandas(_raw_blocks(tokenizer, end_id), _RAW), compression="zstd")
    counts = count_ids(raw).toPandas().sort_values("symbol")      # at most the vocabulary
    symbols, n = counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    frequencies = scaled_frequencies(n) if len(n) else n.astype(np.int64)
    spark.createDataFrame(pd.DataFrame({"symbol": symbols, "frequency": frequencies}), "symbol long, frequency long") \
        .coalesce(1).write.parquet(f"{path}/table")
    table = shared(spark, FrequencyTable(symbols, frequencies))
    raw.mapInPandas(_coded_blocks(table), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(raw)


_POLYNOMIAL = 0xEDB88320      # fixed value: crc32, bits reversed


def _product(x: int, y: int) -> int:
    """Product of two polynomials modulo crc32's (bit 31 is the constant term)."""
    out = 0
    for bit in range(31, -1, -1):
        if x >> bit & 1:
            out ^= y
        y = (y >> 1) ^ (_POLYNOMIAL if y & 1 else 0)
    return out


def joined_crc32(left: int, right: int, right_bytes: int) -> int:
    """crc32 of two byte strings one after the other, from their own crc32 and the second's length."""
    power, square = 1 << 31, 1 << 23                      # 1 and x**8
    while right_bytes:
        if right_bytes & 1:
            power = _product(power, square)
        square = _product(square, square)
        right_bytes >>= 1
    return _product(left, power) ^ right


_PIECE = "file int, ordinal long, doc_id long, first long, at long, n long, crc long"


def _read(table_of):
    def run(frames):
        table = table_of()
        for frame in frames:
            for i in range(0, len(frame), TOGETHER):
                part = frame.iloc[i:i + TOGETHER]
                for payload, crc in zip(part["payload"], part["payload_crc32"], strict=True):
                    if zlib.crc32(payload) != crc:
                        raise ValueError("a block's payload is damaged")
                out = []
                for row, ids in zip(part.itertuples(index=False), decode_blocks(list(part["payload"]), table), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != row.ids_crc32:
                        raise ValueError("a block's ids are damaged")
                    head, end, place, starts = row.doc_head, row.first + row.n_tokens, row.first + row.doc_head, []
                    for doc, n in zip(row.doc_ids, row.doc_tokens, strict=True):      # what stands before them continues an earlier one
                        starts.append((doc, place, int(n)))
                        place += int(n)
                    if head:
                        out.append((row.file, row.first_doc - 1, None, None, row.first, head, zlib.crc32(raw[:4 * head])))
                    for k, (doc, start, n) in enumerate(starts):
                        stop = min(start + n, end)
                        piece = raw[4 * (start - row.first):4 * (stop - row.first)]
                        out.append((row.file, row.first_doc + k, None if doc is None or doc != doc else int(doc), start, start,
                                    stop - start, zlib.crc32(piece)))
                got = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])
                for c in ("doc_id", "first"):
                    got[c] = got[c].astype("Int64")
                yield got
    return run


@F.pandas_udf(T.LongType())
def _whole_crc(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
    out = []
    for c, n in zip(crcs, lengths, strict=True):
        crc = int(c[0])
        for right, size in zip(c[1:], n[1:], strict=True):
            crc = joined_crc32(crc, int(right), 4 * int(size))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks under ``path`` and checked."""
    table = spark.read.schema("symbol long, frequency long").parquet(f"{path}/table").toPandas().sort_values("symbol")
    table_of = shared(spark, FrequencyTable(table["symbol"].to_numpy(np.int64), table["frequency"].to_numpy(np.int64)))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    pieces = stored(blocks.mapInPandas(_read(table_of), _PIECE))
    sizes = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row a file
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                           .alias("offset"))
    parts = (pieces.groupBy("file", "ordinal")
             .agg(F.max("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
                  F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p")))
    return (parts.join(offsets, "file")
            .select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", _whole_crc("p.crc", "p.n").alias("ids_crc32")))


def fresh_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
