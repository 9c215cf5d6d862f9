import zlib

import numpy as np
import public_tokenizers
import pytest

from tickweave.llm import queries, token_files
from tickweave.llm.token_files import (BLOCK, Encoder, FrequencyTable, decode_blocks, encode_blocks, fresh_folder, joined_crc32, read_token_files,
                                       scaled_frequencies, write_token_files)

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_against_the_tokenizer(spark, folder, documents):
    got = sorted(tuple(r) for r in queries.rans_token_files(spark, folder).collect())
    assert got == brute([(r.doc_id, r.text) for r in documents])


def test_odd_documents(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    path = fresh_folder(spark)
    write_token_files(odd_docs, path, PATH, 2)
    got = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    path = fresh_folder(spark)
    write_token_files(no_docs, path, PATH, 2)
    assert read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 4095, 5000, BLOCK])
def test_blocks_round_trip_and_compress(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.geometric(0.01, (3, n)), 60_000).astype(np.uint32)
    symbols, counts = np.unique(tokens, return_counts=True)
    table = FrequencyTable(symbols.astype(np.int64), scaled_frequencies(counts.astype(float)))
    assert table.frequency.sum() == 2**20
    payloads = encode_blocks(tokens, table)
    other = encode_blocks(tokens[:1, :max(1, n // 3)], table)
    back = decode_blocks(payloads + other, table)
    assert all((x == y).all() for x, y in zip(back, [*tokens, tokens[0, :max(1, n // 3)]], strict=True))
    if n == BLOCK:
        p = counts / counts.sum()
        assert len(payloads[0]) * 8 < 1.06 * n * -(p * np.log2(p)).sum()


def test_joined_checksums():
    a, b = b"some bytes", bytes(range(256)) * 5
    assert joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_damage_is_noticed(spark, odd_docs):
    from pyspark.sql import functions as F
    path, bad = fresh_folder(spark), fresh_folder(spark)
    write_token_files(odd_docs, path, PATH, 2)
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    spark.read.parquet(f"{path}/blocks").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, bad).collect()


def test_words_are_coded_as_the_tokenizer_codes_texts():
    from tokenizers import Tokenizer
    encoder, tokenizer = Encoder(PATH, 2), Tokenizer.from_file(PATH)
    assert encoder.plain and encoder.merged
    words = ["Plain", "comma,", "end.", "don't", "we'LL", "x'", "a1", "12", "7b", "Été", "été,", "cafés", "ét", "ßa", "ǅa",
             "ΑΣ", "İx", "字字", "́", "a­", "<|endoftext|>", "a<", "a<|", "\x1cb\x1c", "b\x1c", "\x7f", "a b", " ", "\U0001f600a", "ªµ", "ɉɐ"]
    for word in words:
        assert np.frombuffer(encoder.ids(word), "<u4").tolist() == [*tokenizer.encode(word, add_special_tokens=False).ids, 2], word
        alone = Encoder(PATH, 2)[word.encode()] if len(word.split()) == 1 else None
        assert alone is None or alone + encoder.end == encoder.ids(word), word
    assert encoder.ids(" ".join(words[:19])) == b"".join(encoder.ids(word)[:-4] for word in words[:19]) + encoder.end
    text = " ".join(words)
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_every_text_is_tokenised_once(spark, tmp_path, monkeypatch):
    log, whole = tmp_path / "texts", token_files.Encoder

    class Logged(whole):
        def words(self, text):
            with open(log, "a") as file:
                file.write("x")
            return super().words(text)

    monkeypatch.setattr(token_files, "Encoder", Logged)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    write_token_files(docs, fresh_folder(spark), PATH, 2)
    assert len(log.read_text()) == 20


def test_ids_are_packed_by_their_size():
    for top in (5, 1 << 16, 1 << 20):
        tokens = np.array([1, 0, top - 1, 3], np.uint32)
        assert (token_files.unpacked(token_files.packed(tokens), 4) == tokens).all()
