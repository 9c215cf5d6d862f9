"""The dealt operators over their whole tables, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.llm import (
    decontamination, language, mixing, neighbours, prefix_trie, quality, repeats, scoring, sharding, similarity, spelling, token_files, toxicity,
)
from tickweave.llm.common import ORACLES, QUERIES, query, table  # noqa: F401

SHARDS = 24
TOKENIZER, END_ID = "word_bpe_49k.json", 2


@query("op1_vector_bin_packing")
def vector_bin_packing(spark, folder):
    """All documents in 24 shards of near equal bytes, tokens and rows; copies stay together."""
    rows, _ = sharding.sharded(table(spark, folder, "documents"), SHARDS)
    return sharding.with_slots(rows, SHARDS).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("tokens").alias("n_tokens"))


@query("op2_kneser_ney_language")
def kneser_ney_language(spark, folder):
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    out = language.held_out("doc_id", 4, 2)
    models = language.fit(docs, ~out)
    got = docs.select("doc_id", out.alias("held_out"), language.predictor(spark, models)(F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits", "p.accepted")


@query("op3_rans_token_files")
def rans_token_files(spark, folder):
    """Token ids of all documents written as coded blocks, and read back."""
    import public_tokenizers
    path = token_files.fresh_folder(spark)
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, path)


@query("op4_pruned_graph_neighbours")
def pruned_graph_neighbours(spark, folder):
    """Ten nearest of each vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op5_raked_mixture", mixing.oracle())
def raked_mixture(spark, folder):
    """Every document with its mixture probability and whether the draw keeps it."""
    mixed = mixing.mixed(table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept")


@query("op6_spaced_seed_decontamination")
def spaced_seed_decontamination(spark, folder):
    """Documents that contain a benchmark item, with the item and the extent of the overlap."""
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("n_windows").cast("long").alias("n_windows"),
                        F.col("best").alias("best_match"), "first_at")


@query("op7_bloom_filter_scores")
def bloom_filter_scores(spark, folder):
    """Word-pair model scores of all documents, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    return scoring.score_texts(docs, language.held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")


@query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark, folder):
    """Components of all documents under Jaccard 0.8 of five-word shingles."""
    classes = similarity.near_duplicate_classes(table(spark, folder, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op9_run_length_repeats")
def run_length_repeats(spark, folder):
    """What of every document stays when all strings of 400 bytes that occur twice are cut out."""
    kept = repeats.without_repeats(table(spark, folder, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op10_co_trained_quality")
def co_trained_quality(spark, folder):
    """Quality of every document from the co-trained views."""
    scores = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


@query("op11_bloom_guided_spelling")
def bloom_guided_spelling(spark, folder):
    """Near words, form and root of every word of all documents, some occurrences of which lost a letter."""
    return spelling.variant_groups(table(spark, folder, "documents"), shortest=7, least=2, stronger=10, damaged=31)


@query("op12_subword_bag_toxicity")
def subword_bag_toxicity(spark, folder):
    """Toxicity of every document, learned from the labelled documents that are not held out."""
    out = language.held_out("doc_id", 5, 0)
    scores = toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), ~out)
    return scores.withColumnRenamed("id", "doc_id").select("doc_id", out.alias("held_out"), "score", "predicted")


_TRIE_SQL = """WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
h AS (SELECT conv_id, CASE WHEN conv_id % 100 = 0 THEN 0 ELSE h % 6 END AS h FROM crc),
spliced AS (SELECT h.conv_id, pos, role, text FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % 100 AND pos < h
  UNION ALL SELECT h.conv_id, pos, role, text FROM h JOIN own ON own.conv_id = h.conv_id AND pos >= h),
turns AS (SELECT conv_id, length(text) AS n, md5(role || chr(1) || text) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM spliced),
paths AS (SELECT conv_id, depth, n, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM h),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, left(k, length(k) - 32) AS up FROM paths GROUP BY k, depth),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.k),
below AS (SELECT a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n) AS BIGINT) AS saved_tokens
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.k, a.k) GROUP BY a.k),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(k, depth) AS k FROM paths GROUP BY conv_id) GROUP BY k)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes a JOIN below USING (k) LEFT JOIN ends USING (k) LEFT JOIN full_nodes p ON a.depth > 0 AND p.k = a.up"""


@query("op13_parenthesis_prefix_trie", _TRIE_SQL)
def parenthesis_prefix_trie(spark, folder):
    """All nodes of the trie of conversations that share the first turns of every hundredth."""
    paths = prefix_trie.sequences(table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(paths, period=100, heads=6))
