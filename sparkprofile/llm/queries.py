"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, ann, chosen_path, epsilon_grid, langid, maglev, mih, oracle, packing, rollup, suffix, viterbi, whitening, winnowing
from .common import materialize, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = [f"shard-{i:04d}" for i in range(512)]
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 4) <=> 2"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, slot, shard)`` of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id")
    return maglev.place(documents, "doc_id", SHARDS).select("doc_id", "slot", "shard")


@query
def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after an import, an upgrade, a removal and a repeated commit.

    All documents come in counted by words; all are recounted by a byte-pair vocabulary; the toxic ones are removed.
    """
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    counted = materialize(rollup.count_tokens(
        documents.withColumn("words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))),
        "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("source", "lang", "words"),
    ))
    first = counted.select("doc_id", "source", "lang", F.lit("words/1").alias("tokenizer"), F.col("words").cast("bigint").alias("tokens"))
    second = counted.select("doc_id", "source", "lang", F.lit("byte_bpe_50k/1").alias("tokenizer"), "tokens")
    gone = second.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    ledger = rollup.TokenLedger(spark)
    ledger.commit("import", rollup.signed_changes(None, first))
    ledger.commit("upgrade", rollup.signed_changes(first, second))
    ledger.commit("removal", rollup.signed_changes(gone, None))
    ledger.commit("import", rollup.signed_changes(None, first))
    return ledger.totals()


@query
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)``; learns only from rows that are not held out."""
    documents = read(spark, sf_dir, "documents")
    model = langid.fit(documents.where(f"NOT ({HELD_OUT})"), "text", "lang")
    rows = documents.select("doc_id", "text", F.expr(HELD_OUT).alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query
def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, class_id, copies, n_links, group_id, kept)`` of every document."""
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every embedding whose id is divisible by 50."""
    codes = materialize(mih.sign_codes(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return mih.top_k(codes, codes.where("id % 50 = 0"), 10)


@query
def op6_rank_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans", "kept", "kept_text")


@query
def op7_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, round_trip)`` of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return viterbi.encode(documents, "text", public_tokenizers.path("piece_bpe_32k.model"), digest=True).drop("text")


@query
def op8_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece."""
    pieces = packing.tokenized_pieces(
        read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")
    )
    return packing.pack(materialize(pieces))


@query
def op9_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every embedding."""
    return epsilon_grid.near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_runs, kept_md5)`` of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "text")
    documents = documents.toDF("doc_id", "text", "original")
    removed = F.aggregate("removed_runs", F.lit(0).cast("bigint"), lambda n, r: n + (r["past"] - r["first"]).cast("bigint"))
    return winnowing.line_dedup(documents, long_words=winnowing.LONG_WORDS).select(
        "doc_id", F.size(F.split(F.coalesce("original", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        removed.alias("n_removed"), F.size("removed_runs").cast("bigint").alias("n_runs"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


@query
def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ten nearest found of every embedding whose id is divisible by 100."""
    embeddings = read(spark, sf_dir, "embeddings")
    return ann.top_k(embeddings, embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document."""
    found = alignment.align(
        read(spark, sf_dir, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN, ["doc_id"],
    )
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


@query
def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable embedding and component up to 8."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)


ORACLE |= {
    "op4_chosen_path": oracle.NEAR_DUPLICATES, "op5_multi_index_hashing": oracle.TOP_K_CODES, "op6_rank_doubling": oracle.REPEATED_BYTES,
    "op9_epsilon_grid_order": oracle.NEAR_VECTORS, "op10_winnowing": winnowing.oracle(long_words=winnowing.LONG_WORDS),
}
