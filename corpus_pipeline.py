"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

A stage's intermediate tables are deleted when the next one begins: its result has been written by then.
Every stage but the last returns the columns of ``documents``; a stage that changes a text also changes ``n_chars``.
Null, empty and repeated rows are handled as the operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkprofile.llm import chosen_path, langid, packing, suffix, winnowing
from sparkprofile.llm.common import drop_folders, made_folders, made_tables, materialize, read, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_left: dict[str, list[str]] = {}  # by application: the intermediate tables of the stage that ran last


def _stage(function):
    """A stage that first deletes what the stage before it has left."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_folders(spark, _left.pop(app, []))
        before = made_tables(spark)
        small_batches(spark)
        out = function(spark, docs, sf_dir)
        _left[app] = made_folders(spark, before)
        return out

    return run_stage


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: a text in no language (null, empty or without letters) goes; ``lang`` is what is found, whatever the label."""
    found = langid.identify(docs, langid.fit(docs, "text", "lang")).where(F.col("lang_pred") != langid.UNDECIDED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of runs of lines, of long lines and of whole short texts are cut out; a document of which nothing is left goes."""
    cut = winnowing.line_dedup(docs, long_words=winnowing.LONG_WORDS)
    return _measured(cut.where((F.size("removed_runs") == 0) | (F.trim("text") != "")))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group of near copies stays."""
    found = chosen_path.near_duplicates(docs, prints="kept_print").where("kept")
    kept = materialize(found.select(F.col("doc_id").alias("kept_id"), "kept_print").distinct())
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (chosen_path.text_print(docs["text"]) == kept["kept_print"])
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated passages of at least 50 words or 400 bytes are cut out; a document of which nothing is left goes."""
    cut = suffix.remove_repeats(
        docs, length=suffix.PASSAGE, window=suffix.PASSAGE_WINDOW, run_words=suffix.PASSAGE_WORDS, run_bytes=suffix.LENGTH
    ).withColumnRenamed("kept_text", "text")
    return _measured(cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the tokens of what is left."""
    pieces = packing.tokenized_pieces(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(materialize(pieces))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("repeats", repeats), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's input is deleted when its result is written."""
    docs, kept = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_folders(spark, kept)
        kept = made_folders(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
