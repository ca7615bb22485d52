"""The corpus pipeline: five filtering stages, each over all rows that the one before it kept.

run() writes each stage's rows as Parquet to the shared folder and reads them again for the next one, so a lost executor
never costs more than one stage, and no stage is computed twice. A stage's folder is removed when the next one stands.

Defined cases: null, empty and letterless texts go in the first stage; of documents that link, the smallest doc_id stays
(its repeated rows too); rows without a doc_id are never dropped as near copies nor cut, but go if their own text holds a
benchmark item; of equal passages the one in the smallest (doc_id, place) stays; rows that share a doc_id go together if
one of them holds an item; columns beyond doc_id and text may be absent, and others, whatever their names, are carried to
the last stage; with no row left, or an empty table, every later stage is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.llm import byte_bpe, decontaminate, jaccard_join, language_id, substring_dedup
from helixgrid.llm.queries import public_ranks
from helixgrid.llm.session import fresh_dir, remove, table, unused

#: Below this share of known n-grams no learnt language is near the text.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble no learnt language; null texts have no letter."""
    model = language_id.train(docs, ~language_id.held_out())
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = language_id.predict(docs, model, keep=tuple(docs.columns), lang_as=lang, score_as=score)
    return judged.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of linked documents: 5-word shingles, similarity of 0.8 or more."""
    return jaccard_join.dedup(docs, percent=80, shingle=5).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that an earlier document has; documents of which nothing is left go, and n_chars follows the text."""
    removed = unused(docs, "removed")
    cut = substring_dedup.dedup(docs, line_words=1, removed_as=removed)
    left = cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.size(removed) == 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and their digests; decoding gives the text back."""
    ranks, pattern = public_ranks()
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks)
    return byte_bpe.digests(decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]

#: SQL has neither the learnt language model nor the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
