"""A corpus from raw documents to token ids: quality, line dedup, near-dedup, decontamination, byte-level BPE.

For all stages: texts of any length are taken whole; an empty table gives an empty one; columns beside doc_id and text pass
through as they are, whatever their names. Rows that share a doc_id stay or go together where a stage decides by document (line
dedup takes the lines of all of them as those of one document), and each has a result of its own. A row without doc_id passes the
stages that decide by document, for it is none, and goes in the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talus.llm import bpe, decontaminate, linededup, neardup, quality
from talus.llm.common import durable, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text is judged by its statistics, and labels of unknown documents are left out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, with the rest of its text and its new n_chars. A null text stays null; a text whose lines all go is empty."""
    return linededup.without_repeats(docs, linededup.keep_bitmaps(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays; documents without words are copies of nothing."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(durable(gone, "near-copies"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go; null and empty texts and items match nothing."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(durable(leaks, "leaks"), "doc_id", "left_anti").select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers; a null or empty text has none, and rows without doc_id go."""
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    return bpe.encoded_digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
