"""Corpus pipeline: documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet into the shared scratch folder and reread as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.bpe import token_digests
from tagweave.llm.common import materialize, read_table
from tagweave.llm.line_dedup import SHINGLE, drop_repeated_lines
from tagweave.llm.mixing import mixed_documents
from tagweave.llm.near_dedup import keep_first
from tagweave.llm.quality import fit_quality, keep_good
from tagweave.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-equal lines the first stays; documents left without a line go."""
    return drop_repeated_lines(docs, min_chars=SHINGLE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of their five-word shingles) stays."""
    return keep_first(docs, n=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights; repeated documents are repeated rows."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every row."""
    return token_digests(docs, TOKENIZER)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
          ("encode", encode)]

#: The classifier is learned and the tokenizer is a program: SQL can't say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
