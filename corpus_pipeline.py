"""A training corpus in five stages: language ID, quality, exact duplicates, near duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage works on all
rows that its predecessor kept; all but the last return the columns of documents. A stage's result is written as Parquet
in the shared folder and read again as the next one's docs.

A null or empty text has no language and goes in the first stage; a stage used alone takes it as an empty text. A row
with a null doc_id stays where its text may, and teaches nothing. Of equal or near texts one row stays: the longest, then
the least doc_id, then the first; near copies by doc_id alone. Repeated rows are copies. An empty table gives an empty
table at each stage. Further columns pass through all filtering stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, ngram_join, packing, quality
from tidemark.llm.common import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (op1)."""
    return language_id.filter_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold (op6)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (op3)."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (op5)."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, a row for each piece (op2)."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None
