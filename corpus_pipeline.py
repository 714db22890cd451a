"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, as a stored Parquet table, and
is one operator of quarry.llm; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.jaccard import one_of_each
from quarry.llm.line_dedup import without_boilerplate
from quarry.llm.packing import packed_documents
from quarry.llm.quality import kept_documents
from quarry.llm.store import documents, written
from quarry.llm.substrings import without_repeats


def _length_as_is(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with n_chars, if there is one, as the text now is."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share stay in their first document only."""
    return _length_as_is(docs, without_boilerplate(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their
    five-word shingles, the one with the smallest id stays."""
    return one_of_each(docs, width=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in their first document only; a
    document that consists of such passages goes."""
    return _length_as_is(docs, without_repeats(docs, counts=False, keep_emptied=False))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 2048."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Quantile sketches, components and best-two-fit are not for SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
