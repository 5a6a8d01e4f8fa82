"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage reads the Parquet that the one before it wrote to the shared folder, so a lost executor costs
a stage's unfinished tasks, never a stage that is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import common
from gaugework.llm.decontaminate import keep_uncontaminated
from gaugework.llm.exact_dedup import keep_one_of_equals
from gaugework.llm.ngram_join import keep_one_per_component
from gaugework.llm.packing import pack
from gaugework.llm.toxicity import keep_clean


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier holds for toxic go, each judged by its own text.

    A null or empty text is scored as one without toxic words and stays; without labels nothing goes; a table without rows
    stays one; null ids, repeated rows and other columns are kept as they are.
    """
    return keep_clean(docs, common.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts those with the largest doc_id stay.

    A null text equals an empty one; a null doc_id is below all; rows that share the kept doc_id and text all stay; a
    table without rows stays one; other columns are kept.
    """
    return keep_one_of_equals(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links (five words, 80 percent) connect, the least doc_id stays.

    Texts without words link with nothing and stay; rows with a null doc_id stay; rows of one doc_id are one node and
    stay or go together; components that do not settle in 40 rounds raise an error; a table without rows stays one.
    """
    return keep_one_per_component(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text agrees with a benchmark item in 80 percent of a window of 16 tokens, or of the whole shorter item.

    Null and empty texts and items match nothing; null ids, repeated rows and other columns are kept; with a benchmark or
    documents without rows nothing goes.
    """
    return keep_uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece, with its ids; every source's share of all tokens holds in every sequence.

    A null or empty text is its end id alone; a null source is a source; repeated rows are packed each; a table without
    rows gives none; other columns end here.
    """
    return pack(docs, _tokenizer(), end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, shingle hashes and a tokenizer: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents: one row per piece, with its ids."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
