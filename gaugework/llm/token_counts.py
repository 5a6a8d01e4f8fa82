"""Token counts from a digest cache.

A cache table holds (content_digest, tokenizer_digest, n_tokens).  Documents join it by the SHA-256 of
their whole normalised text and of the tokenizer file; only texts without an entry are encoded, each
distinct one once, and appended.  The cache is Parquet in the shared folder and outlives a run.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows that repeat get the same counts;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common
from gaugework.llm.encoding import piece_counter

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def as_it_is(text: Column) -> Column:
    """The default normalisation: none, null as empty."""
    return F.coalesce(text, F.lit(""))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = piece_counter(path)
    for rows in batches:
        n = counter.count(rows.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])


def read_cache(spark, path: str) -> DataFrame:
    """The cache at path; one that does not exist yet is created empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, normalise=as_it_is) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    common.prepare(spark)
    version = file_digest(model_path)
    content = docs.select("doc_id", normalise(F.col("text")).alias("content")).withColumn(
        "content_digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256))
    )
    keys = common.materialize(
        content.select("doc_id", "content_digest", F.octet_length("content").cast("long").alias("n_bytes")), "token-keys"
    )
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    misses = keys.groupBy("content_digest").agg(F.min_by("doc_id", F.struct("doc_id")).alias("doc_id"))
    misses = misses.join(known.select("content_digest"), "content_digest", "left_anti")
    # A row of its own for each distinct miss: the text itself moves once, and only for these.
    texts = content.join(misses, (content.doc_id.eqNullSafe(misses.doc_id)) & (content.content_digest == misses.content_digest), "left_semi")
    texts = texts.select("content_digest", "content")
    counted = texts.mapInArrow(lambda it: _count(it, model_path), "content_digest binary, n_tokens long")
    # Rows that repeat with one doc_id are one miss.
    counted = counted.dropDuplicates(["content_digest"])
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    # Repeated runs append equal rows.  Written out, so that a digest with very many documents makes a join that splits.
    counts = common.materialize(cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-known")
    return keys.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
