"""Small helpers that all corpus operators share: inputs, shared scratch tables, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch that goes to a Python worker: many short rows or a few very long ones.
ARROW_BYTES = 6 << 20


_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def _bytes(setting: str) -> int:
    """A size as Spark writes it: 64m, 64mb, 1g, 65536, 65536b."""
    digits, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(digits) * _UNITS[unit[:1] or "b"]


#: Python workers live on between stages: freed arrays of a few megabytes go back to the system instead of staying with a worker.
_MALLOC = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver's path is visible to them, and bounds their batches and what they hold on to."""
    if _bytes(spark.conf.get(_BOUND)) > ARROW_BYTES:
        spark.conf.set(_BOUND, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    for name, value in _MALLOC.items():
        env.setdefault(name, value)
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one, set here, only where the master is this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="gaugework-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gaugework/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of text whose shingles or spans one hash bucket holds, about: a bucket lies in one Python worker.
BUCKET_BYTES = 16 << 20


def bucket_bits(text_bytes: int, partitions: int) -> int:
    """Bits of a bucket's number: buckets grow with the texts, and are four a shuffle partition and 64 at least."""
    return (max(64, 4 * partitions, -(-text_bytes // BUCKET_BYTES)) - 1).bit_length()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def without_rows(docs: DataFrame, gone: DataFrame, digest=F.xxhash64) -> DataFrame:
    """The rows of docs whose (doc_id, digest of the text) is not in gone (doc_id, digest); docs may have any other columns."""
    one, two = (_free(docs.columns, name) for name in ("gone_id", "gone_digest"))
    gone = gone.select(F.col("doc_id").alias(one), F.col("digest").alias(two))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(one)) & (digest(text_or_empty()) == F.col(two)), "left_anti")


def _free(taken: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name in {t.lower() for t in taken}:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array, nulls as empty, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def chunks_by_bytes(offsets: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and `rows` rows; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1), at + rows)
        yield at, end
        at = end


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
