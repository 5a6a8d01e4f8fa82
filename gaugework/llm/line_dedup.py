"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

One pass hashes every line and writes a document's hashes as one row, each input task into the folder of one batch.
Batches follow the data: their number and their size grow with the root of the input's tasks.  A batch's
documents are counted per line key; the keys that a run already shows in `least` documents are left out (a merge
anti-join: runs are tables bucketed and sorted by hash, so they are read in order, without a shuffle or sort),
and the rest becomes a new run of level 0.  When a level has FANOUT runs they are merged, counts summed, into
one run of the next level.  At the end the runs' summed counts name the frequent keys, and every line with
such a key goes, in all documents.

A key is the line with white space 0x20, 0x09-0x0D stripped at both ends and A-Z as a-z, held as 96 bits of two
hashes.  A wrong decision needs two keys with the same 96 bits: with 10^12 different keys the chance of any is
below 10^-4.

Defined cases: a null or empty text is one empty line and keeps it (its key has no code points); every
row is a document, also where doc_id repeats or is null (rows equal in doc_id and text are dealt with alike);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import common

#: Runs of a level that are merged; batches for each root of the input's tasks.
FANOUT, BATCHES = 3, 0.7
_SORTED = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    # Spark 4.1 takes a union of bucketed scans for bucketed, yet reads its columnar batches one input after another.
    "spark.sql.unionOutputPartitioning": "false",
}
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key's text.  lower() is right for ASCII lines; translate() leaves other letters as they are."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("hash"), F.hash(key).alias("check"))


def _distinct(keys: str) -> Column:
    """A document's different digests, nulls left out.  Strings have a hash set in array_distinct, structs are compared pair by pair."""
    packed = F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.concat_ws(" ", k["hash"], k["check"]))
    part = lambda k, n: F.substring_index(k, " ", n)
    return F.transform(F.array_distinct(packed), lambda k: F.struct(part(k, 1).cast("long").alias("hash"), part(k, -1).cast("int").alias("check")))


@contextmanager
def _sorted_scans(spark: SparkSession):
    """While runs are written, scans read tables with one file a bucket as sorted; the session is left as it was."""
    before = {name: spark.conf.get(name, None) for name in _SORTED}
    for name, value in _SORTED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Runs:
    """Sorted runs (hash, check, n_docs) in levels, as bucketed tables whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, common.shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []
        self.merges = 0

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, counted: DataFrame, least: int) -> DataFrame:
        """counted without the keys that a run has in `least` documents: a merge anti-join with each run."""
        for run in self.all():
            counted = counted.hint("merge").join(run.where(F.col("n_docs") >= least).select("hash", "check"), ["hash", "check"], "left_anti")
        return counted

    def add(self, run: DataFrame, level: int = 0) -> None:
        """run: counts that a groupBy("hash", "check") has dealt out, so that a bucket lies in one task."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        path = common.scratch_path(self.spark, f"line-run-{level}")
        out = run.select("hash", "check", "n_docs").write.format("parquet").bucketBy(self.buckets, "hash", "check").sortBy("hash", "check")
        out.option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names.append(name)
        self.levels[level].append(self.spark.table(name))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = _summed(self.levels[level]), []
            self.merges += 1
            self.add(merged, level + 1)

    def drop(self) -> None:
        """Takes the runs' names out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _summed(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy("hash", "check").agg(F.sum("n_docs").alias("n_docs"))


def line_hashes(docs: DataFrame, shortest: int) -> tuple[DataFrame, int]:
    """(doc_id, digest, keys, batch) of every row, and the number of batches; too short a key is null."""
    tasks = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    batches = max(1, math.ceil(BATCHES * math.sqrt((tasks or 0) + 1)))
    keys = F.transform(F.split(common.text_or_empty(), "\n", -1), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= shortest, _digest(k)))
    rows = docs.select("doc_id", F.xxhash64(common.text_or_empty()).alias("digest"), hashed.alias("keys"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    path = common.scratch_path(docs.sparkSession, "line-hashes")
    rows.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), batches


def frequent_keys(hashed: DataFrame, batches: int, least: int) -> DataFrame:
    """(hash, check) of the keys in at least `least` documents."""
    spark = hashed.sparkSession
    runs = Runs(spark)
    try:
        with _sorted_scans(spark):
            for b in range(batches):
                lines = hashed.where(F.col("batch") == b).select(F.explode(_distinct("keys")).alias("key"))
                counted = lines.select("key.*").groupBy("hash", "check").agg(F.count("*").alias("n_docs"))
                runs.add(runs.unseen(counted, least))
            return common.materialize(_summed(runs.all()).where(F.col("n_docs") >= least).select("hash", "check"), "line-frequent")
    finally:
        runs.drop()


def drop_frequent_lines(docs: DataFrame, least: int = 10, shortest: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, kept (the other lines, joined by line feeds)."""
    hashed, batches = line_hashes(docs, shortest)
    frequent = frequent_keys(hashed, batches, least)
    places = hashed.select("doc_id", "digest", F.posexplode("keys").alias("i", "key")).where("key is not null").select("doc_id", "digest", "i", "key.*")
    # A document's lines that go, by their place; no more than it has lines.
    hits = places.join(frequent, ["hash", "check"]).groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).agg(F.collect_set("i").alias("gone"))
    text = common.text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    joined = rows.join(hits, rows.doc_id.eqNullSafe(hits.hit_id) & (F.col("digest") == F.col("hit_digest")), "left")
    split = joined.select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    split = split.select("doc_id", "text", "gone", "lines", F.when(F.col("gone").isNotNull(), places).alias("stay"))
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")).alias("kept"),
    )
