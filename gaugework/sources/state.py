"""Sinks and state: append logs with last-write-wins replay, resume, content-addressed and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "key string, seq long, value string"


def append(rows: DataFrame, path: str) -> None:
    """Adds (key, seq, value) rows to the log at path."""
    rows.select(F.col("key").cast("string"), F.col("seq").cast("long"), F.col("value").cast("string")).write.mode("append").parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the rows of one batch, in place of what an earlier try of the same batch has left."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def record_stream(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of calls as a log of batches: a batch that fails and runs again leaves each call once."""

    def write(rows: DataFrame, number: int) -> None:
        append_batch(rows, path, number)

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose write has ended, from one listing in the store."""
    ends = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = ends.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ends) or []
    return sorted(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their batch number; a batch whose write did not end is left out."""
    whole = spark.createDataFrame([(n,) for n in whole_batches(spark, path)], "_whole long")
    rows = spark.read.schema(schema).parquet(f"{path}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))
    return rows.join(F.broadcast(whole), F.col("batch") == F.col("_whole"), "left_semi")  # a number per batch, from the driver's listing


def replay(log: DataFrame) -> DataFrame:
    """The last value of each key; entries whose JSON is torn are skipped."""
    whole = log.where(F.col("key").isNotNull() & F.try_parse_json("value").isNotNull())
    return whole.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return replay(spark.read.schema(LOG).parquet(path))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log {"key": ..., "value": ...} in line order; torn lines are skipped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    whole = lines.select("seq", F.from_json("value", "key string, value variant").alias("r")).where("r.key is not null")
    return whole.select("r.key", "seq", F.to_json("r.value").alias("value")).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose key has no stored result: failures are not stored, so they come again."""
    return work.join(done.select(*keys), keys, "left_anti")


def publish(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions (cache keys) that rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def query_units(units: DataFrame, item_id: str | None = None, unit_type: str | None = None) -> DataFrame:
    if item_id is not None:
        units = units.where(F.col("item_id") == item_id)
    if unit_type is not None:
        units = units.where(F.col("unit_type") == unit_type)
    return units.orderBy("item_id", "start_seconds", "unit_id")


def artifact_ids(files: DataFrame, kind: str) -> DataFrame:
    """(path, content) -> the content's digest and the artifact id made from kind and digest."""
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("sha256"), F.left(F.sha2(F.concat(F.lit(f"{kind}:"), digest), 256), F.lit(24)).alias("artifact_id"))


def usable_manifests(manifests: DataFrame, artifacts: DataFrame, listing: DataFrame) -> DataFrame:
    """Complete manifests none of whose artifacts is missing from the listing."""
    lost = artifacts.join(listing.select("path"), "path", "left_anti").select("cache_key").distinct()
    return manifests.where("status = 'complete'").join(lost, "cache_key", "left_anti")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_cells(spark: SparkSession, root: str, schema: str, pattern: str = r"temp([0-9.]+)_rep(\d+)") -> DataFrame:
    """The CSV files of a grid of run folders, with the setting and repeat from the path."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(schema).csv(root)
    path = F.col("_metadata.file_path")
    found = rows.select("*", F.regexp_extract(path, pattern, 1).alias("setting"), F.regexp_extract(path, pattern, 2).alias("repeat"))
    return found.where("setting <> ''").withColumn("repeat", F.col("repeat").cast("int"))


def complete_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("setting", "repeat").agg(F.count("*").alias("n")).where("n > 0")
