"""The evaluation model over the driver's tables: ratings, judges, labels, classes, vectors, timelines.

Each view exists twice with the same rows: as a DataFrame, and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ["A", "N", "R"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("rater"), F.col("l_returnflag").alias("dimension"),
        (1 + F.floor("l_quantity") % 5).cast("double").alias("score"),
    )


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (1 + F.floor("o_totalprice") % 5).cast("double").alias("judge_raw"), F.col("o_orderpriority").alias("use_case"), F.col("o_orderstatus").alias("model")
    )


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).groupBy("item_id", "dimension").agg(F.avg("score").alias("human"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return human(spark, sf_dir).join(judges(spark, sf_dir), "item_id")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    c = F.col("n_chars")
    third = F.floor(c / 7).cast("long") % 3
    return d.join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 1, "yes").otherwise("partial").alias("target"),
        F.col("source").alias("editor"),
        F.col("lang"),
        F.floor(F.col("doc_id") / 4).cast("long").alias("task_uid"),
        (c % 101).cast("double").alias("ordinal_score"),
        (c % 97).cast("double").alias("second_score"),
        F.when(c % 17 != 0, F.when(c % 101 < 30, "no").when(c % 101 < 60, "partial").otherwise("yes")).alias("prediction"),
        F.when(third == 0, "no").when(third == 1, "partial").otherwise("yes").alias("other"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated decisions: a user's events are draws whose label comes from the value."""
    v = F.floor(F.col("value") * 10).cast("long") % 7
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_type"),
        F.when(v.isin(0, 1), "no").when(v.isin(2, 3), "partial").when(v.isin(4, 5), "yes").alias("label"),
        F.when(F.col("user_id") % 3 == 0, "no").when(F.col("user_id") % 3 == 1, "partial").otherwise("yes").alias("target"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order; the value is a duration, `sec` the seconds since 1970."""
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.abs("value").alias("duration"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("sec"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit scores of an item: its line items, rubrics from the ship status."""
    q = F.floor("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linestatus").alias("rubric_id"), F.col("l_linenumber").alias("unit_id"),
        F.when(q % 4 == 0, "edit_boundary").otherwise("shot").alias("unit_type"), (F.col("l_discount") * 100).alias("duration_seconds"),
        F.when(q % 6 != 0, (1 + q % 5).cast("double")).alias("score"), F.when(q % 9 == 0, "major").when(q % 47 == 0, "critical").alias("severity"), (q % 8 != 0).alias("valid"),
    )


SQL = {
    "ratings": "SELECT l_orderkey AS item_id, l_suppkey AS rater, l_returnflag AS dimension, CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS score FROM lineitem",
    "judges": "SELECT o_orderkey AS item_id, CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS DOUBLE) AS judge_raw, o_orderpriority AS use_case, o_orderstatus AS model FROM orders",
    "human": "SELECT item_id, dimension, avg(score) AS human FROM ratings GROUP BY ALL",
    "aligned": "SELECT * FROM human JOIN judges USING (item_id)",
    "classes": """SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 'no' WHEN quality = 1 THEN 'yes' ELSE 'partial' END AS target, source AS editor, lang,
        doc_id // 4 AS task_uid, CAST(n_chars % 101 AS DOUBLE) AS ordinal_score, CAST(n_chars % 97 AS DOUBLE) AS second_score,
        CASE WHEN n_chars % 17 <> 0 THEN CASE WHEN n_chars % 101 < 30 THEN 'no' WHEN n_chars % 101 < 60 THEN 'partial' ELSE 'yes' END END AS prediction,
        CASE (n_chars // 7) % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'partial' ELSE 'yes' END AS other FROM documents JOIN labels USING (doc_id)""",
    "draws": """SELECT user_id AS item_id, event_type, CASE WHEN v IN (0, 1) THEN 'no' WHEN v IN (2, 3) THEN 'partial' WHEN v IN (4, 5) THEN 'yes' END AS label,
        CASE user_id % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'partial' ELSE 'yes' END AS target FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) % 7 AS v FROM events)""",
    "timeline": "SELECT user_id, event_id, ts, event_type, abs(value) AS duration, epoch_us(ts) / 1000000.0 AS sec FROM events",
    "units": """SELECT l_orderkey AS item_id, l_linestatus AS rubric_id, l_linenumber AS unit_id, CASE WHEN q % 4 = 0 THEN 'edit_boundary' ELSE 'shot' END AS unit_type,
        l_discount * 100 AS duration_seconds, CASE WHEN q % 6 <> 0 THEN CAST(1 + q % 5 AS DOUBLE) END AS score,
        CASE WHEN q % 9 = 0 THEN 'major' WHEN q % 47 = 0 THEN 'critical' END AS severity, q % 8 <> 0 AS valid FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem)""",
}
_NEEDS = {"human": ["ratings"], "aligned": ["ratings", "human", "judges"]}


def with_views(*names: str) -> str:
    """WITH clause of the views and those that they read."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
