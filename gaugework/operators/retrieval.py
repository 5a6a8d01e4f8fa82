"""Text look-ups: best note by keyword overlap, order-keeping dedupe behind a leak filter, top tendencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.text import plain, tokens


def best_notes(notes: DataFrame, metrics: DataFrame, by: str) -> DataFrame:
    """Per group and metric, the note that has most of the metric's keywords; the earliest (note_id) on ties.

    notes: by, note_id, text; metrics: metric_id, keyword (a row per keyword).  Notes meet keywords by token,
    so a note without any keyword never joins.
    """
    words = notes.select(by, "note_id", F.explode(tokens(F.col("text"))).alias("keyword"))
    scored = words.join(F.broadcast(metrics), "keyword").groupBy(by, "metric_id", "note_id").agg(F.count("*").alias("score"))  # the metrics' own keyword lists
    return scored.groupBy(by, "metric_id").agg(F.max(F.struct("score", (-F.col("note_id")).alias("i"))).alias("b")).select(by, "metric_id", (-F.col("b.i")).alias("note_id"), F.col("b.score").alias("score"))


def dedupe_phrases(rows: DataFrame, by: list[str], order: str, text: str, leak: str) -> DataFrame:
    """The first of phrases that are equal once normalised; phrases that show the leak pattern go."""
    keyed = rows.where(~F.lower(F.col(text)).rlike(leak)).withColumn("_key", plain(F.col(text))).where("_key <> ''")
    first = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(order))
    return keyed.withColumn("_i", first).where("_i = 1").drop("_i", "_key")


def top_tendencies(counts: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """The k most frequent keys of each group, by count then key."""
    totals = counts.groupBy(*by, key).agg(F.count("*").alias("n"))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
    return totals.withColumn("rank", i).where(F.col("rank") <= k)


def fill_bank(primary: DataFrame, others: DataFrame, by: str, text: str, most: int) -> DataFrame:
    """Primary questions first, then others, equal texts once, up to `most` per group.  Both: by, pos, text."""
    both = primary.select(by, F.lit(0).alias("source"), "pos", text).unionByName(others.select(by, F.lit(1).alias("source"), "pos", text))
    first = F.row_number().over(Window.partitionBy(by, F.lower(F.trim(F.col(text)))).orderBy("source", "pos"))
    unique = both.withColumn("_f", first).where("_f = 1").drop("_f")
    return unique.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("source", "pos"))).where(F.col("rank") <= most)
