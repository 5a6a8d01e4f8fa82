"""Unit scores to rubric summaries and weighted item scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rubric_summaries(units: DataFrame, by: list[str]) -> DataFrame:
    """(by..., unit_type, duration_seconds, score, severity, valid) -> duration-weighted mean capped by severe errors.

    Cap 2 with a critical unit (or a score of 1 or less); cap 3 where major units (or scores up to 2) have a fifth of
    the duration.  Groups without a valid score keep NULLs and n_valid 0.
    """
    ok = F.coalesce(F.col("valid"), F.lit(False)) & F.col("score").isNotNull()
    weight = F.when(F.col("unit_type") == "edit_boundary", 1.0).otherwise(F.greatest(F.lit(1e-6), F.coalesce("duration_seconds", F.lit(0.0))))
    rows = units.withColumns({"_s": F.when(ok, F.col("score")), "_w": F.when(ok, weight)})
    severe = F.coalesce(F.col("severity") == "major", F.lit(False)) | (F.col("_s") <= 2)
    sums = rows.groupBy(*by).agg(
        (F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("weighted_mean"),
        F.avg("_s").alias("mean"),
        F.min("_s").alias("minimum"),
        F.percentile("_s", F.lit(0.2)).alias("p20"),
        F.var_pop("_s").alias("variance"),
        F.avg((F.col("_s") <= 2).cast("double")).alias("severe_fraction"),
        (F.sum(F.when(severe, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("affected_fraction"),
        F.coalesce(F.bool_or(ok & (F.coalesce(F.col("severity") == "critical", F.lit(False)) | (F.col("_s") <= 1))), F.lit(False)).alias("critical"),
        F.count("_s").alias("n_valid"),
        F.count("*").alias("n_total"),
    )
    cap = F.when(F.col("critical"), 2.0).when(F.col("affected_fraction") >= 0.2, 3.0).otherwise(5.0)
    return sums.withColumn("score", F.when(F.col("weighted_mean").isNotNull(), F.least("weighted_mean", cap)))


def weighted_scores(summaries: DataFrame, by: list[str], rubric: str, weights: dict[str, float]) -> DataFrame:
    """Mean of the rubrics' scores by weight; rubrics without a positive weight or a score are left out."""
    w = F.lit(None).cast("double")
    for name, value in weights.items():
        w = F.when(F.col(rubric) == name, F.lit(float(value))).otherwise(w)
    used = F.when((w > 0) & F.col("score").isNotNull(), w)
    return summaries.groupBy(*by).agg((F.sum(F.col("score") * used) / F.sum(used)).alias("area_score"), F.count(used).alias("n_rubrics"))


def spread_to_dimensions(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """The score of an item for each dimension that it stands for."""
    return scores.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))


def feature_map(summaries: DataFrame, item: str, rubric: str, values: list[str]) -> DataFrame:
    """Flat features `area:<rubric>:<value>` per item, NULLs left out; an item has few rubrics."""
    entries = F.filter(F.array(*(F.struct(F.concat(F.lit("area:"), F.col(rubric), F.lit(f":{v}")).alias("key"), F.col(v).cast("double").alias("value")) for v in values)), lambda e: e["value"].isNotNull())
    return summaries.groupBy(item).agg(F.map_from_entries(F.array_sort(F.flatten(F.collect_list(entries)))).alias("features"))
