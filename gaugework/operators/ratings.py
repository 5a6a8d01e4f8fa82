"""Human ratings: aggregation per item and dimension, rater agreement, alignment with judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}


def aggregate_ratings(ratings: DataFrame, method: str = "mean", score: str = "score") -> DataFrame:
    """(item_id, dimension, rater, score) -> item_id, dimension, human, n_scores, n_raters; an unknown method is the mean.

    NULL scores are left out; an item whose scores are all NULL keeps human NULL and n_scores 0.
    """
    return ratings.groupBy("item_id", "dimension").agg(
        MEASURES.get(method, F.avg)(score).alias("human"), F.count(score).alias("n_scores"), F.countDistinct("rater").alias("n_raters")
    )


def all_measures(ratings: DataFrame, score: str = "score") -> DataFrame:
    return ratings.groupBy("item_id", "dimension").agg(
        *(f(score).cast("double").alias(f"{name}_score") for name, f in MEASURES.items()), F.count(score).alias("n_scores"), F.array_sort(F.collect_list(score)).alias("scores")
    )


def rater_agreement(ratings: DataFrame) -> DataFrame:
    """Per dimension over items with two raters or more: n_items, n_ratings, self_mae, pairwise_mae.

    An item's pairs are not built: sorted scores s give sum over i < j of s_j - s_i = sum of (2 i - n + 1) s_i.
    """
    items = ratings.where("score is not null").groupBy("dimension", "item_id").agg(F.array_sort(F.collect_list(F.col("score").cast("double"))).alias("s"))
    n = F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / n
    items = items.where(n >= 2).select(
        "dimension",
        n.alias("n"),
        F.aggregate(F.transform("s", lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x).alias("dev"),
        F.aggregate(F.transform("s", lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda a, x: a + x).alias("pairs"),
    )
    return items.groupBy("dimension").agg(
        F.count("*").alias("n_items"),
        F.sum("n").alias("n_ratings"),
        F.round(F.sum("dev") / F.sum("n"), 4).alias("self_mae"),
        F.round(F.sum("pairs") / F.sum(F.expr("cast(n as bigint) * (n - 1) / 2")), 4).alias("pairwise_mae"),
    )


def align(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Pairs of a human value and a judge's: inner join on item_id, both sides present."""
    return human.join(judge, "item_id").where("human is not null and judge_raw is not null")


def align_raters(ratings: DataFrame, judge: DataFrame) -> DataFrame:
    """One row per rater and item instead of the aggregate."""
    return ratings.where("score is not null").join(judge.where("judge_raw is not null"), "item_id").select(
        "item_id", "dimension", "rater", F.col("score").alias("human"), "judge_raw"
    )


def overall(values: list[Column]) -> Column:
    """Mean of the values that are there."""
    found = F.array_compact(F.array(*values))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def missing_reasons(items: DataFrame, human: DataFrame, judge: DataFrame, dimensions: list[str], examples: int = 3) -> DataFrame:
    """Why (item, dimension) pairs do not align: dimension, reason, n, the first few item ids."""
    wanted = items.select("item_id", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    rated = human.select("item_id", F.lit(True).alias("rated")).distinct()
    judged = judge.select("item_id", F.lit(True).alias("judged"), "judge_raw")
    found = wanted.join(rated, "item_id", "left").join(human.select("item_id", "dimension", "human"), ["item_id", "dimension"], "left").join(judged, "item_id", "left")
    reason = (
        F.when(F.col("rated").isNull(), "no_human_record")
        .when(F.col("human").isNull(), "no_human_score")
        .when(F.col("judged").isNull(), "no_judge_result")
        .when(F.col("judge_raw").isNull(), "no_judge_score")
    )
    lost = found.withColumn("reason", reason).where("reason is not null")
    # Only the first few rows of a group survive the map side of this window.
    first = lost.withColumn("i", F.row_number().over(Window.partitionBy("dimension", "reason").orderBy("item_id"))).where(F.col("i") <= examples)
    first = first.groupBy("dimension", "reason").agg(F.array_sort(F.collect_list("item_id")).alias("examples"))
    return lost.groupBy("dimension", "reason").agg(F.count("*").alias("n")).join(first, ["dimension", "reason"])


def signal_for_dimension(results: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(item_id, metric_id, position, parsed boolean, score) -> the judge value of each dimension.

    crosswalk: dimension, metric_id, custom boolean.  A built-in metric that was parsed shadows custom ones, also where
    its score is NULL; among custom ones the first by position stands.
    """
    met = results.join(F.broadcast(crosswalk), "metric_id").where(F.col("custom") | F.col("parsed"))  # one row per metric and dimension
    return met.groupBy("item_id", "dimension").agg(F.min_by("score", F.struct("custom", "position")).alias("judge_raw"))


def disagreement_profile(ratings: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """n, range, median, mode (NULL on a tie), pairwise disagreement 1 - sum c(c-1) / (n(n-1)), polarized (range of 2 or more)."""
    counts = ratings.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("c"))
    top = counts.groupBy(*by).agg(F.max("c").alias("_top"))
    sums = counts.join(top, by).groupBy(*by).agg(
        F.sum("c").alias("n"), (F.max(score) - F.min(score)).alias("range"), F.count_if(F.col("c") == F.col("_top")).alias("_modes"), F.max(F.when(F.col("c") == F.col("_top"), F.col(score))).alias("_mode"), F.sum(F.expr("c * (c - 1)")).alias("_same")
    )
    medians = ratings.where(F.col(score).isNotNull()).groupBy(*by).agg(F.median(score).alias("median"))
    n = F.col("n")
    return sums.join(medians, by).select(
        *by, "n", "range", "median", F.when(F.col("_modes") == 1, F.col("_mode")).alias("mode"), F.when(n > 1, 1 - F.col("_same") / (n * (n - 1))).alias("disagreement"), (F.col("range") >= 2).alias("polarized")
    )


def weighted_human(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Sum of value times weight over the weights; NULL without weight."""
    usable = F.when(F.col(value).isNotNull() & (F.col(weight) > 0), F.col(weight))
    return rows.groupBy(*by).agg((F.sum(F.col(value) * usable) / F.sum(usable)).alias("anchor"), F.sum(usable).alias("total_weight"))


def block_scores(rows: DataFrame, by: list[str], value: str, penalty: float = 0.25) -> DataFrame:
    """Mean less a share of the range."""
    return rows.groupBy(*by).agg((F.avg(value) - penalty * (F.max(value) - F.min(value))).alias("block_score"))


def filter_items(items: DataFrame, use_cases: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    if use_cases:
        items = items.where(F.col("use_case").isin(use_cases))
    return items.where(F.col("item_id").rlike(pattern)) if pattern else items


def missing_files(expected: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Expected rows whose file is not there or is empty."""
    return expected.join(listing.where("bytes > 0").select(path), path, "left_anti")
