"""Reports over aligned pairs: per item, per judge signal, repeats, preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators import agreement


def item_gaps(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per item: means, signed and absolute gap (judge minus human), and a gap column for each dimension."""
    gap = F.col("judge_raw") - F.col("human")
    per = [F.round(F.max(F.when(F.col("dimension") == d, gap)), 2).alias(f"gap_{d}") for d in dimensions]
    return pairs.groupBy("item_id").agg(
        F.count("*").alias("n_dims"),
        F.round(F.avg("human"), 3).alias("mean_human"),
        F.round(F.avg("judge_raw"), 3).alias("mean_judge"),
        F.round(F.avg("judge_raw") - F.avg("human"), 3).alias("mean_gap_signed"),
        F.round(F.avg(F.abs(gap)), 3).alias("mean_abs_gap"),
        *per,
    )


def signal_items(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Per item and judge signal: dimensions that share a signal count once.  signals: (dimension, judge_signal), a few rows."""
    grouped = pairs.join(F.broadcast(signals), "dimension").groupBy("item_id", "judge_signal")  # one row per dimension
    h, j = F.avg("human"), F.avg("judge_raw")
    return grouped.agg(
        F.count("*").alias("n_human_dims"), F.round(h, 3).alias("human"), F.round(j, 3).alias("judge"), F.round(j - h, 3).alias("gap_signed"), F.round(F.abs(j - h), 3).alias("abs_gap")
    )


def signal_summary(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Per judge signal, over the rounded values of signal_items()."""
    items = signal_items(pairs, signals)
    means = items.groupBy("judge_signal").agg(
        F.count("*").alias("n_items"),
        F.round(F.avg("human"), 3).alias("mean_human"),
        F.round(F.avg("judge"), 3).alias("mean_judge"),
        F.round(F.avg("judge") - F.avg("human"), 3).alias("mean_gap_signed"),
        F.round(F.avg(F.abs(F.col("judge") - F.col("human"))), 3).alias("mae"),
    )
    rho = agreement.spearman(agreement.cells(items, ["judge_signal"], "human", "judge"), ["judge_signal"])
    return means.join(rho.withColumn("spearman", F.round("spearman", 3)), "judge_signal")


def preference_accuracy(pairs: DataFrame, group: list[str], variant: str) -> DataFrame:
    """Share of variant pairs of a group that human and judge order alike; ties on either side are left out.

    Pairs are built over the means of variants, of which a group has few.
    """
    means = pairs.groupBy(*group, variant).agg(F.avg("human").alias("h"), F.avg("judge_raw").alias("j"))
    other = means.select(*group, F.col(variant).alias("_v"), F.col("h").alias("_h"), F.col("j").alias("_j"))
    met = means.join(other, group).where(F.col(variant) < F.col("_v")).where("h <> _h and j <> _j")
    return met.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.avg(((F.col("h") < F.col("_h")) == (F.col("j") < F.col("_j"))).cast("double")).alias("accuracy"))


def repeat_consistency(scores: DataFrame, repeats: list[str]) -> DataFrame:
    """(item, repeat, score) -> over items that all repeats have: n_items, mean_std, mean_spearman of all repeat pairs."""
    wide = scores.where(F.col("repeat").isin(repeats)).groupBy("item").pivot("repeat", repeats).agg(F.avg("score")).dropna()
    values = F.array(*(F.col(f"`{r}`") for r in repeats))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(repeats)
    std = F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / len(repeats))
    spread = wide.agg(F.count("*").alias("n_items"), F.avg(std).alias("mean_std"))
    two = [
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"`{a}`").alias("human"), F.col(f"`{b}`").alias("judge_raw")) for i, a in enumerate(repeats) for b in repeats[i + 1 :]
    ]
    pairs = wide.select(F.explode(F.array(*two)).alias("p")).select("p.*")
    rho = agreement.spearman(agreement.cells(pairs, ["pair"]), ["pair"]).agg(F.avg("spearman").alias("mean_spearman"))
    return spread.crossJoin(F.broadcast(rho))  # one row with one row


def grid_summary(cells: DataFrame, value: str) -> DataFrame:
    """Mean, population spread and count of a cell metric per (setting, signal)."""
    return cells.groupBy("setting", "signal").agg(F.count(value).alias("n_repeats"), F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"))


def score_variants(sources: list[DataFrame]) -> DataFrame:
    """Fan-in of (item_id, metric_id, score, temperature) tables: spread of each item's scores."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("item_id", "metric_id").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("base_score"),
        F.median("score").alias("median_score"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std_score"),
        (F.max("score") - F.min("score")).alias("range_score"),
        F.array_sort(F.collect_set("temperature")).alias("temperatures"),
    )


def later_wins(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Fan-in merge: the value of the last source that has the key."""
    rows = sources[0].select(*keys, value, F.lit(0).alias("_source"))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select(*keys, value, F.lit(i).alias("_source")))
    return rows.groupBy(*keys).agg(F.max_by(value, "_source").alias(value))


def best_dimension(report: DataFrame, metric: str = "spearman") -> DataFrame:
    return report.where(F.col(metric).isNotNull()).agg(F.max_by("dimension", F.struct(metric, "dimension")).alias("dimension"), F.max(metric).alias(metric))


def running_share(pairs: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Cumulative share of a value inside each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pairs.withColumn("share", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy(*by)))
