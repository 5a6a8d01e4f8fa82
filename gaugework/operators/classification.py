"""Three-class decisions: confusion, class metrics, votes, repeated draws, selective and referral quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scoring as S


def confusion(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(target, prediction) -> counts per pair; predictions outside the labels are `invalid`."""
    return rows.groupBy(*by, "target", S.known_label(F.col("prediction")).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, by: list[str] = (), undefined_f1_is_zero: bool = False) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, ordinal MAE, and recall, precision and F1 of each label.

    Macro F1 is over labels with a defined F1, or over all three with 0 for the others.  One pass of conditional counts.
    """
    p = S.known_label(F.col("prediction"))
    t = F.col("target")

    def count(condition):
        return F.count(F.when(condition, 1))

    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        count(t == p).alias("_hit"),
        F.avg(S.ordinal_error(t, p)).alias("ordinal_mae"),
        count(p == S.INVALID).alias("n_invalid"),
        *(count((t == x) & (p == x)).alias(f"_tp_{x}") for x in S.LABELS),
        *(count(t == x).alias(f"_t_{x}") for x in S.LABELS),
        *(count((p == x) & t.isin(*S.LABELS)).alias(f"_p_{x}") for x in S.LABELS),
    )
    recall = {x: S.ratio(F.col(f"_tp_{x}"), F.col(f"_t_{x}")) for x in S.LABELS}
    precision = {x: S.ratio(F.col(f"_tp_{x}"), F.col(f"_p_{x}")) for x in S.LABELS}
    f1 = {
        x: F.when(recall[x].isNotNull() & precision[x].isNotNull(), F.when(recall[x] + precision[x] > 0, 2 * recall[x] * precision[x] / (recall[x] + precision[x])).otherwise(0.0))
        for x in S.LABELS
    }

    def mean(values):
        found = F.array_compact(F.array(*values))
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))

    f1s = [F.coalesce(f1[x], F.lit(0.0)) if undefined_f1_is_zero else f1[x] for x in S.LABELS]
    return sums.select(
        *by,
        "n",
        "n_invalid",
        S.ratio(F.col("_hit"), F.col("n")).alias("accuracy"),
        mean(recall.values()).alias("balanced_accuracy"),
        mean(f1s).alias("macro_f1"),
        "ordinal_mae",
        *(recall[x].alias(f"recall_{x}") for x in S.LABELS),
        *(precision[x].alias(f"precision_{x}") for x in S.LABELS),
        *(f1[x].alias(f"f1_{x}") for x in S.LABELS),
    )


def label_kappa(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Quadratic weighted kappa of labels; without expected disagreement 1 if none is observed, else 0."""
    z = rows.select(*by, (S.ordinal(F.col("target")) * 2).alias("t"), (S.ordinal(F.col("prediction")) * 2).alias("p")).where("t is not null and p is not null")
    s = z.groupBy(*by).agg(
        F.avg((F.col("t") - F.col("p")) ** 2).alias("_o"), (F.avg(F.expr("t * t")) + F.avg(F.expr("p * p")) - 2 * F.avg("t") * F.avg("p")).alias("_e"),
        (F.min(F.least("t", "p")) == F.max(F.greatest("t", "p"))).alias("_flat"),
    )
    return s.select(*by, F.when(F.col("_flat"), 1.0).otherwise(1 - F.col("_o") / F.col("_e")).alias("kappa"))


def repeated_draws(draws: DataFrame, by: list[str], required: int = 7) -> DataFrame:
    """(by..., target, label) of repeated draws -> counts, hits, modal label, entropy, Wilson interval."""
    label = S.known_label(F.col("label"))
    order = (*S.LABELS, S.INVALID)
    sums = draws.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(label == F.col("target"), 1)).alias("hits"), *(F.count(F.when(label == x, 1)).alias(f"n_{x}") for x in order))
    shares = [F.col(f"n_{x}") / F.col("n") for x in order]
    modal = F.array_max(F.array(*(F.struct(F.col(f"n_{x}").alias("c"), F.lit(-i).alias("o"), F.lit(x).alias("x")) for i, x in enumerate(order))))
    low, high = S.wilson_bounds(F.col("hits"), F.col("n"))
    return sums.select(
        *by,
        "n",
        "hits",
        (F.col("hits") >= required).alias("robust"),
        *(f"n_{x}" for x in order),
        modal["x"].alias("modal_label"),
        (modal["c"] / F.col("n")).alias("modal_share"),
        S.entropy_bits(shares).alias("entropy_bits"),
        low.alias("wilson_low"),
        high.alias("wilson_high"),
    )


def compare_draws(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two repeated_draws() tables: hit difference, total variation and Jensen-Shannon divergence."""
    order = (*S.LABELS, S.INVALID)
    a = left.select(*by, F.col("hits").alias("_ha"), F.struct(*((F.col(f"n_{x}") / F.col("n")).alias(x) for x in order)).alias("a"))
    b = right.select(*by, F.col("hits").alias("_hb"), F.struct(*((F.col(f"n_{x}") / F.col("n")).alias(x) for x in order)).alias("b"))
    pa, pb = [F.col(f"a.{x}") for x in order], [F.col(f"b.{x}") for x in order]
    return a.join(b, by).select(
        *by, (F.col("_hb") - F.col("_ha")).alias("hit_delta"), S.total_variation(pa, pb).alias("total_variation"), S.js_divergence_bits(pa, pb).alias("js_divergence")
    )


def label_reliability(ratings: DataFrame, by: list[str] = ()) -> DataFrame:
    """(item_id, target, label), a row per vote: entropy, modal support, share of items whose target is the modal vote.

    Votes are only counted, so no item's votes are gathered; a null label is no vote.
    """
    sums = ratings.where("label is not null").groupBy(*dict.fromkeys([*by, "item_id", "target"])).agg(
        F.count("*").alias("_n"), (F.min("label") < F.max("label")).alias("_mixed"), *(F.count(F.when(F.col("label") == x, 1)).alias(f"_n_{x}") for x in S.LABELS)
    )
    n = F.col("_n")
    counts = {x: F.col(f"_n_{x}") for x in S.LABELS}
    shares = [counts[x] / n for x in S.LABELS]
    modal = F.array_max(F.array(*(F.struct(counts[x].alias("c"), F.lit(-i).alias("o"), F.lit(x).alias("x")) for i, x in enumerate(S.LABELS))))
    rows = sums.select(
        *by,
        S.entropy_bits(shares).alias("e"),
        (modal["c"] / n).alias("m"),
        (modal["x"] == F.col("target")).cast("double").alias("hit"),
        sum((p * p for p in shares), F.lit(0.0)).alias("agree"),
        F.col("_mixed").cast("double").alias("disputed"),
    )
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("e").alias("entropy_bits"),
        F.avg("m").alias("modal_support"),
        F.avg("hit").alias("modal_match"),
        F.avg("agree").alias("expected_agreement"),
        F.avg("disputed").alias("disputed_rate"),
    )


def selective(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(target, prediction, accepted): coverage, accuracy of what is accepted, errors caught by review, ceiling with perfect review."""
    wrong = (~F.col("target").eqNullSafe(F.col("prediction"))).cast("double")
    a = F.col("accepted")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(a, 1)).alias("n_accepted"), F.sum(wrong).alias("_wrong"), F.sum(F.when(a, wrong).otherwise(0.0)).alias("_wrong_in")
    )
    return sums.select(
        *by,
        "n",
        "n_accepted",
        (F.col("n_accepted") / F.col("n")).alias("coverage"),
        S.ratio(F.col("n_accepted") - F.col("_wrong_in"), F.col("n_accepted")).alias("accepted_accuracy"),
        S.ratio(F.col("_wrong") - F.col("_wrong_in"), F.col("_wrong")).alias("error_capture"),
        ((F.col("n") - F.col("_wrong_in")) / F.col("n")).alias("reviewed_accuracy"),
    )


def referral(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(disputed, referred): precision, recall and F1 of referring disputed items."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("disputed"), 1)).alias("n_disputed"),
        F.count(F.when(F.col("referred"), 1)).alias("n_referred"),
        F.count(F.when(F.col("disputed") & F.col("referred"), 1)).alias("_both"),
    )
    p, r = S.ratio(F.col("_both"), F.col("n_referred")), S.ratio(F.col("_both"), F.col("n_disputed"))
    return sums.select(*by, "n", "n_disputed", "n_referred", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).when((p + r) == 0, 0.0).alias("f1"))


def gate_counts(rows: DataFrame) -> DataFrame:
    """(gate boolean, NULL for skipped; score): passes, failures, skips, mean score."""
    return rows.agg(
        F.count(F.when(F.col("gate"), 1)).alias("passed"), F.count(F.when(~F.col("gate"), 1)).alias("failed"), F.count(F.when(F.col("gate").isNull(), 1)).alias("skipped"), F.avg("score").alias("mean_score")
    )


def grouping_levels(rows: DataFrame, columns: list[str], aggregate: dict) -> DataFrame:
    """The same aggregates over all rows and over each column alone, by grouping sets."""
    sets = [[]] + [[c] for c in columns]
    flags = [(1 - F.grouping(c)) * F.lit(1 << i) for i, c in enumerate(columns)]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(sum(flags, F.lit(0)).alias("level"), *(v.alias(k) for k, v in aggregate.items()))
