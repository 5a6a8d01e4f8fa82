"""Columns for scores and labels: casts, cutpoints, ordinal distances, intervals, votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("no", "partial", "yes")
INVALID = "invalid"


def number(text: Column) -> Column:
    """Text to double: trimmed; blank, bad and NaN text gives NULL (never an ANSI error)."""
    value = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value), value)


def json_number(json: Column, path: str) -> Column:
    """A number at a path of JSON text; booleans, strings and containers give NULL."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, path, "double"))


def item_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def key_part(key: Column, i: int) -> Column:
    return F.get(F.split(key, "::"), i)


def known_label(label: Column) -> Column:
    """The label if it is one of the three, else `invalid` (also for NULL)."""
    return F.when(label.isin(*LABELS), label).otherwise(F.lit(INVALID))


def ordinal(label: Column) -> Column:
    return F.when(label == "no", 0.0).when(label == "partial", 0.5).when(label == "yes", 1.0)


def ordinal_error(target: Column, prediction: Column) -> Column:
    return F.abs(ordinal(target) - ordinal(prediction))


def label_of_score(score: Column, low: float = 0.5, high: float = 1.5, least: float = 0.0, most: float = 2.0) -> Column:
    """Score to label by two cuts; outside [least, most] the query fails."""
    error = F.raise_error(F.concat(F.lit("score out of range: "), score.cast("string"))).cast("string")
    return F.when((score < least) | (score > most), error).when(score < low, "no").when(score < high, "partial").when(score.isNotNull(), "yes")


def label_of_level(level: Column) -> Column:
    """Accuracy level 0..3 to label."""
    return F.when(level == 0, "no").when(level == 1, "partial").when(level.isin(2, 3), "yes")


def label_by_cutpoints(score: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(score < low, "no").when(score < high, "partial").when(score.isNotNull(), "yes")


def label_by_gates(presence: Column, completeness: Column, presence_cut: Column | float, completeness_cut: Column | float) -> Column:
    """`no` below the first gate, `partial` below the second."""
    both = presence.isNotNull() & completeness.isNotNull()
    return F.when(both, F.when(presence < presence_cut, "no").when(completeness < completeness_cut, "partial").otherwise("yes"))


def error_bucket(target: Column, prediction: Column) -> Column:
    return (
        F.when((target == "partial") & (prediction != "partial"), "missed_partial")
        .when((prediction == "partial") & (target != "partial"), "false_partial")
        .when(target != prediction, F.concat(target, F.lit("_as_"), prediction))
        .when(target == "partial", "correct_partial_anchor")
        .otherwise("correct_outer_anchor")
    )


def agreement_bucket(ratings: Column) -> Column:
    """unanimous / disputed / unknown, from an item's ratings."""
    n = F.size(F.array_distinct(F.array_compact(ratings)))
    return F.when(ratings.isNull() | (n == 0), "unknown").when(n == 1, "unanimous").otherwise("disputed")


def majority_label(a: Column, b: Column, c: Column, tie: str = "partial") -> Column:
    """The label that two of three agree on; three different labels give `tie`."""
    return F.when(a.eqNullSafe(b) | a.eqNullSafe(c), a).when(b.eqNullSafe(c), b).otherwise(F.lit(tie))


def repair_reason(wrong: Column, unstable: Column) -> Column:
    return F.when(wrong & unstable, "wrong_and_unstable").when(wrong, "wrong").when(unstable, "unstable")


def correlation_band(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").when(value < 0.30, "poor").when(value < 0.60, "fair").when(value < 0.72, "good").otherwise("strong")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def wilson_bounds(hits: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a rate; (0, 0) without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    denominator = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / denominator
    low, high = F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def entropy_bits(shares: list[Column]) -> Column:
    return sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))


def js_divergence_bits(left: list[Column], right: list[Column]) -> Column:
    def half(values: list[Column], others: list[Column]) -> Column:
        return sum((F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) for a, b in zip(values, others)), F.lit(0.0))

    return (half(left, right) + half(right, left)) / 2


def total_variation(left: list[Column], right: list[Column]) -> Column:
    return sum((F.abs(a - b) for a, b in zip(left, right)), F.lit(0.0)) / 2


def repeats_in_cycle(scores: Column) -> Column:
    """Whether the last p scores equal the p before them, for some p of at least 2, and are not constant."""
    n = F.size(scores)
    cycle = F.exists(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n / 2).cast("int"))),
        lambda p: (n >= 2 * p)
        & (F.slice(scores, n - p + 1, p) == F.slice(scores, n - 2 * p + 1, p))
        & (F.size(F.array_distinct(F.slice(scores, n - p + 1, p))) > 1),
    )
    return F.when(n >= 4, cycle).otherwise(False)


def overlap_importance(concept: Column, metric: Column, floor: float = 0.1) -> Column:
    """Share of a metric's dimensions that a concept covers, at least `floor`."""
    return F.greatest(F.lit(floor), F.coalesce(ratio(F.size(F.array_intersect(concept, metric)), F.size(metric)), F.lit(0.0)))


def oriented_answer(answer: Column, strength: Column, raises_when: Column) -> Column:
    """A yes/no answer as -1..1: positive if it raises the score; 0 if unanswered."""
    sign = F.when(F.lower(answer) == F.lower(raises_when), 1.0).when(F.lower(answer).isin("yes", "no"), -1.0)
    return F.coalesce(sign * F.coalesce(strength, F.lit(1.0)), F.lit(0.0))
