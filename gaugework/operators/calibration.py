"""Transparent calibrators and policies that plain aggregates can fit: bias, line, cutpoints, rules, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import scoring as S

FAR = 100.000001


def bias_leave_one_out(rows: DataFrame, group: str, item: str, base: str = "base", human: str = "human") -> DataFrame:
    """Each row's base plus the mean residual of the other items of its group: totals minus the item's own."""
    r = F.col(human) - F.col(base)
    items = rows.groupBy(group, item).agg(F.sum(r).alias("_r"), F.count(r).alias("_c"))
    totals = items.groupBy(group).agg(F.sum("_r").alias("_rt"), F.sum("_c").alias("_ct"))
    joined = rows.join(items, [group, item]).join(totals, group)
    rest = F.coalesce(S.ratio(F.col("_rt") - F.col("_r"), F.col("_ct") - F.col("_c")), F.lit(0.0))
    return joined.withColumn("prediction", F.col(base) + rest).drop("_r", "_c", "_rt", "_ct")


def fit_line(rows: DataFrame, by: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """Weighted least squares y = intercept + slope x; a constant x gives slope 0."""
    w = F.lit(1.0) if weight is None else weight
    z = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).where("x is not null and y is not null and w > 0")
    sums = z.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("w").alias("_w"), F.sum(F.expr("w * x")).alias("_x"), F.sum(F.expr("w * y")).alias("_y"),
        F.sum(F.expr("w * x * x")).alias("_xx"), F.sum(F.expr("w * x * y")).alias("_xy"), (F.min("x") < F.max("x")).alias("_varies"),
    )
    slope = F.when(F.col("_varies"), (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x"))).otherwise(0.0)
    return sums.withColumn("slope", slope).select(*by, "n", "slope", ((F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_w")).alias("intercept"))


def apply_line(rows: DataFrame, model: DataFrame, by: list[str], x: str, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    """Clipped predictions; rows of a group without a model keep x."""
    p = F.coalesce(F.col("intercept") + F.col("slope") * F.col(x), F.col(x))
    return rows.join(model.select(*by, "slope", "intercept"), by, "left").withColumn("prediction", F.greatest(F.lit(lo), F.least(F.lit(hi), p))).drop("slope", "intercept")


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median: the least value whose cumulative weight reaches half.  Equal values are summed first."""
    z = rows.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    upto = F.sum("_w").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_w").over(Window.partitionBy(*by))
    reached = z.withColumn("_ok", upto >= total / 2).where("_ok")
    return reached.groupBy(*by).agg(F.min(value).alias("weighted_median"))


def impute_median(rows: DataFrame, features: list[str], training: Column) -> DataFrame:
    """NULL features take the training rows' median (0 without one); medians are one row."""
    medians = rows.agg(*(F.median(F.when(training, F.col(f))).alias(f"_{f}") for f in features))
    filled = rows.crossJoin(F.broadcast(medians))  # one row
    return filled.select(*(c for c in rows.columns if c not in features), *(F.coalesce(F.col(f), F.col(f"_{f}"), F.lit(0.0)).alias(f) for f in features))


def varying_features(rows: DataFrame, features: list[str], training: Column) -> DataFrame:
    """feature, n_distinct of its training values; those with one value or none carry nothing."""
    counts = rows.agg(*(F.countDistinct(F.when(training, F.col(f))).alias(f) for f in features))
    return counts.unpivot([], features, "feature", "n_distinct").withColumn("kept", F.col("n_distinct") > 1)


def _trials(rows: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """Label counts below each candidate cut, and their totals: candidates are 0, FAR and just above each score."""
    z = rows.where(F.col(score).isNotNull() & F.col("target").isin(*S.LABELS))
    counted = z.groupBy(F.col(score).cast("double").alias("s")).agg(*(F.count(F.when(F.col("target") == x, 1)).alias(f"c_{x}") for x in S.LABELS))
    edges = rows.sparkSession.createDataFrame([(0.0,), (FAR,)], "cut double")
    cuts = counted.select(F.least(F.lit(FAR), F.col("s") + 1e-6).alias("cut")).unionByName(edges).distinct()
    # Below a cut: the running sums of the scores up to it, by one union and window over distinct scores.
    both = counted.select(F.col("s").alias("at"), F.lit(1).alias("kind"), *(f"c_{x}" for x in S.LABELS)).unionByName(
        cuts.select(F.col("cut").alias("at"), F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(f"c_{x}") for x in S.LABELS))
    )
    w = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)  # distinct scores of a 0-100 scale
    below = both.withColumns({f"b_{x}": F.coalesce(F.sum(f"c_{x}").over(w), F.lit(0)) for x in S.LABELS}).where("kind = 0")
    totals = counted.agg(*(F.coalesce(F.sum(f"c_{x}"), F.lit(0)).alias(f"t_{x}") for x in S.LABELS))
    return below.select(F.col("at").alias("cut"), *(f"b_{x}" for x in S.LABELS)), totals


def fit_cutpoints(
    rows: DataFrame, score: str = "ordinal_score", tolerance: float = 0.01, least_recall: float = 0.1, defaults: tuple[float, float] = (30.0, 60.0), objective: str = "partial"
) -> DataFrame:
    """(target, score) -> one row: the best pair of cuts with its accuracy, macro F1 and partial F1.

    Every pair of candidate cuts is rated from running label counts.  Pairs that keep each represented label's
    recall come first; then, for the `partial` objective, those within the tolerance of the best accuracy.
    Ties go to the pair nearest to the defaults, then to the lowest cuts.  The scale is 0 to 100, so
    candidates are as many as distinct scores, not as rows.
    """
    below, totals = _trials(rows, score)
    a = below.select(F.col("cut").alias("low"), *(F.col(f"b_{x}").alias(f"a_{x}") for x in S.LABELS))
    b = below.select(F.col("cut").alias("high"), *(F.col(f"b_{x}") for x in S.LABELS))
    z = a.join(b, F.col("low") < F.col("high")).crossJoin(F.broadcast(totals))  # one row
    n = F.col("t_no") + F.col("t_partial") + F.col("t_yes")
    tp = {"no": F.col("a_no"), "partial": F.col("b_partial") - F.col("a_partial"), "yes": F.col("t_yes") - F.col("b_yes")}
    predicted = {
        "no": sum(F.col(f"a_{x}") for x in S.LABELS),
        "partial": sum(F.col(f"b_{x}") - F.col(f"a_{x}") for x in S.LABELS),
        "yes": sum(F.col(f"t_{x}") - F.col(f"b_{x}") for x in S.LABELS),
    }
    recall = {x: S.ratio(tp[x], F.col(f"t_{x}")) for x in S.LABELS}
    precision = {x: S.ratio(tp[x], predicted[x]) for x in S.LABELS}
    f1 = {x: F.when((recall[x] + precision[x]) > 0, 2 * recall[x] * precision[x] / (recall[x] + precision[x])).when((recall[x] + precision[x]) == 0, 0.0) for x in S.LABELS}

    def mean(values: list[Column]) -> Column:
        found = F.array_compact(F.array(*values))
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, v: s + v) / F.size(found)).otherwise(0.0)

    kept = F.lit(True)
    for x in S.LABELS:
        kept = kept & ((F.col(f"t_{x}") == 0) | (F.coalesce(recall[x], F.lit(0.0)) + 1e-12 >= least_recall))
    rated = z.where(n > 0).select(
        "low", "high", n.alias("n"), kept.alias("kept"), S.ratio(sum(tp.values()), n).alias("accuracy"), mean(list(recall.values())).alias("balanced"),
        mean(list(f1.values())).alias("macro_f1"), F.coalesce(f1["partial"], F.lit(0.0)).alias("partial_f1"),
        (-F.abs(F.col("low") - defaults[0]) - F.abs(F.col("high") - defaults[1])).alias("nearness"),
    )
    best = rated.groupBy("kept").agg(F.max("accuracy").alias("_most"))
    pool = best.agg(F.max_by(F.struct("kept", "_most"), "kept").alias("p")).select("p.*")
    open_ = rated.join(F.broadcast(pool), "kept")
    if objective == "partial":
        open_ = open_.where(F.col("accuracy") + tolerance + 1e-12 >= F.col("_most"))
        order = ["partial_f1", "macro_f1"]
    else:
        order = ["macro_f1", "partial_f1"]
    key = F.struct(*order, "balanced", "accuracy", "nearness", (-F.col("low")).alias("l"), (-F.col("high")).alias("h"))
    return open_.agg(F.max_by(F.struct("low", "high", "n", "kept", "accuracy", "balanced", "macro_f1", "partial_f1"), key).alias("b")).select("b.*").where("low is not null")


def mine_rules(rows: DataFrame, features: list[Column], least_support: int, least_gain: int) -> DataFrame:
    """(target, prediction) -> best label of each feature value that gains enough over the predictions.

    features: key columns by level, general ones last.  Each row goes to all its levels at once.
    """
    keyed = rows.select("target", "prediction", F.posexplode(F.array(*features)).alias("level", "rule_key")).where("rule_key is not null")
    counts = keyed.groupBy("level", "rule_key", "target").agg(F.count("*").alias("c"), F.count(F.when(F.col("target") == F.col("prediction"), 1)).alias("hit"))
    per = counts.groupBy("level", "rule_key").agg(
        F.sum("c").alias("support"), F.sum("hit").alias("base_hits"), F.max(F.struct("c", (F.col("target") == "partial").alias("p"), F.col("target").alias("label"))).alias("best")
    )
    rules = per.select("level", "rule_key", "support", "base_hits", F.col("best.label").alias("action"), (F.col("best.c") - F.col("base_hits")).alias("gain"))
    return rules.where((F.col("support") >= least_support) & (F.col("gain") >= least_gain))


def safe_switches(rows: DataFrame, features: list[Column], least_support: int) -> DataFrame:
    """(target, prediction, other): feature values where `other` repairs at least one case and breaks none."""
    keyed = rows.select(F.posexplode(F.array(*features)).alias("level", "rule_key"), (F.col("prediction") == F.col("target")).alias("a"), (F.col("other") == F.col("target")).alias("b"))
    per = keyed.where("rule_key is not null").groupBy("level", "rule_key").agg(F.count("*").alias("support"), F.count_if(F.expr("b and not a")).alias("fixed"), F.count_if(F.expr("a and not b")).alias("broken"))
    return per.where((F.col("support") >= least_support) & (F.col("fixed") >= 1) & (F.col("broken") == 0))


def group_priors(rows: DataFrame, group: str, threshold: float, least_support: int) -> DataFrame:
    """Each group's most frequent label where its share and support suffice; the larger label on ties."""
    counts = rows.groupBy(group, "target").agg(F.count("*").alias("c"))
    per = counts.groupBy(group).agg(F.sum("c").alias("support"), F.max(F.struct("c", "target")).alias("m"))
    share = F.col("m.c") / F.col("support")
    return per.where((share >= threshold) & (F.col("support") >= least_support)).select(group, F.col("m.target").alias("label"), "support", share.alias("share"))


def switch_gains(rows: DataFrame, by: list[str], least_support: int, least_gain: int) -> DataFrame:
    """Where a second opinion gains over the first: overall, per label, and per (group, label), by grouping sets."""
    hit = F.count_if(F.col("prediction") == F.col("target"))
    other = F.count_if(F.col("other") == F.col("target"))
    sets = [[F.col(c) for c in by[i:]] for i in range(len(by) + 1)]
    grouped = rows.groupingSets(sets, *by).agg(F.grouping_id().alias("level"), F.count("*").alias("support"), (other - hit).alias("gain"))
    return grouped.where((F.col("support") >= least_support) & (F.col("gain") >= least_gain))


def macro_item_error(rows: DataFrame, item: str, predictions: list[str], human: str = "human") -> DataFrame:
    """predictor, mae: the mean over items of each item's mean absolute error."""
    long = rows.unpivot([item, human], predictions, "predictor", "value")
    items = long.groupBy("predictor", item).agg(F.avg(F.abs(F.col("value") - F.col(human))).alias("e"))
    return items.groupBy("predictor").agg(F.count("*").alias("n_items"), F.avg("e").alias("mae"))


def fit_referral(rows: DataFrame, rules: dict[str, Column], supports: list[int], support: str, coverage_floor: float) -> DataFrame:
    """The (rule, support) whose referral finds disputed items best (F1) while enough items stay unreferred."""
    configs = [F.struct(F.lit(name).alias("rule"), F.lit(k).alias("least_support"), (rule & (F.col(support) >= k)).alias("keep")) for name, rule in rules.items() for k in supports]
    tried = rows.select("disputed", F.explode(F.array(*configs)).alias("c")).select("disputed", "c.*")
    sums = tried.groupBy("rule", "least_support").agg(
        F.avg(F.col("keep").cast("double")).alias("coverage"), F.count_if(~F.col("keep")).alias("_r"), F.count_if("disputed").alias("_d"), F.count_if(F.expr("disputed and not keep")).alias("_b")
    )
    f1 = F.when(F.col("_r") + F.col("_d") > 0, 2 * F.col("_b") / (F.col("_r") + F.col("_d"))).otherwise(0.0)
    rated = sums.withColumn("f1", f1).where(F.col("coverage") >= coverage_floor)
    return rated.orderBy(F.desc("f1"), F.desc("coverage"), "least_support", "rule").limit(1).select("rule", "least_support", "coverage", "f1")


def fit_gates(rows: DataFrame, presence: str, completeness: str, least_recall: float = 0.1, defaults: tuple[float, float] = (50.0, 90.0)) -> DataFrame:
    """(target, two scores of 0..100) -> one row: the pair of gates with the best macro F1, then partial F1 and accuracy.

    Counts below both gates come from running sums over the grid of candidate cuts, as many as distinct scores of each scale.
    """
    z = rows.where(F.col(presence).isNotNull() & F.col(completeness).isNotNull() & F.col("target").isin(*S.LABELS))
    spark = rows.sparkSession

    def cuts(score: str, name: str) -> DataFrame:
        return z.select(F.least(F.lit(FAR), F.col(score) + 1e-6).alias(name)).unionByName(spark.createDataFrame([(0.0,), (FAR,)], f"{name} double")).distinct()

    # A score counts below the cut just above it, so its cell is that cut's.
    counted = z.groupBy((F.least(F.lit(FAR), F.col(presence) + 1e-6)).alias("p"), (F.least(F.lit(FAR), F.col(completeness) + 1e-6)).alias("c")).agg(*(F.count(F.when(F.col("target") == x, 1)).alias(x) for x in S.LABELS))
    grid = cuts(presence, "p").crossJoin(cuts(completeness, "c")).join(counted, ["p", "c"], "left").na.fill(0, list(S.LABELS))  # distinct cuts of the two scales
    by_p = Window.partitionBy("p").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.withColumns({f"r_{x}": F.sum(x).over(by_p) for x in S.LABELS})
    by_c = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    both = run.withColumns({f"b_{x}": F.sum(f"r_{x}").over(by_c) for x in S.LABELS})
    edge = both.where(F.col("c") == FAR).select("p", *(F.col(f"b_{x}").alias(f"a_{x}") for x in S.LABELS))
    totals = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(f"t_{x}") for x in S.LABELS))
    # Below p: a; below p and below c: b; below c alone: with p at its end.
    side = both.where(F.col("p") == FAR).select("c", *(F.col(f"b_{x}").alias(f"s_{x}") for x in S.LABELS))
    z = both.select("p", "c", *(f"b_{x}" for x in S.LABELS)).join(edge, "p").join(side, "c").crossJoin(F.broadcast(totals))  # one row
    inside = {x: F.col(f"s_{x}") - F.col(f"b_{x}") for x in S.LABELS}
    tp = {"no": F.col("a_no"), "partial": inside["partial"], "yes": F.col("t_yes") - F.col("a_yes") - inside["yes"]}
    predicted = {"no": sum(F.col(f"a_{x}") for x in S.LABELS), "partial": sum(inside.values()), "yes": sum(F.col(f"t_{x}") - F.col(f"a_{x}") - inside[x] for x in S.LABELS)}
    recall = {x: S.ratio(tp[x], F.col(f"t_{x}")) for x in S.LABELS}
    precision = {x: S.ratio(tp[x], predicted[x]) for x in S.LABELS}
    f1 = {x: F.when((recall[x] + precision[x]) > 0, 2 * recall[x] * precision[x] / (recall[x] + precision[x])).when((recall[x] + precision[x]) == 0, 0.0) for x in S.LABELS}
    defined = F.array_compact(F.array(*f1.values()))
    macro = F.when(F.size(defined) > 0, F.aggregate(defined, F.lit(0.0), lambda s, v: s + v) / F.size(defined)).otherwise(0.0)
    n = F.col("t_no") + F.col("t_partial") + F.col("t_yes")
    kept = F.lit(True)
    for x in S.LABELS:
        kept = kept & ((F.col(f"t_{x}") == 0) | (F.coalesce(recall[x], F.lit(0.0)) + 1e-12 >= least_recall))
    rated = z.where(n > 0).select(
        F.col("p").alias("presence_cut"), F.col("c").alias("completeness_cut"), kept.alias("kept"), macro.alias("macro_f1"), F.coalesce(f1["partial"], F.lit(0.0)).alias("partial_f1"), S.ratio(sum(tp.values()), n).alias("accuracy")
    )
    near = -F.abs(F.col("presence_cut") - defaults[0]) - F.abs(F.col("completeness_cut") - defaults[1])
    order = F.struct("kept", "macro_f1", "partial_f1", "accuracy", near.alias("n"), (-F.col("presence_cut")).alias("x"), (-F.col("completeness_cut")).alias("y"))
    return rated.agg(F.max_by(F.struct(*rated.columns), order).alias("b")).select("b.*").where("presence_cut is not null")


def cross_validated_cutpoints(rows: DataFrame, folds: DataFrame, task: str, n_folds: int, score: str = "ordinal_score") -> DataFrame:
    """Every row with the label that cuts fitted to the other folds give it: one small fit per fold."""
    z, out = rows.join(folds, task), None
    for f in range(n_folds):
        cuts = fit_cutpoints(z.where(F.col("fold") != f), score).select("low", "high")
        part = z.where(F.col("fold") == f).crossJoin(F.broadcast(cuts)).withColumn("calibrated", S.label_by_cutpoints(F.col(score), F.col("low"), F.col("high")))  # one row
        out = part if out is None else out.unionByName(part)
    return out.drop("low", "high")


def cross_validated_gates(rows: DataFrame, n_folds: int, presence: str, completeness: str) -> DataFrame:
    """(fold 0 .. n_folds - 1, target, two scores) -> every row with the label of the gates fitted to the other folds; one fit per fold.

    A row without a score has no label; a fold whose training rows are none has no rows in the result.
    """
    out = None
    for f in range(n_folds):
        gates = fit_gates(rows.where(F.col("fold") != f), presence, completeness).select("presence_cut", "completeness_cut")
        part = rows.where(F.col("fold") == f).crossJoin(F.broadcast(gates))  # one row
        part = part.withColumn("calibrated", S.label_by_gates(F.col(presence), F.col(completeness), F.col("presence_cut"), F.col("completeness_cut")))
        out = part if out is None else out.unionByName(part)
    return out


def calibrated_units(units: DataFrame, lines: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Units with raw_score, and score and calibration_std by their group's line (bayesian_line), kept within 1..5.

    Units that are not valid, have no score or no line keep their score.
    """
    held = units.join(F.broadcast(lines.select(*by, "intercept", "slope", "noise_std", "mean_x", "slope_std")), by, "left")  # a row per rubric
    use = F.col("valid") & F.col(score).isNotNull() & F.col("slope").isNotNull()
    fitted = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("intercept") + F.col("slope") * F.col(score)))
    spread = F.sqrt(F.col("noise_std") ** 2 + ((F.col(score) - F.col("mean_x")) * F.col("slope_std")) ** 2)
    out = held.withColumns({"raw_score": F.when(use, F.col(score)), "calibration_std": F.when(use, spread), "_fitted": F.when(use, fitted)})
    return out.withColumn(score, F.coalesce("_fitted", score)).drop("_fitted", "intercept", "slope", "noise_std", "mean_x", "slope_std")


def comparators_out_of_fold(rows: DataFrame, by: list[str], fold: str, x: str = "judge_raw", y: str = "human") -> DataFrame:
    """Rows with base, bias and score_linear: the raw score, with the other folds' mean error added, and by their regression line.

    A group's sums less those of the fold give the fits, so rows meet once.  Without a slope (one distinct x) the line is
    the bias; a group of a single fold has neither.
    """
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    own = good.groupBy(*by, fold).agg(*(c.cast("double").alias(f"_{k}") for k, c in parts.items()))
    whole = own.withColumns({f"_o{k}": F.sum(f"_{k}").over(Window.partitionBy(*by)) - F.col(f"_{k}") for k in parts})
    n, sx, sy, sxx, sxy = (F.col(f"_o{k}") for k in parts)
    spread = n * sxx - sx * sx
    slope = F.when((n > 0) & (spread > 1e-9), (n * sxy - sx * sy) / spread).when(n > 0, 1.0)
    fits = whole.withColumns({"_slope": slope, "_bias": F.when(n > 0, (sy - sx) / n)}).withColumn("_cut", F.when(n > 0, (sy - F.col("_slope") * sx) / n))
    z = good.join(fits.select(*by, fold, "_slope", "_bias", "_cut"), [*by, fold])
    return z.withColumns({"base": F.col(x), "bias": F.col(x) + F.col("_bias"), "score_linear": F.col("_cut") + F.col("_slope") * F.col(x)}).drop("_slope", "_bias", "_cut")


def observation_weights(rows: DataFrame, item: str) -> DataFrame:
    """Each of an item's observations weighs one over their number."""
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(item)))


def one_hot(rows: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    return rows.withColumns({f"{prefix}{v}": (F.col(column).eqNullSafe(F.lit(v))).cast("double") for v in values})
