"""Verdicts from leaves, evidence rules, prompt-tree figures, residual leaves and guarded selection.

All are grouped aggregates or columns.  Unless a docstring says otherwise, rows with a null group are a group, ties go to the
smaller name, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions.vectors import cosine




def _sound(label: Column, valid: Column) -> Column:
    return F.coalesce(valid & label.isin(*S.LABELS), F.lit(False))


def label_support(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by..., candidate, label, valid), one leaf per candidate label -> by..., label, valid.

    The candidate with the highest support; a tie gives partial.  A missing, foreign or repeated candidate, or a leaf that is not
    valid, makes the verdict invalid (label NULL).
    """
    score = F.when(F.col("label") == "no", 0).when(F.col("label") == "partial", 1).when(F.col("label") == "yes", 2)
    good = _sound(F.col("label"), F.col("valid")) & F.coalesce(F.col("candidate").isin(*S.LABELS), F.lit(False))
    held = leaves.groupBy(*by).agg(
        F.min(good).alias("_good"), F.count("*").alias("_n"), F.count_distinct("candidate").alias("_kinds"),
        *(F.max(F.when(F.col("candidate") == x, score)).alias(f"_{x}") for x in S.LABELS),
    )
    most = F.greatest(*(F.col(f"_{x}") for x in S.LABELS))
    wins = sum((F.col(f"_{x}") == most).cast("int") for x in S.LABELS)
    label = F.when(wins > 1, "partial")
    for x in S.LABELS:
        label = label.when(F.col(f"_{x}") == most, x)
    valid = F.col("_good") & (F.col("_n") == 3) & (F.col("_kinds") == 3)
    return held.select(*by, F.when(valid, label).alias("label"), valid.alias("valid"))


def requirement_label(presence: Column, fidelity: Column, kind: Column, valid: Column) -> Column:
    """The label of a requirement from its presence and fidelity leaves; NULL where one is not valid."""
    sound = _sound(presence, valid) & _sound(fidelity, valid)
    failed = (presence == "no") | (F.coalesce(kind == "outcome", F.lit(False)) & (fidelity == "no"))
    return F.when(sound, F.when(failed, "no").when((presence == "yes") & (fidelity == "yes"), "yes").otherwise("partial"))


def tree_verdict(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by..., role, label, valid), roles core, modifier and preservation -> by..., label, valid.

    A failed core or preservation leaf fails the whole; any other leaf short of yes makes it partial.
    """
    core, kept = F.col("role") == "core", F.col("role") == "preservation"
    held = leaves.groupBy(*by).agg(
        F.min(_sound(F.col("label"), F.col("valid"))).alias("_good"),
        F.max((core | kept) & (F.col("label") == "no")).alias("_failed"),
        F.max(F.coalesce(F.col("label") != "yes", F.lit(True))).alias("_short"),
    )
    label = F.when(F.col("_failed"), "no").when(F.col("_short"), "partial").otherwise("yes")
    return held.select(*by, F.when(F.col("_good"), label).alias("label"), F.col("_good").alias("valid"))


def evidence_signals(tie: Column, similarity: Column, threshold: Column, support: Column, least_support: int, default: float = 0.7) -> dict[str, Column]:
    """Signals that never see a target: no majority, a route below its threshold, a route with little support."""
    return {
        "total_disagreement": F.coalesce(tie, F.lit(False)),
        "low_route_similarity": F.coalesce(similarity, F.lit(0.0)) < F.coalesce(F.nullif(threshold, F.lit(0.0)), F.lit(default)),
        "unsupported_route": F.coalesce(support, F.lit(0)) < least_support,
    }


def evidence_referral(signals: dict[str, Column], rule: str = "disagreement_or_routing") -> tuple[Column, Column]:
    """(refer, reason): by `disagreement`, by `routing`, or by either; the reason lists the signals that fired."""
    weak = signals["low_route_similarity"] | signals["unsupported_route"]
    refer = {"disagreement": signals["total_disagreement"], "routing": weak}.get(rule, signals["total_disagreement"] | weak)
    fired = F.concat_ws(",", *(F.when(hit, F.lit(name)) for name, hit in signals.items()))
    return refer, F.when(refer, F.concat(F.lit("evidence_referral:"), fired)).otherwise("evidence_accepted")


def route_metrics(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(path array, routed_node) -> n_routed, mean_route_depth, fallback_to_root_rate; rows with neither are not counted."""
    depth = F.greatest(F.coalesce(F.size("path"), F.lit(0)) - 1, F.lit(0))
    rows = routes.where(F.col("path").isNotNull() | F.col("routed_node").isNotNull())
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_routed"), F.avg(depth).alias("mean_route_depth"), F.avg((depth == 0).cast("double")).alias("fallback_to_root_rate"))


def tree_levels(nodes: DataFrame, leaf_cases: int) -> DataFrame:
    """(level, covered, accuracy) of a prompt tree's nodes -> per level: nodes, coverage of the leaf cases, mean accuracy."""
    share = S.ratio(F.sum("covered"), F.lit(float(leaf_cases)))
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), share.alias("coverage"), F.avg("accuracy").alias("mean_accuracy"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, status, accuracy) -> one row: leaves, nodes, compression, root accuracy, loss from children to parent.

    The loss is the mean over merged nodes (accepted, partial, global) with an accuracy of their children's mean less their own.
    """
    child = nodes.where("parent_id is not null and accuracy is not null").groupBy(F.col("parent_id").alias("_of")).agg(F.avg("accuracy").alias("_children"))
    merged = F.col("status").isin("accepted", "partial", "global")
    z = nodes.join(child, F.col("node_id") == F.col("_of"), "left")
    return z.agg(
        F.count_if(F.col("status") == "leaf").alias("n_leaves"), F.count("*").alias("n_final_nodes"), S.ratio(F.count_if(F.col("status") == "leaf"), F.count("*")).alias("compression_ratio"),
        F.avg(F.when(F.col("parent_id").isNull(), F.col("accuracy"))).alias("root_accuracy"), F.avg(F.when(merged, F.col("_children") - F.col("accuracy"))).alias("accuracy_loss"),
    )


def behavior_profile(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., target, prediction) -> by..., profile: shares of the nine target/prediction pairs; other pairs do not count."""
    known = F.col("target").isin(*S.LABELS) & F.col("prediction").isin(*S.LABELS)
    cells = [F.count_if((F.col("target") == t) & (F.col("prediction") == p)).alias(f"_{t}_{p}") for t in S.LABELS for p in S.LABELS]
    held = rows.groupBy(*by).agg(F.count_if(known).alias("_n"), *cells)
    n = F.greatest(F.col("_n"), F.lit(1))
    return held.select(*by, F.array(*(F.col(f"_{t}_{p}") / n for t in S.LABELS for p in S.LABELS)).alias("profile"))


def pair_score(semantic: Column, left: Column, right: Column, transfer: Column | None = None, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted mean of semantic similarity, cosine of behaviour profiles, and transfer where it is known."""
    total = weights[0] * semantic + weights[1] * F.coalesce(cosine(left, right), F.lit(0.0))
    active = weights[0] + weights[1]
    if transfer is None:
        return total / (active or 1.0)
    return F.when(transfer.isNull(), total / (active or 1.0)).otherwise((total + weights[2] * transfer) / ((active + weights[2]) or 1.0))


def failure_signature(family: Column, prediction: Column, target: Column) -> Column:
    """family:prediction->target; a prediction that is no label reads invalid."""
    return F.concat(family, F.lit(":"), S.known_label(prediction), F.lit("->"), target)


def concept_of_feature(name: Column, concepts: list[str]) -> Column:
    """The concept that a feature's name refers to: rubric:<key>, or a known key after fm: or rule:; else NULL."""
    key = F.get(F.split(name, ":"), 1)
    return F.when(name.startswith("rubric:"), F.concat(F.lit("rubric:"), key)).when((name.startswith("fm:") | name.startswith("rule:")) & key.isin(*concepts), key)


def stable_structure(turns: DataFrame, by: list[str], order: str, structure: str, unresolved: Column) -> DataFrame:
    """by..., structure: the last one of a settled debate; of an open one the most repeated, the earliest on ties.  NULLs do not count."""
    counted = turns.where(F.col(structure).isNotNull()).groupBy(*by, structure).agg(F.count("*").alias("_c"), F.min(order).alias("_first"), F.max(order).alias("_last"), F.max(unresolved).alias("_open"))
    picked = counted.groupBy(*by).agg(F.max("_open").alias("_open"), F.max_by(structure, F.struct("_c", -F.col("_first"))).alias("_most"), F.max_by(structure, "_last").alias("_end"))
    return picked.select(*by, F.when(F.col("_open"), F.col("_most")).otherwise(F.col("_end")).alias(structure))


def corpus_tendencies(results: DataFrame, modes: str, delta: str, known: list[str], top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(failure modes with their totals, highest first, at most `top`) and (n, mean_delta, direction) over all results.

    modes: map of mode to count; unknown modes do not count.  A mean beyond 0.05 has a direction.
    """
    totals = results.select(F.explode(modes).alias("mode", "n")).where(F.col("mode").isin(*known)).groupBy("mode").agg(F.sum("n").alias("total"))
    mean = F.coalesce(F.avg(delta), F.lit(0.0))
    bias = results.agg(F.count("*").alias("n"), mean.alias("mean_delta")).withColumn("direction", F.when(F.col("mean_delta") > 0.05, "under").when(F.col("mean_delta") < -0.05, "over").otherwise("none"))
    return totals.where("total > 0").orderBy(F.desc("total"), "mode").limit(top), bias


def anomaly(confidence: Column, measures: list[Column]) -> Column:
    """1 less the confidence (missing: 1), plus the sizes of the finite measures."""
    sizes = (F.coalesce(F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.abs(m)), F.lit(0.0)) for m in measures)
    return sum(sizes, 1.0 - F.coalesce(confidence, F.lit(1.0)))


def guarded_best(candidates: DataFrame, by: list[str], baseline: Column, most_drop: float) -> DataFrame:
    """(by..., name, accuracy, balanced, partial_f1, partial_recall, n_chars) -> by..., name of the best candidate.

    Candidates whose accuracy falls by more than most_drop come last.  Among the others partial F1, then partial recall, balanced
    accuracy, accuracy and brevity decide; among those that fell accuracy and balanced accuracy.
    """
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("accuracy", "balanced", "partial_f1", "partial_recall")}
    fit = value["accuracy"] + most_drop >= baseline
    key = F.struct(
        fit.alias("a"), F.when(fit, value["partial_f1"]).otherwise(value["accuracy"]).alias("b"), F.when(fit, value["partial_recall"]).otherwise(value["balanced"]).alias("c"),
        value["balanced"].alias("d"), value["accuracy"].alias("e"), (-F.col("n_chars")).alias("f"),
    )
    ranked = candidates.select(*by, "name", key.alias("_k"))
    best = ranked.groupBy(*by).agg(F.max("_k").alias("_m"))
    tied = ranked.join(best, by) if by else ranked.crossJoin(F.broadcast(best))  # one row
    return tied.where("_k = _m").groupBy(*by).agg(F.min("name").alias("name"))


def hit_rank(hits: Column, anchors: Column, screened: Column, n_chars: Column) -> Column:
    """A repair candidate's rank: target hits, anchors kept, screen passed, brevity."""
    return F.struct(hits.alias("hits"), anchors.alias("anchors"), screened.cast("int").alias("screened"), (-n_chars).alias("brief"))


def challenger(scores: DataFrame, by: list[str], incumbent: str, margin: float = 0.05) -> DataFrame:
    """(by..., name, score, rate, n_chars) -> by..., name: the best challenger if it beats the incumbent's score by the margin."""
    order = F.struct("score", "rate", (-F.col("n_chars")).alias("b"), "name")
    held = scores.groupBy(*by).agg(F.max_by(F.struct("name", "score"), order).alias("_b"), F.max(F.when(F.col("name") == incumbent, F.col("score"))).alias("_base"))
    wins = F.coalesce((F.col("_b.name") != incumbent) & (F.col("_b.score") >= F.col("_base") + margin - 1e-12), F.lit(False))
    return held.select(*by, F.when(wins, F.col("_b.name")).otherwise(incumbent).alias("name"))


def residual_leaves(rows: DataFrame, item: str, keys: list[Column], least_fit: int, least_validation: int) -> DataFrame:
    """(item, part: fit or validation) -> item, part, leaf: the first key with support in both parts, else the last one.

    keys: contexts from the most specific to the broadest, which every row has.  Validation rows take the first
    key that some fit row has been given.
    """
    keyed = rows.select(item, "part", F.posexplode(F.array(*keys)).alias("level", "key")).where("key is not null")
    counts = keyed.groupBy("key").agg(F.count_if(F.col("part") == "fit").alias("_f"), F.count_if(F.col("part") == "validation").alias("_v"))
    backed = counts.where((F.col("_f") >= max(1, least_fit)) & (F.col("_v") >= max(1, least_validation))).select(F.col("key").alias("_key"))

    def first(of: DataFrame, named: DataFrame) -> DataFrame:
        met = of.join(named, F.col("key") == F.col("_key"), "left")
        pick = F.coalesce(F.min_by("key", F.when(F.col("_key").isNotNull(), F.col("level"))), F.max_by("key", "level"))
        return met.groupBy(item, "part").agg(pick.alias("leaf"))

    fit = first(keyed.where("part = 'fit'"), backed)
    given = fit.select(F.col("leaf").alias("_key")).distinct()
    return fit.unionByName(first(keyed.where("part = 'validation'"), given))


def mapping_ceiling(rows: DataFrame, by: list[str], features: list[str], target: str = "target") -> DataFrame:
    """by..., n, n_profiles, n_collisions, ceiling: the best accuracy of any function of the features; a collision has several labels."""
    counts = rows.groupBy(*by, *features, target).agg(F.count("*").alias("_c"))
    each = counts.groupBy(*by, *features).agg(F.max("_c").alias("_m"), F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return each.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("n_profiles"), F.count_if(F.col("_k") > 1).alias("n_collisions"), (F.sum("_m") / F.sum("_n")).alias("ceiling"))


def majority_without(rows: DataFrame, group: str, target: str = "target") -> DataFrame:
    """(group, n, hits): how often the most frequent label of all other groups is right; the smaller label on ties."""
    own = rows.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(F.col(target) == x).alias(x) for x in S.LABELS))
    total = own.agg(*(F.sum(x).alias(f"_t_{x}") for x in S.LABELS))
    z = own.crossJoin(F.broadcast(total))  # one row
    left = [F.col(f"_t_{x}") - F.col(x) for x in S.LABELS]
    most = F.greatest(*left)
    hits = F.when(left[0] == most, F.col("no")).when(left[1] == most, F.col("partial")).otherwise(F.col("yes"))
    return z.select(group, "n", hits.alias("hits"))


def consensus_search(rows: DataFrame, keys: dict[str, Column], configs: list[list[str]], supports: list[int], least_gain: int = 0) -> DataFrame:
    """(target, prediction, part) -> one row per (config, support): rules, accuracy and balanced accuracy on the validation part.

    Rules are mined from the fit part once for each level; a trial uses those of its levels with its support, the most specific
    level first, and else the prediction.  rank 1 is the best trial: accuracy, balanced accuracy, fewer rules, fewer levels,
    more support; trial 0, without levels, is the baseline.
    """
    from pyspark.sql import Window

    from gaugework.operators.calibration import mine_rules

    names = list(keys)
    spark = rows.sparkSession
    mined = mine_rules(rows.where("part = 'fit'"), list(keys.values()), 1, least_gain).select(F.col("level").alias("_level"), "rule_key", F.col("support").alias("_support"), "action")
    trials = [(0, 0, 0, None)] + [(i * len(supports) + j + 1, s, len(c), [names.index(x) for x in c]) for i, c in enumerate(configs) for j, s in enumerate(supports)]
    plan = spark.createDataFrame(trials, "trial int, least int, n_levels int, levels array<int>")
    steps = plan.select("trial", "least", "n_levels", F.posexplode_outer("levels").alias("place", "_level"))
    used = steps.join(mined, "_level").where(F.col("_support") >= F.col("least"))
    n_rules = used.groupBy("trial").agg(F.count("*").alias("n_rules"))
    held = rows.where("part = 'validation'").select("item_id", "target", "prediction", F.posexplode(F.array(*keys.values())).alias("_at", "_key"))
    fired = held.join(used, (F.col("_at") == F.col("_level")) & (F.col("_key") == F.col("rule_key")))
    chosen = fired.groupBy("item_id", "trial").agg(F.min_by("action", "place").alias("action"))
    base = rows.where("part = 'validation'").select("item_id", "target", "prediction").crossJoin(F.broadcast(plan.select("trial", "least", "n_levels")))  # a row per trial
    said = base.join(chosen, ["item_id", "trial"], "left").withColumn("said", F.coalesce("action", "prediction"))
    hit = F.coalesce(F.col("said") == F.col("target"), F.lit(False))
    recall = [S.ratio(F.count_if(hit & (F.col("target") == x)), F.count_if(F.col("target") == x)) for x in S.LABELS]
    known = F.array_compact(F.array(*recall))
    rated = said.groupBy("trial", "least", "n_levels").agg(F.avg(hit.cast("double")).alias("accuracy"), (F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known)).alias("balanced"))
    rated = rated.join(n_rules, "trial", "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    order = [F.round("accuracy", 12).desc(), F.round("balanced", 12).desc(), F.col("n_rules"), F.col("n_levels"), F.col("least").desc(), F.col("trial")]
    return rated.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row per trial


def consensus_rules(rows: DataFrame, keys: dict[str, Column], configs: list[list[str]], supports: list[int], least_gain: int = 0) -> DataFrame:
    """level (its name), rule_key, support, action, gain: the rules to deploy, mined from all rows with the best trial's levels and support.

    The best trial of consensus_search (one row on the driver) was rated on the validation part alone; where it is the baseline there
    are no rules.
    """
    from gaugework.operators.calibration import mine_rules

    best = consensus_search(rows, keys, configs, supports, least_gain).where("rank = 1").first()
    levels = [] if best is None or not best["trial"] else configs[(best["trial"] - 1) // len(supports)]
    if not levels:
        return rows.sparkSession.createDataFrame([], "level string, rule_key string, support long, action string, gain long")
    mined = mine_rules(rows, [keys[x] for x in levels], best["least"], least_gain)
    return mined.select(F.element_at(F.array(*map(F.lit, levels)), F.col("level") + 1).alias("level"), "rule_key", "support", "action", "gain")
