"""Regression trees by levels: histograms per node, feature and bin; squared loss.

Every level is one aggregate of (node, feature, bin) sums and one running sum over the bins of a node: no task holds
a group's rows, and the sizes follow nodes, features and bins.  A feature with at most `bins` distinct values has a bin
for each, so the search is exact; others have quantile bins.  A cut lies in the middle between the greatest value below
and the least above it in the node, the same place that a search over sorted rows takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.workers import checkpoints

#: A table of splits up to this many rows is broadcast to the rows that descend; a larger one is joined by its key.
MOST_SPLITS = 10_000


def bin_edges(rows: DataFrame, features: list[str], bins: int, uncounted: DataFrame | None = None) -> dict[str, list[float]]:
    """Upper edges of each feature's bins: its distinct values if they are about `bins` at most, else quantiles (of `uncounted`, where rows are distinct ones)."""
    near = rows.agg(*(F.approx_count_distinct(F.col(f).cast("double"), 0.01).alias(f) for f in features)).first()
    shares = [i / bins for i in range(1, bins)]
    found: dict[str, list[float]] = {}
    for few in (True, False):
        some = [f for f in features if (near[f] <= bins) == few]
        # Either array holds about `bins` values.
        edges = [(F.collect_set(F.col(f).cast("double")) if few else F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins)).alias(f) for f in some]
        if some:
            found |= (rows if few or uncounted is None else uncounted).agg(*edges).first().asDict()
    return {f: sorted(set(found[f] or [])) for f in features}


def _bin(x: Column, edges: list[float]) -> Column:
    """How many edges lie below x."""
    return F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < x)) if edges else F.lit(0)


def _descend(rows: DataFrame, splits: DataFrame, by: list[str], features: list[str], few: bool) -> DataFrame:
    """Rows of split nodes go to the child (2n: up to the cut, 2n + 1: above); the others have reached their leaf."""
    s = splits.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("node").alias("_s_node"), F.col("feature_index").alias("_s_f"), F.col("cut").alias("_s_cut"))
    same = F.col("_node") == F.col("_s_node")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    met = rows.join(F.broadcast(s) if few else s, same, "left")  # broadcast: counted, MOST_SPLITS rows at most
    x = F.array(*(F.col(f).cast("double") for f in features))[F.col("_s_f")]
    child = 2 * F.col("_node") + (x > F.col("_s_cut")).cast("int")
    return met.withColumn("_node", F.when(F.col("_s_f").isNotNull(), child).otherwise(F.col("_node"))).drop("_s_node", "_s_f", "_s_cut", *(f"_s_{c}" for c in by))


def histogram_tree(
    rows: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None, depth: int = 2, least: float = 2.0, bins: int = 256,
    count: str | None = None, edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """by..., node (1: root; 2n, 2n + 1: children of n), feature, cut, n, weight, value, gain: one row per node of each group's tree.

    A leaf has a null feature and cut; a node's value is its weighted mean; gain is the drop of the weighted squared error.  least:
    rows of a leaf, or with weights their sum, but never more than half of the group's.  Equal gains (to nine digits of the group's
    squared error) go to the first feature, then to the lowest cut.  Rows with a null feature or target, or a weight not above 0, are left out;
    a group without rows has no tree.  count: how many equal rows a row stands for.  edges: bin_edges() of the features, where they are known.
    """
    checkpoints(rows.sparkSession)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    z = rows.select(*by, *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("_y"), w.alias("_w"), (F.lit(1) if count is None else F.col(count)).cast("long").alias("_c"))
    z = z.dropna(subset=[*features, "_y", "_w"]).where("_w > 0").withColumn("_node", F.lit(1).cast("long"))
    z = z.withColumn("_w", F.col("_w") * F.col("_c"))
    edges = edges or bin_edges(z, features, bins)
    cell = lambda i, f: F.struct(F.lit(i).alias("f"), _bin(F.col(f), edges[f]).alias("b"), F.col(f).alias("x"))
    root = z.groupBy(*by).agg(F.sum("_c").alias("_rn"), F.sum("_w").alias("_rw"), (F.sum(F.expr("_w * _y * _y")) - F.sum(F.expr("_w * _y")) ** 2 / F.sum("_w")).alias("_rloss"))
    out = None
    for level in range(depth + 1):
        at_level = z.where((F.col("_node") >= 1 << level) & (F.col("_node") < 2 << level))
        nodes = at_level.groupBy(*by, "_node").agg(F.sum("_c").alias("n"), F.sum("_w").alias("weight"), F.sum(F.expr("_w * _y")).alias("_s"))
        if level == depth:
            best = nodes.select(*by, F.col("_node").alias("node"), F.lit(None).cast("int").alias("feature_index"), F.lit(None).cast("double").alias("cut"), "n", "weight", (F.col("_s") / F.col("weight")).alias("value"), F.lit(None).cast("double").alias("gain"))
        else:
            cells = at_level.select(*by, "_node", "_y", "_w", "_c", F.explode(F.array(*(cell(i, f) for i, f in enumerate(features)))).alias("_cell"))
            hist = cells.groupBy(*by, "_node", F.col("_cell.f").alias("_f"), F.col("_cell.b").alias("_b")).agg(
                F.sum("_c").alias("_n"), F.sum("_w").alias("_cw"), F.sum(F.expr("_w * _y")).alias("_cs"), F.min("_cell.x").alias("_lo"), F.max("_cell.x").alias("_hi")
            )
            order = Window.partitionBy(*by, "_node", "_f").orderBy("_b")  # the bins of one node and feature
            upto = order.rowsBetween(Window.unboundedPreceding, 0)
            hist = hist.withColumns({"_ln": F.sum("_n").over(upto), "_lw": F.sum("_cw").over(upto), "_ls": F.sum("_cs").over(upto), "_next": F.lead("_lo").over(order)}).where("_next is not null")
            hist = hist.select(*by, "_node", "_f", "_ln", "_lw", "_ls", ((F.col("_hi") + F.col("_next")) / 2).alias("_cut"))
            met = nodes.join(hist, [*by, "_node"], "left").join(root, by, "left") if by else nodes.join(hist, "_node", "left").crossJoin(F.broadcast(root))  # without `by` the root is one row
            rest = F.col("weight") - F.col("_lw")
            gain = F.col("_ls") ** 2 / F.col("_lw") + (F.col("_s") - F.col("_ls")) ** 2 / rest - F.col("_s") ** 2 / F.col("weight")
            if weight is None:
                allowed = (F.col("_ln") >= least) & (F.col("n") - F.col("_ln") >= least)
            else:
                most = F.least(F.lit(least), F.col("_rw") / 2) - 1e-9
                allowed = (F.col("_lw") >= most) & (rest >= most)
            share = F.round(gain / F.col("_rloss"), 9)
            split = F.when(allowed & (share > 0), F.struct(share.alias("share"), (-F.col("_f")).alias("f"), (-F.col("_cut")).alias("c"), gain.alias("gain")))
            best = met.groupBy(*by, "_node", "n", "weight", "_s").agg(F.max(split).alias("_b"))
            best = best.select(*by, F.col("_node").alias("node"), (-F.col("_b.f")).cast("int").alias("feature_index"), (-F.col("_b.c")).alias("cut"), "n", "weight", (F.col("_s") / F.col("weight")).alias("value"), F.col("_b.gain").alias("gain"))
        best = best.checkpoint()
        out = best if out is None else out.unionByName(best)
        splits = best.where("feature_index is not null")
        count = splits.count()
        if count == 0:
            break
        z = _descend(z, splits, by, features, count <= MOST_SPLITS)
    name = F.lit(None).cast("string")
    for i, f in enumerate(features):
        name = F.when(F.col("feature_index") == i, F.lit(f)).otherwise(name)
    return out.select(*by, "node", name.alias("feature"), "cut", "n", "weight", "value", "gain")


def predict(rows: DataFrame, tree: DataFrame, by: list[str], features: list[str], depth: int, default: float | None = None) -> DataFrame:
    """Rows with prediction: the value of the leaf that they reach; `default` for rows of a group without a tree or with a null feature."""
    checkpoints(rows.sparkSession)
    index = F.lit(None).cast("int")
    for i, f in enumerate(features):
        index = F.when(F.col("feature") == f, F.lit(i)).otherwise(index)
    nodes = tree.select(*by, "node", index.alias("feature_index"), "cut", "value").checkpoint()
    few = nodes.count() <= MOST_SPLITS
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    at = rows.withColumn("_node", F.when(whole, F.lit(1).cast("long")))
    for level in range(depth):
        here = (F.col("node") >= 1 << level) & (F.col("node") < 2 << level)
        at = _descend(at, nodes.where(here & F.col("feature_index").isNotNull()), by, features, few)
    values = nodes.select(*(F.col(c).alias(f"_v_{c}") for c in by), F.col("node").alias("_v_node"), F.col("value").alias("_value"))
    same = F.col("_node") == F.col("_v_node")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    met = at.join(F.broadcast(values) if few else values, same, "left")  # broadcast: counted above
    return met.select(*rows.columns, F.coalesce("_value", F.lit(default).cast("double")).alias("prediction"))


def importances(tree: DataFrame, by: list[str]) -> DataFrame:
    """by..., feature, importance: each feature's share of the summed gains of a tree."""
    gains = tree.where("feature is not null").groupBy(*by, "feature").agg(F.sum("gain").alias("_g"))
    return gains.withColumn("importance", F.col("_g") / F.sum("_g").over(Window.partitionBy(*by))).drop("_g")  # a row per feature


def pruned(tree: DataFrame, depth: int) -> DataFrame:
    """The tree of `depth` levels of splits: splits are chosen level by level, so it is the top of any deeper one."""
    inner = F.col("node") < (1 << depth)
    return tree.where(F.col("node") < (2 << depth)).withColumns({c: F.when(inner, F.col(c)) for c in ("feature", "cut", "gain")})


def select_tree(
    rows: DataFrame, fold: str, feature_sets: dict[str, list[str]], depths: list[int], least: list[float], target: str, weight: str | None = None, item: str | None = None, bins: int = 256,
) -> DataFrame:
    """features, n_features, depth, least, mae, rank: out-of-fold errors of every setting, rank 1 the best.

    A row is predicted by the tree of the other folds' rows; trees of all folds grow in one pass, and a setting's depths are read off its
    deepest tree.  mae: over items (the mean of their mean errors) or, without `item`, over rows by weight.  Errors equal to nine digits
    go to fewer features, then to the shallower tree, then to heavier leaves, then by name.  Rows with a null feature of any set, or a
    null target or fold, are left out; a fold without other folds is not predicted.  Equal rows are counted first and stand for each other from then on.
    """
    checkpoints(rows.sparkSession)
    every = sorted({f for fs in feature_sets.values() for f in fs})
    good = rows.dropna(subset=[fold, target, *every]).withColumn("_weight", F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    good = good.select(fold, *([item] if item and item not in (fold, target, *every) else []), *(f for f in every if f not in (fold, target)), target, "_weight")
    cells = good.groupBy(*good.columns).agg(F.count("*").alias("_rows")).checkpoint()  # the only pass over all rows, but for quantile bins
    folds = sorted(r[0] for r in cells.select(fold).distinct().collect())  # a handful
    training = lambda z: z.withColumn("_out", F.explode(F.array(*(F.lit(f) for f in folds)) if folds else F.array().cast("array<int>"))).where(F.col("_out") != F.col(fold))
    train, held = training(cells), cells.withColumn("_out", F.col(fold))
    edges = bin_edges(train.where("_weight > 0"), every, bins, training(good).where("_weight > 0"))
    out = None
    for name, features in feature_sets.items():
        for m in least:
            tree = histogram_tree(train, ["_out"], features, target, None if weight is None else "_weight", max(depths), m, bins, "_rows", {f: edges[f] for f in features})
            for depth in depths:
                said = predict(held, pruned(tree, depth), ["_out"], features, depth).where("prediction is not null")
                error = F.abs(F.col("prediction") - F.col(target))
                if item:
                    mae = said.groupBy(item).agg((F.sum(F.col("_rows") * error) / F.sum("_rows")).alias("_e")).agg(F.avg("_e").alias("mae"))
                else:
                    mae = said.agg((F.sum(F.col("_weight") * F.col("_rows") * error) / F.sum(F.col("_weight") * F.col("_rows"))).alias("mae"))
                one = mae.select(F.lit(name).alias("features"), F.lit(len(features)).alias("n_features"), F.lit(depth).alias("depth"), F.lit(float(m)).alias("least"), "mae").where("mae is not null")
                out = one if out is None else out.unionByName(one)
    order = Window.orderBy(F.round("mae", 9), "n_features", "depth", F.desc("least"), "features")  # a row per setting
    return out.withColumn("rank", F.row_number().over(order))
