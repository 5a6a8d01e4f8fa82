"""Fits per group that need a search or draws: L1 trees, bootstrap, greedy folds; ridge is in gramian.

Each group's rows are fitted in one task (applyInPandas); groups are calibration sets of a dimension or rubric,
pre-aggregated to distinct feature rows with weights where the fit allows it, so size follows distinct values.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.gramian import ridge  # noqa: F401  it needs sums only and is built there
from gaugework.workers import share_package


def weighted_rows(rows: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Equal (features, target) rows as one with their number, which all fits below take as weight."""
    return rows.dropna(subset=[*features, target]).groupBy(*by, *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias(target)).agg(F.count("*").cast("double").alias("weight"))


def _kinds(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in by)


def _median(y: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(y, kind="stable")
    sums = np.cumsum(w[order])
    return float(y[order][np.searchsorted(sums, sums[-1] / 2, side="left")])


def _loss(y: np.ndarray, w: np.ndarray) -> float:
    return float((w * np.abs(y - _median(y, w))).sum()) if len(y) else 0.0


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: float, importance: np.ndarray, ahead: bool = True) -> dict:
    """An L1 tree: the split with the greatest weighted drop of the absolute error, its best next step added."""
    leaf = {"value": _median(y, w), "weight": float(w.sum())}
    whole = _loss(y, w)
    if depth == 0 or whole == 0:
        return leaf
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if w[left].sum() < least or w[~left].sum() < least:
                continue
            gain = own = importance[f] * (whole - _loss(y[left], w[left]) - _loss(y[~left], w[~left]))
            if ahead and depth > 1:
                for side in (left, ~left):
                    child = grow_tree(x[side], y[side], w[side], 1, least, importance, ahead=False)
                    if "feature" in child:
                        gain += child["gain"]
            if best is None or (round(gain, 9), round(own, 9)) > best[:2]:
                best = (round(gain, 9), round(own, 9), f, float(cut), left)
    if best is None or best[0] <= 0:
        return leaf
    gain, _, f, cut, left = best
    return {
        "feature": f, "cut": cut, "gain": gain,
        "left": grow_tree(x[left], y[left], w[left], depth - 1, least, importance, ahead),
        "right": grow_tree(x[~left], y[~left], w[~left], depth - 1, least, importance, ahead),
    }


def paired_bootstrap(rows: DataFrame, by: list[str], unit: str, left: str, right: str, draws: int = 1000, seed: int = 44) -> DataFrame:
    """by..., n_units, mean, low, high of right - left, over resampled units (bootstrap_mean); rows without both are left out."""
    return bootstrap_mean(rows.withColumn("_difference", F.col(right) - F.col(left)), by, unit, "_difference", draws, seed)


def predict_tree(tree: dict, x: np.ndarray) -> np.ndarray:
    if "feature" not in tree:
        return np.full(len(x), tree["value"])
    return np.where(x[:, tree["feature"]] <= tree["cut"], predict_tree(tree["left"], x), predict_tree(tree["right"], x))


def tree_grid(rows: DataFrame, fold: str, feature_sets: dict[str, list[str]], depths: list[int], least: list[float], target: str) -> DataFrame:
    """One row per (feature set, depth, least leaf weight): the out-of-fold mean absolute error of its trees, and its rank.

    Ties go to fewer features, shallower trees and heavier leaves.  Equal rows are counted first; a configuration's folds
    are fitted in one task over the distinct rows.
    """
    share_package(rows.sparkSession)
    features = sorted({f for fs in feature_sets.values() for f in fs})
    cells = weighted_rows(rows, [fold], features, target).withColumnRenamed(fold, "_fold")
    plans = [(name, len(fs), d, float(m)) for name, fs in feature_sets.items() for d in depths for m in least]
    configs = rows.sparkSession.createDataFrame(plans, "features string, n_features int, depth int, least double")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        name, n, depth, most = key
        names = feature_sets[name]
        part = part.sort_values(["_fold", *features, target])
        x, y, w, f = part[names].to_numpy(float), part[target].to_numpy(float), part["weight"].to_numpy(float), part["_fold"].to_numpy()
        error = 0.0
        for one in np.unique(f):
            train = f != one
            if train.any():
                tree = grow_tree(x[train], y[train], w[train], depth, most, np.ones(len(names)))
                error += float((w[~train] * np.abs(predict_tree(tree, x[~train]) - y[~train])).sum())
        return pd.DataFrame([(name, n, depth, most, error / w.sum())], columns=["features", "n_features", "depth", "least", "mae"])

    kind = "features string, n_features int, depth int, least double, mae double"
    rated = cells.crossJoin(F.broadcast(configs)).groupBy("features", "n_features", "depth", "least").applyInPandas(fit, kind)  # distinct rows x configurations
    order = [F.round("mae", 9), "n_features", "depth", F.desc("least"), "features"]
    return rated.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row per configuration


def l1_tree(rows: DataFrame, by: list[str], features: list[str], target: str, depth: int = 2, least: float = 2.0, importance: dict[str, float] | None = None) -> DataFrame:
    """by..., tree (JSON): a small tree per group; fitted to distinct rows with weights."""
    share_package(rows.sparkSession)
    counted = weighted_rows(rows, by, features, target)
    order = np.array([(importance or {}).get(f, 1.0) for f in features])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*features, target])
        tree = grow_tree(part[features].to_numpy(float), part[target].to_numpy(float), part["weight"].to_numpy(float), depth, least, order)
        return pd.DataFrame([(*key, json.dumps(tree))], columns=[*by, "tree"])

    return counted.groupBy(*by).applyInPandas(fit, f"{_kinds(counted, by)}tree string")


def tree_column(tree: dict, features: list[str]) -> Column:
    """A fitted tree as a CASE expression."""
    if "feature" not in tree:
        return F.lit(tree["value"])
    return F.when(F.col(features[tree["feature"]]) <= tree["cut"], tree_column(tree["left"], features)).otherwise(tree_column(tree["right"], features))


def poisson_weight(unit: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) number from a hash of (unit, draw, seed)."""
    u = F.shiftrightunsigned(F.xxhash64(unit, draw, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    weight, total, term = F.lit(0), 0.0, float(np.exp(-1.0))
    for k in range(12):  # the cumulative probabilities up to 1 - 1e-9
        total += term
        term /= k + 1
        weight = weight + (u >= total).cast("int")
    return weight


def bootstrap_mean(rows: DataFrame, by: list[str], unit: str, value: str, draws: int = 1000, seed: int = 44) -> DataFrame:
    """by..., n_units, mean, low, high: percentile interval of the mean over resampled units.

    A draw gives every unit a Poisson(1) weight from a hash of (unit, draw, seed), so draws are sums
    that combine on the map side and no group is gathered; results do not depend on partitioning.
    """
    units = rows.where(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(value).alias("_v"), F.count("*").alias("_c"))
    drawn = units.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weight = poisson_weight(F.col(unit), F.col("_d"), seed)
    sums = drawn.withColumn("_w", weight).groupBy(*by, "_d").agg((F.sum(F.col("_v") * F.col("_w")) / F.nullif(F.sum(F.col("_c") * F.col("_w")), F.lit(0))).alias("_m"))
    ends = sums.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    means = units.groupBy(*by).agg(F.count("*").alias("n_units"), (F.sum("_v") / F.sum("_c")).alias("mean"))
    return means.join(ends, by)


def grouped_folds(rows: DataFrame, task: str, folds: int = 5, seed: int = 44) -> DataFrame:
    """A fold for each task: tasks with one label profile are dealt in hash order, so folds are balanced by label and size."""
    from gaugework.functions.text import stable_rank
    from gaugework.operators.sampling import hash_range, placed_within

    profile = rows.groupBy(task).agg(F.to_json(F.array_sort(F.collect_set("target"))).alias("_p")).withColumn("_rank", stable_rank(seed, F.col(task)))
    placed = placed_within(profile, ["_p"], [F.col("_rank"), F.col(task)], hash_range(F.col("_rank")), "_pos")
    start = F.pmod(F.xxhash64("_p"), F.lit(folds))
    return placed.select(task, F.pmod(F.col("_pos") + start, F.lit(folds)).cast("int").alias("fold"))


def novelty(rows: DataFrame, item: str, features: list[str], training: Column) -> DataFrame:
    """Distance from the training mean in standard deviations (0 for constant features), scaled to 0..1 over all items."""
    stats = rows.agg(*(F.avg(F.when(training, F.col(f))).alias(f"_m_{f}") for f in features), *(F.stddev_pop(F.when(training, F.col(f))).alias(f"_s_{f}") for f in features))
    z = rows.crossJoin(F.broadcast(stats))  # one row
    parts = [F.when(F.col(f"_s_{f}") > 0, F.pow((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"), F.lit(2))).otherwise(0.0) for f in features]
    far = z.select(item, F.sqrt(sum(parts, F.lit(0.0))).alias("distance"))
    ends = far.agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
    return far.crossJoin(F.broadcast(ends)).select(item, "distance", F.when(F.col("_hi") > F.col("_lo"), (F.col("distance") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0).alias("novelty"))


def unit_profiles(pairs: DataFrame, by: list[str], unit: str, x: str, y: str) -> DataFrame:
    """by..., _p, _q, _x, _y, _n, _units: how many units hold exactly the same pairs (a profile, named by 128 bits _p and _q), for each pair of such a unit and its number there."""
    cells = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, unit, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by, unit)  # a unit's distinct pairs
    named = cells.withColumns({c: F.bit_xor(F.xxhash64("_x", "_y", "_n", F.lit(i))).over(own) for i, c in enumerate(("_p", "_q"))})
    return named.groupBy(*by, "_p", "_q", "_x", "_y", "_n").agg(F.count("*").alias("_units"))


def bootstrap_metric(pairs: DataFrame, by: list[str], unit: str, metric, x: str = "human", y: str = "judge_raw", draws: int = 200, seed: int = 0) -> DataFrame:
    """by..., low, high: percentile interval of an agreement metric (a function of counted cells) over resampled units.

    A draw gives every unit a Poisson(1) weight.  Only the sum of the weights of units with equal pairs enters a cell, and the sum of n such
    weights is Poisson(n), so a draw is one Poisson(n) number for each profile (unit_profiles), from a generator seeded by the group, the profile and `seed`.
    """
    profiles = unit_profiles(pairs, by, unit, x, y)
    named = profiles.withColumns({"_s": F.xxhash64("_p", "_q", F.lit(seed), *by), "_t": F.xxhash64("_q", "_p", F.lit(seed), *by)})

    def draw(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                numbers = [np.random.default_rng([s % (1 << 64), t % (1 << 64)]).poisson(n, draws) for s, t, n in zip(*(part.column(c).to_pylist() for c in ("_s", "_t", "_units")))]
                flat, ends = np.concatenate(numbers).astype(np.int64), np.arange(len(part) + 1, dtype=np.int32) * draws
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*part.schema.names, "_w"])

    drawn = named.mapInArrow(draw, ", ".join(f"`{c}` {t}" for c, t in named.dtypes) + ", _w array<long>").select(*by, F.col("_x").alias("x"), F.col("_y").alias("y"), "_n", F.posexplode("_w").alias("_d", "_w"))
    cells = drawn.where("_w > 0").groupBy(*by, "_d", "x", "y").agg(F.sum(F.col("_w") * F.col("_n")).alias("c"))
    each = metric(cells, [*by, "_d"])
    value = [c for c in each.columns if c not in (*by, "_d")][0]
    return each.groupBy(*by).agg(F.count(value).alias("n_draws"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def bayesian_line(rows: DataFrame, by: list[str], x: str, y: str, steps: int = 300, tolerance: float = 1e-3) -> DataFrame:
    """by..., n, intercept, slope, noise_std, mean_x, slope_std: a line whose slope's prior and noise are set by evidence maximisation.

    Only a group's sums enter the fit, so its rows are aggregated first.
    """
    share_package(rows.sparkSession)
    z = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sums = z.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("cxy"))

    def fit(batches):
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                r = row._asdict()
                n, sxx, sxy, syy = r["n"], r["n"] * r["vx"], r["n"] * r["cxy"], r["n"] * r["vy"]
                noise, prior, slope = 1 / (r["vy"] + 1e-10), 1.0, 0.0
                for _ in range(steps):
                    spread = prior + noise * sxx
                    new = noise * sxy / spread
                    used = noise * sxx / spread
                    rest = max(0.0, syy - 2 * new * sxy + new * new * sxx)
                    prior = (used + 2e-6) / (new * new + 2e-6)
                    noise = (n - used + 2e-6) / (rest + 2e-6)
                    moved, slope = abs(new - slope), new
                    if moved < tolerance:
                        break
                out.append((*(r[c] for c in by), n, r["my"] - slope * r["mx"], slope, noise**-0.5, r["mx"], (prior + noise * sxx) ** -0.5))
            yield pd.DataFrame(out, columns=[*by, "n", "intercept", "slope", "noise_std", "mean_x", "slope_std"])

    return sums.mapInPandas(fit, f"{_kinds(sums, by)}n long, intercept double, slope double, noise_std double, mean_x double, slope_std double")
