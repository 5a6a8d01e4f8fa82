"""Linear models from sums: weighted Gramians per group, ridge, least squares, leverage, leave-one-group-out.

A Gramian is one aggregate: the sums of w, w x_i, w y, w x_i x_j, w x_i y over a group, with the features moved by the
table's means first, so that large offsets cost no digits.  Its size follows the features, not the rows; the systems
are solved row by row of the aggregated table.  A group's own sums can be taken from the whole, so every
leave-one-group-out fit costs one small solve and the rows are read once.

Rows with a null feature, target or weight, or a weight not above 0, take no part in a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions.vectors import dot
from gaugework.workers import share_package


def _kinds(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def centre_of(rows: DataFrame, features: list[str]) -> list[float]:
    """The features' means, 0 for one without values: a shift that keeps digits, of no effect on the fits."""
    found = rows.agg(*(F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features)).first()
    return [found[f] for f in features]


def gramian(rows: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None, centre: list[float] | None = None) -> DataFrame:
    """by..., n, g: the upper triangle of the sums of z z' for z = (1, features less centre, target), row by row."""
    centre = centre or [0.0] * len(features)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    z = rows.select(*by, *((F.col(f).cast("double") - c).alias(f"_z{i + 1}") for i, (f, c) in enumerate(zip(features, centre))), F.col(target).cast("double").alias(f"_z{len(features) + 1}"), w.alias("_w"))
    z = z.dropna(subset=[c for c in z.columns if c not in by]).where("_w > 0").withColumn("_z0", F.lit(1.0))
    last = len(features) + 2
    # At most (features + 2)(features + 3) / 2 sums.
    sums = [F.sum(F.expr(f"_w * _z{i} * _z{j}")).alias(f"_g{i}_{j}") for i in range(last) for j in range(i, last)]
    return z.groupBy(*by).agg(F.count("*").alias("n"), *sums).select(*by, "n", F.array(*(f"_g{i}_{j}" for i in range(last) for j in range(i, last))).alias("_gram"))


def matrix_of(g: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = g
    return m + np.triu(m, 1).T


def _moments(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """(weight, means, mean of y, centred X'X, centred X'y) of a Gramian."""
    m = matrix_of(g)
    w, mean, my = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
    return w, mean, my, m[1:-1, 1:-1] - w * np.outer(mean, mean), m[1:-1, -1] - w * mean * my


def least_squares(g: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the shortest least-squares solution."""
    _, mean, my, xx, xy = _moments(g)
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    # A direction whose spread is lost in rounding carries nothing.
    beta = np.linalg.pinv(xx, rcond=1e-11, hermitian=True) @ xy if scale.any() else np.zeros(len(xy))
    return float(my - mean @ beta), beta


def ridge_solution(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of ridge on standardised features; constant ones count as 0."""
    w, mean, my, xx, xy = _moments(g)
    std = np.sqrt(np.maximum(np.diag(xx) / w, 0.0))
    flat = std < 1e-9
    std[flat] = 1.0
    z, u = xx / np.outer(std, std), xy / std
    z[flat, :] = z[:, flat] = 0.0
    u[flat] = 0.0
    lower = np.linalg.cholesky(z + alpha * np.eye(len(u)))
    beta = np.linalg.solve(lower.T, np.linalg.solve(lower, u)) / std
    return float(my - mean @ beta), beta


def solved(sums: DataFrame, by: list[str], solve: Callable[[np.ndarray], tuple[float, np.ndarray]], centre: list[float]) -> DataFrame:
    """by..., n, intercept, coefficients (of the raw features): one small system per row of the aggregated table."""
    share_package(sums.sparkSession)
    shift = np.array(centre)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [solve(np.asarray(g, dtype=float)) for g in part["_gram"]]
            yield part[[*by, "n"]].assign(intercept=[float(a - b @ shift) for a, b in found], coefficients=[b.tolist() for _, b in found])

    return sums.select(*by, "n", "_gram").mapInPandas(fit, f"{_kinds(sums, by)}n long, intercept double, coefficients array<double>")


def ridge(rows: DataFrame, by: list[str], features: list[str], target: str, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """by..., n, intercept, coefficients: ridge on standardised features (constant ones count as 0), from one aggregate."""
    centre = centre_of(rows, features)
    return solved(gramian(rows, by, features, target, weight, centre), by, lambda g: ridge_solution(g, alpha), centre)


def linear(rows: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None) -> DataFrame:
    """by..., n, intercept, coefficients: weighted least squares, the shortest solution where features depend on each other."""
    centre = centre_of(rows, features)
    return solved(gramian(rows, by, features, target, weight, centre), by, least_squares, centre)


def leverage(rows: DataFrame, item: str, features: list[str], training: Column) -> DataFrame:
    """item, novelty, leverage: how far a row lies from the training rows, and how much it would move a ridge fit to them.

    z: the features in standard deviations of the training rows around their mean (a constant one counts in its own unit); a null feature is
    0.0; without training rows all rows are.  novelty: |z| / sqrt(number of features); leverage: z (Z'Z + I)^-1 z', Z: the
    training rows.
    """
    share_package(rows.sparkSession)
    z = rows.select(item, training.alias("_t"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    some = z.agg(F.count_if("_t").alias("n")).first()["n"] > 0
    fit = z.where("_t") if some else z
    centre = centre_of(fit, features)
    sums = gramian(fit.withColumn("_y", F.lit(0.0)), [], features, "_y", None, centre)

    def inverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for g in part["_gram"]:
                if g is None or g[0] is None or np.isnan(g[0]):
                    continue
                w, mean, _, xx, _ = _moments(np.asarray(g, dtype=float))
                std = np.sqrt(np.maximum(np.diag(xx) / w, 0.0))
                std[std < 1e-9] = 1.0
                m = np.linalg.inv(xx / np.outer(std, std) + np.eye(len(std)))
                out.append(((mean + np.array(centre)).tolist(), std.tolist(), m.tolist()))
            yield pd.DataFrame(out, columns=["_mean", "_std", "_m"])

    known = sums.mapInPandas(inverse, "_mean array<double>, _std array<double>, _m array<array<double>>")
    met = z.select(item, F.array(*features).alias("_x")).crossJoin(F.broadcast(known))  # one row
    met = met.withColumn("_z", F.transform(F.arrays_zip("_x", "_mean", "_std"), lambda e: (e["_x"] - e["_mean"]) / e["_std"]))
    moved = F.transform("_m", lambda row: dot(row, F.col("_z")))
    return met.select(item, (F.sqrt(dot(F.col("_z"), F.col("_z"))) / max(1.0, len(features) ** 0.5)).alias("novelty"), dot(moved, F.col("_z")).alias("leverage"))


def comparators(
    rows: DataFrame, group: str, features: list[str], base: str = "base", human: str = "human", weight: str | None = None, by: list[str] | None = None,
    training: Column | None = None, stratum: str | None = None, reference: list[str] | None = None,
) -> DataFrame:
    """Rows with a prediction of each comparator: p_base, p_bias, p_score_linear, p_linear, and with strata p_prompt_bias, p_prompt_linear.

    Without `training` each row is predicted by fits to the other groups of its `by` (leave one group out): the whole's sums
    less the group's own.  With it, by one fit to the training rows.  bias adds the mean residual; score_linear
    regresses on the base, linear on the features, prompt_linear on the `reference` features; prompt_bias adds the
    mean residual of the row's stratum, or the overall one where the stratum has no other rows.  With fewer than
    two groups to fit, the lines are the base.  Rows without base, human or a feature are left out.
    """
    by = by or []
    wanted = list(dict.fromkeys([base, *features, *(reference or [])]))
    good = rows.dropna(subset=[base, human, *wanted]).withColumn("_w", F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    good = good.withColumn("_fit", (F.lit(True) if training is None else F.coalesce(training, F.lit(False))) & (F.col("_w") > 0))
    centre = centre_of(good, wanted)
    fit = good.where("_fit")
    own = gramian(fit, [*by, group], wanted, human, "_w", centre)
    add = lambda a, b, s: F.zip_with(a, b, lambda x, y: x + s * y)
    size = (len(wanted) + 2) * (len(wanted) + 3) // 2
    cells = [F.sum(F.col("_gram")[i]).alias(f"_s{i}") for i in range(size)]
    whole = own.groupBy(*by).agg(F.sum("n").alias("_n"), F.count("*").alias("_groups"), *cells).select(*by, "_n", "_groups", F.array(*(f"_s{i}" for i in range(size))).alias("_whole"))
    names = good.select(*by, group).distinct()
    left = names.join(whole, by, "left") if by else names.crossJoin(F.broadcast(whole))  # without `by` the whole is one row
    if training is None:
        left = left.join(own.withColumnRenamed("_gram", "_own"), [*by, group], "left")
        left = left.select(*by, group, (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("_groups") - F.col("n").isNotNull().cast("int")).alias("_groups"), F.when(F.col("_own").isNull(), F.col("_whole")).otherwise(add("_whole", "_own", -1.0)).alias("_gram"))
    else:
        left = left.select(*by, group, F.col("_n").alias("n"), "_groups", F.col("_whole").alias("_gram"))
    at = {name: i + 1 for i, name in enumerate(wanted)}
    sets = {"score_linear": [base], "linear": features} | ({"prompt_linear": reference} if stratum and reference else {})
    shift, here = np.array(centre), len(wanted) + 1
    share_package(rows.sparkSession)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = {f"_f_{name}": [] for name in sets}
            bias = []
            for g, n, groups in zip(part["_gram"], part["n"], part["_groups"]):
                m = matrix_of(np.asarray(g, dtype=float)) if g is not None and n > 0 else None
                bias.append(None if m is None else float((m[0, here] - m[0, 1] - shift[0] * m[0, 0]) / m[0, 0]))
                for name, chosen in sets.items():
                    if m is None or groups < 2:
                        out[f"_f_{name}"].append(None)
                        continue
                    pick = [0, *(at[f] for f in chosen), here]
                    cut, beta = least_squares(m[np.ix_(pick, pick)][np.triu_indices(len(pick))])
                    out[f"_f_{name}"].append([cut - float(beta @ shift[[at[f] - 1 for f in chosen]]), *beta.tolist()])
            yield part[[*by, group]].assign(_bias=bias, **out)

    fits = left.mapInPandas(solve, f"{_kinds(left, [*by, group])}_bias double, " + ", ".join(f"_f_{name} array<double>" for name in sets))
    met = good.join(fits, [*by, group], "left")
    out = {"p_base": F.col(base).cast("double"), "p_bias": F.col(base) + F.coalesce("_bias", F.lit(0.0))}
    for name, chosen in sets.items():
        f = F.col(f"_f_{name}")
        out[f"p_{name}"] = F.coalesce(f[0] + sum((f[i + 1] * F.col(c) for i, c in enumerate(chosen)), F.lit(0.0)), F.col(base).cast("double"))
    if stratum:
        part = fit.groupBy(*by, group, stratum).agg(F.sum(F.col("_w") * (F.col(human) - F.col(base))).alias("_r"), F.sum("_w").alias("_rw"))
        total = part.groupBy(*by, stratum).agg(F.sum("_r").alias("_rt"), F.sum("_rw").alias("_rwt"), F.count("*").alias("_rg"))
        met = met.join(total, [*by, stratum], "left")
        rest, rest_w, others = F.col("_rt"), F.col("_rwt"), F.col("_rg")
        if training is None:
            met = met.join(part, [*by, group, stratum], "left")
            rest, rest_w, others = rest - F.coalesce("_r", F.lit(0.0)), rest_w - F.coalesce("_rw", F.lit(0.0)), others - F.col("_rw").isNotNull().cast("int")
        out["p_prompt_bias"] = F.col(base) + F.coalesce(F.when(others > 0, S.ratio(rest, rest_w)), F.col("_bias"), F.lit(0.0))
    return met.select(*(c for c in rows.columns), *(c.alias(name) for name, c in out.items()))


def comparator_report(predicted: DataFrame, group: str, human: str = "human", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., predictor, n_items, mae (mean over groups of each group's mean absolute error), weighted_mae (over rows by weight)."""
    by = by or []
    names = [c for c in predicted.columns if c.startswith("p_")]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    long = predicted.select(*by, group, human, w.alias("_w"), *names).unpivot([*by, group, human, "_w"], names, "predictor", "value")
    error = F.abs(F.col("value") - F.col(human))
    items = long.groupBy(*by, "predictor", group).agg(F.avg(error).alias("_e"), F.sum(F.col("_w") * error).alias("_we"), F.sum("_w").alias("_ws"))
    return items.groupBy(*by, F.expr("substring(predictor, 3)").alias("predictor")).agg(F.count("*").alias("n_items"), F.avg("_e").alias("mae"), S.ratio(F.sum("_we"), F.sum("_ws")).alias("weighted_mae"))
