"""Splits and samples that take whole tasks: manifests, label-balanced validation groups, one case per task.

Greedy choices look at counts only.  What comes to the driver is bounded by classes, cells or quotas, never by rows, and says so.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions.text import stable_rank
from gaugework.operators.sampling import hash_range, placed_within, positioned


def task_manifest(rows: DataFrame, task: str, n_train: int, seed: int) -> DataFrame:
    """(task, split): n_train tasks in the order of a seeded hash train, the others test; null tasks are left out.

    With fewer tasks than n_train the query fails.
    """
    tasks = rows.where(F.col(task).isNotNull()).select(F.col(task), F.concat(F.lit(f"{seed}:"), F.col(task).cast("string")).alias("_key")).distinct()
    n = tasks.agg(F.count("*").alias("_n"))
    placed = positioned(tasks, "_key").crossJoin(F.broadcast(n))  # one row
    split = F.when(F.col("_n") < n_train, F.raise_error(F.lit(f"fewer than {n_train} tasks")).cast("string")).when(F.col("pos") < n_train, "train").otherwise("test")
    return placed.select(task, split.alias("split"))


def validation_groups(rows: DataFrame, task: str, fraction: float, seed: int) -> DataFrame:
    """(task, part: fit or validation): whole tasks whose labels come nearest to `fraction` of each label.

    Tasks with equal label counts are alike, so the greedy choice goes over distinct count vectors (a few, on the driver):
    in each step the vector that brings the counts nearest to their targets, relative to them, the smaller vector on ties.
    Of a vector's tasks those with the smallest hashes are taken.  One task, or a fraction of 0, gives fit alone.
    """
    per = rows.groupBy(task).agg(*(F.count_if(F.col("target") == x).alias(x) for x in S.LABELS))
    kinds = sorted((tuple(r[x] for x in S.LABELS), r["n"]) for r in per.groupBy(*S.LABELS).agg(F.count("*").alias("n")).collect())
    taken = choose_vectors(kinds, fraction)
    quota = rows.sparkSession.createDataFrame([(*v, taken.get(v, 0)) for v, _ in kinds], ", ".join(f"{x} long" for x in S.LABELS) + ", quota int")
    # Most tasks may share a vector: their places are counted by ranges of the hash.
    hashed = per.withColumn("_rank", stable_rank(seed, F.col(task)))
    placed = placed_within(hashed, list(S.LABELS), [F.col("_rank"), F.col(task)], hash_range(F.col("_rank")), "_i")
    return placed.join(F.broadcast(quota), list(S.LABELS)).select(task, F.when(F.col("_i") < F.col("quota"), "validation").otherwise("fit").alias("part"))


def choose_vectors(kinds: list[tuple[tuple, int]], fraction: float) -> dict[tuple, int]:
    """How many tasks of each label-count vector to take, from (vector, tasks)."""
    n_tasks = sum(n for _, n in kinds)
    if fraction <= 0 or n_tasks < 2:
        return {}
    wanted = min(max(1, round(n_tasks * fraction)), n_tasks - 1)
    goal = [sum(v[i] * n for v, n in kinds) * fraction for i in range(len(S.LABELS))]
    left, have, taken = dict(kinds), [0] * len(S.LABELS), Counter()
    for _ in range(wanted):
        best = min((v for v, n in left.items() if n), key=lambda v: (round(sum(((h + x - g) / max(1.0, g)) ** 2 for h, x, g in zip(have, v, goal)), 12), v))
        left[best] -= 1
        taken[best] += 1
        have = [h + x for h, x in zip(have, best)]
    return dict(taken)


def one_case_per_task(rows: DataFrame, quotas: dict[str, int], seed: int, turns: bool = False) -> DataFrame:
    """(item_id, target, task_uid, model, category) -> the chosen rows with their step, at most one of a task.

    Each step takes from one label: label after label in the order of quotas, or in turns.  It prefers models and
    categories that the label has least, then those that all have least (in turns: categories, then models, over all),
    then the smaller seeded hash.  As at most sum(quotas) tasks are used, the first sum(quotas) tasks of each
    (label, model, category) cell suffice; they come to the driver.  A quota that cannot be met raises an error.
    """
    total = sum(quotas.values())
    cell, task = ["target", "model", "category"], ["target", "model", "category", "task_uid"]
    rank = stable_rank(seed, F.col("item_id"))
    own = rows.where(F.col("target").isin(list(quotas))).withColumn("_rank", rank)
    first = own.withColumn("_i", F.row_number().over(Window.partitionBy(*task).orderBy("_rank", "item_id"))).where("_i = 1")
    near = first.withColumn("_i", F.row_number().over(Window.partitionBy(*cell).orderBy("_rank", "item_id"))).where(F.col("_i") <= total)
    chosen = choose_cases([r.asDict() for r in near.select("item_id", *task, "_rank").collect()], quotas, turns)
    kinds = dict(rows.dtypes)
    steps = rows.sparkSession.createDataFrame(chosen, f"item_id {kinds['item_id']}, step int")
    return rows.join(F.broadcast(steps), "item_id")  # sum(quotas) rows


def choose_cases(rows: list[dict], quotas: dict[str, int], turns: bool) -> list[tuple]:
    """The greedy choice over a bounded list: (item_id, step)."""
    order = [label for label, n in quotas.items() for _ in range(n)]
    if turns:
        order = [label for i in range(max(quotas.values(), default=0)) for label, n in quotas.items() if i < n]
    counts, used, chosen = Counter(), set(), []
    for label in order:
        free = [r for r in rows if r["target"] == label and r["task_uid"] not in used]
        if not free:
            raise ValueError(f"too few tasks for label {label!r}")

        def key(r: dict) -> tuple:
            model, category = r["model"], r["category"]
            every = (counts["model", model], counts["category", category])
            return ((every[1], every[0]) if turns else (counts[label, "model", model], counts[label, "category", category], *every)) + (r["_rank"], r["item_id"])

        best = min(free, key=key)
        used.add(best["task_uid"])
        for k in (("model", best["model"]), ("category", best["category"]), (label, "model", best["model"]), (label, "category", best["category"])):
            counts[k] += 1
        chosen.append((best["item_id"], len(chosen)))
    return chosen
