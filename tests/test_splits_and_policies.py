"""Splits, samples, grids and verdicts against direct restatements, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import calibration, fitting, policies, splits

CASES = "item_id string, target string, task_uid string, model string, category string"


def cases(n=300, seed=4):
    rng = random.Random(seed)
    return [(f"i{i}", rng.choice(["no", "partial", "yes", "yes"]), f"t{i // 3}", rng.choice("AB"), rng.choice("xyz")) for i in range(n)]


def slow_cases(rows, quotas, seed):
    """The greedy choice over all rows, label after label."""
    chosen, used = [], set()
    for label, n in quotas.items():
        for _ in range(n):
            def key(r):
                of = lambda i, v, some: sum(c[i] == v for c in some)
                same = [c for c in chosen if c[1] == label]
                return of(3, r[3], same), of(4, r[4], same), of(3, r[3], chosen), of(4, r[4], chosen), hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()

            best = min((r for r in rows if r[1] == label and r[2] not in used), key=key)
            chosen.append(best)
            used.add(best[2])
    return [c[0] for c in chosen]


def test_one_case_per_task_equals_the_greedy_choice_over_all_rows(spark):
    rows, quotas = cases(), {"yes": 7, "partial": 6, "no": 5}
    got = splits.one_case_per_task(spark.createDataFrame(rows, CASES), quotas, 44).orderBy("step").collect()
    assert [r["item_id"] for r in got] == slow_cases(rows, quotas, 44) and len({r["task_uid"] for r in got}) == 18
    turns = splits.one_case_per_task(spark.createDataFrame(rows, CASES), {"no": 2, "partial": 3, "yes": 2}, 44, turns=True).orderBy("step").collect()
    assert [r["target"] for r in turns] == ["no", "partial", "yes", "no", "partial", "yes", "partial"]
    with pytest.raises(ValueError, match="too few tasks"):
        splits.one_case_per_task(spark.createDataFrame(rows[:3], CASES), quotas, 44)


def test_validation_groups_balance_labels(spark):
    rows = cases(600, 5)
    got = {r["task_uid"]: r["part"] for r in splits.validation_groups(spark.createDataFrame(rows, CASES), "task_uid", 0.25, 44).collect()}
    held = [t for t, p in got.items() if p == "validation"]
    assert len(got) == 200 and len(held) == 50
    for label in ("no", "partial", "yes"):
        n, h = (sum(r[1] == label for r in some) for some in (rows, [r for r in rows if r[2] in set(held)]))
        assert abs(h - n / 4) <= 2
    alone = splits.validation_groups(spark.createDataFrame(rows[:3], CASES), "task_uid", 0.25, 44).collect()
    assert [r["part"] for r in alone] == ["fit"]
    assert splits.choose_vectors([((1, 0, 0), 3), ((0, 0, 2), 1)], 0.5) == {(0, 0, 2): 1, (1, 0, 0): 1}


def test_task_manifest_needs_enough_tasks(spark):
    tasks = spark.range(10).select(F.col("id").alias("task")).unionByName(spark.range(5).select(F.lit(None).cast("long").alias("task")))
    got = splits.task_manifest(tasks, "task", 3, 1).collect()
    assert len(got) == 10 and sum(r["split"] == "train" for r in got) == 3
    with pytest.raises(Exception, match="fewer than 11 tasks"):
        splits.task_manifest(tasks, "task", 11, 1).collect()


def test_paired_bootstrap_covers_the_difference(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.normal(size=400), rng.normal(0.3, 1.0, 400)))] + [(999, None, 1.0)]
    z = spark.createDataFrame(rows, "unit int, a double, b double").withColumn("g", F.lit(1))
    got = fitting.paired_bootstrap(z, ["g"], "unit", "a", "b", draws=400).first()
    d = np.array([b - a for _, a, b in rows[:-1]])
    boot = np.quantile(d[rng.integers(0, 400, (4000, 400))].mean(axis=1), [0.025, 0.975])
    assert got["n_units"] == 400 and abs(got["mean"] - d.mean()) < 1e-9
    assert abs(got["low"] - boot[0]) < 0.03 and abs(got["high"] - boot[1]) < 0.03


def test_tree_grid_finds_the_feature_that_tells(spark):
    rng = random.Random(6)
    rows = [(i % 4, float(x), float(rng.randrange(5)), 1.0 if x < 3 else 4.0) for i in range(200) for x in [rng.randrange(6)]]
    grid = fitting.tree_grid(spark.createDataFrame(rows, "fold int, a double, b double, y double"), "fold", {"b": ["b"], "a": ["a"], "ab": ["a", "b"]}, [1, 2], [2.0, 5.0], "y").orderBy("rank").collect()
    assert len(grid) == 12 and (grid[0]["features"], grid[0]["depth"], grid[0]["least"], grid[0]["mae"]) == ("a", 1, 5.0, 0.0)


def test_comparators_and_gates_out_of_fold(spark):
    rng = random.Random(7)
    rows = [("d", i % 3, float(x), 2.0 * x + 1) for i in range(60) for x in [rng.randrange(5)]] + [("one", 0, 1.0, 2.0), ("d", 1, None, 1.0)]
    z = spark.createDataFrame(rows, "dimension string, fold int, judge_raw double, human double")
    got = calibration.comparators_out_of_fold(z, ["dimension"], "fold").collect()
    assert len(got) == 61
    assert all(abs(r["score_linear"] - r["human"]) < 1e-9 for r in got if r["dimension"] == "d")
    assert [(r["bias"], r["score_linear"]) for r in got if r["dimension"] == "one"] == [(None, None)]


def test_verdicts_of_missing_and_foreign_leaves(spark):
    leaves = [(1, "no", "yes", True), (1, "partial", "no", True), (1, "yes", "no", True), (2, "no", "yes", True), (2, "yes", "no", True), (3, "no", "maybe", True), (3, "partial", "no", True), (3, "yes", "no", True), (4, "no", "no", None), (4, "partial", "no", True), (4, "yes", "no", True)]
    got = {r["item"]: (r["label"], r["valid"]) for r in policies.label_support(spark.createDataFrame(leaves, "item int, candidate string, label string, valid boolean"), ["item"]).collect()}
    assert got == {1: ("no", True), 2: (None, False), 3: (None, False), 4: (None, False)}
    tree = [(1, "core", "yes", True), (1, "modifier", "no", True), (1, "preservation", "yes", True), (2, "core", "yes", True), (2, "preservation", "no", True), (3, "core", None, True)]
    got = {r["item"]: r["label"] for r in policies.tree_verdict(spark.createDataFrame(tree, "item int, role string, label string, valid boolean"), ["item"]).collect()}
    assert got == {1: "partial", 2: "no", 3: None}


def test_timeline_starts_and_cycles_see_all_events(spark, tmp_path):
    from gaugework.plans import catalog

    rows = [(30_000 + i, f"2024-01-01 00:0{i}:00", 7, "ab"[i % 2], 1.0, "{}") for i in range(8)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.queries()["score_cycles"](spark, str(tmp_path)).collect()] == [(7, True)]
    assert catalog.queries()["sequence_segments"](spark, str(tmp_path)).count() == 1
