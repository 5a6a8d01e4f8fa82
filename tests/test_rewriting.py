"""The prompt search against a sequential one, and its resumption."""

import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators.rewriting import rewrite_search


def label(prompt, score):
    low, high = map(int, prompt.split("-"))
    return "no" if score < low else "partial" if score < high else "yes"


def judge(rows, prompt):
    low, high = map(int, prompt.split("-"))
    return rows.select("item_id", F.when(F.col("score") < low, "no").when(F.col("score") < high, "partial").otherwise("yes").alias("prediction"))


def rewrite(prompt, shown):
    """Moves each cut towards the shown mistakes."""
    low, high = map(int, prompt.split("-"))
    up = sum(r["bucket"] == "no/partial" for r in shown) - sum(r["bucket"] == "partial/no" for r in shown)
    over = sum(r["bucket"] == "partial/yes" for r in shown) - sum(r["bucket"] == "yes/partial" for r in shown)
    return f"{max(0, low + 5 * up)}-{max(1, high + 5 * over)}"


def macro(rows):
    out = {}
    for x in ("no", "partial", "yes"):
        tp, t, p = sum(a == b == x for a, b in rows), sum(a == x for a, _ in rows), sum(b == x for _, b in rows)
        out[x] = (tp / t if t else None, 2 * tp / (t + p) if t and p else None)
    recalls = [r for r, _ in out.values() if r is not None]
    return sum(a == b for a, b in rows) / len(rows), sum(recalls) / len(recalls), out["partial"][1] or 0.0, out["partial"][0] or 0.0


def sequential(cases, prompt, max_steps, per_bucket, drop):
    split = "validation" if any(c[3] == "validation" for c in cases) else "fit"
    now, trials, stop = prompt, [], "max_steps"

    def measure(p, part):
        return macro([(c[1], label(p, c[4])) for c in cases if c[3] == part])

    trials.append(now)
    for _ in range(max_steps):
        fit = [c for c in cases if c[3] == "fit"]
        if all(label(now, c[4]) == c[1] for c in fit):
            stop = "fit_correct"
            break
        buckets, turns = {}, {}
        for c in sorted(fit):
            b = f"{c[1]}/{label(now, c[4])}"
            turns[b, c[2]] = turns.get((b, c[2]), 0) + 1
            buckets.setdefault(b, []).append((turns[b, c[2]], c[0]))
        shown = [{"bucket": b} for b in sorted(buckets) for _ in sorted(buckets[b])[:per_bucket]]
        after = rewrite(now, shown)
        if after == now:
            stop = "optimizer_unchanged"
            break
        now = after
        trials.append(now)
    base = measure(prompt, split)[0]

    def key(p):
        accuracy, balanced, f1, recall = measure(p, split)
        fine = accuracy + drop >= base
        return (fine, f1 if fine else accuracy, recall if fine else balanced, balanced, accuracy, -len(p))

    return trials, stop, trials.index(max(trials, key=key))


def made(seed, n=160, held=True):
    rng = random.Random(seed)
    return [(i, label("35-70", s + rng.choice([0, 0, 0, 8, -8])), i // 3, "validation" if held and i % 4 == 0 else "fit", s) for i in range(n) for s in [rng.randrange(101)]]


SCHEMA = "item_id long, target string, task_uid long, split string, score int"


@pytest.mark.parametrize(("seed", "held", "start"), [(1, True, "20-90"), (2, False, "50-55"), (3, True, "35-70")])
def test_search_equals_the_sequential_one(spark, tmp_path, seed, held, start):
    cases = made(seed, held=held)
    trials, results = rewrite_search(spark.createDataFrame(cases, SCHEMA), start, judge, rewrite, f"file://{tmp_path}/s", 3, 4, 0.02)
    wanted, stop, best = sequential(cases, start, 3, 4, 0.02)
    rows = trials.orderBy("step").collect()
    assert [r["prompt"] for r in rows] == wanted and {r["stop_reason"] for r in rows} == {stop} and [r["step"] for r in rows if r["selected"]] == [best]
    assert {r["item_id"]: r["prediction"] for r in results.collect()} == {c[0]: label(wanted[best], c[4]) for c in cases}


def test_search_stops_and_resumes(spark, tmp_path):
    cases = spark.createDataFrame(made(4), SCHEMA)
    right = cases.withColumn("target", F.when(F.col("score") < 20, "no").when(F.col("score") < 90, "partial").otherwise("yes"))
    trials, _ = rewrite_search(right, "20-90", judge, rewrite, f"file://{tmp_path}/a")
    assert [(r["step"], r["stop_reason"], r["accuracy"]) for r in trials.collect()] == [(0, "fit_correct", 1.0)]
    trials, _ = rewrite_search(cases, "20-90", judge, lambda p, shown: f" {p} ", f"file://{tmp_path}/b")
    assert [(r["step"], r["stop_reason"]) for r in trials.collect()] == [(0, "optimizer_unchanged")]
    calls = []

    def stops(prompt, shown):
        calls.append(prompt)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return rewrite(prompt, shown)

    with pytest.raises(RuntimeError):
        rewrite_search(cases, "10-95", judge, stops, f"file://{tmp_path}/c", 3)
    again, _ = rewrite_search(cases, "10-95", judge, stops, f"file://{tmp_path}/c", 3)
    whole, _ = rewrite_search(cases, "10-95", judge, rewrite, f"file://{tmp_path}/d", 3)
    assert calls.count("10-95") == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
