"""Linear models from sums, trees by levels, exact cosine joins and the merge loop, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import agreement, blocks, gramian, merging, routing, trees

# -- Gramians ---------------------------------------------------------------------------------------------


def observations(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.uniform(1, 5), float(rng.randrange(4))
        rows.append((f"g{rng.randrange(9)}", rng.choice("pqr"), a, b, 2 * b, 1e6 + a, 0.5 * a + b + rng.gauss(0, 0.3), rng.choice([0.5, 1.0, 2.0])))
    return [*rows, ("g1", "p", None, 1.0, 2.0, 1e6, 3.0, 1.0), ("g1", "p", 1.0, 1.0, 2.0, 1e6, None, 1.0), ("g2", "q", 2.0, 1.0, 2.0, 1e6, 2.0, 0.0), ("lone", "z", 3.0, 2.0, 4.0, 1e6, 9.0, 1.0)]


SCHEMA = "task string, kind string, base double, b double, twice double, big double, human double, w double"


def brute_fit(rows, columns, weight=True):
    x = np.array([[r[c] for c in columns] for r in rows])
    y, w = np.array([r[6] for r in rows]), np.array([r[7] if weight else 1.0 for r in rows])
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    root = np.sqrt(w)[:, None]
    beta = np.linalg.lstsq((x - mx) * root, (y - my) * root[:, 0], rcond=1e-9)[0]
    return my - mx @ beta, beta


def brute_comparators(rows, fit_of):
    out = []
    for r in rows:
        fit = [f for f in fit_of(r) if f[7] > 0]
        groups = {f[0] for f in fit}
        mean = lambda some: sum(f[7] * (f[6] - f[2]) for f in some) / sum(f[7] for f in some)
        bias = r[2] + mean(fit)
        own = [f for f in fit if f[1] == r[1]]
        lines = []
        for columns in ([2], [2, 3, 4], [3]):
            if len(groups) < 2:
                lines.append(r[2])
                continue
            cut, beta = brute_fit(fit, columns)
            lines.append(cut + sum(b * r[c] for b, c in zip(beta, columns)))
        out.append((r[0], r[6], r[2], bias, *lines, r[2] + (mean(own) if own else mean(fit))))
    return sorted(out)


NAMES = ["p_base", "p_bias", "p_score_linear", "p_linear", "p_prompt_linear", "p_prompt_bias"]


@pytest.mark.parametrize("frozen", [False, True])
def test_comparators_equal_refits(spark, frozen):
    rows = observations()
    good = [r for r in rows if None not in r]
    training = F.col("task") < "g5" if frozen else None
    got = gramian.comparators(spark.createDataFrame(rows, SCHEMA), "task", ["base", "b", "twice"], "base", "human", "w", training=training, stratum="kind", reference=["b"])
    wanted = brute_comparators(good, (lambda r: [f for f in good if f[0] < "g5"]) if frozen else (lambda r: [f for f in good if f[0] != r[0]]))
    found = sorted(tuple(r) for r in got.select("task", "human", *NAMES).collect())
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-7)
    report = {r["predictor"]: r for r in gramian.comparator_report(got, "task", weight="w").collect()}
    errors = {}
    for r in wanted:
        errors.setdefault(r[0], []).append(abs(r[3] - r[1]))
    assert report["bias"]["mae"] == pytest.approx(sum(sum(e) / len(e) for e in errors.values()) / len(errors)) and report["bias"]["n_items"] == len(errors)


def test_fits_of_one_group_and_of_no_rows(spark):
    one = spark.createDataFrame([("a", "p", 2.0, 1.0, 2.0, 0.0, 3.0, 1.0), ("a", "p", 3.0, 1.0, 2.0, 0.0, 5.0, 1.0)], SCHEMA)
    got = gramian.comparators(one, "task", ["base", "b"], "base", "human").orderBy("base").collect()
    assert [(r["p_bias"], r["p_linear"]) for r in got] == [(2.0, 2.0), (3.0, 3.0)]
    assert gramian.comparators(one.limit(0), "task", ["base"], "base", "human").count() == 0
    assert gramian.ridge(one.limit(0), ["task"], ["base"], "human").count() == 0
    assert gramian.leverage(one.limit(0), "task", ["base"], F.lit(True)).count() == 0


def test_linear_keeps_digits_of_large_offsets(spark):
    rows = [r for r in observations() if None not in r and r[7] > 0]
    got = gramian.linear(spark.createDataFrame(rows, SCHEMA), [], ["big", "b"], "human", "w").first()
    cut, beta = brute_fit(rows, [5, 3])
    assert got["coefficients"] == pytest.approx(beta.tolist(), rel=1e-6) and got["intercept"] == pytest.approx(cut, rel=1e-6)


def test_leverage_equals_the_matrix_formula(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 3), rng.uniform(5, 6), 7.0, rng.choice([None, 1.0, 2.0])) for i in range(50)]
    x = np.array([[0.0 if v is None else v for v in r[1:]] for r in rows])
    train = np.arange(50) % 3 != 0
    std = x[train].std(axis=0)
    std[std < 1e-9] = 1.0
    z = (x - x[train].mean(axis=0)) / std
    m = np.linalg.inv(z[train].T @ z[train] + np.eye(4))
    got = gramian.leverage(spark.createDataFrame(rows, "i long, a double, b double, c double, d double"), "i", ["a", "b", "c", "d"], F.col("i") % 3 != 0).orderBy("i").collect()
    assert [r["leverage"] for r in got] == pytest.approx(np.einsum("ij,jk,ik->i", z, m, z).tolist())
    assert [r["novelty"] for r in got] == pytest.approx((np.linalg.norm(z, axis=1) / 2).tolist())


# -- trees by levels --------------------------------------------------------------------------------------


def brute_tree(rows, depth, least, weighted):
    """rows (x..., y, w) -> {node: (feature, cut, n, value)}."""
    total = sum(r[-1] for r in rows)
    loss = lambda some: sum(r[-1] * r[-2] ** 2 for r in some) - sum(r[-1] * r[-2] for r in some) ** 2 / sum(r[-1] for r in some)
    whole, out = loss(rows), {}
    mass = (lambda some: sum(r[-1] for r in some)) if weighted else len
    floor = min(least, total / 2) - 1e-9 if weighted else least

    def grow(node, some, left):
        best = None
        for f in range(len(rows[0]) - 2):
            values = sorted({r[f] for r in some})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                low, high = [r for r in some if r[f] <= cut], [r for r in some if r[f] > cut]
                if min(mass(low), mass(high)) < floor:
                    continue
                key = (round((loss(some) - loss(low) - loss(high)) / whole, 9), -f, -cut)
                if key[0] > 0 and (best is None or key > best[0]):
                    best = (key, f, cut, low, high)
        value = sum(r[-1] * r[-2] for r in some) / sum(r[-1] for r in some)
        if left == 0 or best is None:
            out[node] = (None, None, len(some), pytest.approx(value))
            return
        out[node] = (f"f{best[1]}", pytest.approx(best[2]), len(some), pytest.approx(value))
        grow(2 * node, best[3], left - 1)
        grow(2 * node + 1, best[4], left - 1)

    grow(1, rows, depth)
    return out


@pytest.mark.parametrize(("depth", "least", "weighted"), [(3, 2, False), (2, 6, False), (3, 3.0, True), (2, 1e9, True)])
def test_histogram_tree_equals_exact_search(spark, depth, least, weighted):
    rng = random.Random(3)
    groups = {g: [(rng.randrange(6) * 1.0, rng.uniform(0, 1), float(rng.randrange(2)), rng.choice([1.0, 2.0, 5.0]) + rng.random(), rng.choice([0.25, 1.0, 2.0]) if weighted else 1.0) for _ in range(n)] for g, n in (("a", 60), ("b", 25), (None, 3))}
    rows = [(g, *r) for g, own in groups.items() for r in own] + [("a", None, 1.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, f0 double, f1 double, f2 double, y double, w double")
    tree = trees.histogram_tree(frame, ["g"], ["f0", "f1", "f2"], "y", "w" if weighted else None, depth, least, bins=256)
    got = {}
    for r in tree.collect():
        got.setdefault(r["g"], {})[r["node"]] = (r["feature"], r["cut"], r["n"], r["value"])
    wanted = {g: brute_tree(own, depth, least, weighted) for g, own in groups.items() if g is not None}
    assert {g: got[g] for g in wanted} == wanted and set(got) == set(groups)
    predicted = trees.predict(frame, tree, ["g"], ["f0", "f1", "f2"], depth, default=-1.0)
    for r in predicted.where("g in ('a', 'b') and f0 is not null").collect():
        node, own = 1, wanted[r["g"]]
        while own[node][0] is not None:
            node = 2 * node + (r[own[node][0]] > got[r["g"]][node][1])
        assert r["prediction"] == own[node][3]
    assert [r["prediction"] for r in predicted.where("g = 'c' or f0 is null").collect()] == [-1.0, -1.0]


def test_histogram_tree_with_quantile_bins_and_in_plain_plans(spark):
    frame = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("x"), (F.col("id") % 3).cast("double").alias("z")).withColumn("y", F.when(F.col("x") > 700, 5.0).otherwise(1.0) + F.col("z") / 10)
    tree = trees.histogram_tree(frame, [], ["x", "z"], "y", depth=2, least=10, bins=64)
    got = {r["node"]: r for r in tree.collect()}
    assert got[1]["feature"] == "x" and abs(got[1]["cut"] - 700) < 20 and got[2]["feature"] == "z"
    assert {r["feature"] for r in trees.importances(tree, []).collect()} == {"x", "z"}
    assert trees.histogram_tree(frame.limit(0), [], ["x"], "y").count() == 0
    plan = trees.predict(frame, tree, [], ["x", "z"], 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_tree_selection_equals_refits(spark):
    rng = random.Random(12)
    rows = [(i % 3, i % 11, float(rng.randrange(5)), rng.choice([0.0, 1.0]), 0.0, rng.choice([0.5, 1.0])) for i in range(90)]
    rows = [(f, t, a, b, a + 2 * b + rng.gauss(0, 0.4), w) for f, t, a, b, _, w in rows]
    frame = spark.createDataFrame([*rows, (0, 1, None, 1.0, 1.0, 1.0)], "fold int, task int, f0 double, f1 double, y double, w double")
    got = {(r["features"], r["depth"], r["least"]): (r["mae"], r["rank"]) for r in trees.select_tree(frame, "fold", {"one": ["f0"], "both": ["f0", "f1"]}, [1, 2], [2.0, 6.0], "y", "w", "task").collect()}
    wanted = {}
    for name, pick in (("one", [2]), ("both", [2, 3])):
        for depth in (1, 2):
            for m in (2.0, 6.0):
                errors = {}
                for held in range(3):
                    tree = brute_tree([(*(r[i] for i in pick), r[4], r[5]) for r in rows if r[0] != held], depth, m, True)
                    for r in rows:
                        if r[0] == held:
                            node = 1
                            while tree[node][0] is not None:
                                node = 2 * node + (r[pick[int(tree[node][0][1])]] > tree[node][1].expected)
                            errors.setdefault(r[1], []).append(abs(tree[node][3].expected - r[4]))
                wanted[name, depth, m] = sum(sum(e) / len(e) for e in errors.values()) / len(errors)
    assert {k: v[0] for k, v in got.items()} == {k: pytest.approx(v) for k, v in wanted.items()}
    order = sorted(wanted, key=lambda k: (round(wanted[k], 9), 1 if k[0] == "one" else 2, k[1], -k[2]))
    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][1])] == order
    assert trees.select_tree(frame.limit(0), "fold", {"one": ["f0"]}, [1], [2.0], "y").count() == 0


# -- exact cosine joins and the merge loop ----------------------------------------------------------------


def clustered(seed, n, dims=12, groups=8, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return [(i, (middles[i % groups] / np.linalg.norm(middles[i % groups]) + rng.normal(size=dims) * spread).tolist(), int(i % 3)) for i in range(n)]


def brute_pairs(rows, threshold):
    found = {}
    for i, a, k in rows:
        for j, b, m in rows:
            if i < j and k == m and a and b and len(a) == len(b) and any(a) and any(b):
                c = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
                if c >= threshold:
                    found[i, j] = c
    return found


@pytest.mark.parametrize("threshold", [0.5, 0.97, 1.0 - 1e-12])
def test_pivots_lose_no_pair(spark, threshold):
    rows = clustered(4, 240)
    rows += [(1000 + i, rows[7][1], 1) for i in range(12)] + [(2000, [], 1), (2001, [0.0] * 12, 1), (2002, [1.0, 2.0], 0), (2003, [2.0, 4.0], 0), (2004, None, 0)]
    frame = spark.createDataFrame(rows, "node_id long, embedding array<double>, k long")
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in routing.pair_candidates(frame, threshold, within="k").collect()}
    wanted = brute_pairs([r for r in rows if r[1]], threshold)
    if threshold < 1 - 1e-9:
        assert set(got) == set(wanted) and all(got[p] == pytest.approx(wanted[p]) for p in got)
    else:  # where rounding decides
        assert set(got) <= set(brute_pairs([r for r in rows if r[1]], threshold - 1e-9))


def test_pivots_compare_few_pairs_of_clustered_vectors(spark):
    rows = clustered(5, 1200, dims=16, groups=40, spread=0.03)
    frame = spark.createDataFrame(rows, "node_id long, embedding array<double>, k long")
    compared = routing.near_pairs(frame, 0.95, "node_id", "embedding", None).count()
    wanted = len(brute_pairs([(i, v, 0) for i, v, _ in rows], 0.95))
    assert wanted <= compared < 1200 * 1199 / 2 / 8


@pytest.mark.parametrize("block", [40, 700, 2048])
def test_blocks_of_vectors_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = [(i, v, 0 if i < 640 else i) for i, v, _ in clustered(14, 700, groups=20)] + [(800 + i, v, 90 + i % 3) for i, v, _ in clustered(15, 60)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(90)] + [(2000, [], 0), (2001, [0.0] * 12, 0), (2002, [1.0, 2.0], 0), (2003, [2.0, 4.0], 0), (2004, [1e-200] * 12, 0)]
    frame = spark.createDataFrame([*rows, (2005, None, 0), (2006, rows[7][1], None)], "node_id long, embedding array<double>, k long")
    for threshold in (0.3, 0.9):
        got = routing.pair_candidates(frame, threshold, within="k").collect()
        wanted = brute_pairs(rows[:-1], threshold)
        assert {(r["left_id"], r["right_id"]): r["similarity"] for r in got} == {p: pytest.approx(s) for p, s in wanted.items()} and len(got) == len(wanted)
    odd = spark.createDataFrame([(1, [math.inf, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, math.nan], 0)], "node_id long, embedding array<double>, k long")
    assert {(r["left_id"], r["right_id"]) for r in routing.pair_candidates(odd, 0.5, within="k").collect()} == {(1, 2), (1, 3), (2, 3)}  # NaN is above all numbers


def test_blocked_pairs_as_a_table_or_a_rule(spark):
    frame = spark.createDataFrame(clustered(16, 90), "node_id long, embedding array<double>, k long")
    table = spark.createDataFrame([(i, j) for i in range(90) for j in range(i + 1, 90) if (i + j) % 5 == 0], "left_id long, right_id long")
    found = [{(r["left_id"], r["right_id"]) for r in routing.pair_candidates(frame, 0.5, b).collect()} for b in (None, table, (F.col("left_id") + F.col("right_id")) % 5 == 0)]
    assert found[1] == found[2] == {p for p in found[0] if sum(p) % 5} != found[0]


def test_blocks_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 30)
    frame = spark.createDataFrame(clustered(5, 1200, dims=16, groups=40, spread=0.03), "node_id long, embedding array<double>, k long")
    rows, met = blocks.dealt(frame, 0.95, "node_id", "embedding", None)
    n = rows.select("_block").distinct().count()
    assert n > 30 and met.count() < n * (n + 1) / 2 / 4


def test_complete_links_above(spark):
    rows = [(i, v, i % 12) for i, v, _ in clustered(6, 60, groups=4)]
    frame = spark.createDataFrame(rows, "m long, embedding array<double>, g long")
    every = {(r["left_group"], r["right_group"]): r["similarity"] for r in routing.complete_links(frame, "g").collect()}
    got = {(r["left_group"], r["right_group"]): r["similarity"] for r in routing.complete_links_above(frame, "g", 0.1, "m").collect()}
    assert got == {p: pytest.approx(s) for p, s in every.items() if s >= 0.1} and got


@pytest.mark.parametrize("block", [50, 2048])
def test_complete_links_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = [(i % 9 if i < 900 else i % 60, v) for i, v, _ in clustered(17, 1100, groups=5)] + [(3, rows) for rows in [clustered(17, 1)[0][1]] * 400]
    rows += [(70, [1.0, 2.0]), (70, None), (71, [0.0, 0.0]), (71, [2.0, 1.0]), (72, [3.0, 4.0]), (73, [math.nan, 1.0]), (73, [3.0, 3.0]), (74, [math.nan, 2.0]), (75, []), (76, [1e-200, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "g long, v array<double>")
    def cosine(a, b):  # noqa: E306
        both = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if a and b and len(a) == len(b) else 0.0
        return 0.0 if both == 0 else float(np.dot(a, b) / both)
    wanted, held = {}, {}  # noqa: E305
    for g, v in rows[:-1]:
        held.setdefault(g, []).append(v)
    for g, left in held.items():
        for h, right in held.items():
            if g < h:
                whole = all(v and len(v) == 12 and any(v) for v in left + right)
                unit = [np.array([np.array(v) / np.linalg.norm(v) for v in side]) for side in (left, right)] if whole else None
                each = (unit[0] @ unit[1].T).ravel() if whole else np.array([cosine(a, b) for a in left for b in right])
                wanted[g, h] = float(np.nanmin(each)) if not np.isnan(each).all() else math.nan
    got = {(r["left_group"], r["right_group"]): r["similarity"] for r in routing.complete_links(frame, "g", "v").collect()}
    assert got == {p: pytest.approx(s, abs=1e-9, nan_ok=True) for p, s in wanted.items()}
    some = [p for p in wanted if sum(p) % 3 == 0]
    pairs = spark.createDataFrame(some, "left_group long, right_group long")
    for cost in (0, 10**9):  # as rows and in blocks
        monkeypatch.setattr(routing, "ROW_COST", cost)
        got = {(r["left_group"], r["right_group"]): r["similarity"] for r in routing.complete_links(frame, "g", "v", pairs).collect()}
        assert got == {p: pytest.approx(wanted[p], abs=1e-9, nan_ok=True) for p in some}


def test_complete_links_above_look_at_few_pairs_of_groups_apart(spark, monkeypatch):
    rows = [(i, v, i % 6) for i, v, _ in clustered(18, 3000, groups=2, spread=0.05)] + [(5000 + i, clustered(18, 2, groups=2)[0][1], i) for i in range(6)]
    frame = spark.createDataFrame(rows, "m long, embedding array<double>, g long")
    seen, whole = [], routing.complete_links
    monkeypatch.setattr(routing, "complete_links", lambda members, group, vector, pairs: (seen.append(pairs.count()), whole(members, group, vector, pairs))[1])
    got = {(r["left_group"], r["right_group"]) for r in routing.complete_links_above(frame, "g", 0.5, "m").collect()}
    least = {(r["left_group"], r["right_group"]): r["similarity"] for r in whole(frame, "g").collect()}
    assert got == {p for p, s in least.items() if s >= 0.5} and len(seen) == 2 and seen[1] < len(least)


def test_greedy_matching_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(routing, "SCANNED", 40)
    rng = random.Random(7)
    pairs = [(i, j, rng.choice([0.5, 0.9, rng.random()])) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.3] + [(100 + i, 100 + j, 0.7) for i in range(30) for j in range(i + 1, 30)]
    used, wanted = set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {i, j} & used:
            used |= {i, j}
            wanted.add((i, j, s))
    assert {tuple(r) for r in routing.greedy_matching(spark.createDataFrame(pairs, "left_id long, right_id long, similarity double")).collect()} == wanted


@pytest.mark.parametrize("block, scanned", [(2048, 1 << 20), (30, 3000), (2048, 100)])
def test_nearest_matching_equals_a_scan_of_all_pairs(spark, monkeypatch, block, scanned):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(routing, "SCANNED", scanned)
    rows = [(i, [v], k) for i, v, k in clustered(21, 330)] + [(400 + i, [v, rows[1]], 0) for i, (_, v, _) in enumerate(clustered(22, 40)) for rows in clustered(23, 1)]
    copied, like = clustered(24, 1)[0][1], clustered(25, 1)[0][1]
    rows += [(500 + i, [copied] * (1 + i % 2), 0) for i in range(61)] + [(600 + i, [like], 1) for i in range(9)] + [(610, [[2 * x for x in like]], 1), (700, [[0.0] * 12], 1), (701, [[1.0, 2.0]], 1), (702, [[1.0, 3.0]], 1)]
    rng = random.Random(4)
    blocked = {(500 + i, 501 + i) for i in range(0, 60, 7)} | {(600, 601)} | {tuple(sorted(rng.sample(range(330), 2))) for _ in range(60)}
    frame = spark.createDataFrame(rows, "node_id long, vectors array<array<double>>, k long")

    def cosine(a, b):  # summed in order: equal vectors have equal cosines
        dot, left, right = 0.0, 0.0, 0.0
        for x, y in zip(a, b):
            dot, left, right = dot + x * y, left + x * x, right + y * y
        return dot / (math.sqrt(left) * math.sqrt(right)) if left and right and len(a) == len(b) else 0.0

    found = [(min(cosine(x, y) for x in v for y in w), i, j) for i, v, k in rows for j, w, m in rows if i < j and k == m and (i, j) not in blocked]
    for threshold in (0.2, 0.9):
        used, wanted = set(), {}
        for s, i, j in sorted((p for p in found if p[0] >= threshold), key=lambda p: (-p[0], p[1], p[2])):
            if not {i, j} & used:
                used |= {i, j}
                wanted[i, j] = s
        got = routing.nearest_matching(frame, threshold, within="k", blocked=spark.createDataFrame(sorted(blocked), "left_id long, right_id long")).collect()
        assert {(r["left_id"], r["right_id"]): r["similarity"] for r in got} == wanted and len(got) == len(wanted) > 100


def test_nearest_matching_takes_copies_in_one_round(spark, monkeypatch):
    monkeypatch.setattr(routing, "SCANNED", 2000)
    frame = spark.createDataFrame([(i, [v], 0) for i, v, _ in clustered(26, 100)] + [(1000 + i, [clustered(27, 1)[0][1]], 0) for i in range(1000)], "node_id long, vectors array<array<double>>, k long")
    rounds, whole = [], routing.best_partners
    monkeypatch.setattr(routing, "best_partners", lambda *a: (rounds.append(1), whole(*a))[1])
    got = {(r["left_id"], r["right_id"]) for r in routing.nearest_matching(frame, 0.1).collect()}
    assert {(1000 + i, 1001 + i) for i in range(0, 1000, 2)} <= got and len(rounds) < 8


def brute_tree_of(rows, start, decay, floor, accept, shared):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    members = {i: [i] for i, _, _ in rows}
    groups = {i: {g} for i, _, g in rows}
    active, blocked, made = sorted(members), set(), {}
    for level in range(1, round((start - floor) / decay) + 2):
        threshold = max(floor, start - decay * (level - 1))
        open_ = []
        for x, a in enumerate(active):
            for b in active[x + 1 :]:
                if (a, b) in blocked or level <= shared and not groups[a] & groups[b]:
                    continue
                s = min(float(unit[p] @ unit[q]) for p in members[a] for q in members[b])
                if s >= threshold - 1e-12:
                    open_.append((-s, a, b))
        used = set()
        pairs = []
        for s, a, b in sorted(open_):
            if not {a, b} & used:
                used |= {a, b}
                pairs.append((a, b))
        if not pairs and threshold <= floor:
            break
        for a, b in pairs:
            if not accept(a, b):
                blocked.add((a, b))
                continue
            name = f"merge:{level}:{hashlib.sha256(f'{a}{chr(10)}{b}'.encode()).hexdigest()[:24]}"
            made[name] = (level, a, b)
            members[name], groups[name] = members[a] + members[b], groups[a] | groups[b]
            active = [n for n in active if n not in (a, b)] + [name]
        active.sort()
    return made, {n: len(members[n]) for n in members}


@pytest.mark.parametrize("shared", [0, 2])
def test_merge_tree_equals_a_sequential_build_and_resumes(spark, tmp_path, shared):
    rows = [(f"n{i:03d}", v, str(g)) for i, v, g in clustered(8, 48, dims=6, groups=5, spread=0.2)]
    frame = spark.createDataFrame([(i, v, [g]) for i, v, g in rows], "node_id string, embedding array<double>, groups array<string>")
    fine = lambda a, b: int(hashlib.sha256((a + b).encode()).hexdigest(), 16) % 4 != 0
    asked = []

    def accept(pairs, level):
        asked.append(level)
        if level == 3 and asked.count(3) == 1:
            raise RuntimeError("stopped")
        return pairs.where(F.conv(F.right(F.sha2(F.concat("left_id", "right_id").cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 4 != 0)

    folder = f"file://{tmp_path}/tree"
    with pytest.raises(RuntimeError, match="stopped"):
        merging.merge_tree(frame, folder, 0.95, 0.1, 0.5, accept, shared)
    tree = merging.merge_tree(frame, folder, 0.95, 0.1, 0.5, accept, shared).collect()
    assert asked.count(1) == asked.count(2) == 1 and asked.count(3) == 2
    made, sizes = brute_tree_of(rows, 0.95, 0.1, 0.5, fine, shared)
    assert {r["node_id"]: (r["level"], r["left_id"], r["right_id"]) for r in tree if r["level"]} == made and len(made) > 10
    assert {r["node_id"]: r["n_members"] for r in tree} == sizes
    children = {c for _, a, b in made.values() for c in (a, b)}
    assert {r["node_id"] for r in tree if r["active"]} == set(sizes) - children
    one = next(r for r in tree if r["level"] == 1)
    assert one["centroid"] == pytest.approx(((np.array(dict((i, v) for i, v, _ in rows)[one["left_id"]]) + np.array(dict((i, v) for i, v, _ in rows)[one["right_id"]])) / 2).tolist())


def test_merge_tree_stops_at_its_attempts_and_takes_no_leaves(spark, tmp_path):
    frame = spark.createDataFrame([(i, [math.cos(i / 50), math.sin(i / 50)]) for i in range(10)], "node_id long, embedding array<double>")
    assert [r["level"] for r in merging.merge_tree(frame, f"file://{tmp_path}/a", 0.9, 0.1, 0.7, most_attempts=2).where("level > 0").collect()] == [1, 1]
    assert merging.merge_tree(frame.limit(0), f"file://{tmp_path}/b").count() == 0


# -- Kendall's tau-b for continuous scores -----------------------------------------------------------------


def tau_b(pairs):
    s, n, tx, ty = 0, len(pairs), 0, 0
    for i in range(n):
        for j in range(i):
            a, b = np.sign(pairs[i][0] - pairs[j][0]), np.sign(pairs[i][1] - pairs[j][1])
            s += a * b
            tx += a == 0
            ty += b == 0
    whole = n * (n - 1) / 2
    return s / math.sqrt((whole - tx) * (whole - ty)) if whole > tx and whole > ty else None


@pytest.mark.parametrize("block", [3])
def test_kendall_by_inversions(spark, block):
    rng = random.Random(9)
    groups = {g: [(rng.choice([rng.random(), 0.5, 0.25]), rng.choice([rng.random() * 3, -1.0, 2.0])) for _ in range(n)] for g, n in (("a", 90), ("b", 40), ("two", 2))}
    groups["flat"] = [(1.0, float(i)) for i in range(6)]
    groups["down"] = [(float(i), -float(i)) for i in range(17)]
    frame = spark.createDataFrame([(g, *p) for g, own in groups.items() for p in own], "g string, human double, judge_raw double")
    counted = agreement.cells(frame, ["g"])
    got = {r["g"]: r["kendall"] for r in agreement.kendall_by_inversions(counted, ["g"], block).collect()}
    grid = {r["g"]: r["kendall"] for r in agreement.kendall_on_grid(counted, ["g"]).collect()}
    for g, own in groups.items():
        wanted = None if g in ("two", "flat") else pytest.approx(tau_b(own))
        assert got[g] == wanted and grid[g] == wanted


def test_kendall_of_many_distinct_scores_makes_no_grid(spark, monkeypatch):
    rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003))).cast("double").alias("human"), F.col("id").cast("double").alias("judge_raw"))
    counted = agreement.cells(rows, [])
    monkeypatch.setattr(agreement, "kendall_on_grid", None)
    got = agreement.kendall(counted, []).first()["kendall"]
    y = np.array([r["human"] for r in rows.orderBy("judge_raw").collect()])
    discordant = sum(int((y[:i] > y[i]).sum()) for i in range(len(y)))
    n = len(y)
    ties = sum(c * (c - 1) / 2 for c in np.unique(y, return_counts=True)[1])
    whole = n * (n - 1) / 2
    assert got == pytest.approx((whole - ties - 2 * discordant) / math.sqrt(whole * (whole - ties)))


def test_tree_selection_counts_equal_rows_once(spark, monkeypatch):
    rows = spark.range(200_000).select((F.col("id") % 4).alias("fold"), (F.col("id") % 40).alias("task"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3 + F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 / 2 + 0.5).alias("w"))
    seen, whole = [], trees.histogram_tree
    monkeypatch.setattr(trees, "histogram_tree", lambda z, *a: (seen.append(z.count()), whole(z, *a))[1])
    got = trees.select_tree(rows, "fold", {"a": ["a"], "task": ["a", "task"]}, [1, 2], [50.0], "y", "w", "task").collect()
    assert len(got) == 4 and seen == [120 * 3] * 2
    uneven = rows.withColumn("b", F.when(F.col("fold") == 0, F.lit(1.0)).otherwise(F.rand(3)))
    assert trees.bin_edges(uneven.distinct(), ["a", "b"], 16, uneven) == trees.bin_edges(uneven, ["a", "b"], 16)
