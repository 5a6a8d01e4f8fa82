"""Operators that SQL does not express, and degenerate input, against small Python oracles."""

import collections
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions import text as X
from gaugework.functions import vectors as V
from gaugework.operators import agreement as A
from gaugework.operators import areas, calibration, fitting, intervals, judging, ratings, routing, sampling
from gaugework.operators import classification as C
from gaugework.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def tau_b(x, y):
    s = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, tx, ty = s + a * b, tx + abs(a), ty + abs(b)
    return s / math.sqrt(tx * ty) if tx and ty else None


def test_agreement_against_python(spark):
    rng = random.Random(1)
    data = [(g, float(rng.randrange(1, 6)), rng.choice([None, *map(float, range(1, 6))])) for g in "ab" for _ in range(60)]
    data += [("short", 1.0, 2.0), ("short", 2.0, 1.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("flat", 3.0, 4.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0)]
    got = {r["g"]: r for r in A.agreement(spark.createDataFrame(data, "g string, human double, judge_raw double"), ["g"]).collect()}
    for g in "ab":
        x, y = map(np.array, zip(*[(h, j) for k, h, j in data if k == g and j is not None]))
        assert got[g]["n"] == len(x)
        assert got[g]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got[g]["kendall"] == pytest.approx(tau_b(x, y))
        assert got[g]["mae"] == pytest.approx(np.abs(x - y).mean()) and got[g]["rmse"] == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
    assert got["short"]["pearson"] is None and got["short"]["spearman"] is None and got["short"]["kendall"] is None and got["short"]["qwk"] == pytest.approx(-1)
    assert got["flat"]["spearman"] is None and got["flat"]["pearson"] is None and got["flat"]["kendall"] is None
    assert got["same"]["qwk"] is None and got["same"]["mae"] == 0
    assert A.agreement(spark.createDataFrame([], "g string, human double, judge_raw double"), ["g"]).count() == 0


def test_rater_agreement_known_values(spark):
    rows = [("i", "d", r, s) for r, s in enumerate((2.0, 4.0, 5.0))] + [("k", "d", 1, 3.0)]
    got = ratings.rater_agreement(spark.createDataFrame(rows, "item_id string, dimension string, rater long, score double")).first()
    assert (got["n_items"], got["n_ratings"], got["self_mae"], got["pairwise_mae"]) == (1, 3, 1.1111, 2.0)


def test_label_kappa_degenerate(spark):
    def kappa(pairs):
        return C.label_kappa(spark.createDataFrame(pairs, "target string, prediction string")).first()["kappa"]

    assert kappa([("no", "no"), ("no", "no")]) == 1.0 and kappa([("no", "yes"), ("yes", "no")]) == pytest.approx(-1)


def test_label_functions(spark):
    assert [one(spark, S.label_of_score(F.lit(v))) for v in (0.0, 0.49, 0.5, 1.49, 1.5, 2.0)] == ["no", "no", "partial", "partial", "yes", "yes"]
    with pytest.raises(Exception, match="out of range"):
        one(spark, S.label_of_score(F.lit(2.01)))
    for a, b, label in ((10.0, 100.0, "no"), (80.0, 95.0, "yes"), (80.0, 60.0, "partial")):
        assert one(spark, S.label_by_gates(F.lit(a), F.lit(b), 50.0, 90.0)) == label
    assert one(spark, S.number(F.lit(" nan "))) is None and one(spark, S.number(F.lit(" 2.5 "))) == 2.5 and one(spark, S.number(F.lit(""))) is None
    values = {'{"a": {"b": 3}}': 3.0, '{"a": {"b": true}}': None, '{"a": {"b": "3"}}': None, '{"a": {"b": 2.5}}': 2.5, "{": None}
    for text, wanted in values.items():
        assert one(spark, S.json_number(F.lit(text), "$.a.b")) == wanted
    assert one(spark, S.agreement_bucket(F.array(F.lit(0.5), F.lit(0.5)))) == "unanimous" and one(spark, S.agreement_bucket(F.array(F.lit(0.5), F.lit(1.0)))) == "disputed"
    low, high = S.wilson_bounds(F.lit(7), F.lit(10))
    assert one(spark, low) == pytest.approx(0.3968, abs=1e-4) and one(spark, high) == pytest.approx(0.8922, abs=1e-4)
    assert one(spark, S.wilson_bounds(F.lit(0), F.lit(0))[1]) == 0.0
    for scores, cycle in (([3, 2, 3, 2], True), ([3, 3, 3, 3], False), ([1, 2, 3], False), ([5, 1, 2, 3, 1, 2, 3], True)):
        assert one(spark, S.repeats_in_cycle(F.array(*map(F.lit, scores)))) is cycle


def test_text_and_vector_functions(spark):
    assert one(spark, X.jaccard(X.tokens(F.lit("A b")), X.tokens(F.lit("b, c")))) == pytest.approx(1 / 3)
    assert one(spark, X.fill(F.lit("{a} {b} {c}"), {"a": F.lit("1"), "b": F.lit(None)})) == "1  {c}"
    assert one(spark, X.shorten(F.lit("abcdef"), 5)) == "ab..." and one(spark, X.unfence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1) and one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0 and one(spark, V.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, V.level_threshold(F.lit(9))) == 0.7


def test_label_reliability_counts_votes(spark):
    rows = [(1, "yes", x) for x in ("yes", "yes", "no", None)] + [(2, "no", "yes"), (3, "no", None)]
    got = C.label_reliability(spark.createDataFrame(rows, "item_id long, target string, label string"))
    r = got.first()
    assert r["n"] == 2 and r["modal_match"] == 0.5 and r["disputed_rate"] == 0.5 and r["modal_support"] == pytest.approx((2 / 3 + 1) / 2)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_balanced_quotas_against_dealing(spark):
    rng = random.Random(3)
    for total in (0, 1, 7, 23, 1000):
        sizes = {f"g{i}": rng.choice([0, 1, 2, 5, 9, 30]) for i in range(7)}
        sizes = {g: n for g, n in sizes.items() if n}
        quota, left = dict.fromkeys(sizes, 0), min(total, sum(sizes.values()))
        while left:
            g = min((q, g) for g, q in quota.items() if q < sizes[g])[1]
            quota[g] += 1
            left -= 1
        frame = spark.createDataFrame(list(sizes.items()), "g string, n long")
        assert {r["g"]: r["quota"] for r in sampling.balanced_quotas(frame, "g", total).collect()} == quota


def test_evenly_spaced_positions(spark):
    for n in (1, 2, 7, 20):
        for k in range(n + 1):
            rows = spark.range(n).where(sampling.is_evenly_spaced(F.col("id"), F.lit(n), F.lit(k)))
            assert sorted(r["id"] for r in rows.collect()) == [i * n // k for i in range(k)]


def test_nearest_matches_against_one_pass(spark):
    rng = random.Random(4)
    times = [(g, rng.choice(["left", "right"]), round(rng.uniform(0, 40), 2)) for g in range(5) for _ in range(40)]
    frame = spark.createDataFrame(times, "g long, side string, at double")
    got = sorted(((r["g"], r["left_at"], r["right_at"], r["kind"]) for r in intervals.nearest_matches(frame, "g", 0.4).collect()), key=str)
    wanted = []
    for g in range(5):
        left, right = (sorted(t for k, s, t in times if k == g and s == side) for side in ("left", "right"))
        used = set()
        for a in left:
            near = [(abs(b - a), b, i) for i, b in enumerate(right) if i not in used and abs(b - a) <= 0.4]
            if near:
                _, b, i = min(near)
                used.add(i)
                wanted.append((g, a, b, "matched"))
            else:
                wanted.append((g, a, None, "left_only"))
        wanted += [(g, None, b, "right_only") for i, b in enumerate(right) if i not in used]
    assert got == sorted(wanted, key=str)


def test_segments_known_values(spark):
    rows = [("a", 70.0, [], [10.0, 27.0, 55.0]), ("b", 10.0, [1.0, 5.0, 6.0], None), ("c", 65.0, None, [])]
    got = intervals.segments(spark.createDataFrame(rows, "g string, duration double, silences array<double>, boundaries array<double>"), "g", 30.0).collect()
    spans = {g: [(r["start"], r["end"]) for r in got if r["g"] == g] for g in "abc"}
    assert spans["a"] == [(0, 27), (27, 55), (55, 70)] and spans["b"] == [(0, 5), (5, 10)] and spans["c"] == [(0, 30), (30, 60), (60, 65)]


def ends_in_cycle(s):
    return any(s[-p:] == s[-2 * p : -p] and len(set(s[-p:])) > 1 for p in range(2, len(s) // 2 + 1))


def test_trailing_cycles_against_brute_force(spark):
    rng = random.Random(8)
    groups = {g: rng.choices("ab", k=rng.randrange(1, 9)) for g in range(40)} | {40: ["a"] * 30, 41: list("xab" + "abcab" * 2), 42: list("ab" * 20), 43: list("abc" * 7 + "abd" * 7), 44: [*rng.choices("abc", k=50)] * 2, None: list("abab")}
    rows = [(g, 3 * i + rng.randrange(3) - 20, x) for g, s in groups.items() for i, x in enumerate(s)]
    rng.shuffle(rows)
    table, wanted = spark.createDataFrame(rows, "g long, i long, x string"), {g: ends_in_cycle(s) for g, s in groups.items()}
    assert len(set(wanted.values())) == 2
    for width in (7, 4096):
        assert {r["g"]: r["cycles"] for r in intervals.trailing_cycles(table, "g", "i", "x", width).collect()} == wanted


def events_table(spark, folder, rows):
    """rows: user, event id, minute, type."""
    e = spark.createDataFrame(rows, "user_id long, event_id long, minute long, event_type string")
    e.select("user_id", "event_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "event_type", F.lit(1.0).alias("value")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_score_cycles_whole_sees_all_events(spark, tmp_path):
    rows = [(1, 9 * i + 5, i, x) for i, x in enumerate(["view", "click"] * 3)] + [(2, i, i, x) for i, x in enumerate(["view", "click", "view", "view", "click", "buy"])]
    got = {r["user_id"]: r["cycles"] for r in catalog.queries()["score_cycles_whole"](spark, events_table(spark, tmp_path, rows)).collect()}
    assert got == {1: True, 2: False}


def test_sequence_segments_has_users_of_late_ids(spark, tmp_path):
    day = 24 * 60
    rows = [(1, 5, 0, "view"), (1, 20_001, 2 * day, "click"), (2, 20_000, day, "view"), (2, 20_003, 2 * day, "purchase"), (2, 20_002, 6 * day, "click")]
    rows += [(3, 7, 5 * day, "click"), (3, 20_009, 4 * day, "view")]  # the first id is not the first time
    got = catalog.queries()["sequence_segments"](spark, events_table(spark, tmp_path, rows)).collect()
    d = 86400.0
    assert sorted((r["user_id"], r["ordinal"], r["start"], r["end"]) for r in got) == [(1, 0, 0, 2 * d), (2, 0, 0, d), (2, 1, d, 4 * d), (2, 2, 4 * d, 5 * d), (3, 0, 0, d)]


def test_area_scores_known_values(spark):
    units = [("i", "r", "shot", 1.0, 5.0, None, True), ("i", "r", "shot", 1.0, 1.0, "critical", True), ("i", "s", "shot", 1.0, None, None, True)]
    got = {r["rubric"]: r for r in areas.rubric_summaries(spark.createDataFrame(units, "item string, rubric string, unit_type string, duration_seconds double, score double, severity string, valid boolean"), ["item", "rubric"]).collect()}
    assert got["r"]["mean"] == 3.0 and got["r"]["score"] == 2.0 and got["s"]["score"] is None and got["s"]["n_valid"] == 0


def test_greedy_matching_against_sorted_scan(spark):
    rng = random.Random(5)
    pairs = [(i, j, rng.randrange(50) / 50) for i, j in itertools.combinations(range(14), 2) if rng.random() < 0.6]
    used, wanted = set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in used and j not in used:
            used |= {i, j}
            wanted.add((i, j, s))
    got = routing.greedy_matching(spark.createDataFrame(pairs, "left_id long, right_id long, similarity double"))
    assert {tuple(r) for r in got.select("left_id", "right_id", "similarity").collect()} == wanted


def test_greedy_matching_goes_on_until_no_pair_is_left(spark):
    equal = [(i, j, 0.5) for i, j in itertools.combinations(range(200), 2)]
    chain = [(1000 + i, 1001 + i, 0.9 - i / 1000) for i in range(300)]
    got = routing.greedy_matching(spark.createDataFrame(equal + chain, "left_id long, right_id long, similarity double")).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == {(i, i + 1) for i in range(0, 200, 2)} | {(1000 + i, 1001 + i) for i in range(0, 300, 2)} and len(got) == 250


def test_greedy_matching_with_short_lists(spark):
    rng = random.Random(9)
    pairs = [(i, j, rng.randrange(4) / 4) for i, j in itertools.combinations(range(16), 2) if rng.random() < 0.7]
    used, wanted = set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in used and j not in used:
            used |= {i, j}
            wanted.add((i, j, s))
    got = routing.greedy_matching(spark.createDataFrame(pairs, "left_id long, right_id long, similarity double"), listed=3)
    assert {tuple(r) for r in got.collect()} == wanted


def test_nearest_node_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(routing, "MOST_NODES", 3)
    rng = np.random.default_rng(1)
    items, nodes = rng.normal(size=(20, 4)), rng.normal(size=(11, 4))
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item long, embedding array<double>")
    n = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(nodes)], "node_id long, centroid array<double>")
    got = {r["item"]: r["node_id"] for r in routing.nearest_node(f, n).collect()}
    cos = items @ nodes.T / np.linalg.norm(items, axis=1)[:, None] / np.linalg.norm(nodes, axis=1)
    assert [got[i] for i in range(20)] == cos.argmax(axis=1).tolist()


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 6, size=(80, 2)).astype(float)
    y = 1 + 0.5 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=80) * 0.1
    rows = spark.createDataFrame([("d", *map(float, r), float(v)) for r, v in zip(x, y)], "g string, a double, b double, y double")
    got = fitting.ridge(rows, ["g"], ["a", "b"], "y").first()
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(got["coefficients"], beta) and got["intercept"] == pytest.approx(y.mean() - x.mean(0) @ beta) and got["n"] == 80


def test_l1_tree_and_its_column(spark):
    rows = spark.createDataFrame([("d", float(a), float(b), 4.0 if a > 2 else 2.0) for a in range(5) for b in range(3)], "g string, a double, b double, y double")
    tree = json.loads(fitting.l1_tree(rows, ["g"], ["a", "b"], "y").first()["tree"])
    assert tree["feature"] == 0 and tree["cut"] == 2.5
    assert rows.where(fitting.tree_column(tree, ["a", "b"]) != F.col("y")).count() == 0


def test_bootstrap_brackets_the_mean(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([("g", i, rng.gauss(5, 1)) for i in range(200)], "g string, unit long, v double")
    r = fitting.bootstrap_mean(rows, ["g"], "unit", "v", draws=300).first()
    assert r["low"] < r["mean"] < r["high"] and 0.2 < r["high"] - r["low"] < 0.4
    assert fitting.bootstrap_mean(rows.repartition(7), ["g"], "unit", "v", draws=300).first()["low"] == pytest.approx(r["low"])


def test_bootstrap_of_a_metric_draws_once_for_units_with_equal_pairs(spark):
    rng = np.random.default_rng(9)
    cells = [(g, u, float(u % 4), float((u % 4 + rng.integers(3)) % 5)) for g in ("a", None) for u in range(900)]
    cells += [(g, u, float(u % 3), 2.0) for g, u, _, _ in cells if u % 2] + [(g, u, x, y) for g, u, x, y in cells if u % 5 == 0]
    rows = spark.createDataFrame([*cells, ("a", 1, None, 1.0)], "g string, unit long, x double, y double")
    profiles = fitting.unit_profiles(rows, ["g"], "unit", "x", "y").collect()
    kinds = {g: collections.Counter(frozenset(collections.Counter((x, y) for _, _, x, y in part).items()) for _, part in itertools.groupby(sorted((c for c in cells if c[0] == g), key=lambda c: c[1]), key=lambda c: c[1])) for g in ("a", None)}
    for g in kinds:
        got = collections.defaultdict(dict)
        for r in profiles:
            if r["g"] == g:
                got[r["_p"], r["_q"]][(r["_x"], r["_y"]), r["_n"]] = r["_units"]
        assert {frozenset(c): set(c.values()) for c in got.values()} == {k: {n} for k, n in kinds[g].items()} and len(got) < 300

    def mean(counted, by):
        return counted.groupBy(*by).agg((F.sum(F.col("c") * (F.col("x") - F.col("y"))) / F.sum("c")).alias("mean"))

    found = {r["g"]: r for r in fitting.bootstrap_metric(rows, ["g"], "unit", mean, "x", "y", draws=2000).collect()}
    again = {r["g"]: r for r in fitting.bootstrap_metric(rows.repartition(7), ["g"], "unit", mean, "x", "y", draws=2000).collect()}
    assert found == again and found.keys() == {"a", None}
    for g in found:
        sums = np.array([[sum(c[2] - c[3] for c in cells if c[:2] == (g, u)), sum(c[:2] == (g, u) for c in cells)] for u in range(900)])
        drawn = rng.poisson(1, (4000, 900)) @ sums
        low, high = np.percentile(drawn[:, 0] / drawn[:, 1], [2.5, 97.5])
        assert found[g]["n_draws"] == 2000 and abs(found[g]["low"] - low) < 0.1 * (high - low) > abs(found[g]["high"] - high)


def test_bootstrap_queries_take_1000_draws(spark, monkeypatch):
    asked, whole = {}, {f: getattr(fitting, f) for f in ("bootstrap_mean", "bootstrap_metric")}
    for f, operator in whole.items():
        monkeypatch.setattr(fitting, f, lambda *a, f=f, operator=operator, **b: (asked.update({f: b["draws"]}), operator(*a, **b))[1])
    for name in ("bootstrap_interval", "bootstrap_spearman"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == {"bootstrap_mean": 1000, "bootstrap_metric": 1000}


def test_folds_keep_tasks_together_and_balance(spark):
    rows = spark.createDataFrame([(t, label) for t in range(60) for label in (("no", "yes") if t % 3 else ("partial",))], "task long, target string")
    folds = fitting.grouped_folds(rows, "task", 3).collect()
    sizes = [sum(r["fold"] == f for r in folds) for f in range(3)]
    assert len({r["task"] for r in folds}) == 60 and max(sizes) - min(sizes) <= 2


def test_cutpoints_separate_and_fall_back(spark):
    rows = spark.createDataFrame([("partial", 90.0), ("no", 30.0), ("yes", 95.0)], "target string, ordinal_score double")
    best = calibration.fit_cutpoints(rows).first()
    assert best["accuracy"] == 1.0 and 30 < best["low"] <= 90 < best["high"] <= 95
    assert calibration.fit_cutpoints(rows.limit(0)).count() == 0


def test_judges_validate_and_survive_failures(spark):
    class Flaky:
        def generate(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("down")
            return {"fence": '```json\n{"score_1_to_5": 4, "rationale": "ok"}\n```', "high": '{"score_1_to_5": 9, "rationale": "x"}', "bool": '{"score_1_to_5": true, "rationale": ""}'}.get(prompt, "not json")

    rows = spark.createDataFrame([(k,) for k in ("fence", "high", "bool", "prose", "boom")], "k string")
    got = {r["k"]: r for r in judging.judge(rows, "k", "{k}", {"k": "k"}, Flaky).collect()}
    assert got["fence"]["judge_raw"] == 4.0 and got["fence"]["valid"]
    assert got["high"]["flags"] == ["out_of_range"] and got["bool"]["flags"] == ["no_score", "empty_rationale"] and got["prose"]["flags"] == ["not_json"]
    assert got["boom"]["judge_raw"] is None and "RuntimeError" in got["boom"]["error"]


def test_route_tree_descends_while_children_qualify(spark):
    nodes = [(1, None, [1.0, 0.0], 0.0), (2, None, [0.0, 1.0], 0.0), (3, 1, [1.0, 0.2], 0.9), (4, 3, [1.0, 0.3], 0.999), (5, 2, [0.5, 1.0], 0.99)]
    items = [(10, [1.0, 0.3]), (11, [1.0, 0.1]), (12, [-0.1, 1.0])]
    got = routing.route_tree(spark.createDataFrame(items, "item_id long, embedding array<double>"), spark.createDataFrame(nodes, "node_id long, parent_id long, centroid array<double>, threshold double"), 3)
    assert {r["item_id"]: (r["node_id"], r["steps"]) for r in got.collect()} == {10: (4, 2), 11: (3, 1), 12: (2, 0)}


def test_bayesian_line_follows_clear_data_and_shrinks_noise(spark):
    rng = random.Random(7)
    rows = [("clear", float(x), 1 + 0.5 * x) for x in range(1, 6) for _ in range(20)] + [("noise", float(rng.randrange(1, 6)), rng.gauss(3, 1)) for _ in range(30)]
    got = {r["g"]: r for r in fitting.bayesian_line(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["clear"]["slope"] == pytest.approx(0.5, abs=1e-3) and got["clear"]["intercept"] == pytest.approx(1, abs=1e-2)
    assert abs(got["noise"]["slope"]) < 0.25 and got["noise"]["noise_std"] == pytest.approx(1, abs=0.4)


def test_cross_validated_cutpoints_use_other_folds(spark):
    rows = spark.createDataFrame([(i, i % 6, ("no", "partial", "yes")[i % 3], (20.0, 50.0, 90.0)[i % 3] + i % 5) for i in range(60)], "item_id long, task long, target string, ordinal_score double")
    folds = fitting.grouped_folds(rows, "task", 2)
    got = calibration.cross_validated_cutpoints(rows, folds, "task", 2)
    assert got.count() == 60 and got.where("calibrated <> target").count() == 0
