"""Queries over linear models and trees that are fitted from sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import gramian, trees
from gaugework.plans import tables as T
from gaugework.plans.registry import query

W = T.with_views


def _parts(spark, sf):
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 11).cast("double").alias("c"))


_LEVERAGE = """WITH f AS (SELECT p_partkey AS item_id, p_size::DOUBLE AS a, p_retailprice AS b, (p_partkey % 11)::DOUBLE AS c, p_partkey % 3 <> 0 AS t FROM part),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f WHERE t),
    z AS (SELECT item_id, t, (a - ma) / sa AS x, (b - mb) / sb AS y, (c - mc) / sc AS w FROM f, s),
    g AS (SELECT 1 + sum(x * x) AS p, sum(x * y) AS q, sum(x * w) AS r, 1 + sum(y * y) AS u, sum(y * w) AS v, 1 + sum(w * w) AS o FROM z WHERE t),
    d AS (SELECT *, p * (u * o - v * v) - q * (q * o - v * r) + r * (q * v - u * r) AS det FROM g)
    SELECT item_id, sqrt(x * x + y * y + w * w) / sqrt(3.0) AS novelty,
      (x * x * (u * o - v * v) + y * y * (p * o - r * r) + w * w * (p * u - q * q) + 2 * (x * y * (r * v - q * o) + x * w * (q * v - r * u) + y * w * (q * r - p * v))) / det AS leverage FROM z, d"""


@query(_LEVERAGE, "novelty leverage", "item_id")
def leverage(spark, sf):
    return gramian.leverage(_parts(spark, sf), "item_id", ["a", "b", "c"], F.col("item_id") % 3 != 0)


def _observations(spark, sf):
    z = T.aligned(spark, sf).where("human is not null and judge_raw is not null")
    return z.withColumns({"late": (F.col("item_id") % 7).cast("double"), "task": F.col("item_id") % 40, "weight": (1 + F.col("item_id") % 3).cast("double")})


_OBSERVED = W("aligned") + ", z AS (SELECT *, judge_raw AS a, human AS y, (item_id % 7)::DOUBLE AS b, item_id % 40 AS task, (1 + item_id % 3)::DOUBLE AS w FROM aligned WHERE human IS NOT NULL AND judge_raw IS NOT NULL)"
_SUMS = "sum(w) AS w, sum(w * a) AS a, sum(w * b) AS b, sum(w * y) AS y, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab, sum(w * a * y) AS ay, sum(w * b * y) AS yb"
#: Refits without each task: all other rows are summed anew for every task.
_REFITS = (
    _OBSERVED
    + f""", t AS (SELECT DISTINCT dimension, task FROM z), o AS (SELECT t.dimension, t.task, {_SUMS} FROM t JOIN z ON z.dimension = t.dimension AND z.task <> t.task GROUP BY 1, 2),
    c AS (SELECT dimension, task, a / w AS ma, b / w AS mb, y / w AS my, aa - a * a / w AS aa, bb - b * b / w AS bb, ab - a * b / w AS ab, ay - a * y / w AS ay, yb - b * y / w AS yb FROM o),
    m AS (SELECT *, ay / aa AS k, yb / bb AS l, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS ka, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS kb FROM c),
    r AS (SELECT t.dimension, t.task, use_case, sum(w * (y - a)) / sum(w) AS residual FROM t JOIN z ON z.dimension = t.dimension AND z.task <> t.task GROUP BY 1, 2, 3),
    p AS (SELECT z.dimension, z.item_id, z.task, z.w, z.y, z.a AS base, z.a + my - ma AS bias, my + k * (z.a - ma) AS score_linear, my + ka * (z.a - ma) + kb * (z.b - mb) AS linear,
      my + l * (z.b - mb) AS prompt_linear, z.a + coalesce(residual, my - ma) AS prompt_bias FROM z JOIN m USING (dimension, task) LEFT JOIN r USING (dimension, task, use_case))"""
)


@query(_REFITS + " SELECT dimension, item_id, bias, score_linear, linear, prompt_linear, prompt_bias FROM p", "bias score_linear linear prompt_linear prompt_bias", "dimension item_id")
def leave_group_out(spark, sf):
    p = gramian.comparators(_observations(spark, sf), "task", ["judge_raw", "late"], "judge_raw", "human", "weight", ["dimension"], stratum="use_case", reference=["late"])
    return p.select("dimension", "item_id", *(F.col(f"p_{c}").alias(c) for c in ("bias", "score_linear", "linear", "prompt_linear", "prompt_bias")))


@query(
    _REFITS + """, e AS (SELECT dimension, task, w, unnest(['base', 'bias', 'score_linear', 'linear', 'prompt_linear', 'prompt_bias']) AS predictor,
      unnest([abs(base - y), abs(bias - y), abs(score_linear - y), abs(linear - y), abs(prompt_linear - y), abs(prompt_bias - y)]) AS e FROM p), i AS (SELECT dimension, predictor, task, avg(e) AS e, sum(w * e) AS we, sum(w) AS w FROM e GROUP BY 1, 2, 3)
    SELECT dimension, predictor, count(*) AS n_items, avg(e) AS mae, sum(we) / sum(w) AS weighted_mae FROM i GROUP BY 1, 2""",
    "mae weighted_mae", "dimension predictor n_items",
)
def comparator_report(spark, sf):
    p = gramian.comparators(_observations(spark, sf), "task", ["judge_raw", "late"], "judge_raw", "human", "weight", ["dimension"], stratum="use_case", reference=["late"])
    return gramian.comparator_report(p, "task", "human", "weight", ["dimension"])


@query(
    _OBSERVED
    + f""", o AS (SELECT dimension, {_SUMS} FROM z WHERE task < 30 GROUP BY 1), c AS (SELECT dimension, a / w AS ma, b / w AS mb, y / w AS my, aa - a * a / w AS aa, bb - b * b / w AS bb, ab - a * b / w AS ab, ay - a * y / w AS ay, yb - b * y / w AS yb FROM o),
    p AS (SELECT z.dimension, task, y, w, z.a AS base, z.a + my - ma AS bias, my + ay / aa * (z.a - ma) AS score_linear, my + (bb * ay - ab * yb) / (aa * bb - ab * ab) * (z.a - ma) + (aa * yb - ab * ay) / (aa * bb - ab * ab) * (z.b - mb) AS linear FROM z JOIN c USING (dimension) WHERE task >= 30),
    e AS (SELECT dimension, task, w, unnest(['base', 'bias', 'score_linear', 'linear']) AS predictor, unnest([abs(base - y), abs(bias - y), abs(score_linear - y), abs(linear - y)]) AS e FROM p), i AS (SELECT dimension, predictor, task, avg(e) AS e, sum(w * e) AS we, sum(w) AS w FROM e GROUP BY 1, 2, 3)
    SELECT dimension, predictor, count(*) AS n_items, avg(e) AS mae, sum(we) / sum(w) AS weighted_mae FROM i GROUP BY 1, 2""",
    "mae weighted_mae", "dimension predictor n_items",
)
def frozen_holdout(spark, sf):
    p = gramian.comparators(_observations(spark, sf), "task", ["judge_raw", "late"], "judge_raw", "human", "weight", ["dimension"], training=F.col("task") < 30)
    return gramian.comparator_report(p.where("task >= 30"), "task", "human", "weight", ["dimension"])


_TREE = (
    "WITH "
    + ", ".join(f"{n} AS ({T.SQL[n]})" for n in ("ratings", "judges"))
    + ", x1 AS (SELECT dimension, 1 AS node, judge_raw AS v0, (item_id % 7)::DOUBLE AS v1, (item_id % 1000)::DOUBLE AS v2, score AS y FROM ratings JOIN judges USING (item_id))"
    + "".join(
        f""", u{k} AS (SELECT dimension, node, f, CASE f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS v, y FROM x{k}, range(0, 3) r(f)), h{k} AS (SELECT dimension, node, f, v, count(*) AS n, sum(y) AS s FROM u{k} GROUP BY ALL),
        r{k} AS (SELECT dimension, node, f, v, sum(n) OVER w AS ln, sum(s) OVER w AS ls, lead(v) OVER w AS nv FROM h{k} WINDOW w AS (PARTITION BY dimension, node, f ORDER BY v)),
        n{k} AS (SELECT dimension, node, count(*) AS n, sum(y) AS s FROM x{k} GROUP BY 1, 2), l{k} AS (SELECT dimension, sum(y * y) - sum(y) ** 2 / count(*) AS loss FROM x1 GROUP BY 1),
        g{k} AS (SELECT dimension, node, f, (v + nv) / 2 AS cut, round((ls ** 2 / ln + (s - ls) ** 2 / (n - ln) - s ** 2 / n) / loss, 9) AS share, ls ** 2 / ln + (s - ls) ** 2 / (n - ln) - s ** 2 / n AS gain
          FROM r{k} JOIN n{k} USING (dimension, node) JOIN l{k} USING (dimension) WHERE nv IS NOT NULL AND ln >= 20 AND n - ln >= 20),
        b{k} AS (SELECT * FROM g{k} WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY dimension, node ORDER BY share DESC, f, cut) = 1),
        x{k + 1} AS (SELECT x.dimension, 2 * x.node + (CASE f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END > cut)::INT AS node, v0, v1, v2, y FROM x{k} x JOIN b{k} b USING (dimension, node))"""
        for k in (1, 2)
    )
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT n.dimension, n.node, {('b.f, b.cut, b.gain' if k < 3 else 'NULL AS f, NULL AS cut, NULL AS gain')}, n.n, n.s / n.n AS value FROM (SELECT dimension, node, count(*) AS n, sum(y) AS s FROM x{k} GROUP BY 1, 2) n" + (f" LEFT JOIN b{k} b USING (dimension, node)" if k < 3 else "") for k in (1, 2, 3))
    + ")"
)
_NAMES = "CASE f WHEN 0 THEN 'judge_raw' WHEN 1 THEN 'late' WHEN 2 THEN 'slot' END"
_FEATURES = ["judge_raw", "late", "slot"]


def _rated(spark, sf):
    z = T.ratings(spark, sf).join(T.judges(spark, sf), "item_id")
    return z.withColumns({"late": (F.col("item_id") % 7).cast("double"), "slot": (F.col("item_id") % 1000).cast("double")})


@query(_TREE + f" SELECT dimension, node, {_NAMES} AS feature, cut, n, value, gain FROM a", "cut value gain", "dimension node:i feature n")
def histogram_tree(spark, sf):
    return trees.histogram_tree(_rated(spark, sf), ["dimension"], _FEATURES, "score", depth=2, least=20, bins=1024).drop("weight")


@query(_TREE + f" SELECT dimension, {_NAMES} AS feature, sum(gain) / sum(sum(gain)) OVER (PARTITION BY dimension) AS importance FROM a WHERE f IS NOT NULL GROUP BY dimension, f", "importance", "dimension feature")
def tree_importances(spark, sf):
    return trees.importances(trees.histogram_tree(_rated(spark, sf), ["dimension"], _FEATURES, "score", depth=2, least=20, bins=1024), ["dimension"])


@query(
    _TREE
    + """, q AS (SELECT x1.dimension, y, v0, v1, v2, CASE WHEN d1.f IS NULL THEN d1.value WHEN d2.f IS NULL THEN d2.value ELSE d3.value END AS p FROM x1 JOIN a d1 ON d1.dimension = x1.dimension AND d1.node = 1
      LEFT JOIN a d2 ON d2.dimension = x1.dimension AND d2.node = 2 + (CASE d1.f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END > d1.cut)::INT LEFT JOIN a d3 ON d3.dimension = x1.dimension AND d3.node = 2 * d2.node + (CASE d2.f WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END > d2.cut)::INT)
    SELECT dimension, count(*) AS n, avg(abs(p - y)) AS mae, avg((p - y) ** 2) AS mse FROM q GROUP BY 1""",
    "mae mse", "dimension n",
)
def tree_errors(spark, sf):
    rows = _rated(spark, sf)
    tree = trees.histogram_tree(rows, ["dimension"], _FEATURES, "score", depth=2, least=20, bins=1024)
    error = F.col("prediction") - F.col("score")
    return trees.predict(rows, tree, ["dimension"], _FEATURES, 2).groupBy("dimension").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))


@query()
def tree_selection(spark, sf):
    rows = _rated(spark, sf).withColumns({"fold": F.col("item_id") % 4, "task": F.col("item_id") % 40})
    return trees.select_tree(rows, "fold", {"judge": ["judge_raw"], "all": _FEATURES}, [1, 2], [20.0], "score", item="task", bins=1024)
