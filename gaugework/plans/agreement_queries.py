"""Queries over ratings and judges: aggregation, alignment, agreement, reports, areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.operators import agreement as A
from gaugework.operators import areas, calibration, ratings, reports
from gaugework.operators import classification as C
from gaugework.plans import tables as T
from gaugework.plans.registry import query

W = T.with_views


@query(
    W("ratings") + "SELECT item_id, dimension, avg(score) AS mean_score, median(score) AS median_score, max(score) AS max_score, min(score) AS min_score, count(score) AS n_scores FROM ratings GROUP BY ALL",
    "mean_score median_score max_score min_score", "item_id dimension n_scores",
)
def label_measures(spark, sf):
    return ratings.all_measures(T.ratings(spark, sf)).drop("scores")


@query(W("ratings") + "SELECT item_id, dimension, median(score) AS human, count(score) AS n_scores, count(DISTINCT rater) AS n_raters FROM ratings GROUP BY ALL", "human", "item_id dimension n_scores n_raters")
def label_median(spark, sf):
    return ratings.aggregate_ratings(T.ratings(spark, sf), "median")


@query(
    W("ratings")
    + """, i AS (SELECT item_id, dimension, row_number() OVER (PARTITION BY item_id, dimension ORDER BY score) AS k, score, avg(score) OVER g AS m, count(*) OVER g AS n FROM ratings WINDOW g AS (PARTITION BY item_id, dimension)),
    p AS (SELECT a.dimension, avg(abs(a.score - b.score)) AS v FROM i a JOIN i b ON a.item_id = b.item_id AND a.dimension = b.dimension AND a.k < b.k GROUP BY 1)
    SELECT i.dimension, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings, round(avg(abs(score - m)), 4) AS self_mae, round(any_value(p.v), 4) AS pairwise_mae
    FROM i JOIN p ON i.dimension = p.dimension WHERE n >= 2 GROUP BY 1""",
    "self_mae pairwise_mae", "dimension n_items n_ratings",
)
def rater_agreement(spark, sf):
    return ratings.rater_agreement(T.ratings(spark, sf))


@query(W("aligned") + "SELECT * FROM aligned", "human judge_raw", "item_id dimension use_case model")
def aligned_pairs(spark, sf):
    return ratings.align(ratings.aggregate_ratings(T.ratings(spark, sf)).select("item_id", "dimension", "human"), T.judges(spark, sf))


@query(W("ratings", "judges") + "SELECT item_id, dimension, rater, score AS human, judge_raw FROM ratings JOIN judges USING (item_id)", "human judge_raw", "item_id dimension rater")
def per_rater_pairs(spark, sf):
    return ratings.align_raters(T.ratings(spark, sf), T.judges(spark, sf))


@query(
    W("human", "judges")
    + """, w AS (SELECT o_custkey * 3 AS item_id, d.dimension FROM orders, (VALUES ('A'), ('N'), ('R')) d(dimension)),
    x AS (SELECT w.*, CASE WHEN w.item_id NOT IN (SELECT item_id FROM human) THEN 'no_human_record' WHEN h.human IS NULL THEN 'no_human_score'
        WHEN j.item_id IS NULL THEN 'no_judge_result' WHEN j.judge_raw IS NULL THEN 'no_judge_score' END AS reason
      FROM w LEFT JOIN human h USING (item_id, dimension) LEFT JOIN (SELECT item_id, CASE WHEN judge_raw > 1 THEN judge_raw END AS judge_raw FROM judges WHERE item_id % 5 <> 0) j ON w.item_id = j.item_id)
    SELECT dimension, reason, count(*) AS n, array_to_string(list_sort(list(item_id))[1:3], ',') AS examples FROM x WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "", "dimension reason n examples",
)
def missing_diagnosis(spark, sf):
    items = T.read(spark, sf, "orders").select((F.col("o_custkey") * 3).alias("item_id"))
    judged = T.judges(spark, sf).where("item_id % 5 <> 0").withColumn("judge_raw", F.when(F.col("judge_raw") > 1, F.col("judge_raw")))
    out = ratings.missing_reasons(items, T.human(spark, sf), judged, T.DIMENSIONS)
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    """SELECT l_orderkey AS item_id, l_linenumber AS line, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS overall
    FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_tax END AS a, CASE WHEN l_discount > 0.02 THEN l_discount END AS b, CASE WHEN l_quantity > 5 THEN l_quantity END AS c FROM lineitem)""",
    "overall", "item_id line:i",
)
def derive_overall(spark, sf):
    def present(name, least):
        return F.when(F.col(name) > least, F.col(name))

    values = [present("l_tax", 0.02), present("l_discount", 0.02), present("l_quantity", 5)]
    return T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line"), ratings.overall(values).alias("overall"))


_AGREEMENT = """, r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY human) + (count(*) OVER (PARTITION BY {by}, human) - 1) / 2.0 AS rh,
      rank() OVER (PARTITION BY {by} ORDER BY judge_raw) + (count(*) OVER (PARTITION BY {by}, judge_raw) - 1) / 2.0 AS rj FROM {src}),
    q AS (SELECT {by}, least(5, greatest(1, round_even(human, 0))) AS h, least(5, greatest(1, round_even(judge_raw, 0))) AS j FROM {src}),
    k AS (SELECT {by}, 1 - sum((h - j) ** 2) / nullif(sum(h * h) + sum(j * j) - 2 * sum(h) * sum(j) / count(*), 0) AS qwk FROM q GROUP BY ALL),
    c AS (SELECT {by}, human AS x, judge_raw AS y, count(*)::DOUBLE AS c FROM {src} GROUP BY ALL),
    t AS (SELECT {a}, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(a.c * b.c * (a.x <> b.x)::INT) AS sx, sum(a.c * b.c * (a.y <> b.y)::INT) AS sy
      FROM c a JOIN c b USING ({by}) GROUP BY ALL)
    SELECT r.{by}, count(*) AS n, avg(abs(human - judge_raw)) AS mae, sqrt(avg((human - judge_raw) ** 2)) AS rmse, corr(human, judge_raw) AS pearson, corr(rh, rj) AS spearman,
      any_value(t.s / sqrt(t.sx * t.sy)) AS kendall, any_value(k.qwk) AS qwk FROM r JOIN t ON r.{by} = t.{by} JOIN k ON r.{by} = k.{by} GROUP BY 1"""


@query(W("aligned") + _AGREEMENT.format(by="dimension", src="aligned", a="dimension"), "mae rmse pearson spearman kendall qwk", "dimension n")
def agreement_by_dimension(spark, sf):
    return A.agreement(T.aligned(spark, sf), ["dimension"])


@query(W("ratings", "judges") + ", rp AS (SELECT dimension, score AS human, judge_raw FROM ratings JOIN judges USING (item_id))" + _AGREEMENT.format(by="dimension", src="rp", a="dimension"), "mae rmse pearson spearman kendall qwk", "dimension n")
def agreement_per_rater(spark, sf):
    return A.agreement(ratings.align_raters(T.ratings(spark, sf), T.judges(spark, sf)), ["dimension"])


@query(
    W("aligned")
    + """, g AS (SELECT dimension, 'use_case' AS category, use_case AS value, human, judge_raw FROM aligned UNION ALL SELECT dimension, 'model', model, human, judge_raw FROM aligned),
    r AS (SELECT *, rank() OVER (PARTITION BY dimension, category, value ORDER BY human) + (count(*) OVER (PARTITION BY dimension, category, value, human) - 1) / 2.0 AS rh,
      rank() OVER (PARTITION BY dimension, category, value ORDER BY judge_raw) + (count(*) OVER (PARTITION BY dimension, category, value, judge_raw) - 1) / 2.0 AS rj FROM g)
    SELECT dimension, category, value, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rh, rj) END AS spearman FROM r GROUP BY 1, 2, 3""",
    "spearman", "dimension category value n",
)
def agreement_by_category(spark, sf):
    return A.by_categories(T.aligned(spark, sf), "dimension", ["use_case", "model"])


_GAP = ", ".join(f"round(max(CASE WHEN dimension = '{d}' THEN judge_raw - human END), 2) AS gap_{d}" for d in T.DIMENSIONS)


@query(
    W("aligned") + f"""SELECT item_id, count(*) AS n_dims, round(avg(human), 3) AS mean_human, round(avg(judge_raw), 3) AS mean_judge, round(avg(judge_raw) - avg(human), 3) AS mean_gap_signed,
    round(avg(abs(judge_raw - human)), 3) AS mean_abs_gap, {_GAP} FROM aligned GROUP BY 1""",
    "mean_human mean_judge mean_gap_signed mean_abs_gap gap_A gap_N gap_R", "item_id n_dims",
)
def per_item_gap(spark, sf):
    return reports.item_gaps(T.aligned(spark, sf), T.DIMENSIONS)


_SIGNALS = [("A", "m1"), ("N", "m2"), ("R", "m1")]
_SIGNAL_ITEMS = """, s AS (SELECT item_id, CASE dimension WHEN 'N' THEN 'm2' ELSE 'm1' END AS judge_signal, count(*) AS n_human_dims, round(avg(human), 3) AS human, round(avg(judge_raw), 3) AS judge,
    round(avg(judge_raw) - avg(human), 3) AS gap_signed, round(abs(avg(judge_raw) - avg(human)), 3) AS abs_gap FROM aligned GROUP BY 1, 2)"""


@query(W("aligned") + _SIGNAL_ITEMS + "SELECT * FROM s", "human judge gap_signed abs_gap", "item_id judge_signal n_human_dims")
def per_signal_item(spark, sf):
    return reports.signal_items(T.aligned(spark, sf), spark.createDataFrame(_SIGNALS, "dimension string, judge_signal string"))


@query(
    W("aligned") + _SIGNAL_ITEMS
    + """, r AS (SELECT *, rank() OVER (PARTITION BY judge_signal ORDER BY human) + (count(*) OVER (PARTITION BY judge_signal, human) - 1) / 2.0 AS rh,
      rank() OVER (PARTITION BY judge_signal ORDER BY judge) + (count(*) OVER (PARTITION BY judge_signal, judge) - 1) / 2.0 AS rj FROM s)
    SELECT judge_signal, count(*) AS n_items, round(avg(human), 3) AS mean_human, round(avg(judge), 3) AS mean_judge, round(avg(judge) - avg(human), 3) AS mean_gap_signed,
      round(avg(abs(human - judge)), 3) AS mae, round(corr(rh, rj), 3) AS spearman FROM r GROUP BY 1""",
    "mean_human mean_judge mean_gap_signed mae spearman", "judge_signal n_items",
)
def per_signal_summary(spark, sf):
    return reports.signal_summary(T.aligned(spark, sf), spark.createDataFrame(_SIGNALS, "dimension string, judge_signal string"))


@query(
    W("aligned")
    + """, m AS (SELECT dimension, use_case, model, avg(human) AS h, avg(judge_raw) AS j FROM aligned GROUP BY 1, 2, 3)
    SELECT a.dimension, a.use_case, count(*) AS n_pairs, avg(((a.h < b.h) = (a.j < b.j))::INT) AS accuracy FROM m a JOIN m b ON a.dimension = b.dimension AND a.use_case = b.use_case AND a.model < b.model
    WHERE a.h <> b.h AND a.j <> b.j GROUP BY 1, 2""",
    "accuracy", "dimension use_case n_pairs",
)
def pairwise_accuracy(spark, sf):
    return reports.preference_accuracy(T.aligned(spark, sf), ["dimension", "use_case"], "model")


_REPEATS = """WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'purchase') AS b, avg(value) FILTER (event_type = 'view') AS c FROM events GROUP BY 1),
    z AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
      rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM z)
    SELECT count(*) AS n_items, avg(sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 3)) AS mean_std, (corr(ra, rb) + corr(ra, rc) + corr(rb, rc)) / 3 AS mean_spearman FROM (SELECT *, (a + b + c) / 3 AS m FROM r)"""


@query(_REPEATS, "mean_std mean_spearman", "n_items")
def repeat_consistency(spark, sf):
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("repeat"), F.col("value").alias("score"))
    return reports.repeat_consistency(e, ["click", "purchase", "view"])


@query(
    "WITH c AS (SELECT event_type AS signal, CAST(date_trunc('day', ts) AS DATE) AS day, user_id % 3 AS setting, avg(value) AS mae FROM events GROUP BY 1, 2, 3) SELECT setting, signal, count(mae) AS n_repeats, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae FROM c GROUP BY 1, 2",
    "mean_mae std_mae", "setting signal n_repeats",
)
def grid_summary(spark, sf):
    e = T.read(spark, sf, "events")
    cells = e.groupBy(F.col("event_type").alias("signal"), F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("setting")).agg(F.avg("value").alias("mae"))
    return reports.grid_summary(cells, "mae")


@query(
    W("ratings") + "SELECT item_id, dimension AS metric_id, count(*) AS n, avg(score) AS base_score, median(score) AS median_score, stddev_pop(score) AS std_score, max(score) - min(score) AS range_score, count(DISTINCT rater % 3) AS n_temperatures FROM ratings GROUP BY 1, 2",
    "base_score median_score std_score range_score", "item_id metric_id n n_temperatures",
)
def score_variants(spark, sf):
    r = T.ratings(spark, sf).select("item_id", F.col("dimension").alias("metric_id"), "score", (F.col("rater") % 3).alias("temperature"))
    out = reports.score_variants([r.where("temperature = 0"), r.where("temperature <> 0")])
    return out.withColumn("n_temperatures", F.size("temperatures")).drop("temperatures")


@query(
    "SELECT c_custkey AS item_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal END, 1.0) AS value FROM customer", "value", "item_id"
)
def fan_in_later_wins(spark, sf):
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("value"))
    parts = [c.withColumn("value", F.lit(1.0)), c.where("item_id % 2 = 0").withColumn("value", -F.col("value")), c.where("item_id % 3 = 0")]
    return reports.later_wins(parts, ["item_id"], "value")


_AREA = """, z AS (SELECT *, CASE WHEN valid AND score IS NOT NULL THEN score END AS s, CASE WHEN valid AND score IS NOT NULL THEN CASE WHEN unit_type = 'edit_boundary' THEN 1.0 ELSE greatest(1e-6, duration_seconds) END END AS w FROM units),
    a AS (SELECT item_id, rubric_id, sum(s * w) / sum(w) AS weighted_mean, avg(s) AS mean, min(s) AS minimum, quantile_cont(s, 0.2) AS p20, var_pop(s) AS variance, avg(CASE WHEN s IS NOT NULL THEN (s <= 2)::INT END) AS severe_fraction,
      sum(CASE WHEN severity = 'major' OR s <= 2 THEN w ELSE 0 END) / sum(w) AS affected_fraction, coalesce(bool_or(s IS NOT NULL AND (coalesce(severity = 'critical', FALSE) OR s <= 1)), FALSE) AS critical, count(s) AS n_valid, count(*) AS n_total FROM units2 GROUP BY 1, 2),
    b AS (SELECT *, least(weighted_mean, CASE WHEN critical THEN 2.0 WHEN affected_fraction >= 0.2 THEN 3.0 ELSE 5.0 END) AS score0 FROM a),
    c AS (SELECT * EXCLUDE (score0), CASE WHEN weighted_mean IS NOT NULL THEN score0 END AS score FROM b)""".replace("units2", "z")


@query(W("units") + _AREA + "SELECT * FROM c", "weighted_mean mean minimum p20 variance severe_fraction affected_fraction score", "item_id rubric_id critical n_valid n_total")
def area_summaries(spark, sf):
    return areas.rubric_summaries(T.units(spark, sf), ["item_id", "rubric_id"])


@query(
    W("units") + _AREA + "SELECT item_id, d.dimension, sum(score * w) / sum(w) AS area_score, count(w) AS n_rubrics FROM (SELECT *, CASE WHEN score IS NOT NULL THEN CASE rubric_id WHEN 'F' THEN 0.3 WHEN 'O' THEN 0.7 END END AS w FROM c), (VALUES ('pacing'), ('audio')) d(dimension) GROUP BY 1, 2",
    "area_score", "item_id dimension n_rubrics",
)
def area_scores(spark, sf):
    summaries = areas.rubric_summaries(T.units(spark, sf), ["item_id", "rubric_id"])
    return areas.spread_to_dimensions(areas.weighted_scores(summaries, ["item_id"], "rubric_id", {"F": 0.3, "O": 0.7}), ["pacing", "audio"])


@query(W("units") + _AREA + "SELECT item_id, sum((score IS NOT NULL)::INT + 1)::BIGINT AS n_features, sum(coalesce(score, 0) + n_valid) AS total FROM c GROUP BY 1", "total", "item_id n_features")
def area_features(spark, sf):
    f = areas.feature_map(areas.rubric_summaries(T.units(spark, sf), ["item_id", "rubric_id"]), "item_id", "rubric_id", ["score", "n_valid"])
    return f.select("item_id", F.size("features").alias("n_features"), F.aggregate(F.map_values("features"), F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(W("judges") + "SELECT count_if(judge_raw >= 3) AS passed, count_if(judge_raw = 2) AS failed, count_if(judge_raw < 2) AS skipped, avg(judge_raw) AS mean_score FROM judges", "mean_score", "passed:i failed:i skipped:i")
def gate_counts(spark, sf):
    j = T.judges(spark, sf)
    return C.gate_counts(j.select(F.when(F.col("judge_raw") >= 3, True).when(F.col("judge_raw") == 2, False).alias("gate"), F.col("judge_raw").alias("score")))


@query(
    W("aligned")
    + """, i AS (SELECT use_case, item_id, sum(human - judge_raw) AS r, count(*) AS c FROM aligned GROUP BY 1, 2), t AS (SELECT use_case, sum(r) AS rt, sum(c) AS ct FROM i GROUP BY 1)
    SELECT a.item_id, a.dimension, judge_raw + coalesce((rt - r) / nullif(ct - c, 0), 0) AS prediction FROM aligned a JOIN i USING (use_case, item_id) JOIN t USING (use_case)""",
    "prediction", "item_id dimension",
)
def bias_leave_one_out(spark, sf):
    rows = T.aligned(spark, sf).withColumn("base", F.col("judge_raw"))
    return calibration.bias_leave_one_out(rows, "use_case", "item_id").select("item_id", "dimension", "prediction")


@query(W("aligned") + "SELECT dimension, count(*) AS n, regr_slope(human, judge_raw) AS slope, regr_intercept(human, judge_raw) AS intercept FROM aligned GROUP BY 1", "slope intercept", "dimension n")
def score_line(spark, sf):
    return calibration.fit_line(T.aligned(spark, sf), ["dimension"], "judge_raw", "human")


@query(
    W("aligned")
    + """, m AS (SELECT dimension, regr_slope(human, judge_raw) AS s, regr_intercept(human, judge_raw) AS i FROM aligned GROUP BY 1),
    p AS (SELECT item_id, human, judge_raw AS base, greatest(1, least(5, i + s * judge_raw)) AS line FROM aligned JOIN m USING (dimension)),
    e AS (SELECT item_id, avg(abs(base - human)) AS b, avg(abs(line - human)) AS l FROM p GROUP BY 1)
    SELECT 'base' AS predictor, count(*) AS n_items, avg(b) AS mae FROM e UNION ALL SELECT 'line', count(*), avg(l) FROM e""",
    "mae", "predictor n_items",
)
def comparator_errors(spark, sf):
    rows = T.aligned(spark, sf)
    p = calibration.apply_line(rows, calibration.fit_line(rows, ["dimension"], "judge_raw", "human"), ["dimension"], "judge_raw")
    return calibration.macro_item_error(p.withColumnsRenamed({"judge_raw": "base", "prediction": "line"}), "item_id", ["base", "line"])


@query(
    W("units") + """, z AS (SELECT rubric_id, score, sum(duration_seconds) AS w FROM units WHERE duration_seconds > 0 AND score IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY rubric_id ORDER BY score) AS u, sum(w) OVER (PARTITION BY rubric_id) AS t FROM z) SELECT rubric_id, min(score) AS weighted_median FROM c WHERE u >= t / 2 GROUP BY 1""",
    "weighted_median", "rubric_id",
)
def weighted_median(spark, sf):
    return calibration.weighted_median(T.units(spark, sf), ["rubric_id"], "score", "duration_seconds")


@query(
    """WITH f AS (SELECT l_orderkey AS item_id, l_linenumber AS line, l_orderkey % 4 <> 0 AS training, CASE WHEN l_linenumber <> 3 THEN l_discount END AS a, CASE WHEN l_quantity < 40 THEN l_quantity END AS b FROM lineitem),
    m AS (SELECT median(a) FILTER (training) AS ma, median(b) FILTER (training) AS mb FROM f) SELECT item_id, line, coalesce(a, ma, 0) AS a, coalesce(b, mb, 0) AS b FROM f, m""",
    "a b", "item_id line:i",
)
def impute_median(spark, sf):
    f = T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("a"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("b")
    )
    return calibration.impute_median(f, ["a", "b"], F.col("item_id") % 4 != 0)


@query(
    """SELECT 'l_linenumber' AS feature, count(DISTINCT l_linenumber) FILTER (l_orderkey % 4 <> 0) AS n_distinct, TRUE AS kept FROM lineitem UNION ALL SELECT 'one', 1, FALSE UNION ALL
    SELECT 'l_tax', count(DISTINCT l_tax) FILTER (l_orderkey % 4 <> 0), TRUE FROM lineitem""",
    "", "feature n_distinct kept",
)
def varying_features(spark, sf):
    f = T.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_tax", F.lit(1.0).alias("one"))
    return calibration.varying_features(f, ["l_linenumber", "l_tax", "one"], F.col("l_orderkey") % 4 != 0)


@query(W("judges") + "SELECT item_id, CASE WHEN v < 0.3 THEN 'poor' WHEN v < 0.6 THEN 'fair' WHEN v < 0.72 THEN 'good' ELSE 'strong' END AS band FROM (SELECT item_id, judge_raw / 6 AS v FROM judges)", "", "item_id band")
def correlation_bands(spark, sf):
    return T.judges(spark, sf).select("item_id", S.correlation_band(F.col("judge_raw") / 6).alias("band"))


@query(
    W("ratings") + """, c AS (SELECT item_id, score, count(*) AS c FROM ratings GROUP BY 1, 2), t AS (SELECT *, max(c) OVER (PARTITION BY item_id) AS m FROM c),
    s AS (SELECT item_id, sum(c) AS n, max(score) - min(score) AS range, CASE WHEN count(*) FILTER (c = m) = 1 THEN max(score) FILTER (c = m) END AS mode, sum(c * (c - 1)) AS same FROM t GROUP BY 1)
    SELECT s.item_id, n, range, median, mode, CASE WHEN n > 1 THEN 1 - same / (n * (n - 1)) END AS disagreement, range >= 2 AS polarized FROM s JOIN (SELECT item_id, median(score) AS median FROM ratings GROUP BY 1) m USING (item_id)""",
    "range median mode disagreement", "item_id n:i polarized",
)
def disagreement_profile(spark, sf):
    return ratings.disagreement_profile(T.ratings(spark, sf), ["item_id"])


@query(
    "SELECT l_partkey AS item_id, sum(l_quantity * l_discount) FILTER (l_discount > 0) / nullif(sum(l_discount) FILTER (l_discount > 0), 0) AS anchor, sum(l_discount) FILTER (l_discount > 0) AS total_weight, avg(l_quantity) - 0.25 * (max(l_quantity) - min(l_quantity)) AS block_score FROM lineitem GROUP BY 1",
    "anchor total_weight block_score", "item_id",
)
def weighted_anchor(spark, sf):
    li = T.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_quantity", "l_discount")
    return ratings.weighted_human(li, ["item_id"], "l_quantity", "l_discount").join(ratings.block_scores(li, ["item_id"], "l_quantity"), "item_id")


@query(
    """WITH r AS (SELECT o_orderkey AS item_id, m.metric_id, m.position, o_orderkey % 3 <> 0 AS parsed, CASE WHEN o_orderkey % 5 <> m.position THEN o_totalprice / m.position END AS score FROM orders, (VALUES ('m1', 1), ('own_b', 2), ('own_a', 3)) m(metric_id, position)),
    x AS (SELECT item_id, c.dimension, score, custom, position FROM r JOIN (VALUES ('pace', 'm1', FALSE), ('pace', 'own_a', TRUE), ('sync', 'own_a', TRUE), ('sync', 'own_b', TRUE)) c(dimension, metric_id, custom) USING (metric_id) WHERE custom OR parsed)
    SELECT item_id, dimension, judge_raw FROM (SELECT item_id, dimension, score AS judge_raw, row_number() OVER (PARTITION BY item_id, dimension ORDER BY custom, position) AS i FROM x) WHERE i = 1""",
    "judge_raw", "item_id dimension",
)
def signal_for_dimension(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice", (F.col("o_orderkey") % 3 != 0).alias("parsed"))
    metrics = F.array(*(F.struct(F.lit(m).alias("metric_id"), F.lit(i).alias("position")) for i, m in enumerate(("m1", "own_b", "own_a"), 1)))
    r = o.withColumn("m", F.explode(metrics)).select("item_id", "m.metric_id", "m.position", "parsed", F.when(F.col("item_id") % 5 != F.col("m.position"), F.col("o_totalprice") / F.col("m.position")).alias("score"))
    walk = spark.createDataFrame([("pace", "m1", False), ("pace", "own_a", True), ("sync", "own_a", True), ("sync", "own_b", True)], "dimension string, metric_id string, custom boolean")
    return ratings.signal_for_dimension(r, walk)


@query(
    W("aligned") + "SELECT item_id, dimension, use_case FROM aligned WHERE use_case IN ('1-URGENT', '5-LOW') AND regexp_matches(item_id::VARCHAR, '7$')", "", "item_id dimension use_case"
)
def filter_items(spark, sf):
    return ratings.filter_items(T.aligned(spark, sf).withColumn("item_id", F.col("item_id").cast("string")), ["1-URGENT", "5-LOW"], "7$").select(F.col("item_id").cast("long"), "dimension", "use_case")
