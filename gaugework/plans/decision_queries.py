"""Queries over classes, samples and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.operators import calibration, fitting, rewriting, sampling, splits
from gaugework.operators import classification as C
from gaugework.plans import tables as T
from gaugework.plans.registry import query
from gaugework.workers import scratch

W = T.with_views
_P = "CASE WHEN prediction IN ('no', 'partial', 'yes') THEN prediction ELSE 'invalid' END"


def _ord(c: str) -> str:
    return f"CASE {c} WHEN 'no' THEN 0.0 WHEN 'partial' THEN 0.5 WHEN 'yes' THEN 1.0 END"


@query(W("classes") + f"SELECT editor, target, {_P} AS prediction, count(*) AS n FROM classes GROUP BY 1, 2, 3", "", "editor target prediction n")
def confusion(spark, sf):
    return C.confusion(T.classes(spark, sf), ["editor"])


def _metrics(by: str, zero: bool) -> str:
    labels = ("no", "partial", "yes")
    g = f"{by}, " if by else ""
    counts = ", ".join(
        f"count_if(target = '{x}' AND p = '{x}') AS tp_{x}, count_if(target = '{x}') AS t_{x}, count_if(p = '{x}') AS p_{x}" for x in labels
    )
    rates = ", ".join(f"tp_{x} / nullif(t_{x}, 0) AS recall_{x}, tp_{x} / nullif(p_{x}, 0) AS precision_{x}" for x in labels)
    f1 = ", ".join(f"CASE WHEN recall_{x} + precision_{x} > 0 THEN 2 * recall_{x} * precision_{x} / (recall_{x} + precision_{x}) WHEN recall_{x} + precision_{x} = 0 THEN 0.0 END AS f1_{x}" for x in labels)
    macro = " + ".join(f"coalesce(f1_{x}, 0)" for x in labels)
    some = " + ".join(f"(f1_{x} IS NOT NULL)::INT" for x in labels)
    recalls = " + ".join(f"coalesce(recall_{x}, 0)" for x in labels)
    known = " + ".join(f"(recall_{x} IS NOT NULL)::INT" for x in labels)
    return (
        W("classes")
        + f""", z AS (SELECT *, {_P} AS p FROM classes), a AS (SELECT {g}count(*) AS n, count_if(p = 'invalid') AS n_invalid, avg((target = p)::INT) AS accuracy,
        avg(abs({_ord('target')} - {_ord('p')})) AS ordinal_mae, {counts} FROM z {'GROUP BY ' + by if by else ''}), r AS (SELECT *, {rates} FROM a), f AS (SELECT *, {f1} FROM r)
        SELECT *, ({recalls}) / nullif({known}, 0) AS balanced_accuracy, ({macro}) / {'3' if zero else f'nullif({some}, 0)'} AS macro_f1 FROM f"""
    )


_MEASURES = "accuracy balanced_accuracy macro_f1 ordinal_mae " + " ".join(f"{m}_{x}" for x in S.LABELS for m in ("recall", "precision", "f1"))


@query(_metrics("", False), _MEASURES, "n:i n_invalid:i")
def class_metrics(spark, sf):
    return C.class_metrics(T.classes(spark, sf))


@query(_metrics("editor", False), _MEASURES, "editor n:i n_invalid:i")
def class_metrics_by_editor(spark, sf):
    return C.class_metrics(T.classes(spark, sf), ["editor"])


@query(_metrics("lang", True), _MEASURES, "lang n:i n_invalid:i")
def class_metrics_zero_filled(spark, sf):
    return C.class_metrics(T.classes(spark, sf), ["lang"], undefined_f1_is_zero=True)


@query(
    W("classes") + f""", z AS (SELECT editor, 2 * ({_ord('target')}) AS t, 2 * ({_ord('prediction')}) AS p FROM classes), y AS (SELECT * FROM z WHERE t IS NOT NULL AND p IS NOT NULL),
    m AS (SELECT a.editor, avg((a.t - b.p) ** 2) AS e FROM y a JOIN y b USING (editor) GROUP BY 1), o AS (SELECT editor, avg((t - p) ** 2) AS o FROM y GROUP BY 1)
    SELECT editor, CASE WHEN e = 0 THEN CASE WHEN o = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - o / e END AS kappa FROM m JOIN o USING (editor)""",
    "kappa", "editor",
)
def label_kappa(spark, sf):
    return C.label_kappa(T.classes(spark, sf), ["editor"])


@query(
    W("classes") + """SELECT item_id, CASE WHEN prediction = other OR prediction = third THEN prediction WHEN other = third THEN other WHEN prediction IS NULL AND other = third THEN other ELSE 'partial' END AS vote
    FROM (SELECT *, CASE WHEN second_score < 30 THEN 'no' WHEN second_score < 60 THEN 'partial' ELSE 'yes' END AS third FROM classes)""",
    "", "item_id vote",
)
def consensus_vote(spark, sf):
    c = T.classes(spark, sf)
    third = S.label_by_cutpoints(F.col("second_score"), 30.0, 60.0)
    return c.select("item_id", S.majority_label(F.col("prediction"), F.col("other"), third).alias("vote"))


_DRAWS = """, z AS (SELECT *, coalesce(label, 'invalid') AS l FROM draws), a AS (SELECT item_id, {by} target, count(*) AS n, count_if(l = target) AS hits, count_if(l = 'no') AS n_no, count_if(l = 'partial') AS n_partial,
    count_if(l = 'yes') AS n_yes, count_if(l = 'invalid') AS n_invalid FROM z GROUP BY ALL)"""
_Z = "1.959963984540054"


@query(
    W("draws") + _DRAWS.format(by="")
    + f""", b AS (SELECT *, greatest(n_no, n_partial, n_yes, n_invalid) AS m, hits / n AS p FROM a)
    SELECT item_id, target, n, hits, hits >= 7 AS robust, n_no, n_partial, n_yes, n_invalid, CASE m WHEN n_no THEN 'no' WHEN n_partial THEN 'partial' WHEN n_yes THEN 'yes' ELSE 'invalid' END AS modal_label, m / n AS modal_share,
    {' + '.join(f"CASE WHEN n_{x} > 0 THEN -(n_{x} / n) * log2(n_{x} / n) ELSE 0 END" for x in ('no', 'partial', 'yes', 'invalid'))} AS entropy_bits,
    greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n)) / (1 + {_Z} * {_Z} / n)) AS wilson_low,
    least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt((p * (1 - p) + {_Z} * {_Z} / (4 * n)) / n)) / (1 + {_Z} * {_Z} / n)) AS wilson_high FROM b""",
    "modal_share entropy_bits wilson_low wilson_high", "item_id target n:i hits:i robust n_no:i n_partial:i n_yes:i n_invalid:i modal_label",
)
def repeated_draws(spark, sf):
    return C.repeated_draws(T.draws(spark, sf), ["item_id", "target"])


def _js() -> str:
    def kl(a: str, b: str) -> str:
        return " + ".join(f"CASE WHEN {a}{x} > 0 THEN {a}{x} * log2(2 * {a}{x} / ({a}{x} + {b}{x})) ELSE 0 END" for x in ("no", "partial", "yes", "invalid"))

    shares = ", ".join(f"x.n_{c} / x.n AS a_{c}, y.n_{c} / y.n AS b_{c}" for c in ("no", "partial", "yes", "invalid"))
    tv = " + ".join(f"abs(a_{c} - b_{c})" for c in ("no", "partial", "yes", "invalid"))
    return (
        W("draws") + _DRAWS.format(by="event_type,")
        + f""", s AS (SELECT item_id, y.hits - x.hits AS hit_delta, {shares} FROM a x JOIN a y USING (item_id) WHERE x.event_type = 'click' AND y.event_type = 'view')
    SELECT item_id, hit_delta, ({tv}) / 2 AS total_variation, ({kl('a_', 'b_')} + {kl('b_', 'a_')}) / 2 AS js_divergence FROM s"""
    )


@query(_js(), "total_variation js_divergence", "item_id hit_delta:i")
def draw_comparison(spark, sf):
    d = T.draws(spark, sf)
    left, right = (C.repeated_draws(d.where(F.col("event_type") == e), ["item_id", "target"]).drop("target") for e in ("click", "view"))
    return C.compare_draws(left, right, ["item_id"])


@query(
    W("draws") + """, v AS (SELECT item_id, target, list(label) AS votes FROM draws WHERE label IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT *, len(votes) AS n, [len(list_filter(votes, lambda x: x = 'no')), len(list_filter(votes, lambda x: x = 'partial')), len(list_filter(votes, lambda x: x = 'yes'))] AS c FROM v)
    SELECT target, count(*) AS n, avg(list_sum(list_transform(c, lambda k: CASE WHEN k > 0 THEN -(k / n) * log2(k / n) ELSE 0 END))) AS entropy_bits, avg(list_max(c) / n) AS modal_support,
    avg((['no', 'partial', 'yes'][list_position(c, list_max(c))] = target)::INT) AS modal_match, avg(list_sum(list_transform(c, lambda k: (k / n) ** 2))) AS expected_agreement, avg((len(list_distinct(votes)) > 1)::INT) AS disputed_rate
    FROM s GROUP BY 1""",
    "entropy_bits modal_support modal_match expected_agreement disputed_rate", "target n",
)
def label_reliability(spark, sf):
    # A user's draws stand for an item's votes, one per rater.
    return C.label_reliability(T.draws(spark, sf), ["target"])


@query(
    W("classes") + """, z AS (SELECT editor, (target IS DISTINCT FROM prediction)::INT AS w, second_score >= 40 AS a FROM classes)
    SELECT editor, count(*) AS n, count_if(a) AS n_accepted, count_if(a) / count(*) AS coverage, (count_if(a) - sum(w) FILTER (a)) / nullif(count_if(a), 0) AS accepted_accuracy,
    (sum(w) - coalesce(sum(w) FILTER (a), 0)) / nullif(sum(w), 0) AS error_capture, (count(*) - coalesce(sum(w) FILTER (a), 0)) / count(*) AS reviewed_accuracy FROM z GROUP BY 1""",
    "coverage accepted_accuracy error_capture reviewed_accuracy", "editor n n_accepted:i",
)
def selective_metrics(spark, sf):
    return C.selective(T.classes(spark, sf).withColumn("accepted", F.col("second_score") >= 40), ["editor"])


@query(
    W("classes") + """, z AS (SELECT lang, target <> other AS d, second_score < 40 AS r FROM classes), s AS (SELECT lang, count(*) AS n, count_if(d) AS nd, count_if(r) AS nr, count_if(d AND r) AS b FROM z GROUP BY 1)
    SELECT lang, n, nd AS n_disputed, nr AS n_referred, b / nullif(nr, 0) AS precision, b / nullif(nd, 0) AS recall, CASE WHEN nr > 0 AND nd > 0 THEN CASE WHEN b > 0 THEN 2 * (b / nr) * (b / nd) / (b / nr + b / nd) ELSE 0 END END AS f1 FROM s""",
    "precision recall f1", "lang n n_disputed:i n_referred:i",
)
def referral_quality(spark, sf):
    c = T.classes(spark, sf).select("lang", (F.col("target") != F.col("other")).alias("disputed"), (F.col("second_score") < 40).alias("referred"))
    return C.referral(c, ["lang"])


@query(
    W("classes") + "SELECT editor, lang, (1 - grouping(editor)) + 2 * (1 - grouping(lang)) AS level, count(*) AS n, avg((target = prediction)::INT) AS accuracy FROM classes GROUP BY GROUPING SETS ((), (editor), (lang))",
    "accuracy", "editor lang level:i n",
)
def accuracy_by_level(spark, sf):
    hit = F.avg((F.col("target") == F.col("prediction")).cast("double"))
    return C.grouping_levels(T.classes(spark, sf), ["editor", "lang"], {"n": F.count("*"), "accuracy": hit})


@query(
    W("classes") + f""", z AS (SELECT *, {_P} AS p FROM classes) SELECT CASE WHEN target = 'partial' AND p <> 'partial' THEN 'missed_partial' WHEN p = 'partial' AND target <> 'partial' THEN 'false_partial'
    WHEN target <> p THEN target || '_as_' || p WHEN target = 'partial' THEN 'correct_partial_anchor' ELSE 'correct_outer_anchor' END AS bucket, CASE WHEN target <> p AND second_score < 20 THEN 'wrong_and_unstable' WHEN target <> p THEN 'wrong' WHEN second_score < 20 THEN 'unstable' END AS reason,
    count(*) AS n FROM z GROUP BY 1, 2""",
    "", "bucket reason n",
)
def error_buckets(spark, sf):
    c, p = T.classes(spark, sf), S.known_label(F.col("prediction"))
    return c.groupBy(S.error_bucket(F.col("target"), p).alias("bucket"), S.repair_reason(F.col("target") != p, F.col("second_score") < 20).alias("reason")).agg(F.count("*").alias("n"))


@query(
    W("classes") + "SELECT item_id, CASE WHEN ordinal_score < 30 THEN 'no' WHEN ordinal_score < 60 THEN 'partial' ELSE 'yes' END AS cut_label, CASE WHEN ordinal_score < 40 THEN 'no' WHEN second_score < 70 THEN 'partial' ELSE 'yes' END AS gate_label, CASE WHEN ordinal_score / 50.5 < 0.5 THEN 'no' WHEN ordinal_score / 50.5 < 1.5 THEN 'partial' ELSE 'yes' END AS score_label FROM classes",
    "", "item_id cut_label gate_label score_label",
)
def cutpoint_labels(spark, sf):
    c = T.classes(spark, sf)
    return c.select(
        "item_id", S.label_by_cutpoints(F.col("ordinal_score"), 30.0, 60.0).alias("cut_label"), S.label_by_gates(F.col("ordinal_score"), F.col("second_score"), 40.0, 70.0).alias("gate_label"),
        S.label_of_score(F.col("ordinal_score") / 50.5).alias("score_label"),
    )


_CUTS = """, s AS (SELECT ordinal_score AS s, target FROM classes), cand AS (SELECT DISTINCT least(100.000001, s + 1e-6) AS c FROM s UNION SELECT 0.0 UNION SELECT 100.000001),
    h AS (SELECT s, target, count(*) AS c FROM s GROUP BY 1, 2), pr AS (SELECT a.c AS low, b.c AS high FROM cand a, cand b WHERE a.c < b.c),
    m AS (SELECT low, high, sum(h.c) AS n, {tp}, {pp}, {tt} FROM pr, h GROUP BY 1, 2),
    r AS (SELECT *, {rates} FROM m), f AS (SELECT *, {f1} FROM r),
    g AS (SELECT low, high, n, (t_no = 0 OR coalesce(r_no, 0) + 1e-12 >= 0.1) AND (t_partial = 0 OR coalesce(r_partial, 0) + 1e-12 >= 0.1) AND (t_yes = 0 OR coalesce(r_yes, 0) + 1e-12 >= 0.1) AS kept, (tp_no + tp_partial + tp_yes) / n AS accuracy,
      (coalesce(r_no, 0) + coalesce(r_partial, 0) + coalesce(r_yes, 0)) / ((r_no IS NOT NULL)::INT + (r_partial IS NOT NULL)::INT + (r_yes IS NOT NULL)::INT) AS balanced,
      coalesce((coalesce(f_no, 0) + coalesce(f_partial, 0) + coalesce(f_yes, 0)) / nullif((f_no IS NOT NULL)::INT + (f_partial IS NOT NULL)::INT + (f_yes IS NOT NULL)::INT, 0), 0) AS macro_f1, coalesce(f_partial, 0) AS partial_f1, -abs(low - 30) - abs(high - 60) AS nearness FROM f),
    p AS (SELECT * FROM g WHERE kept = (SELECT bool_or(kept) FROM g)), q AS (SELECT * FROM p WHERE {guard})
    SELECT low, high, n, kept, accuracy, balanced, macro_f1, partial_f1 FROM q ORDER BY {order}, balanced DESC, accuracy DESC, nearness DESC, low, high LIMIT 1"""


def _cuts(guard: str, order: str) -> str:
    inside = {"no": "s < low", "partial": "s >= low AND s < high", "yes": "s >= high"}
    return W("classes") + _CUTS.format(
        tp=", ".join(f"coalesce(sum(h.c) FILTER (target = '{x}' AND {i}), 0) AS tp_{x}" for x, i in inside.items()),
        pp=", ".join(f"coalesce(sum(h.c) FILTER ({i}), 0) AS p_{x}" for x, i in inside.items()),
        tt=", ".join(f"coalesce(sum(h.c) FILTER (target = '{x}'), 0) AS t_{x}" for x in inside),
        rates=", ".join(f"tp_{x} / nullif(t_{x}, 0) AS r_{x}, tp_{x} / nullif(p_{x}, 0) AS q_{x}" for x in inside),
        f1=", ".join(f"CASE WHEN r_{x} + q_{x} > 0 THEN 2 * r_{x} * q_{x} / (r_{x} + q_{x}) WHEN r_{x} + q_{x} = 0 THEN 0.0 END AS f_{x}" for x in inside),
        guard=guard, order=order,
    )


@query(_cuts("accuracy + 0.01 + 1e-12 >= (SELECT max(accuracy) FROM p)", "partial_f1 DESC, macro_f1 DESC"), "low high accuracy balanced macro_f1 partial_f1", "n:i kept")
def cutpoint_fit(spark, sf):
    return calibration.fit_cutpoints(T.classes(spark, sf))


@query(_cuts("TRUE", "macro_f1 DESC, partial_f1 DESC"), "low high accuracy balanced macro_f1 partial_f1", "n:i kept")
def cutpoint_fit_macro(spark, sf):
    return calibration.fit_cutpoints(T.classes(spark, sf), objective="macro")


@query(
    W("classes") + """, k AS (SELECT target, prediction, unnest([0, 1, 2]) AS level, unnest([editor || '::' || coalesce(prediction, ''), lang || '::' || coalesce(prediction, ''), coalesce(prediction, '')]) AS rule_key FROM classes),
    c AS (SELECT level, rule_key, target, count(*) AS c, count(*) FILTER (target = prediction) AS h FROM k GROUP BY 1, 2, 3),
    p AS (SELECT level, rule_key, sum(c) AS support, sum(h) AS base_hits, arg_max(target, (c, target = 'partial', target)) AS action, max(c) AS best FROM c GROUP BY 1, 2)
    SELECT level, rule_key, support, base_hits, action, best - base_hits AS gain FROM p WHERE support >= 5 AND best - base_hits >= 1""",
    "", "level:i rule_key support:i base_hits:i action gain:i",
)
def rule_mining(spark, sf):
    p = F.coalesce("prediction", F.lit(""))
    keys = [F.concat_ws("::", "editor", p), F.concat_ws("::", "lang", p), p]
    return calibration.mine_rules(T.classes(spark, sf), keys, 5, 1)


@query(
    W("classes") + """, k AS (SELECT target = prediction AS a, target = other AS b, unnest([0, 1]) AS level, unnest([editor || '::' || lang, editor]) AS rule_key FROM classes)
    SELECT level, rule_key, count(*) AS support, count_if(b AND NOT a) AS fixed, count_if(a AND NOT b) AS broken FROM k GROUP BY 1, 2 HAVING count(*) >= 2 AND count_if(b AND NOT a) >= 1 AND count_if(a AND NOT b) = 0""",
    "", "level:i rule_key support fixed:i broken:i",
)
def safe_switches(spark, sf):
    return calibration.safe_switches(T.classes(spark, sf), [F.concat_ws("::", "editor", "lang"), F.col("editor")], 2)


@query(
    W("classes") + ", c AS (SELECT editor, target, count(*) AS c FROM classes GROUP BY 1, 2) SELECT editor, arg_max(target, (c, target)) AS label, sum(c) AS support, max(c) / sum(c) AS share FROM c GROUP BY 1 HAVING max(c) / sum(c) >= 0.4 AND sum(c) >= 5",
    "share", "editor label support:i",
)
def editor_prior(spark, sf):
    return calibration.group_priors(T.classes(spark, sf), "editor", 0.4, 5)


@query(
    W("classes") + "SELECT editor, prediction, grouping(editor, prediction) AS level, count(*) AS support, count(*) FILTER (target = other) - count(*) FILTER (target = prediction) AS gain FROM classes GROUP BY GROUPING SETS ((), (prediction), (editor, prediction)) HAVING count(*) >= 3 AND count(*) FILTER (target = other) - count(*) FILTER (target = prediction) >= 1",
    "", "editor prediction level:i support gain:i",
)
def switch_gains(spark, sf):
    return calibration.switch_gains(T.classes(spark, sf), ["editor", "prediction"], 3, 1)


@query(
    W("classes") + """, t AS (SELECT target <> other AS d, r.rule, k.k, CASE r.rule WHEN 'agree' THEN coalesce(prediction = other, FALSE) ELSE second_score >= 30 END AND ordinal_score >= k.k AS keep FROM classes, (VALUES ('agree'), ('second')) r(rule), (VALUES (0), (20), (40)) k(k)),
    s AS (SELECT rule, k AS least_support, avg(keep::INT) AS coverage, count_if(NOT keep) AS r, count_if(d) AS nd, count_if(d AND NOT keep) AS b FROM t GROUP BY 1, 2)
    SELECT rule, least_support, coverage, CASE WHEN r + nd > 0 THEN 2 * b / (r + nd) ELSE 0 END AS f1 FROM s WHERE coverage >= 0.2 ORDER BY f1 DESC, coverage DESC, least_support, rule LIMIT 1""",
    "coverage f1", "rule least_support:i",
)
def referral_fit(spark, sf):
    c = T.classes(spark, sf).withColumn("disputed", F.col("target") != F.col("other"))
    rules = {"agree": F.coalesce(F.col("prediction") == F.col("other"), F.lit(False)), "second": F.col("second_score") >= 30}
    return calibration.fit_referral(c, rules, [0, 20, 40], "ordinal_score", 0.2)


@query("SELECT c_custkey AS item_id FROM (SELECT c_custkey, row_number() OVER (PARTITION BY 1 ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i IN (SELECT (r.i * n) // k FROM range(0, (SELECT greatest(1, round_even(count(*) * 0.13::DOUBLE, 0))::BIGINT FROM customer)) r(i), (SELECT count(*) AS n, greatest(1, round_even(count(*) * 0.13::DOUBLE, 0))::BIGINT AS k FROM customer))", "", "item_id")
def evenly_spaced(spark, sf):
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("all").alias("g"))
    return sampling.stratified(c, "g", "item_id", 0.13).select("item_id")


_QUOTA = """, z AS (SELECT g, count(*) AS n FROM src GROUP BY 1), y AS (SELECT *, sum(n) OVER () AS a, {total} AS t FROM z), x AS (SELECT *, floor(t * n / a) AS b, t * n / a - floor(t * n / a) AS f FROM y),
    w AS (SELECT *, row_number() OVER (ORDER BY f DESC, g) AS r, t - sum(b) OVER () AS l FROM x), q AS (SELECT g, n, least(n, b + (r <= l)::INT)::BIGINT AS quota FROM w),
    p AS (SELECT src.*, row_number() OVER (PARTITION BY g ORDER BY item_id) - 1 AS i FROM src)
    SELECT g, item_id FROM p JOIN q USING (g) WHERE i IN (SELECT (k.k * q.n) // q.quota FROM range(0, q.quota) k(k))"""


@query("WITH src AS (SELECT c_mktsegment AS g, c_custkey AS item_id FROM customer)" + _QUOTA.format(total="greatest(1, round_even(sum(n) OVER () * 0.07::DOUBLE, 0))"), "", "g item_id")
def stratified_sample(spark, sf):
    c = T.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("item_id"))
    return sampling.stratified(c, "g", "item_id", 0.07)


@query(
    """WITH s AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT g, n, unnest(range(0, n)) AS j FROM s), o AS (SELECT g, row_number() OVER (ORDER BY j, g) AS r FROM u), q AS (SELECT g, count(*) AS quota FROM o WHERE r <= 731 GROUP BY 1),
    p AS (SELECT c_nationkey AS g, c_custkey AS item_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT g, item_id FROM p JOIN q USING (g) WHERE i IN (SELECT (k.k * n) // quota FROM range(0, quota) k(k))""",
    "", "g:i item_id",
)
def balanced_sample(spark, sf):
    c = T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("item_id"))
    return sampling.balanced(c, "g", "item_id", 731)


@query(
    """WITH g AS (SELECT DISTINCT o_orderstatus AS split, o_custkey AS task FROM orders), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY split ORDER BY task) - 1 AS i FROM g WINDOW w AS (PARTITION BY split)),
    k AS (SELECT *, (i - CASE split WHEN 'O' THEN 5 ELSE 0 END + n) % n AS j, greatest(1, round_even(n * CASE split WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.2::DOUBLE ELSE 0.5 END, 0))::BIGINT AS k FROM n),
    c AS (SELECT split, task FROM k WHERE j IN (SELECT (t.t * n) // k FROM range(0, k) t(t))) SELECT o_orderkey AS item_id, o_orderstatus AS split FROM orders JOIN c ON o_orderstatus = split AND o_custkey = task""",
    "", "item_id split",
)
def grouped_split_sample(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("task"))
    return sampling.split_groups(o, "split", "task", {"F": 1.0, "O": 0.2}, 0.5, {"O": 5}).select("item_id", "split")


@query("SELECT o_orderkey AS item_id, CASE WHEN row_number() OVER (ORDER BY sha256(CAST('7:' || o_orderkey AS VARCHAR)), o_orderkey) <= greatest(1, round_even(0.2::DOUBLE * count(*) OVER (), 0)) THEN 'validation' ELSE 'training' END AS part FROM orders", "", "item_id part")
def stable_holdout(spark, sf):
    return sampling.holdout(T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")), "item_id", 0.2, 7)


@query("SELECT g, item_id, turn FROM (SELECT o_orderpriority AS g, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, g LIMIT 333", "", "g item_id turn:i")
def round_robin_subset(spark, sf):
    return sampling.round_robin(T.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("item_id")), "g", "item_id", 333)


@query(
    "SELECT item_id, CASE WHEN i <= ceil(n * 0.1::DOUBLE) THEN 'development' WHEN i <= ceil(n * 0.5::DOUBLE) THEN 'confirmation' ELSE 'final' END AS part FROM (SELECT o_orderkey AS item_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('44:' || o_orderkey), o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)",
    "", "item_id part",
)
def nested_partitions(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("g"))
    return sampling.nested_shares(o, "g", "item_id", [("development", 0.1), ("confirmation", 0.5)], 44).select("item_id", "part")


# A method's t-th turn goes to the label at place t mod (number of labels with rows left): played turn by turn.
@query(
    W("classes").replace("WITH ", "WITH RECURSIVE ", 1) + """, ranked AS (SELECT editor, target, item_id, row_number() OVER (PARTITION BY editor, target ORDER BY sha256('44::' || item_id), item_id) - 1 AS i FROM classes),
    n AS (SELECT editor, count(*) FILTER (target = 'no') AS a, count(*) FILTER (target = 'partial') AS b, count(*) FILTER (target = 'yes') AS c FROM ranked GROUP BY 1),
    w AS (SELECT editor, 0 AS t, a, b, c, 0 AS ua, 0 AS ub, 0 AS uc, '' AS label, 0 AS i FROM n UNION ALL
      SELECT editor, t + 1, a, b, c, ua + (l = 'no')::INT, ub + (l = 'partial')::INT, uc + (l = 'yes')::INT, l, CASE l WHEN 'no' THEN ua WHEN 'partial' THEN ub ELSE uc END
      FROM (SELECT *, list_filter(['no', 'partial', 'yes'], lambda x: CASE x WHEN 'no' THEN ua < a WHEN 'partial' THEN ub < b ELSE uc < c END) AS live, live[1 + t % len(live)] AS l FROM w WHERE ua + ub + uc < a + b + c))
    SELECT editor, target, item_id, t - 1 AS turn FROM w JOIN ranked r USING (editor, i) WHERE t > 0 AND label = target ORDER BY turn, editor LIMIT (SELECT count(*) // 2 FROM classes)""",
    "", "editor target item_id turn",
)
def alternating_pilot(spark, sf):
    c = T.classes(spark, sf).select("editor", "target", "item_id")
    return sampling.alternate(c, "editor", "target", "item_id", c.count() // 2, 44).drop("position")


@query(
    W("classes") + "SELECT * FROM (SELECT target, item_id, (target <> coalesce(prediction, ''))::INT AS tier, row_number() OVER (PARTITION BY target ORDER BY (target <> coalesce(prediction, '')), second_score DESC, ordinal_score DESC, item_id) AS rank, count(*) OVER (PARTITION BY target) < 4 AS short FROM classes) WHERE rank <= 4",
    "", "target item_id tier:i rank:i short",
)
def topk_anchors(spark, sf):
    tier = (F.col("target") != F.coalesce("prediction", F.lit(""))).cast("int")
    out = sampling.tiered_top(T.classes(spark, sf), ["target"], tier, [F.desc("second_score"), F.desc("ordinal_score"), F.col("item_id")], 4)
    return out.select("target", "item_id", "tier", "rank", "short")


@query(
    W("classes") + f""", z AS (SELECT item_id, task_uid, target || '/' || {_P} AS bucket FROM classes), t AS (SELECT *, row_number() OVER (PARTITION BY bucket, task_uid ORDER BY item_id) AS turn FROM z),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY turn, item_id) AS rank FROM t WHERE turn <= 6) SELECT bucket, item_id, rank FROM r WHERE rank <= 6""",
    "", "bucket item_id rank:i",
)
def boundary_cases(spark, sf):
    z = T.classes(spark, sf).select("item_id", "task_uid", F.concat_ws("/", "target", S.known_label(F.col("prediction"))).alias("bucket"))
    return sampling.boundary_cases(z, "bucket", "task_uid", "item_id", 6).select("bucket", "item_id", "rank")


_UNITS = """, x AS (SELECT user_id, event_id AS unit_id, sec AS start_seconds, duration AS a, row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, event_id) AS xr, count(*) OVER (PARTITION BY user_id) AS n FROM timeline),
    r AS (SELECT *, xr <= 4 AS e, row_number() OVER (PARTITION BY user_id, xr <= 4 ORDER BY start_seconds, unit_id) - 1 AS i FROM x),
    s AS (SELECT user_id, n, k.k AS k FROM (SELECT DISTINCT user_id, n FROM x WHERE n > 12), range(0, 8) k(k)), h AS (SELECT DISTINCT user_id, least(n - 4 - 1, floor((k + 0.5) * ((n - 4) / 8.0)))::BIGINT AS i FROM s)
    SELECT r.user_id, r.unit_id, (n <= 12 OR e OR h.i IS NOT NULL) AS selected FROM r LEFT JOIN h ON r.user_id = h.user_id AND r.i = h.i AND NOT r.e"""


@query(W("timeline") + _UNITS, "", "user_id unit_id selected")
def unit_selection(spark, sf):
    t = T.timeline(spark, sf).select("user_id", F.col("event_id").alias("unit_id"), F.col("sec").alias("start_seconds"), "duration")
    return sampling.select_units(t, ["user_id"], 12, F.col("duration")).select("user_id", "unit_id", "selected")


@query(W("classes") + "SELECT c.item_id FROM classes c WHERE task_uid NOT IN (SELECT task_uid FROM classes WHERE ordinal_score < 10)", "", "item_id")
def clean_holdout(spark, sf):
    c = T.classes(spark, sf)
    return c.join(c.where("ordinal_score < 10").select("task_uid").distinct(), "task_uid", "left_anti").select("item_id")


@query(
    W("aligned") + """, z AS (SELECT dimension, human AS y, judge_raw AS a, (item_id % 7)::DOUBLE AS b FROM aligned WHERE human IS NOT NULL AND judge_raw IS NOT NULL),
    m AS (SELECT dimension, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, CASE WHEN stddev_pop(a) < 1e-12 THEN 1 ELSE stddev_pop(a) END AS sa, CASE WHEN stddev_pop(b) < 1e-12 THEN 1 ELSE stddev_pop(b) END AS sb,
      var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM z GROUP BY 1),
    g AS (SELECT *, n * va / (sa * sa) + 1 AS p, n * cab / (sa * sb) AS q, n * vb / (sb * sb) + 1 AS r, n * cay / sa AS u, n * cby / sb AS v FROM m),
    s AS (SELECT *, (r * u - q * v) / (p * r - q * q) / sa AS c_judge, (p * v - q * u) / (p * r - q * q) / sb AS c_late FROM g) SELECT dimension, n, my - ma * c_judge - mb * c_late AS intercept, c_judge, c_late FROM s""",
    "intercept c_judge c_late", "dimension n",
)
def ridge_fit(spark, sf):
    z = T.aligned(spark, sf).withColumn("late", (F.col("item_id") % 7).cast("double"))
    return fitting.ridge(z, ["dimension"], ["judge_raw", "late"], "human").select("dimension", "n", "intercept", F.col("coefficients")[0].alias("c_judge"), F.col("coefficients")[1].alias("c_late"))


@query()
def l1_tree_fit(spark, sf):
    z = T.ratings(spark, sf).join(T.judges(spark, sf), "item_id").withColumn("late", (F.col("item_id") % 7).cast("double"))
    return fitting.l1_tree(z, ["dimension"], ["judge_raw", "late"], "score")


@query()
def bootstrap_interval(spark, sf):
    z = T.classes(spark, sf).withColumn("hit", (F.col("target") == F.coalesce("prediction", F.lit(""))).cast("double"))
    return fitting.bootstrap_mean(z, ["lang"], "task_uid", "hit", draws=1000)


@query()
def grouped_folds(spark, sf):
    return fitting.grouped_folds(T.classes(spark, sf), "task_uid")


@query(
    """WITH f AS (SELECT p_partkey AS item_id, p_size::DOUBLE AS a, p_retailprice AS b, p_partkey % 3 <> 0 AS t FROM part), s AS (SELECT avg(a) FILTER (t) AS ma, stddev_pop(a) FILTER (t) AS sa, avg(b) FILTER (t) AS mb, stddev_pop(b) FILTER (t) AS sb FROM f),
    d AS (SELECT item_id, sqrt(((a - ma) / sa) ** 2 + ((b - mb) / sb) ** 2) AS distance FROM f, s) SELECT item_id, distance, (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) AS novelty FROM d""",
    "distance novelty", "item_id",
)
def novelty(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return fitting.novelty(p, "item_id", ["a", "b"], F.col("item_id") % 3 != 0)


@query(
    W("classes") + """, s AS (SELECT ordinal_score AS p, second_score AS c, target FROM classes), h AS (SELECT p, c, target, count(*) AS n FROM s GROUP BY ALL),
    pc AS (SELECT DISTINCT least(100.000001, p + 1e-6) AS gp FROM s UNION SELECT 0.0 UNION SELECT 100.000001), cc AS (SELECT DISTINCT least(100.000001, c + 1e-6) AS gc FROM s UNION SELECT 0.0 UNION SELECT 100.000001),
    l AS (SELECT gp, gc, target, CASE WHEN p < gp THEN 'no' WHEN c < gc THEN 'partial' ELSE 'yes' END AS y, sum(n) AS n FROM pc, cc, h GROUP BY ALL),
    m AS (SELECT gp, gc, sum(n) AS n, coalesce(sum(n) FILTER (target = y), 0) / sum(n) AS accuracy, """
    + ", ".join(f"sum(n) FILTER (target = '{x}' AND y = '{x}') AS tp_{x}, sum(n) FILTER (target = '{x}') AS t_{x}, sum(n) FILTER (y = '{x}') AS p_{x}" for x in S.LABELS)
    + " FROM l GROUP BY 1, 2), f AS (SELECT *, " + ", ".join(f"CASE WHEN t_{x} > 0 AND p_{x} > 0 THEN 2 * coalesce(tp_{x}, 0) / (t_{x} + p_{x}) END AS f_{x}" for x in S.LABELS)
    + """ FROM m) SELECT gp AS presence_cut, gc AS completeness_cut, """ + " AND ".join(f"(t_{x} IS NULL OR coalesce(tp_{x}, 0) / t_{x} + 1e-12 >= 0.1)" for x in S.LABELS)
    + """ AS kept, (coalesce(f_no, 0) + coalesce(f_partial, 0) + coalesce(f_yes, 0)) / ((f_no IS NOT NULL)::INT + (f_partial IS NOT NULL)::INT + (f_yes IS NOT NULL)::INT) AS macro_f1, coalesce(f_partial, 0) AS partial_f1, accuracy FROM f
    ORDER BY kept DESC, round(macro_f1, 12) DESC, round(partial_f1, 12) DESC, round(accuracy, 12) DESC, -abs(gp - 50) - abs(gc - 90) DESC, gp, gc LIMIT 1""",
    "presence_cut completeness_cut macro_f1 partial_f1 accuracy", "kept",
)
def gate_fit(spark, sf):
    return calibration.fit_gates(T.classes(spark, sf), "ordinal_score", "second_score")


@query()
def cutpoint_cross_validation(spark, sf):
    c = T.classes(spark, sf)
    return calibration.cross_validated_cutpoints(c, fitting.grouped_folds(c, "task_uid", 3), "task_uid", 3).select("item_id", "fold", "calibrated")


_FOLD_CUTS = " UNION ALL ".join(
    f"SELECT {f} AS fold, low, high FROM ({_cuts('accuracy + 0.01 + 1e-12 >= (SELECT max(accuracy) FROM p)', 'partial_f1 DESC, macro_f1 DESC').replace('target FROM classes)', f'target FROM classes WHERE task_uid % 3 <> {f})')})" for f in range(3)
)


@query(W("classes") + f", b AS ({_FOLD_CUTS}) SELECT item_id, fold, CASE WHEN ordinal_score < low THEN 'no' WHEN ordinal_score < high THEN 'partial' ELSE 'yes' END AS calibrated FROM classes JOIN b ON task_uid % 3 = fold", "", "item_id fold:i calibrated")
def cutpoint_folds(spark, sf):
    c = T.classes(spark, sf)
    folds = c.select("task_uid", (F.col("task_uid") % 3).alias("fold")).distinct()
    return calibration.cross_validated_cutpoints(c, folds, "task_uid", 3).select("item_id", "fold", "calibrated")


@query()
def bootstrap_spearman(spark, sf):
    from gaugework.operators import agreement

    return fitting.bootstrap_metric(T.aligned(spark, sf), ["dimension"], "item_id", agreement.spearman, draws=1000)


_LINES = """, z AS (SELECT rubric_id, score::DOUBLE AS x, duration_seconds::DOUBLE AS y FROM units WHERE valid AND score IS NOT NULL AND duration_seconds IS NOT NULL),
    m AS (SELECT rubric_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS sxx, count(*) * covar_pop(x, y) AS sxy, count(*) * var_pop(y) AS syy, var_pop(y) AS vy FROM z GROUP BY 1),
    it AS (SELECT rubric_id, 0 AS step, 1 / (vy + 1e-10) AS noise, 1.0::DOUBLE AS prior, 0.0::DOUBLE AS slope, 1e9::DOUBLE AS moved FROM m UNION ALL
      SELECT rubric_id, step + 1, (n - used + 2e-6) / (greatest(0, syy - 2 * new * sxy + new * new * sxx) + 2e-6), (used + 2e-6) / (new * new + 2e-6), new, abs(new - slope) FROM
      (SELECT it.*, m.*, noise * sxy / (prior + noise * sxx) AS new, noise * sxx / (prior + noise * sxx) AS used FROM it JOIN m USING (rubric_id) WHERE step < 300 AND moved >= 1e-3)),
    l AS (SELECT rubric_id, n, my - slope * mx AS intercept, slope, noise ** -0.5 AS noise_std, mx AS mean_x, (prior + noise * sxx) ** -0.5 AS slope_std FROM it JOIN m USING (rubric_id) QUALIFY step = max(step) OVER (PARTITION BY rubric_id))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(W("units") + _LINES + "SELECT * FROM l"), "intercept slope noise_std mean_x slope_std", "rubric_id n")
def unit_lines(spark, sf):
    z = T.units(spark, sf).where("valid")
    return fitting.bayesian_line(z, ["rubric_id"], "score", "duration_seconds")


@query(W("classes") + "SELECT item_id, 1.0 / count(*) OVER (PARTITION BY task_uid) AS weight, (lang = 'en')::INT::DOUBLE AS is_en, (lang = 'de')::INT::DOUBLE AS is_de FROM classes", "weight is_en is_de", "item_id")
def observation_weights(spark, sf):
    return calibration.one_hot(calibration.observation_weights(T.classes(spark, sf), "task_uid"), "lang", ["en", "de"], "is_").select("item_id", "weight", "is_en", "is_de")


@query(
    _recursive(W("units") + _LINES + """SELECT item_id, rubric_id, unit_id, CASE WHEN ok THEN greatest(1, least(5, intercept + slope * score)) ELSE score END AS score, CASE WHEN ok THEN score END AS raw_score, CASE WHEN ok THEN sqrt(noise_std ** 2 + ((score - mean_x) * slope_std) ** 2) END AS calibration_std
    FROM (SELECT u.*, l.* EXCLUDE (rubric_id), valid AND score IS NOT NULL AND slope IS NOT NULL AS ok FROM units u LEFT JOIN l USING (rubric_id))"""),
    "score raw_score calibration_std", "item_id rubric_id unit_id:i",
)
def calibrated_units(spark, sf):
    units = T.units(spark, sf)
    lines = fitting.bayesian_line(units.where("valid"), ["rubric_id"], "score", "duration_seconds")
    return calibration.calibrated_units(units, lines, ["rubric_id"]).select("item_id", "rubric_id", "unit_id", "score", "raw_score", "calibration_std")


@query(
    W("aligned") + """, z AS (SELECT *, item_id % 5 AS fold FROM aligned WHERE human IS NOT NULL AND judge_raw IS NOT NULL), o AS (SELECT dimension, f.fold, count(*)::DOUBLE AS n, sum(judge_raw) AS sx, sum(human) AS sy, sum(judge_raw ** 2) AS sxx, sum(judge_raw * human) AS sxy FROM z JOIN (SELECT DISTINCT dimension, fold FROM z) f USING (dimension) WHERE z.fold <> f.fold GROUP BY 1, 2),
    l AS (SELECT *, CASE WHEN n * sxx - sx * sx > 1e-9 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 1 END AS slope, (sy - sx) / n AS b FROM o),
    p AS (SELECT dimension, item_id, human, judge_raw AS base, judge_raw + b AS bias, (sy - slope * sx) / n + slope * judge_raw AS score_linear FROM z JOIN l USING (dimension, fold)), e AS (SELECT dimension, item_id, unnest(['base', 'bias', 'score_linear']) AS predictor, unnest([abs(base - human), abs(bias - human), abs(score_linear - human)]) AS e FROM p)
    SELECT dimension, predictor, count(*) AS n_items, avg(e) AS mae FROM e GROUP BY 1, 2""",
    "mae", "dimension predictor n_items",
)
def out_of_fold_comparators(spark, sf):
    z = T.aligned(spark, sf).withColumn("fold", F.col("item_id") % 5)
    p = calibration.comparators_out_of_fold(z, ["dimension"], "fold")
    long = p.unpivot(["dimension", "item_id", "human"], ["base", "bias", "score_linear"], "predictor", "value")
    items = long.groupBy("dimension", "predictor", "item_id").agg(F.avg(F.abs(F.col("value") - F.col("human"))).alias("e"))
    return items.groupBy("dimension", "predictor").agg(F.count("*").alias("n_items"), F.avg("e").alias("mae"))


_GATES = (
    W("classes") + """, s AS (SELECT item_id, task_uid % 3 AS fold, ordinal_score AS p, second_score AS c, target FROM classes), fs AS (SELECT DISTINCT fold AS f FROM s), t AS (SELECT f, p, c, target FROM s JOIN fs ON fold <> f), h AS (SELECT f, p, c, target, count(*) AS n FROM t GROUP BY ALL),
    pc AS (SELECT DISTINCT f, least(100.000001, p + 1e-6) AS gp FROM t UNION SELECT f, 0.0 FROM fs UNION SELECT f, 100.000001 FROM fs), cc AS (SELECT DISTINCT f, least(100.000001, c + 1e-6) AS gc FROM t UNION SELECT f, 0.0 FROM fs UNION SELECT f, 100.000001 FROM fs),
    l AS (SELECT f, gp, gc, target, CASE WHEN p < gp THEN 'no' WHEN c < gc THEN 'partial' ELSE 'yes' END AS y, sum(n) AS n FROM pc JOIN cc USING (f) JOIN h USING (f) GROUP BY ALL),
    m AS (SELECT f, gp, gc, sum(n) AS n, coalesce(sum(n) FILTER (target = y), 0) / sum(n) AS accuracy, """
    + ", ".join(f"sum(n) FILTER (target = '{x}' AND y = '{x}') AS tp_{x}, sum(n) FILTER (target = '{x}') AS t_{x}, sum(n) FILTER (y = '{x}') AS p_{x}" for x in S.LABELS)
    + " FROM l GROUP BY 1, 2, 3), g AS (SELECT *, " + ", ".join(f"CASE WHEN t_{x} > 0 AND p_{x} > 0 THEN 2 * coalesce(tp_{x}, 0) / (t_{x} + p_{x}) END AS f_{x}" for x in S.LABELS) + ", "
    + " AND ".join(f"(t_{x} IS NULL OR coalesce(tp_{x}, 0) / t_{x} + 1e-12 >= 0.1)" for x in S.LABELS)
    + """ AS kept FROM m), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY f ORDER BY kept DESC, round((coalesce(f_no, 0) + coalesce(f_partial, 0) + coalesce(f_yes, 0)) / ((f_no IS NOT NULL)::INT + (f_partial IS NOT NULL)::INT + (f_yes IS NOT NULL)::INT), 12) DESC,
      round(coalesce(f_partial, 0), 12) DESC, round(accuracy, 12) DESC, -abs(gp - 50) - abs(gc - 90) DESC, gp, gc) = 1)
    SELECT item_id, fold, CASE WHEN p < gp THEN 'no' WHEN c < gc THEN 'partial' ELSE 'yes' END AS calibrated FROM s JOIN b ON fold = f"""
)


@query(_GATES, "", "item_id fold:i calibrated")
def gate_cross_validation(spark, sf):
    c = T.classes(spark, sf).withColumn("fold", F.col("task_uid") % 3)
    return calibration.cross_validated_gates(c, 3, "ordinal_score", "second_score").select("item_id", "fold", "calibrated")


@query("SELECT task, CASE WHEN row_number() OVER (ORDER BY sha256('44:' || task), task) <= 40 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT c_custkey AS task FROM customer)", "", "task split")
def task_manifest(spark, sf):
    return splits.task_manifest(T.read(spark, sf, "customer").select(F.col("c_custkey").alias("task")), "task", 40, 44)


@query()
def validation_groups(spark, sf):
    return splits.validation_groups(T.classes(spark, sf), "task_uid", 0.2, 44)


def _cases(spark, sf):
    return T.classes(spark, sf).select("item_id", "target", "task_uid", F.col("lang").alias("model"), F.col("editor").alias("category"))


@query()
def unique_task_sample(spark, sf):
    return splits.one_case_per_task(_cases(spark, sf), {"yes": 4, "partial": 5, "no": 4}, 44)


@query()
def unique_task_turns(spark, sf):
    return splits.one_case_per_task(_cases(spark, sf), {"no": 4, "partial": 4, "yes": 4}, 44, turns=True)


@query()
def paired_difference(spark, sf):
    hit = lambda c: (F.col("target") == F.coalesce(c, F.lit(""))).cast("double")
    z = T.classes(spark, sf).withColumns({"a": hit("prediction"), "b": hit("other")})
    return fitting.paired_bootstrap(z, ["lang"], "task_uid", "a", "b", draws=1000)


@query()
def prompt_trees(spark, sf):
    z = T.ratings(spark, sf).join(T.judges(spark, sf), "item_id").withColumn("late", (F.col("item_id") % 7).cast("double"))
    return fitting.l1_tree(z, ["use_case"], ["judge_raw", "late"], "score")


@query()
def tree_grid(spark, sf):
    z = T.ratings(spark, sf).join(T.judges(spark, sf), "item_id").withColumns({"late": (F.col("item_id") % 7).cast("double"), "fold": F.col("item_id") % 4})
    return fitting.tree_grid(z, "fold", {"judge": ["judge_raw"], "both": ["judge_raw", "late"]}, [1, 2], [2.0, 8.0], "score")


@query()
def rewrite_search(spark, sf):
    """Prompts are two cut points; the rewriter widens what lies between them while it is shown missed cases."""

    def judge(rows, prompt):
        low, high = map(float, prompt.split())
        return rows.select("item_id", S.label_by_cutpoints(F.col("ordinal_score"), low, high).alias("prediction"))

    def rewrite(prompt, shown):
        low, high = map(float, prompt.split())
        missed = sum(r["bucket"].startswith("partial/") for r in shown) > sum(r["bucket"] == "partial/partial" for r in shown)
        return f"{low - 4} {high + 4}" if missed else f"{low + 1} {high - 1}"

    c = T.classes(spark, sf).select("item_id", "target", "task_uid", "ordinal_score", F.when(F.col("task_uid") % 4 == 0, "validation").otherwise("fit").alias("split"))
    trials, _ = rewriting.rewrite_search(c, "40.0 80.0", judge, rewrite, scratch(spark, "rewrites"))
    return trials
