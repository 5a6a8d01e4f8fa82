"""Queries over verdicts, evidence, prompt trees, residual leaves and guarded selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions import text as X
from gaugework.operators import judging, policies
from gaugework.plans import tables as T
from gaugework.plans.registry import query
from gaugework.sources import notes

W = T.with_views
_THIRD = "CASE WHEN second_score < 30 THEN 'no' WHEN second_score < 60 THEN 'partial' ELSE 'yes' END"
_SCORE = "CASE label WHEN 'no' THEN 0 WHEN 'partial' THEN 1 WHEN 'yes' THEN 2 END"


def _leaves(spark, sf):
    """Three leaves an item: one for each candidate label, or, by role, core, modifier and preservation."""
    c = T.classes(spark, sf).withColumn("third", S.label_by_cutpoints(F.col("second_score"), 30.0, 60.0))
    said = F.array(*(F.struct(F.lit(x).alias("candidate"), F.lit(role).alias("role"), F.col(v).alias("label"), (F.col("ordinal_score") != 7).alias("valid")) for x, role, v in (("no", "core", "prediction"), ("partial", "modifier", "other"), ("yes", "preservation", "third"))))
    return c.select("item_id", F.explode(said).alias("x")).select("item_id", "x.*")


_LEAVES = f""", leaves AS (SELECT item_id, unnest(['no', 'partial', 'yes']) AS candidate, unnest(['core', 'modifier', 'preservation']) AS role, unnest([prediction, other, {_THIRD}]) AS label, ordinal_score <> 7 AS valid FROM classes)"""


@query(
    W("classes") + _LEAVES + f""", s AS (SELECT item_id, bool_and(valid AND label IS NOT NULL) AS valid, list({_SCORE} ORDER BY candidate) AS v FROM leaves GROUP BY 1)
    SELECT item_id, valid, CASE WHEN valid THEN CASE WHEN len(list_filter(v, lambda x: x = list_max(v))) > 1 THEN 'partial' ELSE ['no', 'partial', 'yes'][list_position(v, list_max(v))] END END AS label FROM s""",
    "", "item_id label valid",
)
def label_support(spark, sf):
    return policies.label_support(_leaves(spark, sf), ["item_id"])


@query(
    W("classes") + _LEAVES + """SELECT item_id, bool_and(valid AND label IS NOT NULL) AS valid, CASE WHEN bool_and(valid AND label IS NOT NULL) THEN CASE WHEN bool_or(role <> 'modifier' AND label = 'no') THEN 'no' WHEN bool_or(label <> 'yes') THEN 'partial' ELSE 'yes' END END AS label FROM leaves GROUP BY 1""",
    "", "item_id label valid",
)
def tree_verdict(spark, sf):
    return policies.tree_verdict(_leaves(spark, sf), ["item_id"])


@query(
    W("classes") + "SELECT item_id, CASE WHEN prediction IS NOT NULL AND ordinal_score <> 7 THEN CASE WHEN prediction = 'no' OR (lang = 'en' AND other = 'no') THEN 'no' WHEN prediction = 'yes' AND other = 'yes' THEN 'yes' ELSE 'partial' END END AS label FROM classes", "", "item_id label"
)
def requirement_labels(spark, sf):
    kind = F.when(F.col("lang") == "en", "outcome").otherwise("state")
    return T.classes(spark, sf).select("item_id", policies.requirement_label(F.col("prediction"), F.col("other"), kind, F.col("ordinal_score") != 7).alias("label"))


def _referral(rule: str) -> str:
    refer = {"disagreement": "a", "routing": "b OR c"}.get(rule, "a OR b OR c")
    return W("classes") + f""", z AS (SELECT item_id, coalesce(prediction <> other AND other <> {_THIRD} AND prediction <> {_THIRD}, FALSE) AS a, ordinal_score / 100 < CASE WHEN second_score < 5 THEN 0.7 ELSE second_score / 200 END AS b, length(editor) + ordinal_score % 3 < 6 AS c FROM classes)
    SELECT item_id, {refer} AS refer, CASE WHEN {refer} THEN 'evidence_referral:' || concat_ws(',', CASE WHEN a THEN 'total_disagreement' END, CASE WHEN b THEN 'low_route_similarity' END, CASE WHEN c THEN 'unsupported_route' END) ELSE 'evidence_accepted' END AS reason FROM z"""


def _refer(spark, sf, rule: str):
    c, third = T.classes(spark, sf), S.label_by_cutpoints(F.col("second_score"), 30.0, 60.0)
    tie = (F.col("prediction") != F.col("other")) & (F.col("other") != third) & (F.col("prediction") != third)
    threshold = F.when(F.col("second_score") >= 5, F.col("second_score") / 200)
    signals = policies.evidence_signals(tie, F.col("ordinal_score") / 100, threshold, F.char_length("editor") + F.col("ordinal_score") % 3, 6)
    refer, reason = policies.evidence_referral(signals, rule)
    return c.select("item_id", refer.alias("refer"), reason.alias("reason"))


@query(_referral("disagreement_or_routing"), "", "item_id refer reason")
def evidence_referral(spark, sf):
    return _refer(spark, sf, "disagreement_or_routing")


@query(_referral("routing"), "", "item_id refer reason")
def evidence_referral_routing(spark, sf):
    return _refer(spark, sf, "routing")


@query(
    "SELECT p_brand AS brand, count(*) AS n_routed, avg(greatest(p_size % 4 - 1, 0)) AS mean_route_depth, avg((p_size % 4 <= 1)::INT) AS fallback_to_root_rate FROM part WHERE p_size % 4 > 0 OR p_size % 3 = 0 GROUP BY 1",
    "mean_route_depth fallback_to_root_rate", "brand n_routed",
)
def route_metrics(spark, sf):
    size = F.col("p_size") % 4
    path = F.when(size > 0, F.expr("slice(array('a', 'b', 'c'), 1, p_size % 4)"))
    routes = T.read(spark, sf, "part").select(F.col("p_brand").alias("brand"), path.alias("path"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("routed_node"))
    return policies.route_metrics(routes, ["brand"])


_NODES = """WITH nodes AS (SELECT n_nationkey AS node_id, CASE WHEN n_nationkey >= 5 THEN n_regionkey END AS parent_id, CASE WHEN n_nationkey < 5 THEN 'accepted' ELSE 'leaf' END AS status, (n_nationkey >= 5)::INT AS level, coalesce(c, 0) AS covered, CASE WHEN n_nationkey % 7 <> 3 THEN a END AS accuracy
    FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c, avg((c_acctbal > 0)::INT) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""


def _nodes(spark, sf):
    """Nations as a tree's nodes: the first five are the merged roots of the regions."""
    own = T.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("a"))
    root = F.col("n_nationkey") < 5
    return T.read(spark, sf, "nation").join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").alias("node_id"), F.when(~root, F.col("n_regionkey")).alias("parent_id"), F.when(root, "accepted").otherwise("leaf").alias("status"),
        (~root).cast("int").alias("level"), F.coalesce("c", F.lit(0)).alias("covered"), F.when(F.col("n_nationkey") % 7 != 3, F.col("a")).alias("accuracy"),
    )


@query(_NODES + "SELECT level, count(*) AS n_nodes, sum(covered) / 1000.0 AS coverage, avg(accuracy) AS mean_accuracy FROM nodes GROUP BY 1", "coverage mean_accuracy", "level:i n_nodes")
def tree_levels(spark, sf):
    return policies.tree_levels(_nodes(spark, sf), 1000)


@query(
    _NODES + """SELECT count_if(status = 'leaf') AS n_leaves, count(*) AS n_final_nodes, count_if(status = 'leaf') / count(*) AS compression_ratio, avg(accuracy) FILTER (parent_id IS NULL) AS root_accuracy, avg(k - accuracy) FILTER (status = 'accepted') AS accuracy_loss
    FROM nodes LEFT JOIN (SELECT parent_id AS of, avg(accuracy) AS k FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1) ON node_id = of""",
    "compression_ratio root_accuracy accuracy_loss", "n_leaves:i n_final_nodes",
)
def tree_summary(spark, sf):
    return policies.tree_summary(_nodes(spark, sf))


_PROFILE = ", ".join(f"count_if(target = '{t}' AND prediction = '{p}') / greatest(1, count_if(prediction IS NOT NULL)) AS {t}_{p}" for t in S.LABELS for p in S.LABELS)
_CELLS = " ".join(f"{t}_{p}" for t in S.LABELS for p in S.LABELS)


@query(W("classes") + f"SELECT editor, {_PROFILE} FROM classes GROUP BY 1", _CELLS, "editor")
def behavior_profile(spark, sf):
    p = policies.behavior_profile(T.classes(spark, sf), ["editor"])
    return p.select("editor", *(F.col("profile")[i].alias(name) for i, name in enumerate(_CELLS.split())))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}.{c} * {b}.{c}" for c in _CELLS.split()) + ")"


@query(
    W("classes") + f""", p AS (SELECT editor, {_PROFILE} FROM classes GROUP BY 1), z AS (SELECT a.editor AS left_editor, b.editor AS right_editor, coalesce({_dot('a', 'b')} / nullif(sqrt({_dot('a', 'a')} * {_dot('b', 'b')}), 0), 0) AS behavior FROM p a JOIN p b ON a.editor < b.editor)
    SELECT left_editor, right_editor, CASE WHEN right_editor LIKE '%3' THEN (0.5 * 0.25 + 0.3 * behavior) / 0.8 ELSE (0.5 * 0.25 + 0.3 * behavior + 0.2 * 0.75) / 1.0 END AS score FROM z""",
    "score", "left_editor right_editor",
)
def pair_scores(spark, sf):
    p = policies.behavior_profile(T.classes(spark, sf), ["editor"])
    a = p.select(F.col("editor").alias("left_editor"), F.col("profile").alias("x"))
    b = p.select(F.col("editor").alias("right_editor"), F.col("profile").alias("y"))
    transfer = F.when(~F.col("right_editor").endswith("3"), F.lit(0.75))
    score = policies.pair_score(F.lit(0.25), F.col("x"), F.col("y"), transfer)
    return a.join(b, F.col("left_editor") < F.col("right_editor")).select("left_editor", "right_editor", score.alias("score"))  # a row per editor


@query(W("classes") + "SELECT lang || ':' || coalesce(prediction, 'invalid') || '->' || target AS signature, count(*) AS n FROM classes GROUP BY 1", "", "signature n")
def failure_signatures(spark, sf):
    c = T.classes(spark, sf).select(policies.failure_signature(F.col("lang"), F.col("prediction"), F.col("target")).alias("signature"))
    return c.groupBy("signature").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'rubric:' || p_size WHEN 1 THEN CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') THEN p_brand END WHEN 2 THEN CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') THEN p_brand END END AS concept FROM part", "", "p_partkey concept"
)
def feature_concepts(spark, sf):
    p, k = T.read(spark, sf, "part"), F.col("p_size") % 4
    name = F.when(k == 0, F.concat_ws(":", F.lit("rubric"), "p_size", "p_name")).when(k == 1, F.concat_ws(":", F.lit("fm"), "p_brand", F.lit("x"))).when(k == 2, F.concat_ws(":", F.lit("rule"), "p_brand")).otherwise("base_score")
    return p.select("p_partkey", policies.concept_of_feature(name, ["Brand#11", "Brand#12", "Brand#21"]).alias("concept"))


@query(
    """WITH t AS (SELECT user_id, event_id, event_type AS s FROM events WHERE event_type <> 'purchase'), c AS (SELECT user_id, s, count(*) AS c, min(event_id) AS f, max(event_id) AS l FROM t GROUP BY 1, 2)
    SELECT user_id, CASE WHEN user_id % 2 = 0 THEN arg_max(s, c * 1000000000000 - f) ELSE arg_max(s, l) END AS structure FROM c GROUP BY 1""",
    "", "user_id structure",
)
def stable_structures(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("structure"))
    return policies.stable_structure(e, ["user_id"], "event_id", "structure", F.col("user_id") % 2 == 0)


@query(
    """WITH t AS (SELECT event_type AS mode, sum(floor(abs(value))::BIGINT % 4) AS total FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1), b AS (SELECT count(*) AS n, avg(value) AS mean_delta FROM events)
    SELECT mode, total, n, mean_delta, CASE WHEN mean_delta > 0.05 THEN 'under' WHEN mean_delta < -0.05 THEN 'over' ELSE 'none' END AS direction FROM (SELECT * FROM t WHERE total > 0 ORDER BY total DESC, mode LIMIT 2), b""",
    "mean_delta", "mode total:i n direction",
)
def corpus_tendencies(spark, sf):
    e = T.read(spark, sf, "events").select(F.create_map("event_type", F.floor(F.abs("value")).cast("long") % 4).alias("modes"), "value")
    modes, bias = policies.corpus_tendencies(e, "modes", "value", ["click", "view", "purchase"], 2)
    return modes.crossJoin(F.broadcast(bias))  # one row


@query(
    "SELECT l_orderkey, l_linenumber, 1 - coalesce(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END, 1) + abs(l_tax) + coalesce(CASE WHEN l_quantity > 10 THEN abs(l_quantity - 25) END, 0) AS score FROM lineitem", "score", "l_orderkey l_linenumber:i"
)
def unit_anomaly(spark, sf):
    unit = T.read(spark, sf, "lineitem")
    confidence = F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10)
    measures = [F.col("l_tax"), F.when(F.col("l_quantity") > 10, F.col("l_quantity") - 25)]
    return unit.select("l_orderkey", "l_linenumber", policies.anomaly(confidence, measures).alias("score"))


_CAND = "WITH c AS (SELECT s_nationkey AS g, s_name AS name, s_suppkey % 11 / 10.0 AS accuracy, s_suppkey % 7 / 6.0 AS balanced, s_suppkey % 3 / 2.0 AS partial_f1, s_suppkey % 5 / 4.0 AS partial_recall, s_suppkey % 13 AS n_chars FROM supplier)"


def _candidates(spark, sf):
    k = F.col("s_suppkey")
    return T.read(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("g"), F.col("s_name").alias("name"), (k % 11 / 10.0).alias("accuracy"), (k % 7 / 6.0).alias("balanced"), (k % 3 / 2.0).alias("partial_f1"), (k % 5 / 4.0).alias("partial_recall"), (k % 13).alias("n_chars")
    )


@query(
    _CAND + """, z AS (SELECT *, accuracy + 0.02 >= 0.5 AS fit FROM c), r AS (SELECT g, name, row_number() OVER (PARTITION BY g ORDER BY fit DESC, CASE WHEN fit THEN partial_f1 ELSE accuracy END DESC, CASE WHEN fit THEN partial_recall ELSE balanced END DESC, balanced DESC, accuracy DESC, n_chars, name) AS i FROM z)
    SELECT g, name FROM r WHERE i = 1""",
    "", "g:i name",
)
def guarded_selection(spark, sf):
    return policies.guarded_best(_candidates(spark, sf), ["g"], F.lit(0.5), 0.02)


@query(_CAND + "SELECT g, name FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY accuracy DESC, balanced DESC, partial_f1 > 0.4 DESC, n_chars, name) AS i FROM c) WHERE i = 1", "", "g:i name")
def repair_rank(spark, sf):
    c = _candidates(spark, sf)
    rank = policies.hit_rank(F.col("accuracy"), F.col("balanced"), F.col("partial_f1") > 0.4, F.col("n_chars"))
    best = c.withColumn("r", rank).groupBy("g", "r").agg(F.min("name").alias("name")).groupBy("g").agg(F.max_by("name", "r").alias("name"))
    return best


@query(
    """WITH c AS (SELECT s_nationkey AS g, CASE WHEN s_suppkey % 9 = 0 THEN 'base' ELSE s_name END AS name, s_suppkey % 11 / 10.0 AS score, s_suppkey % 7 / 6.0 AS rate, s_suppkey % 13 AS n_chars FROM supplier),
    b AS (SELECT g, max(score) FILTER (name = 'base') AS base FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, rate DESC, n_chars, name DESC) AS i FROM c)
    SELECT g, CASE WHEN name <> 'base' AND score >= base + 0.05 - 1e-12 THEN name ELSE 'base' END AS name FROM r JOIN b USING (g) WHERE i = 1""",
    "", "g:i name",
)
def challenger_selection(spark, sf):
    k = F.col("s_suppkey")
    c = T.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.when(k % 9 == 0, "base").otherwise(F.col("s_name")).alias("name"), (k % 11 / 10.0).alias("score"), (k % 7 / 6.0).alias("rate"), (k % 13).alias("n_chars"))
    return policies.challenger(c, ["g"], "base")


@query(
    W("classes") + """, k AS (SELECT item_id, CASE WHEN task_uid % 3 = 0 THEN 'validation' ELSE 'fit' END AS part, unnest([1, 2, 3]) AS level, unnest(['e:' || editor || '/' || p, 'l:' || lang || '/' || p, 'p:' || p]) AS key FROM (SELECT *, coalesce(prediction, '') AS p FROM classes)),
    b AS (SELECT key FROM k GROUP BY 1 HAVING count_if(part = 'fit') >= 3 AND count_if(part = 'validation') >= 2), f AS (SELECT item_id, part, coalesce(arg_min(k.key, level) FILTER (b.key IS NOT NULL), arg_max(k.key, level)) AS leaf FROM k LEFT JOIN b USING (key) WHERE part = 'fit' GROUP BY 1, 2),
    g AS (SELECT DISTINCT leaf FROM f), v AS (SELECT item_id, part, coalesce(arg_min(k.key, level) FILTER (leaf IS NOT NULL), arg_max(k.key, level)) AS leaf FROM k LEFT JOIN g ON key = leaf WHERE part = 'validation' GROUP BY 1, 2) SELECT * FROM f UNION ALL SELECT * FROM v""",
    "", "item_id part leaf",
)
def residual_leaves(spark, sf):
    c = T.classes(spark, sf).withColumn("part", F.when(F.col("task_uid") % 3 == 0, "validation").otherwise("fit"))
    p = F.coalesce("prediction", F.lit(""))
    keys = [F.concat(F.lit("e:"), "editor", F.lit("/"), p), F.concat(F.lit("l:"), "lang", F.lit("/"), p), F.concat(F.lit("p:"), p)]
    return policies.residual_leaves(c, "item_id", keys, 3, 2)


@query(
    W("classes") + """, c AS (SELECT lang, editor, prediction, target, count(*) AS c FROM classes GROUP BY 1, 2, 3, 4), e AS (SELECT lang, editor, prediction, max(c) AS m, sum(c) AS n, count(*) AS k FROM c GROUP BY 1, 2, 3)
    SELECT lang, sum(n) AS n, count(*) AS n_profiles, count_if(k > 1) AS n_collisions, sum(m) / sum(n) AS ceiling FROM e GROUP BY 1""",
    "ceiling", "lang n:i n_profiles n_collisions:i",
)
def mapping_ceiling(spark, sf):
    return policies.mapping_ceiling(T.classes(spark, sf), ["lang"], ["editor", "prediction"])


@query(
    W("classes") + """, o AS (SELECT editor, count(*) AS n, count_if(target = 'no') AS a, count_if(target = 'partial') AS b, count_if(target = 'yes') AS c FROM classes GROUP BY 1), z AS (SELECT *, sum(a) OVER () - a AS x, sum(b) OVER () - b AS y, sum(c) OVER () - c AS w FROM o)
    SELECT editor, n, CASE greatest(x, y, w) WHEN x THEN a WHEN y THEN b ELSE c END AS hits FROM z""",
    "", "editor n hits:i",
)
def majority_without(spark, sf):
    return policies.majority_without(T.classes(spark, sf), "editor")


_KEYS = {"ep": "editor || '::' || p", "lp": "lang || '::' || p", "p": "p"}
_CONFIGS = [["p"], ["lp", "p"], ["ep", "p"], ["ep", "lp", "p"]]


def _search() -> str:
    trials = [(0, 0, 0, [])] + [(i * 3 + j + 1, s, len(c), c) for i, c in enumerate(_CONFIGS) for j, s in enumerate((4, 8, 12))]
    steps = ", ".join(f"({t}, {s}, {n}, {place}, '{level}')" for t, s, n, c in trials for place, level in enumerate(c))
    plan = ", ".join(f"({t}, {s}, {n})" for t, s, n, _ in trials)
    keyed = ", ".join(f"'{k}'" for k in _KEYS)
    return W("classes") + f""", z AS (SELECT *, coalesce(prediction, '') AS p, task_uid % 3 = 0 AS held FROM classes), k AS (SELECT item_id, target, prediction, held, unnest([{keyed}]) AS level, unnest([{', '.join(_KEYS.values())}]) AS key FROM z),
    c AS (SELECT level, key, target, count(*) AS c, count(*) FILTER (target = prediction) AS h FROM k WHERE NOT held GROUP BY 1, 2, 3),
    m AS (SELECT level, key, sum(c) AS support, arg_max(target, (c, target = 'partial', target)) AS action, max(c) - sum(h) AS gain FROM c GROUP BY 1, 2),
    steps(trial, least, n_levels, place, level) AS (VALUES {steps}), plan(trial, least, n_levels) AS (VALUES {plan}),
    u AS (SELECT trial, place, level, key, action FROM steps JOIN m USING (level) WHERE support >= least AND gain >= 0), nr AS (SELECT trial, count(*) AS n_rules FROM u GROUP BY 1),
    f AS (SELECT item_id, trial, arg_min(action, place) AS action FROM k JOIN u USING (level, key) WHERE held GROUP BY 1, 2),
    s AS (SELECT plan.*, z.target, coalesce(coalesce(f.action, z.prediction) = z.target, FALSE) AS hit FROM z CROSS JOIN plan LEFT JOIN f ON f.item_id = z.item_id AND f.trial = plan.trial WHERE held),
    r AS (SELECT trial, least, n_levels, avg(hit::INT) AS accuracy, list_avg(list_filter([{', '.join(f"(count_if(hit AND target = '{x}') / nullif(count_if(target = '{x}'), 0))" for x in S.LABELS)}], lambda x: x IS NOT NULL)) AS balanced FROM s GROUP BY 1, 2, 3)
    SELECT trial, least, n_levels, accuracy, balanced, coalesce(n_rules, 0) AS n_rules, row_number() OVER (ORDER BY round(accuracy, 12) DESC, round(balanced, 12) DESC, coalesce(n_rules, 0), n_levels, least DESC, trial) AS rank FROM r LEFT JOIN nr USING (trial)"""


@query(_search(), "accuracy balanced", "trial:i least:i n_levels:i n_rules:i rank:i")
def consensus_search(spark, sf):
    c = T.classes(spark, sf).withColumn("part", F.when(F.col("task_uid") % 3 == 0, "validation").otherwise("fit"))
    p = F.coalesce("prediction", F.lit(""))
    keys = {"ep": F.concat_ws("::", "editor", p), "lp": F.concat_ws("::", "lang", p), "p": p}
    return policies.consensus_search(c, keys, _CONFIGS, [4, 8, 12])


def _rules() -> str:
    steps = ", ".join(f"({i * 3 + j + 1}, {s}, '{level}')" for i, c in enumerate(_CONFIGS) for j, s in enumerate((4, 8, 12)) for level in c)
    keyed = ", ".join(f"'{k}'" for k in _KEYS)
    return W("classes") + f""", best AS (SELECT trial FROM ({_search()}) WHERE rank = 1), z AS (SELECT *, coalesce(prediction, '') AS p FROM classes),
    k AS (SELECT target, prediction, unnest([{keyed}]) AS level, unnest([{', '.join(_KEYS.values())}]) AS key FROM z), c AS (SELECT level, key, target, count(*) AS c, count(*) FILTER (target = prediction) AS h FROM k GROUP BY 1, 2, 3),
    m AS (SELECT level, key, sum(c) AS support, arg_max(target, (c, target = 'partial', target)) AS action, max(c) - sum(h) AS gain FROM c GROUP BY 1, 2), steps(trial, least, level) AS (VALUES {steps})
    SELECT level, key AS rule_key, support, action, gain FROM m JOIN steps USING (level) JOIN best USING (trial) WHERE support >= least AND gain >= 0"""


@query(_rules(), "", "level rule_key support:i action gain:i")
def consensus_rules(spark, sf):
    c = T.classes(spark, sf).withColumn("part", F.when(F.col("task_uid") % 3 == 0, "validation").otherwise("fit"))
    p = F.coalesce("prediction", F.lit(""))
    keys = {"ep": F.concat_ws("::", "editor", p), "lp": F.concat_ws("::", "lang", p), "p": p}
    return policies.consensus_rules(c, keys, _CONFIGS, [4, 8, 12])


@query("SELECT p_partkey, p_name || ' ' || p_brand AS transcript FROM part", "", "p_partkey transcript")
def timeline_transcripts(spark, sf):
    p = T.read(spark, sf, "part")
    text = F.concat(F.lit("clip 1,x,2\n  w1,\""), "p_name", F.lit("\",1.5\nno word line\nw2,"), "p_brand", F.lit(" ,2\nw3,,1"))
    return p.select("p_partkey", X.transcript(text).alias("transcript"))


@query("SELECT p_partkey, concat_ws(chr(10), p_name, CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand) AS summary FROM part", "", "p_partkey summary")
def summary_texts(spark, sf):
    p = T.read(spark, sf, "part")
    return p.select("p_partkey", X.summary_lines(F.concat(F.lit("  "), "p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("  "), F.col("p_brand")).alias("summary"))


@query(
    "SELECT event_id, unnest(['$.k', '$.list[0].k', '$.list[1].deep.k']) AS path, unnest([json_extract_string(props, '$.k'), CAST(event_id % 7 AS VARCHAR), 'true']) AS value FROM events", "", "event_id path value"
)
def json_scores(spark, sf):
    nested = F.concat(F.substring("props", 1, F.char_length("props") - 1), F.lit(', "list": [{"k": '), (F.col("event_id") % 7).cast("string"), F.lit('}, {"deep": {"k": true, "x": 1}}]}'))
    e = T.read(spark, sf, "events").select("event_id", nested.alias("text"))
    return judging.json_scores(e, "event_id", "text", ["k"]).select("event_id", "path", "value")


@query(
    """SELECT p_partkey, p_name AS notes_prompt, CASE WHEN p_size % 3 <> 2 THEN p_size::VARCHAR || '|' || to_json(p_type)::VARCHAR END AS final_clip_ids, CASE WHEN p_size % 3 = 0 THEN p_type || ' ' || p_brand ELSE '' END AS transcript,
      CASE WHEN p_size % 3 = 2 THEN 2 END AS n_segments, CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_name ELSE p_brand END AS captions, 2 AS v1_size FROM part""",
    "", "p_partkey notes_prompt final_clip_ids transcript n_segments:i captions v1_size:i",
)
def notes_assembly(spark, sf):
    p = T.read(spark, sf, "part")
    ids = F.when(F.col("p_size") % 3 != 2, F.concat(F.lit('"finalClipIds": ['), F.col("p_size").cast("string"), F.lit(', "'), "p_type", F.lit('"], ')))
    view = F.concat(F.lit('{"input": {"currentTimeline": "clip 1,a,2\\n1,'), "p_type", F.lit(",1.5\\n2,"), "p_brand", F.lit(',2"}}'))
    extra = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', {"caption": "'), "p_name", F.lit('", "video_id": 7}, {"caption": ""}'))).otherwise("")
    output = F.concat(
        F.coalesce(ids, F.lit('"finalSegments": [{"a": 1}, 2], ')), F.lit('"finalTracks": {"v1": [{"caption": "main"}, 1], "v2": [{"caption": "'), "p_brand", F.lit('", "start_ms": 1}'), extra, F.lit('], "other": 3}')
    )
    text = F.concat(
        F.lit('{"prompt": "'), "p_name", F.lit('", "stages": [{"name": "OrchestratorRefineV2", "output": {}}, {"name": "OrchestratorRefineV4", "output": {'), output,
        F.lit('}, "subStages": [{"input": 3}, '), F.when(F.col("p_size") % 3 == 0, view).otherwise(F.lit('{"input": {"currentTimeline": "  "}}')), F.lit(']}, {"name": "Later", "output": {"finalTracks": {}}}]}'),
    )
    a = notes.assembly(p.select("p_partkey", text.alias("notes")), "p_partkey", "notes")
    return a.select("p_partkey", "notes_prompt", F.array_join("final_clip_ids", "|").alias("final_clip_ids"), "transcript", F.when(F.col("segments").isNotNull(), F.size("segments")).alias("n_segments"), F.array_join(F.transform("b_roll", lambda c: c["caption"]), "|").alias("captions"), F.col("track_sizes")["v1"].alias("v1_size"))


_HEX = "list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', h[i]) - 1) * (16 ** (8 - i))::BIGINT))::BIGINT"


@query(f"SELECT item_id, 1 + {_HEX} % 5 AS score_1_to_5, 'digest ' || ({_HEX} % 1000) AS rationale, TRUE AS valid FROM (SELECT item_id, sha256('Features of: ' || text) AS h FROM benchmark)", "", "item_id score_1_to_5:i rationale valid")
def extracted_features(spark, sf):
    b = T.read(spark, sf, "benchmark")
    found = judging.extract(b, "item_id", "Features of: {text}", {"text": "text"}, judging.HashEngine, "score_1_to_5 long, rationale string, confidence double")
    return found.select("item_id", "score_1_to_5", "rationale", "valid")


@query("SELECT item_id, ((instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1) / 255.0 AS first, ((instr('0123456789abcdef', h[15]) - 1) * 16 + instr('0123456789abcdef', h[16]) - 1) / 255.0 AS last FROM (SELECT item_id, sha256(text) AS h FROM benchmark)", "first last", "item_id")
def text_embeddings(spark, sf):
    e = judging.embed(T.read(spark, sf, "benchmark"), "item_id", "text", judging.HashEmbedder)
    return e.select("item_id", F.col("embedding")[0].alias("first"), F.col("embedding")[7].alias("last"))
