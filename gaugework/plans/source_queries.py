"""Queries through files: rows of the tables are written in the formats of annotation, label, timeline and log files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions import text as X
from gaugework.operators import ratings, reports
from gaugework.plans import tables as T
from gaugework.plans.registry import query
from gaugework.sources import curation, readers, state
from gaugework.streaming import incremental
from gaugework.workers import scratch

W = T.with_views


def _lines(rows, path: str):
    rows.select("value").write.text(path)
    return path


@query("SELECT 's' || s_suppkey || '::0::ve' AS item_id, 'mos' AS rater, 'quality' AS dimension, (1 + s_suppkey % 9 / 2.0)::DOUBLE AS score FROM supplier WHERE s_suppkey % 4 <> 0", "score", "item_id rater dimension")
def annotation_files(spark, sf):
    s = T.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stem"), "s_suppkey", (1 + F.col("s_suppkey") % 9 / 2.0).alias("score"))
    at = scratch(spark, "annotations")
    curation.write_labels(s, s.where("s_suppkey % 4 <> 0"), at, "ve", "mos", "quality")
    return readers.annotations(spark, at, "*.txt").where("dimension = 'quality'").select("item_id", "rater", "dimension", "score")


@query("SELECT event_id::VARCHAR AS item_id, 'u' || user_id AS unit_id, event_type AS rubric_id, (1 + event_id % 5)::DOUBLE AS rating, CASE WHEN event_id % 3 = 0 THEN 'major' END AS severity FROM events", "rating", "item_id unit_id rubric_id severity")
def unit_annotation_lines(spark, sf):
    e = T.read(spark, sf, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("item_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unit_id"), F.col("event_type").alias("rubric_id"), (1 + F.col("event_id") % 5).alias("rating"), F.when(F.col("event_id") % 3 == 0, "major").alias("severity")))
    path = _lines(e.select(line.alias("value")), scratch(spark, "units"))
    kinds = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # the rubrics
    return readers.unit_annotations(spark, path, kinds).select("item_id", "unit_id", "rubric_id", "rating", "severity")


@query("SELECT 'v' || p_partkey AS stem, p_size / 10.0 AS score, p_name || '|' || p_brand AS prompt FROM part", "score", "stem prompt")
def piped_label_lines(spark, sf):
    p = T.read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    good = F.concat(F.lit(" v"), key, F.lit(".mp4 |"), (F.col("p_size") / 10).cast("string"), F.lit("|"), "p_name", F.lit("|"), "p_brand")
    bad = F.concat(F.lit("w"), key, F.element_at(F.array(F.lit("|x|no number"), F.lit("|3"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = p.select(F.explode(F.array(good, bad)).alias("value"))
    return readers.piped_labels(spark, _lines(rows, scratch(spark, "labels")))


_HALVES = "[0.0, 0.5, 1.0]"


@query(
    f"""WITH r AS (SELECT p_partkey::VARCHAR AS uid, e AS editor, k, {_HALVES}[1 + (p_partkey * k + p_size * e.ord) % 3] AS sc FROM part, (SELECT unnest([{{'n': 'left', 'ord': 1}}, {{'n': 'right', 'ord': 2}}]) AS e), range(1, 4) t(k)),
    m AS (SELECT uid, editor.n AS editor, median(sc) AS median_sc, count(*) AS n_raters FROM r GROUP BY 1, 2) SELECT uid, editor, median_sc, n_raters, CASE WHEN median_sc = 0 THEN 'no' WHEN median_sc = 0.5 THEN 'partial' WHEN median_sc = 1 THEN 'yes' ELSE 'invalid' END AS label FROM m""",
    "median_sc", "uid editor n_raters label",
)
def rating_tables(spark, sf):
    p, found = T.read(spark, sf, "part"), None
    half = lambda k, order: F.element_at(F.array(F.lit("0"), F.lit("0.5"), F.lit("1")), ((F.col("p_partkey") * k + F.col("p_size") * order) % 3 + 1).cast("int"))
    for k in (1, 2, 3):  # a table per rater
        cell = lambda order: F.concat(F.lit("["), half(k, order), F.lit(", 1]"))  # noqa: B023, E731
        at = scratch(spark, f"ratings-{k}")
        p.select(F.col("p_partkey").cast("string").alias("uid"), cell(1).alias("left"), cell(2).alias("right")).write.option("header", True).option("sep", "\t").option("quote", "").csv(at)
        one = readers.rating_table(spark, at)
        found = one if found is None else found.unionByName(one)
    return readers.median_labels(found).select("uid", "editor", "median_sc", "n_raters", "label")


@query("SELECT o_orderkey AS item_id, k - 1 AS rater, (o_orderkey + k) % 4 AS level, CASE (o_orderkey + k) % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'partial' ELSE 'yes' END AS label FROM orders, range(1, 4) t(k)", "", "item_id rater:i level:i label")
def level_lines(spark, sf):
    o = T.read(spark, sf, "orders")
    at = scratch(spark, "levels")
    o.select(F.col("o_orderkey").cast("string").alias("item_id"), F.transform(F.array(*(F.lit(k) for k in (1, 2, 3))), lambda k: (F.col("o_orderkey") + k) % 4).alias("levels")).write.json(at)
    return readers.level_rows(spark, at).select(F.col("item_id").cast("long").alias("item_id"), "rater", "level", "label")


@query(
    "SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN s < 0.5 THEN 'no' WHEN s < 1.5 THEN 'partial' ELSE 'yes' END AS target, s / 2 AS score_0_1 FROM (SELECT *, (o_orderkey % 9) / 4.0 AS s FROM orders)",
    "score_0_1", "item_id split target",
)
def scored_edit_lines(spark, sf):
    o = T.read(spark, sf, "orders")
    at = scratch(spark, "scored")
    o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("task_uid"), (F.col("o_orderkey") % 9 / 4.0).alias("human_score")).write.json(at)
    splits = o.select(F.col("o_custkey").alias("task_uid"), F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split")).distinct()
    return readers.scored_edits(spark, at, splits).select(F.col("item_id").cast("long").alias("item_id"), "split", "target", "score_0_1")


@query(
    """SELECT n_name AS timeline, i AS idx, 'c' || i AS name, (n_nationkey + 1) * (i + 1) / 24.0 AS duration, i % 3 <> 2 AS moves FROM nation, range(0, 6) t(i)""", "duration", "timeline idx:i name moves"
)
def timeline_files(spark, sf):
    n = T.read(spark, sf, "nation")
    time = lambda v: F.struct(v.cast("double").alias("value"), F.lit(24.0).alias("rate"))
    clip = lambda i: F.struct(
        F.when(i % 3 == 2, "Transition.1").otherwise("Clip.1").alias("OTIO_SCHEMA"), F.concat(F.lit("c"), i.cast("string")).alias("name"),
        F.struct(time((F.col("n_nationkey") + 1) * (i + 1)).alias("duration"), time(F.lit(0)).alias("start_time")).alias("source_range"),
    )
    track = F.struct(F.lit("Video").alias("kind"), F.transform(F.sequence(F.lit(0), F.lit(5)), clip).alias("children"))
    at = scratch(spark, "timelines")
    n.select("n_name", F.to_json(F.struct(F.struct(F.array(track).alias("children")).alias("tracks"))).alias("value")).repartition("n_name").write.partitionBy("n_name").text(at)  # a file per nation
    found = readers.timeline_clips(spark, at, "*.txt")
    name = F.replace(F.url_decode(F.regexp_extract("path", "n_name=([^/]+)/", 1)), F.lit("+"), F.lit(" "))
    return found.select(name.alias("timeline"), "idx", "name", "duration", "moves")


@query("SELECT n_regionkey AS project, n_nationkey AS prompt_idx, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation", "", "project prompt_idx:i bytes sha256")
def asset_listing(spark, sf):
    n, at = T.read(spark, sf, "nation"), scratch(spark, "assets")
    n.select("n_regionkey", F.col("n_nationkey").alias("n"), F.col("n_name").alias("value")).repartition("n").write.partitionBy("n_regionkey", "n").text(at)
    listed = readers.listed_outputs(spark, at, r"n_regionkey=(\d+)/n=(\d+)/[^/]*$", "*.txt")
    return listed.join(readers.asset_digests(spark, at, "*.txt").select("path", "sha256"), "path").select(F.col("project").cast("long").alias("project"), "prompt_idx", "bytes", "sha256")


@query("SELECT user_id::VARCHAR AS key, max(event_id) AS seq, arg_max(props, event_id) AS value FROM events GROUP BY 1", "", "key seq value")
def log_written_in_parts(spark, sf):
    e, at = T.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value")), scratch(spark, "log")
    for part in (0, 1):
        state.append(e.where(F.col("seq") % 2 == part), at)
    return state.read_log(spark, at).select("key", "seq", "value")


@query("SELECT o_orderpriority AS setting, k AS repeat, count(*) AS n, sum(o_orderkey) AS keys FROM orders, range(1, 3) t(k) WHERE (o_orderkey + k) % 2 = 0 GROUP BY 1, 2", "", "setting repeat:i n keys:i")
def csv_cells(spark, sf):
    o, at = T.read(spark, sf, "orders"), scratch(spark, "cells")
    for k in (1, 2):
        for p in [r["p"] for r in o.select(F.col("o_orderpriority").alias("p")).distinct().collect()]:  # the settings
            mine = o.where((F.col("o_orderpriority") == p) & ((F.col("o_orderkey") + k) % 2 == 0))
            state.write_csv(mine, f"{at}/set{p.split('-')[0]}_rep{k}", ["o_orderkey", "o_orderpriority"])
    cells = state.read_cells(spark, at, "o_orderkey long, o_orderpriority string", r"set([0-9A-Z]+)_rep(\d+)")
    whole = state.complete_cells(cells)
    return cells.groupBy("setting", "repeat").agg(F.max("o_orderpriority").alias("p"), F.sum("o_orderkey").alias("keys")).join(whole, ["setting", "repeat"]).select(F.col("p").alias("setting"), "repeat", "n", "keys")


@query(
    "SELECT l_orderkey AS item_id, l_linenumber AS unit_id, l_quantity AS start_seconds FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F'",
    "start_seconds", "item_id unit_id",
)
def published_units(spark, sf):
    u, at = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("unit_id"), F.col("l_linestatus").alias("unit_type"), F.col("l_quantity").cast("double").alias("start_seconds"), F.col("l_returnflag").alias("cache_key")), scratch(spark, "published")
    state.publish(u, at, "cache_key")
    state.publish(u.where("cache_key = 'N'").withColumn("start_seconds", F.col("start_seconds") + 1), at, "cache_key")  # its partition alone is replaced
    return state.query_units(spark.read.parquet(at), unit_type="F").select("item_id", "unit_id", "start_seconds")


@query(
    """SELECT p_partkey, 'a' || p_size AS artifact FROM part WHERE p_size % 4 <> 3 AND p_size % 5 <> 0""", "", "p_partkey artifact"
)
def whole_manifests(spark, sf):
    p = T.read(spark, sf, "part").withColumn("artifact", F.concat(F.lit("a"), F.col("p_size").cast("string")))
    manifests = p.select(F.col("p_partkey").alias("cache_key"), "artifact", F.when(F.col("p_size") % 4 == 3, "partial").otherwise("complete").alias("status"))
    listing = p.where("p_size % 5 <> 0").select(F.col("artifact").alias("path")).distinct()
    return state.usable_manifests(manifests, manifests.select("cache_key", F.col("artifact").alias("path")), listing).select(F.col("cache_key").alias("p_partkey"), "artifact")


@query(
    """SELECT event_id, CASE WHEN v < 0.5 THEN 'no' WHEN v < 1.5 THEN 'partial' ELSE 'yes' END AS label, CASE event_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'partial' ELSE 'yes' END AS level_label,
      CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 2 = event_id % 3 THEN 'unanimous' ELSE 'disputed' END AS bucket,
      CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'wrong_and_unstable' WHEN event_id % 2 = 0 THEN 'wrong' WHEN event_id % 3 = 0 THEN 'unstable' END AS repair,
      array_to_string(list_sort(list_distinct(regexp_extract_all(lower(event_type || ' K' || event_id % 3 || ' ' || event_type), '[a-z0-9]+'))), ' ') AS signature FROM (SELECT *, (event_id % 9) / 4.0 AS v FROM events)""",
    "", "event_id label level_label bucket repair signature",
)
def label_columns(spark, sf):
    e = T.read(spark, sf, "events")
    i = F.col("event_id")
    votes = F.when(i % 7 != 0, F.array(i % 2, i % 3))
    said = F.concat("event_type", F.lit(" K"), (i % 3).cast("string"), F.lit(" "), "event_type")
    return e.select(
        "event_id", S.label_of_score(i % 9 / 4.0).alias("label"), S.label_of_level(i % 4).alias("level_label"), S.agreement_bucket(votes).alias("bucket"), S.repair_reason(i % 2 == 0, i % 3 == 0).alias("repair"),
        F.array_join(X.signature(said), " ").alias("signature"),
    )


@query(W("aligned") + "SELECT dimension, use_case, avg(human) - 0.25 * (max(human) - min(human)) AS block_score FROM aligned GROUP BY 1, 2", "block_score", "dimension use_case")
def block_scores(spark, sf):
    return ratings.block_scores(T.aligned(spark, sf), ["dimension", "use_case"], "human")


@query(
    W("aligned") + ", r AS (SELECT dimension, corr(human, judge_raw) AS pearson FROM aligned GROUP BY 1) SELECT arg_max(dimension, (pearson, dimension)) AS dimension, max(pearson) AS pearson FROM r WHERE pearson IS NOT NULL",
    "pearson", "dimension",
)
def best_dimension(spark, sf):
    from gaugework.operators import agreement

    report = agreement.pearson(agreement.cells(T.aligned(spark, sf), ["dimension"]), ["dimension"])
    return reports.best_dimension(report, "pearson")


@query("SELECT user_id::VARCHAR AS key, count(*)::VARCHAR AS value FROM events GROUP BY 1 HAVING count(*) % 7 <> 0", "", "key value")
def judged_stream(spark, sf):
    e, at = T.read(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("n")), scratch(spark, "judged")
    e.write.parquet(f"{at}/work")
    judge = lambda rows: rows.select("key", F.when(F.col("n") % 7 != 0, F.col("n").cast("string")).alias("value"))  # noqa: E731  a failure has no value
    for _ in range(2):  # a second run finds its keys done
        incremental.judge_stream(spark.readStream.schema(e.schema).parquet(f"{at}/work"), judge, f"{at}/results", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/results").select("key", "value")
