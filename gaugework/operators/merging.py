"""Agglomeration of leaves into a tree of nodes, level by level, over tables that a stopped build resumes from.

Two nodes are as similar as their least similar members (complete link).  An open node carries its members' vectors, and
routing.nearest_matching compares nodes in blocks; pairs of nodes, which a low floor makes a good part of all, are never a table.

Each level lowers the threshold, matches the open pairs greedily (most similar first, then by ids), asks the `accept`
callback about the matched pairs, merges the accepted ones and blocks the others for good.  A level's new nodes, open nodes'
vectors and blocked pairs are written to its folder; a build that is started again reads the finished levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.vectors import norm
from gaugework.operators.routing import nearest_matching
from gaugework.workers import done

_NODES = "node_id string, level int, left_id string, right_id string, similarity double, n_members long, centroid array<double>, groups array<string>"
_MEMBERS = "node_id string, vectors array<array<double>>"
_PAIRS = "left_id string, right_id string, similarity double"
_BLOCKED = "left_id string, right_id string"


def _kept(df: DataFrame, path: str, schema: str) -> DataFrame:
    if not done(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def merge_tree(
    leaves: DataFrame, folder: str, start: float = 0.90, decay: float = 0.05, floor: float = 0.70, accept: Callable[[DataFrame, int], DataFrame] | None = None,
    shared_group_levels: int = 0, most_attempts: int | None = None,
) -> DataFrame:
    """leaves (node_id, embedding, optionally groups) -> node_id, level (0: a leaf), left_id, right_id, similarity, n_members, centroid, groups, active (no parent).

    accept: (matched pairs left_id, right_id, similarity; level) -> the pairs to merge, as rows with left_id and right_id; the model
    calls that judge a merge belong there.  None accepts all.  In the first `shared_group_levels` levels only nodes with a
    common group are matched.  most_attempts: pairs tried in all, most similar first.  floor must be above 0.  Leaves with an empty or zero
    vector stay leaves; an open node's row holds its members' distinct vectors, 2 to the power of the levels at most; node ids are distinct and not null; no leaves give an empty tree.
    """
    spark = leaves.sparkSession
    groups = F.col("groups").cast("array<string>") if "groups" in leaves.columns else F.array().cast("array<string>")
    vector = F.col("embedding").cast("array<double>")
    first = leaves.select(
        F.col("node_id").cast("string").alias("node_id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("left_id"), F.lit(None).cast("string").alias("right_id"),
        F.lit(None).cast("double").alias("similarity"), F.lit(1).cast("long").alias("n_members"), vector.alias("centroid"), groups.alias("groups"),
    )
    nodes = _kept(first, f"{folder}/level-0/nodes", _NODES)
    members = nodes.where((F.size("centroid") > 0) & (norm(F.col("centroid")) > 0)).select("node_id", F.array("centroid").alias("vectors"))
    blocked, tried = None, 0
    for level in range(1, round((start - floor) / decay) + 2):
        threshold, at = max(floor, start - decay * (level - 1)), f"{folder}/level-{level}"
        pairs_at, parents_at = f"{at}/pairs", f"{at}/nodes"
        if not done(spark, pairs_at):
            shared = level <= shared_group_levels
            open_ = members.join(nodes.select("node_id", F.explode(F.array_distinct("groups")).alias("_group")), "node_id") if shared else members
            matched = nearest_matching(open_, max(floor, threshold - 1e-12), within="_group" if shared else None, blocked=blocked)
            if most_attempts is not None:
                matched = matched.orderBy(F.desc("similarity"), "left_id", "right_id").limit(max(0, most_attempts - tried))
            matched.write.mode("overwrite").parquet(pairs_at)
        pairs = spark.read.schema(_PAIRS).parquet(pairs_at)
        n = pairs.count()
        tried += n
        if n:
            yes = pairs if accept is None or done(spark, parents_at) else accept(pairs, level).select("left_id", "right_id").distinct().join(pairs, ["left_id", "right_id"])
            side = lambda s: nodes.select(F.col("node_id").alias(f"{s}_id"), F.col("n_members").alias(f"_n_{s}"), F.col("centroid").alias(f"_c_{s}"), F.col("groups").alias(f"_g_{s}"))
            met = yes.join(side("left"), "left_id").join(side("right"), "right_id")
            whole = F.col("_n_left") + F.col("_n_right")
            middle = F.zip_with("_c_left", "_c_right", lambda x, y: (x * F.col("_n_left") + y * F.col("_n_right")) / whole)
            name = F.concat(F.lit(f"merge:{level}:"), F.left(F.sha2(F.concat_ws("\n", "left_id", "right_id").cast("binary"), 256), F.lit(24)))
            made = met.select(
                name.alias("node_id"), F.lit(level).alias("level"), "left_id", "right_id", "similarity", whole.alias("n_members"), middle.alias("centroid"), F.array_sort(F.array_union("_g_left", "_g_right")).alias("groups")
            )
            parents = _kept(made, parents_at, _NODES)
            refused = pairs.join(parents, ["left_id", "right_id"], "left_anti").select("left_id", "right_id")
            blocked = _kept(refused if blocked is None else blocked.unionByName(refused), f"{at}/blocked", _BLOCKED)
            of = lambda s: members.select(F.col("node_id").alias(f"{s}_id"), F.col("vectors").alias(f"_v_{s}"))
            joined = parents.join(of("left"), "left_id").join(of("right"), "right_id").select("node_id", F.array_distinct(F.concat("_v_left", "_v_right")).alias("vectors"))
            merged = parents.select(F.explode(F.array("left_id", "right_id")).alias("node_id"))
            members = _kept(members.join(merged, "node_id", "left_anti").unionByName(joined), f"{at}/members", _MEMBERS)
            nodes = nodes.unionByName(parents)
        if (not n and threshold <= floor) or (most_attempts is not None and tried >= most_attempts):
            break
    children = nodes.where("level > 0").select(F.explode(F.array("left_id", "right_id")).alias("_child"))
    return nodes.join(children, F.col("node_id") == F.col("_child"), "left").withColumn("active", F.col("_child").isNull()).drop("_child")
