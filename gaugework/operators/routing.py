"""Vectors and rules: centroids, pair candidates, routing to the best node, thresholds, ordered backoff."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.vectors import cosine, dot, norm
from gaugework.operators.blocks import BLOCK, best_partners, least_cosines, pairs_above
from gaugework.workers import checkpoints, share_package

#: Node tables are trees of prompts: at most this many rows are broadcast; beyond it the join is cut into blocks.
MOST_NODES = 10_000
#: Members of a group that tell most groups apart before all members meet.
WITNESSES = 8
#: Pairs of vectors that blocks compare while rows compare one, about.
ROW_COST = 500
#: Pairs that one round of greedy_matching scans in one task.
SCANNED = 1 << 20


def centroids(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Component-wise mean per group; groups with vectors of different or no length get an empty array.

    Components are averaged as rows (group, position), so no group's vectors meet in one task.
    """
    sizes = rows.groupBy(*by).agg(F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"), F.count("*").alias("n"))
    parts = rows.select(*by, F.posexplode(vector).alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    means = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c"))  # one entry per component
    centroid = F.when((F.col("_lo") == F.col("_hi")) & (F.col("_lo") > 0), F.transform("_c", lambda c: c["_m"])).otherwise(F.array().cast("array<double>"))
    return sizes.join(means, by, "left").select(*by, "n", centroid.alias("centroid"))


def nearest_node(items: DataFrame, nodes: DataFrame, vector: str = "embedding", node_id: str = "node_id", node_vector: str = "centroid") -> DataFrame:
    """Each item's most similar node, the largest id on ties: item columns, node_id, similarity.

    The node table is counted first; nodes come in blocks of MOST_NODES, each broadcast, and the best of
    all blocks stays.
    """
    n = nodes.count()
    blocks = max(1, -(-n // MOST_NODES))
    best: DataFrame | None = None
    for b in range(blocks):
        some = nodes.where(F.pmod(F.xxhash64(node_id), F.lit(blocks)) == b).select(F.struct(F.col(node_id).alias("id"), F.col(node_vector).alias("v")).alias("_node"))
        held = some.agg(F.collect_list("_node").alias("_nodes"))  # at most about MOST_NODES rows
        met = items.crossJoin(F.broadcast(held))  # one row: the block's nodes as an array
        scored = F.array_max(F.transform("_nodes", lambda x: F.struct(cosine(F.col(vector), x["v"]).alias("similarity"), x["id"].alias("id"))))
        part = met.withColumn("_best", scored).drop("_nodes")
        best = part if best is None else best.unionByName(part)
    columns = [c for c in items.columns]
    if blocks > 1:
        best = best.groupBy(*columns).agg(F.max("_best").alias("_best"))
    return best.select(*columns, F.col("_best.id").alias(node_id), F.col("_best.similarity").alias("similarity"))


def _pivots(units: DataFrame, pivots: int) -> DataFrame:
    """One row: the unit vectors of the first `pivots` nodes in the order of a hash, as an array."""
    some = units.orderBy(F.xxhash64("_id"), "_id").limit(pivots)
    return some.agg(F.collect_list("_u").alias("_pivots"))  # at most `pivots` vectors


def near_pairs(nodes: DataFrame, threshold: float, node_id: str, vector: str, within: str | None, pivots: int = 64) -> DataFrame:
    """Node pairs of one class that angular pivots cannot tell apart: left_id, right_id, _a, _b, _k; every pair with a cosine of `threshold` (> 0) is there.

    A vector lives in the cell of its nearest pivot; a cell knows its widest angle.  By the triangle inequality on angles a vector can
    have a partner in another cell only if its angle to that cell's pivot is at most the cell's widest angle plus the threshold's,
    so it visits those cells alone, those of smaller number.  In a cell, vectors meet by bands of their angle to the pivot: two whose angles
    differ by more than the threshold's are no pair.  Cells and bands are an equi-join that skew handling can split.
    """
    reach = math.acos(min(1.0, threshold)) + 1e-6  # beyond the rounding of angles
    v = F.col(vector)
    units = nodes.select(F.col(node_id).alias("_id"), v.alias("_v"), (F.lit(0) if within is None else F.col(within)).alias("_k"), norm(v).alias("_n")).where((F.size("_v") > 0) & (F.col("_n") > 0))
    units = units.where("_k is not null").withColumn("_u", F.transform("_v", lambda x: x.cast("double") / F.col("_n"))).drop("_n")
    angle = lambda p: F.when(F.size(p) == F.size("_u"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("_u"), p)))))
    at = units.crossJoin(F.broadcast(_pivots(units, pivots))).withColumn("_angles", F.transform("_pivots", angle)).drop("_pivots", "_u")  # one row
    at = at.withColumn("_own", F.array_min("_angles")).withColumn("_cell", F.when(F.col("_own").isNull(), -1).otherwise(F.array_position("_angles", F.col("_own")).cast("int") - 1)).fillna({"_own": 0.0})
    at = at.withColumn("_size", F.size("_v"))
    wide = at.groupBy("_k", "_size", "_cell").agg(F.max("_own").alias("_widest"))
    cells = wide.groupBy(F.col("_k").alias("_ck"), F.col("_size").alias("_cs")).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_widest"))).alias("_cells"))  # an entry per pivot
    met = at.join(cells, (F.col("_k") == F.col("_ck")) & (F.col("_size") == F.col("_cs")))
    lower = F.filter(F.map_keys("_cells"), lambda c: (c >= 0) & (c < F.col("_cell")) & (F.get(F.col("_angles"), c) <= F.element_at("_cells", c) + reach))
    places = F.concat(F.array(F.struct(F.col("_cell").alias("c"), F.col("_own").alias("t"), F.lit(True).alias("home"))), F.transform(lower, lambda c: F.struct(c.alias("c"), F.get(F.col("_angles"), c).alias("t"), F.lit(False).alias("home"))))
    met = met.select("_id", "_v", "_k", "_size", F.explode(places).alias("p")).select("_id", "_v", "_k", "_size", "p.*").withColumn("_band", F.floor(F.col("t") / reach).cast("int"))
    home = met.where("home").select(F.col("_id").alias("_i"), F.col("_v").alias("_a"), F.col("t").alias("_ta"), "_k", "_size", "c", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)).alias("_band"))
    other = met.select(F.col("_id").alias("_j"), F.col("_v").alias("_b"), F.col("t").alias("_tb"), "home", "_k", "_size", "c", "_band")
    pairs = home.join(other, ["_k", "_size", "c", "_band"]).where((F.abs(F.col("_ta") - F.col("_tb")) <= reach) & (~F.col("home") | (F.col("_i") < F.col("_j"))) & (F.col("_i") != F.col("_j")))
    return pairs.select(F.least("_i", "_j").alias("left_id"), F.greatest("_i", "_j").alias("right_id"), "_a", "_b", "_k")


def pair_candidates(nodes: DataFrame, threshold: float, blocked: DataFrame | Column | None = None, node_id: str = "node_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """Node pairs (left_id < right_id) of one compatible class with a cosine of at least the threshold, without the blocked ones.

    blocked: a table of pairs, or a condition on left_id and right_id where blocked pairs are a rule: a table of them would be as large as all pairs.
    For a threshold above 0 blocks of vectors meet (blocks.pairs_above); at or below 0, where empty and zero vectors count as well,
    all pairs of a class meet as rows.
    """
    if threshold > 0:
        pairs = pairs_above(nodes, threshold, node_id, vector, within)
    else:
        key = F.lit(0) if within is None else F.col(within)
        a = nodes.select(F.col(node_id).alias("left_id"), F.col(vector).alias("_a"), key.alias("_k"))
        b = nodes.select(F.col(node_id).alias("right_id"), F.col(vector).alias("_b"), key.alias("_k"))
        pairs = a.join(b, "_k").where("left_id < right_id").withColumn("similarity", cosine(F.col("_a"), F.col("_b"))).where(F.col("similarity") >= threshold)
    pairs = pairs.select("left_id", "right_id", *([] if within is None else [F.col("_k").alias(within)]), "similarity")
    if isinstance(blocked, Column):
        return pairs.where(~F.coalesce(blocked, F.lit(False)))
    return pairs if blocked is None else pairs.join(blocked, ["left_id", "right_id"], "left_anti")


def complete_links_above(members: DataFrame, group: str, threshold: float, member_id: str, vector: str = "embedding") -> DataFrame:
    """(left_group < right_group, similarity) of the groups whose member pairs all have a cosine of at least the threshold (> 0): the least of them.

    One pair of members below the threshold tells that two groups are not linked, so groups meet first by one member each (pairs_above),
    then by WITNESSES of each; only pairs of groups that pass meet as a whole.
    """
    checkpoints(members.sparkSession)
    named = members.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(member_id).alias("m"), F.col(vector).alias("v"))
    one = named.groupBy("g").agg(F.min_by("v", F.struct(F.xxhash64("m"), "m")).alias("v"))
    pairs = pairs_above(one, threshold, "g", "v", None).select(F.col("left_id").alias("left_group"), F.col("right_id").alias("right_group")).checkpoint()
    sizes = named.groupBy("g").agg(F.ceil(F.count("*") / WITNESSES).alias("_of"))
    some = named.join(sizes, "g").where(F.pmod(F.xxhash64("m", F.lit(1)), F.col("_of")) == 0)  # about WITNESSES of a group, perhaps none
    apart = complete_links(some, "g", "v", pairs).where(F.col("similarity") < threshold)
    pairs = pairs.join(apart, ["left_group", "right_group"], "left_anti").checkpoint()
    return complete_links(named, "g", "v", pairs).where(F.col("similarity") >= threshold)


def complete_links(members: DataFrame, group: str, vector: str = "embedding", pairs: DataFrame | None = None) -> DataFrame:
    """Least cosine over the member pairs of two groups, for the given pairs (left_group < right_group) or every pair of groups.

    Members meet in blocks (least_cosines); where given pairs of groups have few of the member pairs that would meet so, members meet as rows,
    by group pair, an equi-join that skew handling can split.
    """
    if pairs is None:
        return least_cosines(members, group, vector, None)
    sizes = members.groupBy(F.col(group).alias("left_group")).agg(F.count("*").alias("_l"))
    met = pairs.select("left_group", "right_group").join(sizes, "left_group").join(sizes.select(F.col("left_group").alias("right_group"), F.col("_l").alias("_r")), "right_group")
    n, in_blocks = met.agg(F.sum(F.col("_l") * F.col("_r")), F.sum(F.greatest(F.lit(BLOCK), "_l") * F.greatest(F.lit(BLOCK), "_r"))).first()
    total = sizes.agg(F.sum("_l")).first()[0] or 0
    if n and n * ROW_COST >= min(total * total, in_blocks):
        return least_cosines(members, group, vector, pairs)
    a = members.select(F.col(group).alias("left_group"), F.col(vector).alias("_a"))
    b = members.select(F.col(group).alias("right_group"), F.col(vector).alias("_b"))
    met = pairs.select("left_group", "right_group").join(a, "left_group").join(b, "right_group")
    return met.groupBy("left_group", "right_group").agg(F.min(cosine(F.col("_a"), F.col("_b"))).alias("similarity"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs in order; a node whose listed pairs end before it is matched is open, and so is who meets it from then on."""
    used, open_ = set(), set()
    for rows in batches:
        taken = []
        for at, (left, right, left_ends, right_ends) in enumerate(zip(rows["left_id"], rows["right_id"], rows["left_ends"], rows["right_ends"])):
            if left not in used and right not in used:
                if left in open_ or right in open_:
                    open_ |= {left, right}
                else:
                    used |= {left, right}
                    taken.append(at)
            open_ |= {x for x, ends in ((left, left_ends), (right, right_ends)) if ends and x not in used}
        yield rows.iloc[taken][["left_id", "right_id", "similarity"]]


def _dominant(left: DataFrame) -> DataFrame:
    """The pairs that come first for both of their nodes: a scan takes each of them."""
    key = F.struct((-F.col("similarity")).alias("s"), "left_id", "right_id").alias("k")
    ends = left.select(F.explode(F.array("left_id", "right_id")).alias("id"), key)
    best = ends.groupBy("id").agg(F.min("k").alias("k"))
    twice = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2")
    return twice.select(F.col("k.left_id").alias("left_id"), F.col("k.right_id").alias("right_id"), (-F.col("k.s")).alias("similarity"))


def greedy_matching(pairs: DataFrame, listed: int | None = None) -> DataFrame:
    """The matching of a scan by (similarity desc, ids) until no pair is left.

    While there are more nodes than one task should scan (SCANNED), a round takes all pairs that come first for both of their nodes, or,
    every other time (many equal pairs give few of those), scans the first SCANNED pairs of the order.  Then a round scans the best `listed` pairs
    of every node (None: about SCANNED pairs in all) and takes those that no unlisted pair can come before.  Pairs of matched
    nodes go after each round, and the first pair is always taken.  Pairs without an id or a similarity are no candidates.
    """
    checkpoints(pairs.sparkSession)
    share_package(pairs.sparkSession)
    left, out, turn = pairs.select("left_id", "right_id", "similarity").na.drop().checkpoint(), None, 0
    kinds, order = dict(left.dtypes), [F.desc("similarity"), F.col("left_id"), F.col("right_id")]
    schema = f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, similarity {kinds['similarity']}"
    while not left.isEmpty():
        ends = left.withColumn("id", F.col("left_id")).unionByName(left.withColumn("id", F.col("right_id")))
        nodes = ends.select("id").distinct().count()
        turn += 1
        if nodes > SCANNED and turn % 2:
            taken = _dominant(left).select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("left_id", "right_id", "similarity")))
        else:
            if nodes > SCANNED:
                near = left.orderBy(*order).limit(SCANNED).withColumns({"left_ends": F.lit(False), "right_ends": F.lit(False)})
            else:
                most = listed or max(1, SCANNED // nodes)
                own = Window.partitionBy("id")
                near = ends.withColumns({"_k": F.row_number().over(own.orderBy(*order)), "_n": F.count("*").over(own)}).where(F.col("_k") <= most)
                last = (F.col("_k") == most) & (F.col("_n") > most)
                near = near.groupBy("left_id", "right_id", "similarity").agg(F.max(last & (F.col("id") == F.col("left_id"))).alias("left_ends"), F.max(last & (F.col("id") == F.col("right_id"))).alias("right_ends"))
            scanned = near.repartition(1).sortWithinPartitions(*order)  # at most SCANNED pairs, or `listed` of a node
            taken = scanned.mapInPandas(_scan, schema)
        taken = taken.checkpoint()
        out = taken if out is None else out.unionByName(taken)
        used = taken.select(F.col("left_id").alias("id")).unionByName(taken.select(F.col("right_id").alias("id")))
        left = left.join(used, left.left_id == used.id, "left_anti").join(used, left.right_id == used.id, "left_anti").checkpoint()
    return left if out is None else out


def _in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of equal vectors in the order of their ids, group after group: each meets the first that waits and is not blocked for it."""
    group, waiting = None, []
    for rows in batches:
        taken = []
        for one, node, blocked, similarity in zip(rows["_group"], rows["_id"], rows["_blocked"], rows["_same"]):
            if one != group:
                group, waiting = one, []
            never = () if blocked is None else set(blocked)
            at = next((i for i, other in enumerate(waiting) if other not in never), None)
            if at is None:
                waiting.append(node)
            else:
                taken.append((waiting.pop(at), node, similarity))
        yield pd.DataFrame(taken, columns=["left_id", "right_id", "similarity"])


def _copies(nodes: DataFrame, threshold: float, blocked: DataFrame | None) -> DataFrame | None:
    """The pairs that a scan takes among nodes of equal vectors (_id, _vs, _k): these come before all others of their nodes.

    That holds where no other vector of the class points the same way and a node has one class; other nodes are left to the lists.  None: no copies.
    """
    if threshold > 1 - 1e-9 or nodes.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return None
    one = nodes.where(F.size(F.array_distinct("_vs")) == 1).select("_id", "_k", F.get("_vs", F.lit(0)).alias("_v"))
    same = one.groupBy("_k", "_v").agg(F.count("*").alias("_n"), F.min("_id").alias("_group")).where("_n > 1 and _k is not null").checkpoint()
    if same.isEmpty():
        return None
    every = nodes.select("_k", F.explode("_vs").alias("_v")).distinct().withColumn("_at", F.sha2(F.to_json(F.struct("_k", "_v")), 256))
    like = pairs_above(every, 1 - 1e-9, "_at", "_v", "_k")
    unsafe = every.join(like.select(F.explode(F.array("left_id", "right_id")).alias("_at")).distinct(), "_at", "left_semi").select("_k", "_v")
    same = same.join(unsafe, ["_k", "_v"], "left_anti").withColumn("_same", cosine(F.col("_v"), F.col("_v"))).where(F.col("_same") >= threshold)
    met = one.join(same, ["_k", "_v"]).select("_group", "_id", "_same")
    before = met.withColumn("_blocked", F.lit(None).cast(f"array<{dict(met.dtypes)['_id']}>"))
    if blocked is not None:  # a node has few blocked pairs
        before = met.join(blocked.groupBy(F.col("right_id").alias("_id")).agg(F.collect_set("left_id").alias("_blocked")), "_id", "left")
    kind = dict(met.dtypes)["_id"]
    return before.repartition("_group").sortWithinPartitions("_group", "_id").mapInPandas(_in_turn, f"left_id {kind}, right_id {kind}, similarity double")


def nearest_matching(nodes: DataFrame, threshold: float, node_id: str = "node_id", vectors: str = "vectors", within: str | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """The matching that greedy_matching finds among all pairs of a class (`within`) that are as similar as the threshold (> 0) and not blocked, without making these pairs.

    Two nodes are as similar as their least similar vectors (`vectors`: a list of vectors per node; a node may have a row for each of its classes).
    A round lists the best partners of every open node, about SCANNED in all, and scans them as greedy_matching does; with more nodes than that it takes the pairs
    that are best for both.  Nodes of equal vectors meet first (_copies): their lists would name the same few.
    """
    checkpoints(nodes.sparkSession)
    share_package(nodes.sparkSession)
    held = nodes.select(F.col(node_id).alias("_id"), F.col(vectors).alias("_vs"), (F.lit(0) if within is None else F.col(within)).alias("_k")).where("_id is not null")
    kind, order = dict(held.dtypes)["_id"], [F.desc("similarity"), F.col("left_id"), F.col("right_id")]
    schema = f"left_id {kind}, right_id {kind}, similarity double"
    most = 0
    if blocked is not None:
        blocked = blocked.select("left_id", "right_id")
        most = blocked.select(F.explode(F.array("left_id", "right_id")).alias("_id")).groupBy("_id").count().agg(F.max("count")).first()[0] or 0
    out, taken = None, _copies(held, threshold, blocked)
    while True:
        if taken is not None:
            taken = taken.checkpoint()
            if out is not None and taken.isEmpty():
                return out
            out = taken if out is None else out.unionByName(taken)
        gone = None if out is None else out.select(F.explode(F.array("left_id", "right_id")).alias("_id"))
        left = held if gone is None else held.join(gone, "_id", "left_anti")
        n, rows = left.agg(F.count_distinct("_id"), F.count("*")).first()
        listed = max(1, SCANNED // max(1, n))
        own = Window.partitionBy("_i").orderBy(F.desc("similarity"), "_j")
        lists = best_partners(left, threshold, listed + most, "_id", "_vs", "_k").select("_i", "_j", "similarity", F.least("_i", "_j").alias("left_id"), F.greatest("_i", "_j").alias("right_id"))
        lists = lists.where("_i <> _j")
        if rows > n:  # two classes of a node can name the same partner
            lists = lists.distinct()
        if blocked is not None:
            lists = lists.join(blocked, ["left_id", "right_id"], "left_anti")
        near = lists.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= listed).withColumn("_last", F.col("_n") == listed)
        near = near.groupBy("left_id", "right_id", "similarity").agg(F.max(F.col("_last") & (F.col("_i") == F.col("left_id"))).alias("left_ends"), F.max(F.col("_last") & (F.col("_i") == F.col("right_id"))).alias("right_ends"))
        if n > SCANNED:
            taken = _dominant(near).select("left_id", "right_id", "similarity")
        else:
            taken = near.repartition(1).sortWithinPartitions(*order).mapInPandas(_scan, schema)  # at most SCANNED pairs, or one of a node
        if out is None:
            out = nodes.sparkSession.createDataFrame([], schema)


def routing_thresholds(similarities: DataFrame, by: str, margin: float = 0.0, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """(by, similarity, covered): midpoint of the least covered and the greatest other similarity, moved by the margin."""
    sums = similarities.groupBy(by).agg(
        F.min(F.when(F.col("covered"), F.col("similarity"))).alias("lowest_positive"), F.max(F.when(~F.col("covered"), F.col("similarity"))).alias("highest_negative")
    )
    middle = F.coalesce((F.col("lowest_positive") + F.col("highest_negative")) / 2, F.col("lowest_positive"), F.lit(most))
    return sums.withColumn("threshold", F.greatest(F.lit(least), F.least(F.lit(most), middle + margin)))


def backoff(rows: DataFrame, rules: DataFrame, keys: list[Column], default: str, rule_key: str = "rule_key", action: str = "action") -> DataFrame:
    """The action of the first key, in order, that has a rule; rule tables hold one row per key and are joined by key."""
    found, actions = rows, []
    for i, key in enumerate(keys):
        named = rules.select(F.col(rule_key).alias(f"_k{i}"), F.col(action).alias(f"_a{i}"))
        found = found.withColumn(f"_q{i}", key).join(named, F.col(f"_q{i}") == F.col(f"_k{i}"), "left").drop(f"_k{i}", f"_q{i}")
        actions.append(F.col(f"_a{i}"))
    level = F.lit(None).cast("int")
    for i in reversed(range(len(keys))):
        level = F.when(actions[i].isNotNull(), F.lit(i)).otherwise(level)
    return found.withColumns({"action": F.coalesce(*actions, F.lit(default)), "rule_level": level}).drop(*(f"_a{i}" for i in range(len(keys))))


def route_tree(items: DataFrame, nodes: DataFrame, depth: int, item: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Descent from the most similar root to the most similar eligible child, level by level: item, node_id, similarity, steps.

    nodes: node_id, parent_id (NULL: a root), centroid, threshold; a child is eligible from its threshold on.  Items
    meet only the children of the node that they have reached; a node has few children.
    """
    child = nodes.select(F.col("parent_id").alias("_parent"), F.col("node_id").alias("_id"), F.col("centroid").alias("_v"), F.col("threshold").alias("_t"))
    roots = nodes.where("parent_id is null").select("node_id", "centroid")
    at = nearest_node(items.select(item, vector), roots).withColumn("steps", F.lit(0))
    for step in range(1, depth + 1):
        similar = cosine(F.col(vector), F.col("_v"))
        met = at.join(child, F.col("node_id") == F.col("_parent")).withColumn("_s", similar).where(F.col("_s") >= F.col("_t"))
        best = met.groupBy(item).agg(F.max(F.struct("_s", "_id")).alias("_b"))
        moved = at.join(best, item, "left")
        at = moved.select(
            item, vector, F.coalesce("_b._id", "node_id").alias("node_id"), F.coalesce("_b._s", "similarity").alias("similarity"), F.when(F.col("_b").isNotNull(), F.lit(step)).otherwise(F.col("steps")).alias("steps")
        )
    return at.drop(vector)
