"""Deterministic sampling, quotas and splits.

Positions come from row_number inside a group.  Where a position over all rows is needed, positioned()
adds per-range counts to positions inside ranges, so no single task sorts the table.  Quota tables have
one row per group or label.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gaugework.functions.text import stable_rank
from gaugework.workers import share_package

#: Ranges into which positioned() cuts an order: leading hex digits of a hash.
_DIGITS = 3


def positioned(rows: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """0-based position in the order of sha256(key); at most 16 ** 3 ranges are counted on their own."""
    h = F.sha2(F.col(key).cast("string"), 256)
    cut = rows.withColumns({"_h": h, "_range": F.left(h, F.lit(_DIGITS))})
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # 4096 rows at most
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    return cut.withColumn("_i", inside).join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_i")).drop("_h", "_range", "_i", "_base")


def placed_within(rows: DataFrame, by: list[str], order: list[Column], cut: Column, name: str) -> DataFrame:
    """0-based position inside each group of `by`, in `order`; cut: a range number that does not fall along that order.

    A group is counted range by range, so that a group with most of the rows is not sorted in one task.
    """
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    inside = rows.withColumn("_range", cut).withColumn("_inside", F.row_number().over(w) - 1)
    counts = inside.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(c).alias(f"_by{i}") for i, c in enumerate([*by, "_range"])]
    bases = counts.select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row per group and range
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate([*by, "_range"])))
    return inside.join(bases, same).withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_base", *(f"_by{i}" for i in range(len(by) + 1)))


def hash_range(rank: Column) -> Column:
    """Ranges of a hexadecimal hash: its leading digits."""
    return F.left(rank, F.lit(_DIGITS))


def key_range(rows: DataFrame, key: str) -> Column:
    """Ranges of a numeric key between about even percentiles (63 numbers on the driver); one range for other keys."""
    if not isinstance(rows.schema[key].dataType, NumericType):
        return F.lit(0)
    bounds = rows.agg(F.percentile_approx(key, [i / 64 for i in range(1, 64)], 1000)).first()[0]
    return sum((F.coalesce(F.col(key) > b, F.lit(False)).cast("int") for b in sorted(set(bounds or []))), F.lit(0))


def is_evenly_spaced(position: Column, n: Column, k: Column) -> Column:
    """Whether a position of n is among floor(i n / k) for i < k."""
    i = F.ceil(position * k / n)
    return (k > 0) & (i < k) & (F.floor(i * n / F.greatest(k, F.lit(1))) == position)


def target_count(n: Column, ratio: float) -> Column:
    """max(1, n * ratio rounded half-even); 0 for a ratio of 0."""
    share = max(0.0, min(1.0, ratio))
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n * F.lit(share)))).otherwise(0).cast("long") if share > 0 else F.lit(0).cast("long")


def proportional_quotas(sizes: DataFrame, group: str, total: Column | int) -> DataFrame:
    """(group, n) -> quota by largest remainder, earlier groups first on ties; a few rows."""
    every = Window.partitionBy()
    raw = F.col("_t") * F.col("n") / F.col("_all")
    rows = sizes.withColumn("_all", F.sum("n").over(every)).withColumn("_t", F.least(F.lit(total) if isinstance(total, int) else total, F.col("_all")))
    rows = rows.withColumns({"_base": F.floor(raw), "_rest": raw - F.floor(raw)})
    rows = rows.withColumn("_left", F.col("_t") - F.sum("_base").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), group))
    return rows.select(group, "n", F.least(F.col("n"), F.col("_base") + (rank <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def balanced_quotas(sizes: DataFrame, group: str, total: int) -> DataFrame:
    """(group, n) -> quota as even as sizes allow, earlier groups first: the unit j of a group is taken in round j.

    Rounds are found from the sizes alone (a few rows), not by dealing out units.
    """
    every = Window.partitionBy()
    ordered = Window.orderBy("n", group)
    rows = sizes.withColumns({"_i": F.row_number().over(ordered) - 1, "_g": F.count("*").over(every), "_t": F.least(F.lit(total).cast("long"), F.sum("n").over(every))})
    below = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A group is filled whole if all groups can be given its size.
    rows = rows.withColumn("_before", below).withColumn("_whole", (F.col("_before") + (F.col("_g") - F.col("_i")) * F.col("n")) <= F.col("_t"))
    used = F.sum(F.when(F.col("_whole"), F.col("n")).otherwise(0)).over(every)
    open_ = F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(every)
    rows = rows.withColumns({"_rest": F.col("_t") - used, "_open": open_})
    place = F.row_number().over(Window.partitionBy("_whole").orderBy(group)) - 1
    level = F.floor(F.col("_rest") / F.greatest(F.col("_open"), F.lit(1)))
    extra = (place < F.col("_rest") - level * F.col("_open")).cast("int")
    return rows.select(group, "n", F.when(F.col("_whole"), F.col("n")).otherwise(level + extra).cast("long").alias("quota"))


def take_evenly(rows: DataFrame, group: str, key: str, quotas: DataFrame) -> DataFrame:
    """Evenly spaced rows of each group in the order of key; quotas: (group, n, quota)."""
    at = placed_within(rows, [group], [F.col(key)], key_range(rows, key), "_pos")
    placed = at.join(F.broadcast(quotas.select(group, "n", "quota")), group)  # a row per group
    return placed.where(is_evenly_spaced(F.col("_pos"), F.col("n"), F.col("quota"))).drop("_pos", "n", "quota")


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"))


def stratified(rows: DataFrame, group: str, key: str, ratio: float) -> DataFrame:
    """A share of the rows, dealt to groups in proportion, evenly spaced inside each."""
    sizes = group_sizes(rows, group).withColumn("_total", target_count(F.sum("n").over(Window.partitionBy()), ratio))
    quotas = proportional_quotas(sizes, group, F.col("_total"))
    return take_evenly(rows, group, key, quotas)


def balanced(rows: DataFrame, group: str, key: str, total: int) -> DataFrame:
    return take_evenly(rows, group, key, balanced_quotas(group_sizes(rows, group), group, total))


def split_groups(rows: DataFrame, split: str, group: str, ratios: dict[str, float], default: float = 1.0, offsets: dict[str, int] | None = None) -> DataFrame:
    """Evenly spaced whole groups of each split, after rotating the sorted groups by the split's offset."""
    groups = rows.select(split, group).distinct()
    n = F.count("*").over(Window.partitionBy(split))
    i = F.row_number().over(Window.partitionBy(split).orderBy(group)) - 1
    shift = F.lit(0)
    for name, by in (offsets or {}).items():
        shift = F.when(F.col(split) == name, F.lit(by)).otherwise(shift)
    want = target_count(F.col("_n"), default)
    for name, r in ratios.items():
        want = F.when(F.col(split) == name, target_count(F.col("_n"), r)).otherwise(want)
    placed = groups.withColumns({"_n": n, "_i": i}).withColumn("_i", F.pmod(F.col("_i") - shift, F.col("_n"))).withColumn("_k", want)
    chosen = placed.where(is_evenly_spaced(F.col("_i"), F.col("_n"), F.col("_k"))).select(split, group)
    return rows.join(chosen, [split, group], "left_semi")


def holdout(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """`part` is validation for the first round(n * fraction) keys in the order of sha256(seed:key), else training."""
    ranked = positioned(rows.withColumn("_ranked", F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), "_ranked", "_pos")
    n = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("_rows")))
    total = rows.agg(F.count("*").alias("_rows"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("part", F.when(F.col("_pos") < n, "validation").otherwise("training")).drop("_ranked", "_pos", "_rows")  # one row


def round_robin(rows: DataFrame, group: str, key: str, total: int) -> DataFrame:
    """The first rows when groups are visited in turn: at most `total` rows of each group are kept before the last step."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("turn", i).where(F.col("turn") <= total).orderBy("turn", group).limit(total)


def nested_shares(rows: DataFrame, group: str, key: str, shares: list[tuple[str, float]], seed: int = 0, rest: str = "final") -> DataFrame:
    """Nested samples per group in one hash order: the first share that holds a row names its `part`."""
    sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("_rank", stable_rank(seed, F.col(key)))
    placed = placed_within(ranked, [group], [F.col("_rank"), F.col(key)], hash_range(F.col("_rank")), "_i")
    part = None
    for name, share in shares:
        inside = F.col("_i") < F.ceil(F.col("_n") * F.lit(share))
        part = F.when(inside, name) if part is None else part.when(inside, name)
    z = placed.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_of")))  # a row per group
    return z.withColumn("part", part.otherwise(rest)).drop("_rank", "_i", "_n", "_of")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    i = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", i).where(F.col("rank") <= k)


def tiered_top(rows: DataFrame, group: list[str], tier: Column, order: list[Column], k: int) -> DataFrame:
    """The first k of a group, tier by tier; a shortage is told by `short`."""
    chosen = top_per_group(rows.withColumn("tier", tier), group, [F.col("tier"), *order], k)
    return chosen.withColumn("short", F.count("*").over(Window.partitionBy(*group)) < k)


def boundary_cases(rows: DataFrame, bucket: str, task: str, key: str, per_bucket: int) -> DataFrame:
    """Up to per_bucket rows of each bucket: each task's first row before any task's second."""
    turn = F.row_number().over(Window.partitionBy(bucket, task).orderBy(key))
    return top_per_group(rows.withColumn("_turn", turn).where(F.col("_turn") <= per_bucket), [bucket], [F.col("_turn"), F.col(key)], per_bucket).drop("_turn")


def select_units(units: DataFrame, by: list[str], cap: int, anomaly: Column) -> DataFrame:
    """At most cap units of each group: a third by anomaly, the rest at even strides of the timeline.

    units: by..., unit_id, start_seconds.  `selected` marks them; all units come back.
    """
    w = Window.partitionBy(*by)
    rows = units.withColumns({"_n": F.count("*").over(w), "_x": F.row_number().over(w.orderBy(F.desc(anomaly), "unit_id"))})
    extreme = F.lit(min(max(1, cap // 3), cap))
    rows = rows.withColumn("_extreme", F.col("_x") <= extreme)
    slots, rest = cap - min(max(1, cap // 3), cap), F.col("_n") - extreme
    i = F.row_number().over(Window.partitionBy(*by, "_extreme").orderBy("start_seconds", "unit_id")) - 1
    rows = rows.withColumn("_i", i)
    # Slot s takes floor((s + 0.5) * stride); the slot that may take place i is found back from i.
    stride = rest / F.lit(max(1, slots))
    near = F.greatest(F.lit(0), F.ceil(F.col("_i") / stride - 0.5))
    hit = F.exists(F.array(near - 1, near, near + 1), lambda s: (s >= 0) & (s < slots) & (F.least(rest - 1, F.floor((s + 0.5) * stride)) == F.col("_i")))
    chosen = (F.col("_n") <= cap) | ((F.lit(cap) > 0) & (F.col("_extreme") | ((F.lit(slots) > 0) & (rest > 0) & hit)))
    return rows.withColumn("selected", chosen).drop("_n", "_x", "_extreme", "_i")


def _turns(counts: pd.DataFrame) -> pd.DataFrame:
    """(inner, n) of one outer group -> phases: inner, before (its rows taken earlier), until, first (turn), place, width.

    In a phase the same inner groups have rows left; turn t goes to the one at place t mod width, and the phase ends with the turn that empties
    one of them.  There are as many phases as inner groups.
    """
    left = {k: int(n) for k, n in sorted(zip(counts["_inner"], counts["_n"])) if n}
    taken, turn, out = dict.fromkeys(left, 0), 0, []
    while left:
        width = len(left)
        first = {k: turn + (i - turn) % width for i, k in enumerate(left)}
        end = min(first[k] + (n - 1) * width for k, n in left.items())
        for i, k in enumerate(left):
            more = (end - first[k]) // width + 1 if end >= first[k] else 0
            out.append((k, taken[k], taken[k] + more, first[k], width))
            taken[k] += more
        left = {k: n - (out[len(out) - width + i][2] - out[len(out) - width + i][1]) for i, (k, n) in enumerate(left.items())}
        left = {k: n for k, n in left.items() if n}
        turn = end + 1
    return pd.DataFrame(out, columns=["_inner", "_before", "_until", "_first", "_width"])


def alternate(rows: DataFrame, outer: str, inner: str, key: str, limit: int | None, seed: int) -> DataFrame:
    """The first `limit` rows, with their turn and position, when the outer groups take turns and each goes through its inner groups in turn.

    Rows of an inner group come in the order of a seeded hash of key; a group without rows left is passed over.  A row's turn
    follows from its place in its group and from the groups' sizes, so no rotation over rows is run.  Rows of equal turn stand in the order of
    their outer groups.  limit None, or no fewer than the rows: all rows, in hash order.  A null group is a group named "".
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    share_package(rows.sparkSession)
    ranked = rows.withColumns({"_rank": F.sha2(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")), 256), "_outer": F.coalesce(F.col(outer).cast("string"), F.lit("")), "_inner": F.coalesce(F.col(inner).cast("string"), F.lit(""))})
    counts = ranked.groupBy("_outer", "_inner").agg(F.count("*").alias("_n"))
    if limit is None or limit >= (counts.agg(F.sum("_n")).first()[0] or 0):
        none = F.lit(None).cast("long")
        return ranked.withColumns({"turn": none, "position": none}).orderBy("_rank", key).drop("_rank", "_outer", "_inner")

    def phases(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _turns(part).assign(_outer=key[0])

    planned = counts.groupBy("_outer").applyInPandas(phases, "_inner string, _before long, _until long, _first long, _width long, _outer string")  # a row per inner group and phase
    placed = placed_within(ranked, ["_outer", "_inner"], [F.col("_rank"), F.col(key)], hash_range(F.col("_rank")), "_i")
    planned = planned.select(F.col("_outer").alias("_po"), F.col("_inner").alias("_pi"), "_before", "_until", "_first", "_width")
    met = placed.join(planned, (F.col("_outer") == F.col("_po")) & (F.col("_inner") == F.col("_pi")) & (F.col("_i") >= F.col("_before")) & (F.col("_i") < F.col("_until")))
    met = met.withColumn("turn", F.col("_first") + (F.col("_i") - F.col("_before")) * F.col("_width"))
    # Before a row stand the rows of earlier turns, and those of its turn in earlier outer groups.
    totals = counts.groupBy("_outer").agg(F.sum("_n").alias("t")).agg(F.collect_list(F.struct(F.col("_outer").alias("o"), "t")).alias("_totals"))  # an entry per outer group
    earlier = F.aggregate("_totals", F.lit(0).cast("long"), lambda s, x: s + F.least(x["t"], F.col("turn")))
    beside = F.size(F.filter("_totals", lambda x: (x["o"] < F.col("_outer")) & (x["t"] > F.col("turn"))))
    placed = met.crossJoin(F.broadcast(totals)).withColumn("position", earlier + beside)  # one row
    return placed.where(F.col("position") < limit).select(*rows.columns, "turn", "position").orderBy("position")
