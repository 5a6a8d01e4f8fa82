"""Agreement of two scores per group: MAE, RMSE, Pearson, Spearman, Kendall tau-b, quadratic weighted kappa.

All metrics come from the counted cells (group, x, y), so the rows are shuffled once, combined on the map
side, and ranks are taken over distinct values.  Degenerate input gives NULL: fewer than 3 pairs or
a constant side for the correlations, fewer than 2 pairs or no expected disagreement for kappa.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.scoring import ratio
from gaugework.operators.sampling import key_range, placed_within


def cells(pairs: DataFrame, by: list[str], x: str = "human", y: str = "judge_raw") -> DataFrame:
    """(by..., x, y, c): how often each pair of values occurs; pairs with a NULL are left out."""
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))


def _average_rank(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of a side with their average rank (ties share it)."""
    totals = counted.groupBy(*by, value).agg(F.sum("c").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return totals.select(*by, value, (upto - (F.col("n") - 1) / 2).alias(f"rank_{value}"))


def _correlation(rows: DataFrame, by: list[str], a: str, b: str, name: str) -> DataFrame:
    """Pearson of a and b, weighted by c, from centred sums."""
    w = Window.partitionBy(*by)
    n = F.sum("c").over(w)
    centred = rows.withColumns(
        {"_n": n, "_a": F.col(a) - F.sum(F.col(a) * F.col("c")).over(w) / n, "_b": F.col(b) - F.sum(F.col(b) * F.col("c")).over(w) / n}
    )
    sums = centred.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.sum(F.expr("c * _a * _b")).alias("_ab"),
        F.sum(F.expr("c * _a * _a")).alias("_aa"),
        F.sum(F.expr("c * _b * _b")).alias("_bb"),
        (F.min(a) < F.max(a)).alias("_va"),
        (F.min(b) < F.max(b)).alias("_vb"),
    )
    value = F.when((F.col("_n") >= 3) & F.col("_va") & F.col("_vb"), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*by, value.alias(name))


def errors(counted: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("x") - F.col("y")
    return counted.groupBy(*by).agg(
        F.sum("c").alias("n"), (F.sum(F.abs(d) * F.col("c")) / F.sum("c")).alias("mae"), F.sqrt(F.sum(d * d * F.col("c")) / F.sum("c")).alias("rmse")
    )


def pearson(counted: DataFrame, by: list[str]) -> DataFrame:
    return _correlation(counted, by, "x", "y", "pearson")


def spearman(counted: DataFrame, by: list[str]) -> DataFrame:
    ranked = counted.join(_average_rank(counted, by, "x"), [*by, "x"]).join(_average_rank(counted, by, "y"), [*by, "y"])
    return _correlation(ranked, by, "rank_x", "rank_y", "spearman")


#: Cells of a group's grid of distinct values up to which kendall() fills the grid.
GRID = 1 << 20


def kendall(counted: DataFrame, by: list[str]) -> DataFrame:
    """tau-b: over the grid of values where all groups' grids are small (a rating scale), else by counted inversions; both are exact."""
    sizes = counted.groupBy(*by).agg((F.approx_count_distinct("x") * F.approx_count_distinct("y")).alias("_grid")).agg(F.max("_grid")).first()[0]
    return kendall_on_grid(counted, by) if (sizes or 0) <= GRID else kendall_by_inversions(counted, by)


def _tau(sums: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """tau-b from _n and _s (concordant less discordant pairs), or _d (discordant ones) and _txy (ties in both)."""

    def ties(value: str, name: str) -> DataFrame:
        totals = counted.groupBy(*by, value).agg(F.sum("c").cast("double").alias("t"))
        return totals.groupBy(*by).agg(F.sum(F.expr("t * (t - 1) / 2")).alias(name))

    joined = sums.join(ties("x", "_tx"), by).join(ties("y", "_ty"), by) if by else sums.crossJoin(ties("x", "_tx")).crossJoin(ties("y", "_ty"))  # one row each
    all_pairs = F.expr("_n * (_n - 1) / 2")
    spread = F.sqrt((all_pairs - F.col("_tx")) * (all_pairs - F.col("_ty")))
    if "_d" in sums.columns:
        joined = joined.withColumn("_s", all_pairs - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.col("_d"))
    return joined.select(*by, F.when(F.col("_n") >= 3, ratio(F.col("_s"), spread)).alias("kendall"))


def _dense(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., value, r_<value>: each distinct value's 0-based place; ranges of values are counted on their own."""
    distinct = counted.select(*by, value).distinct()
    return placed_within(distinct, by, [F.col(value)], key_range(distinct, value), f"r_{value}")


def kendall_by_inversions(counted: DataFrame, by: list[str], block: int = 4096) -> DataFrame:
    """tau-b for continuous scores: discordant pairs are counted bit by bit of y's place, n log n steps in all.

    Of two values of y the greater one has a 1 where they first differ, seen from the highest bit.  So for each bit, among the cells that agree in
    the bits above, a cell with a 0 makes a discordant pair with every cell with a 1 at a smaller x.  Those are a running sum in the order of
    x: inside blocks of `block` places of x, and over the blocks' sums.
    """
    placed = counted.join(_dense(counted, by, "x"), [*by, "x"]).join(_dense(counted, by, "y"), [*by, "y"]).select(*by, "c", F.col("r_x").alias("_rx"), F.col("r_y").alias("_ry"))
    bits = max(1, (placed.agg(F.max("_ry")).first()[0] or 0).bit_length())
    leveled = placed.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    one = F.expr("shiftright(_ry, _l) & 1")
    cell = leveled.groupBy(*by, "_l", F.expr("shiftright(_ry, _l + 1)").alias("_p"), F.floor(F.col("_rx") / block).alias("_b"), "_rx").agg(F.sum(F.col("c") * one).alias("_ones"), F.sum(F.col("c") * (1 - one)).alias("_zeros"))
    inside = Window.partitionBy(*by, "_l", "_p", "_b").orderBy("_rx").rangeBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("_inner", F.coalesce(F.sum("_ones").over(inside), F.lit(0)))
    blocks = cell.groupBy(*by, "_l", "_p", "_b").agg(F.sum("_ones").alias("_ones"), F.sum("_zeros").alias("_zeros"), F.sum(F.col("_zeros").cast("decimal(38,0)") * F.col("_inner")).alias("_in"))
    before = Window.partitionBy(*by, "_l", "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_ones").over(before), F.lit(0)))
    pairs = blocks.groupBy(*by).agg(F.sum(F.col("_in") + F.col("_zeros").cast("decimal(20,0)") * F.col("_before")).cast("double").alias("_d"))
    whole = counted.groupBy(*by).agg(F.sum("c").cast("double").alias("_n"), F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("_txy"))
    return _tau(whole.join(pairs, by) if by else whole.crossJoin(pairs), counted, by)  # without groups one row each


def kendall_on_grid(counted: DataFrame, by: list[str]) -> DataFrame:
    """tau-b, for scores on a grid.

    A group's cells are made cumulative over the whole grid of its distinct x and y values, so concordant
    pairs come from two running sums; no cell meets another.  The grid's size is what bounds this, not the rows.
    """
    xs = counted.select(*by, "x").distinct()
    ys = counted.select(*by, "y").distinct()
    grid = xs.join(ys, by).join(counted, [*by, "x", "y"], "left").select(*by, "x", "y", F.coalesce("c", F.lit(0)).alias("c"))
    # below(x, y): pairs with a smaller x and a smaller y; aside(x, y): a smaller x and a larger y.
    before = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    run = grid.withColumn("_left", F.coalesce(F.sum("c").over(before), F.lit(0)))
    under = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(1, Window.unboundedFollowing)
    run = run.withColumns({"_below": F.coalesce(F.sum("_left").over(under), F.lit(0)), "_aside": F.coalesce(F.sum("_left").over(over), F.lit(0))})
    sums = run.groupBy(*by).agg(F.sum(F.expr("cast(c as double) * (_below - _aside)")).alias("_s"), F.sum("c").cast("double").alias("_n"))

    return _tau(sums, counted, by)


def kappa(counted: DataFrame, by: list[str], lo: int = 1, hi: int = 5) -> DataFrame:
    """Quadratic weighted kappa of half-even rounded scores, clamped to lo..hi."""

    def level(v: str):
        return F.least(F.lit(hi), F.greatest(F.lit(lo), F.bround(v).cast("int"))).cast("double")

    z = counted.select(*by, level("x").alias("x"), level("y").alias("y"), F.col("c").cast("double").alias("c"))
    s = z.groupBy(*by).agg(
        F.sum("c").alias("_n"),
        F.sum(F.expr("c * (x - y) * (x - y)")).alias("_o"),
        F.expr("sum(c * x * x) + sum(c * y * y) - 2 * sum(c * x) * sum(c * y) / sum(c)").alias("_e"),
        (F.min(F.least("x", "y")) == F.max(F.greatest("x", "y"))).alias("_flat"),
    )
    return s.select(*by, F.when((F.col("_n") >= 2) & ~F.col("_flat"), 1 - F.col("_o") / F.col("_e")).alias("qwk"))


def agreement(pairs: DataFrame, by: list[str], x: str = "human", y: str = "judge_raw", lo: int = 1, hi: int = 5) -> DataFrame:
    """One row per group with all metrics."""
    counted = cells(pairs, by, x, y)
    out = errors(counted, by)
    for f in (pearson, spearman, kendall):
        out = out.join(f(counted, by), by)
    return out.join(kappa(counted, by, lo, hi), by)


def by_categories(pairs: DataFrame, dimension: str, categories: list[str], metric=spearman, x: str = "human", y: str = "judge_raw") -> DataFrame:
    """A metric for each dimension and each value of each category; a NULL value is the group `None`."""
    tagged = pairs.select(
        F.col(dimension),
        F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in categories))).alias("g"),
        x,
        y,
    ).select(dimension, "g.category", "g.value", x, y)
    by = [dimension, "category", "value"]
    counted = cells(tagged, by, x, y)
    return errors(counted, by).select(*by, "n").join(metric(counted, by), by)
