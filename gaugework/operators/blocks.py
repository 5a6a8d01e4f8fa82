"""Cosines between blocks of vectors: Spark deals pairs of blocks to tasks, numpy multiplies two blocks at a time.

A task holds two blocks of about BLOCK vectors, whatever the table's size.  Cosines that decide are the quotient of functions.vectors.cosine,
its sums added in the same order; the product of matrices only tells which pairs need it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.vectors import norm
from gaugework.workers import share_package

#: Vectors of a block.
BLOCK = 2048
#: Pivots at most; their angles tell which blocks lie too far apart.
PIVOTS = 64
#: Beyond the rounding of a product of matrices and of an angle.
SLACK, ANGLE_SLACK = 1e-9, 1e-6
#: Norms whose quotients round as usual.
TAME = 1e-150, 1e150
_STRIP = 512


def as_doubles(df: DataFrame, vector: str) -> Column:
    """The vector column as an array of floats or doubles."""
    return F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists without nulls as a matrix of doubles."""
    flat = pa.compute.list_flatten(column.combine_chunks())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def norms(across: np.ndarray) -> np.ndarray:
    """The norms of vectors given as columns, summed in order."""
    total = np.zeros(across.shape[1])
    with np.errstate(all="ignore"):
        for row in across:
            total += row * row
    return np.sqrt(total)


def cosines(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, left_norm: np.ndarray, right_norm: np.ndarray) -> np.ndarray:
    """The cosine of each pair of columns (i of left, j of right), summed in order."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 18):
        a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        total = np.zeros(len(a))
        with np.errstate(all="ignore"):
            for x, y in zip(left, right):
                total += x[a] * y[b]
            both = left_norm[a] * right_norm[b]
            out[at : at + (1 << 18)] = np.where(both <= 0, 0.0, total / both)
    return out


def units_of(part: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows by their norms; NaN, which no bound leaves out, where a norm lies outside TAME."""
    with np.errstate(all="ignore"):
        return np.where(((size > TAME[0]) & (size < TAME[1]))[:, None], part / size[:, None], np.nan)


def _segments(values: pa.ChunkedArray) -> list[np.ndarray]:
    """The positions of each distinct value."""
    codes = values.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []


def _pairs_kernel(threshold: float):
    """Two blocks, or one -> the pairs between them, or in it, with a cosine of at least the threshold."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        whole = not side.any()
        lefts, rights, found = [], [], []
        for rows in _segments(table.column("_k")):  # blocks of small classes hold several
            part = matrix(table.column("_v").take(pa.array(rows)))
            across = np.ascontiguousarray(part.T)
            size = norms(across)
            unit = units_of(part, size)
            a = np.arange(len(rows)) if whole else np.flatnonzero(side[rows] == 0)
            b = a if whole else np.flatnonzero(side[rows] == 1)
            for at in range(0, len(b), _STRIP):
                some = b[at : at + _STRIP]
                first = a[: at + len(some)] if whole else a
                near = ~(unit[first] @ unit[some].T < threshold - SLACK)
                if whole:
                    near[at:] = np.triu(near[at:], 1)  # each pair once
                i, j = np.nonzero(near)
                i, j = first[i], some[j]
                exact = cosines(across, across, i, j, size, size)
                keep = ~(exact < threshold)
                lefts.append(rows[i[keep]])
                rights.append(rows[j[keep]])
                found.append(exact[keep])
        i, j = (pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (lefts, rights))
        taken = table.column("_id").take(i), table.column("_id").take(j), table.column("_k").take(i), pa.array(np.concatenate(found) if found else np.zeros(0))
        return pa.table(taken, names=["_i", "_j", "_k", "similarity"])

    return run


def _with_cells(units: DataFrame, pivots: int) -> DataFrame:
    """units with _angles (to each pivot; null where the norm is not tame) and _cell, the nearest pivot's number."""
    some = units.where("_tame").orderBy(F.xxhash64("_id"), "_id").limit(pivots).select("_v").collect()  # at most PIVOTS vectors
    held: dict[int, list] = {}
    for at, (v,) in enumerate(some):
        held.setdefault(len(v), []).append((at, v))
    pivot = {n: ([at for at, _ in found], np.array([v for _, v in found]) / np.linalg.norm([v for _, v in found], axis=1)[:, None]) for n, found in held.items()}

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            angles = np.zeros((len(table), max(1, len(some))))
            for rows in _segments(table.column("_size")):
                part = matrix(table.column("_v").take(pa.array(rows)))
                at, middle = pivot.get(part.shape[1], ([], None))
                if at:
                    angles[np.ix_(rows, at)] = np.arccos(np.clip(units_of(part, norms(np.ascontiguousarray(part.T))) @ middle.T, -1, 1))
            tame = ~np.isnan(angles).any(axis=1)
            near = np.where(tame, np.argmin(angles, axis=1), -1)
            offsets = np.arange(len(table) + 1, dtype=np.int32) * angles.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(angles.ravel()), mask=pa.array(~tame))
            for found in table.append_column("_angles", lists).append_column("_cell", pa.array(near.astype(np.int32))).to_batches():
                yield found

    return units.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in units.dtypes) + ", _angles array<double>, _cell int")


def dealt(nodes: DataFrame, threshold: float, node_id: str, vector: str, within: str | None, also: tuple[str, ...] = (), times: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with _block; pairs of blocks _l <= _r that can hold a pair with a cosine of `threshold` (> 0)).  also: columns that go along; times: larger blocks.

    A class (equal `within` and length) lies in blocks by its vectors' nearest pivots; two of them whose angles to any pivot lie further apart
    than the threshold's hold no pair, by the triangle inequality.  Classes of less than half a block share one.
    """
    reach, block_size = math.acos(min(1.0, threshold)) + ANGLE_SLACK, BLOCK * times
    units = nodes.select(*also, F.col(node_id).alias("_id"), as_doubles(nodes, vector).alias("_v"), (F.lit(0) if within is None else F.col(within)).alias("_k"))
    units = units.where("_k is not null").withColumn("_n", norm(F.col("_v"))).where((F.size("_v") > 0) & (F.col("_n") > 0))
    units = units.withColumns({"_size": F.size("_v"), "_tame": (F.col("_n") > TAME[0]) & (F.col("_n") < TAME[1])})
    sizes = units.groupBy("_k", "_size").agg(F.count("*").alias("_c"))
    most, total = sizes.agg(F.max("_c"), F.sum("_c")).first()
    pivots = min(PIVOTS, -(-(most or 0) // block_size))
    small = F.col("_c") < block_size // 2
    if pivots > 1:
        at = _with_cells(units, pivots).join(sizes, ["_k", "_size"])
    else:
        at = units.join(sizes, ["_k", "_size"]).withColumns({"_angles": F.lit(None).cast("array<double>"), "_cell": F.lit(0)})
    at = at.withColumn("_cell", F.when(small, F.lit(0)).otherwise(F.col("_cell")))
    cells = at.groupBy("_k", "_size", "_cell").agg(F.count("*").alias("_cc"))
    at = at.join(cells, ["_k", "_size", "_cell"])
    packs = max(1, -(-(total or 0) // block_size))
    part = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.ceil(F.col("_cc") / block_size)))
    block = F.when(small, F.struct(F.lit(None).cast(dict(at.dtypes)["_k"]).alias("k"), F.col("_size").alias("s"), F.lit(0).alias("c"), F.pmod(F.xxhash64("_k"), F.lit(packs)).cast("long").alias("p")))
    block = block.otherwise(F.struct(F.col("_k").alias("k"), F.col("_size").alias("s"), F.col("_cell").alias("c"), part.cast("long").alias("p")))
    at = at.withColumn("_block", block)
    ends = [f(F.get("_angles", F.lit(i))).alias(f"{n}{i}") for i in range(pivots if pivots > 1 else 0) for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = at.groupBy("_block").agg(F.count("*").alias("_rows"), *ends)
    l, r = (blocks.select(F.col("_block").alias(f"_{s}"), F.col("_block.k").alias(f"_k_{s}"), F.col("_block.s").alias(f"_s_{s}"), F.col("_block.c").alias(f"_c_{s}"), F.col("_block.p").alias(f"_p_{s}"), *(F.col(e).alias(f"{s}_{e}") for e in blocks.columns if e[:2] in ("lo", "hi"))) for s in "lr")
    after = (F.col("_c_l") < F.col("_c_r")) | ((F.col("_c_l") == F.col("_c_r")) & (F.col("_p_l") < F.col("_p_r")))
    near = F.lit(True)
    for i in range(pivots if pivots > 1 else 0):
        apart = (F.col(f"r_lo{i}") - F.col(f"l_hi{i}") > reach) | (F.col(f"l_lo{i}") - F.col(f"r_hi{i}") > reach)
        near = near & ~F.coalesce(apart, F.lit(False))
    others = l.join(r, (F.col("_k_l") == F.col("_k_r")) & (F.col("_s_l") == F.col("_s_r")) & after & near).select("_l", "_r")
    return at.select(*also, "_id", "_v", "_k", "_block"), blocks.select(F.col("_block").alias("_l"), F.col("_block").alias("_r")).unionByName(others)


def sent(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row to every pair of blocks that has its block: _side 0 (left; or both) or 1."""
    left = pairs.select(F.col("_l").alias("_at"), "_l", "_r", F.lit(0).alias("_side"))
    right = pairs.where("_l <> _r").select(F.col("_r").alias("_at"), "_l", "_r", F.lit(1).alias("_side"))
    return rows.join(left.unionByName(right), rows["_block"] == F.col("_at")).drop("_at", "_block")


def pairs_above(nodes: DataFrame, threshold: float, node_id: str, vector: str, within: str | None) -> DataFrame:
    """left_id, right_id, _k, similarity: the pairs of one class (`within`) with a cosine of at least the threshold (> 0)."""
    share_package(nodes.sparkSession)
    rows, pairs = dealt(nodes, threshold, node_id, vector, within)
    kinds = dict(rows.dtypes)
    met = sent(rows, pairs).groupBy("_l", "_r").applyInArrow(_pairs_kernel(threshold), f"_i {kinds['_id']}, _j {kinds['_id']}, _k {kinds['_k']}, similarity double")
    return met.where("_i <> _j").select(F.least("_i", "_j").alias("left_id"), F.greatest("_i", "_j").alias("right_id"), "_k", "similarity")


def _least_kernel(table: pa.Table) -> pa.Table:
    """Two blocks of groups' members, or one -> the least cosine between any two groups; a NaN counts only where there is nothing else."""
    side = table.column("_side").to_numpy()
    code = table.column("_g").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    length = table.column("_size").to_numpy()
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    a, b = a[np.argsort(code[a], kind="stable")], b[np.argsort(code[b], kind="stable")]
    starts = lambda x: np.flatnonzero(np.diff(code[x], prepend=-1))
    rows, columns = starts(a), starts(b)
    found = np.full((len(rows), len(columns)), np.inf)
    sizes = np.unique(length)
    if len(sizes) > 1:  # vectors of different lengths have a cosine of 0
        has = lambda x, at: np.add.reduceat((length[x][:, None] == sizes).astype(np.int64), at, axis=0) > 0
        l, r = has(a, rows), has(b, columns)
        mixed = (l.astype(int) @ r.astype(int).T) < l.sum(1)[:, None] * r.sum(1)[None, :]
        found[mixed] = 0.0
    for n in sizes:
        x, y = a[length[a] == n], b[length[b] == n]
        if not len(x) or not len(y):
            continue
        up, down = starts(x), starts(y)
        at_row, at_column = np.searchsorted(code[a[rows]], code[x[up]]), np.searchsorted(code[b[columns]], code[y[down]])
        if n <= 0:
            part = np.zeros((len(up), len(down)))
        else:
            left, right = (matrix(table.column("_v").take(pa.array(z))) for z in (x, y))
            left_norm, right_norm = (norms(np.ascontiguousarray(z.T)) for z in (left, right))
            part = np.full((len(up), len(down)), np.inf)
            plain = ((left_norm > TAME[0]) & (left_norm < TAME[1])).all() and ((right_norm > TAME[0]) & (right_norm < TAME[1])).all()
            for at in range(0, len(x), _STRIP):
                with np.errstate(all="ignore"):
                    cosine = left[at : at + _STRIP] @ right.T
                    both = left_norm[at : at + _STRIP, None] * right_norm[None, :]
                    cosine /= both
                if not plain:
                    cosine = np.where(both <= 0, 0.0, cosine)
                    cosine[np.isnan(cosine)] = np.inf
                here = np.unique(np.searchsorted(up, np.arange(at, at + len(cosine)), side="right") - 1)
                least = np.minimum.reduceat(np.minimum.reduceat(cosine, np.maximum(up[here] - at, 0), axis=0), down, axis=1)
                part[here] = np.minimum(part[here], least)
        spot = np.ix_(at_row, at_column)
        found[spot] = np.minimum(found[spot], part)
    found[np.isposinf(found)] = np.nan
    i, j = (z.ravel() for z in np.meshgrid(a[rows], b[columns], indexing="ij"))
    other = code[i] != code[j]
    i, j = pa.array(i[other]), pa.array(j[other])
    return pa.table([table.column("_g").take(i), table.column("_g").take(j), pa.array(found.ravel()[other])], names=["_i", "_j", "similarity"])


def least_cosines(members: DataFrame, group: str, vector: str, pairs: DataFrame | None) -> DataFrame:
    """left_group < right_group, similarity: the least cosine of their members, for the given pairs of groups or all.

    Copies in a group are one member.  Groups of less than half a block share blocks, others have their own; only blocks of a wanted pair meet.
    A vector that is null, empty or has a null component has a cosine of 0 with all; see functions.vectors.cosine.
    """
    share_package(members.sparkSession)
    v = as_doubles(members, vector)
    usable = norm(v).isNotNull() & (F.size(v) > 0)  # a null component makes the norm null
    held = members.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.when(usable, v).alias("_v")).distinct().withColumn("_size", F.when(F.col("_v").isNull(), 0).otherwise(F.size("_v")))
    sizes = held.groupBy("_g").agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c")).first()[0] or 0
    packs = max(1, -(-total // BLOCK))
    small = F.col("_c") < BLOCK // 2
    own = F.pmod(F.xxhash64("_v"), F.ceil(F.col("_c") / BLOCK))
    pack = F.pmod(F.xxhash64("_g"), F.lit(packs))
    block = F.struct(F.when(~small, F.col("_g")).alias("g"), F.when(small, pack).otherwise(own).cast("long").alias("p"))
    rows = held.join(sizes, "_g").select("_g", "_v", "_size", block.alias("_block"))
    places = rows.select("_g", "_block").distinct()
    if pairs is None:
        blocks = places.select("_block").distinct()
        met = blocks.select(F.col("_block").alias("_l")).join(blocks.select(F.col("_block").alias("_r")), F.col("_l") <= F.col("_r"))
        met = met.where(F.coalesce(F.col("_l.g") != F.col("_r.g"), F.lit(True)))  # not two blocks of one group
    else:
        wanted = pairs.select("left_group", "right_group")
        met = wanted.join(places.select(F.col("_g").alias("left_group"), F.col("_block").alias("_x")), "left_group").join(places.select(F.col("_g").alias("right_group"), F.col("_block").alias("_y")), "right_group")
        met = met.select(F.least("_x", "_y").alias("_l"), F.greatest("_x", "_y").alias("_r")).distinct()
    kind = dict(rows.dtypes)["_g"]
    found = sent(rows, met).groupBy("_l", "_r").applyInArrow(_least_kernel, f"_i {kind}, _j {kind}, similarity double")
    found = found.groupBy(F.least("_i", "_j").alias("left_group"), F.greatest("_i", "_j").alias("right_group")).agg(F.min("similarity").alias("similarity"))
    return found if pairs is None else found.join(wanted.distinct(), ["left_group", "right_group"], "left_semi")


def _partners_kernel(threshold: float, most: int):
    """Two blocks of nodes, or one -> each node's best `most` partners there, equal ones in the order of their ids."""

    def best(left: np.ndarray, right: np.ndarray, vectors: tuple, starts: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> tuple:
        across, size, unit = vectors
        members = lambda nodes: np.repeat(starts[nodes] - np.cumsum(counts[nodes]) + counts[nodes], counts[nodes]) + np.arange(counts[nodes].sum())
        single, plain = counts.max() == 1, not np.isnan(unit).any()
        there, down = unit[members(right)].T, np.cumsum(counts[right]) - counts[right]
        step, found = max(1, _STRIP // int(counts.max())), []
        for at in range(0, len(left), step):
            some = left[at : at + step]
            near = unit[members(some)] @ there
            if not single:
                near = np.minimum.reduceat(np.minimum.reduceat(near, np.cumsum(counts[some]) - counts[some], axis=0), down, axis=1)
            if not plain:
                near[np.isnan(near)] = -np.inf
            if left is right:
                near[np.arange(len(some)), np.arange(at, at + len(some))] = -np.inf  # not with itself
            bound = np.full(len(some), threshold)
            high = near
            if len(right) >= 2 * most:  # the greatest of groups of columns: as many values reach their bound as theirs
                width = min(16, len(right) // most)
                high = near[:, : len(right) // width * width].reshape(len(some), width, -1).max(axis=1)
            if high.shape[1] > most:
                bound = np.maximum(bound, np.partition(high, high.shape[1] - most, axis=1)[:, high.shape[1] - most])
            i, j = np.nonzero(near >= bound[:, None] - SLACK)
            i, j = some[i], right[j]
            if single:
                exact = cosines(across, across, starts[i], starts[j], size, size)
            else:
                both = counts[i] * counts[j]
                pair, place = np.repeat(np.arange(len(i)), both), np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
                exact = cosines(across, across, starts[i][pair] + place // counts[j][pair], starts[j][pair] + place % counts[j][pair], size, size)
                exact = np.minimum.reduceat(exact, np.cumsum(both) - both) if len(i) else exact
            keep = exact >= threshold
            i, j, exact = i[keep], j[keep], exact[keep]
            order = np.lexsort((rank[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            keep = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < most
            found.append((i[keep], j[keep], exact[keep]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        rank = np.empty(len(table), dtype=np.int64)
        rank[pa.compute.sort_indices(table.column("_id").combine_chunks()).to_numpy()] = np.arange(len(table))
        out = []
        for rows in _segments(table.column("_k")):
            held = table.column("_vs").take(pa.array(rows)).combine_chunks()
            counts = pa.compute.list_value_length(held).to_numpy().astype(np.int64)
            part = matrix(pa.chunked_array([pa.compute.list_flatten(held)]))
            across = np.ascontiguousarray(part.T)
            with np.errstate(all="ignore"):
                unit = part / np.abs(part).max(axis=1)[:, None]  # vectors of any size
                unit /= np.linalg.norm(unit, axis=1)[:, None]
            vectors, starts = (across, norms(across), unit), np.cumsum(counts) - counts
            a = np.flatnonzero(side[rows] == 0)
            b = np.flatnonzero(side[rows] == 1) if side.any() else a
            for left, right in ((a, b), (b, a)) if side.any() else ((a, a),):
                if len(left) and len(right):
                    i, j, exact = best(left, right, vectors, starts, counts, rank[rows])
                    out.append((rows[i], rows[j], exact))
        i, j, exact = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table([table.column("_id").take(pa.array(i)), table.column("_id").take(pa.array(j)), pa.array(exact)], names=["_i", "_j", "similarity"])

    return run


def best_partners(nodes: DataFrame, threshold: float, most: int, node_id: str, vectors: str, within: str | None) -> DataFrame:
    """_i, _j, similarity (both ways): each node's best `most` partners of its class at the threshold (> 0), and perhaps more.

    Two nodes are as similar as their least similar vectors; `vectors` is a list of vectors, and a pair of blocks is left out by the first ones.
    """
    share_package(nodes.sparkSession)
    rows, pairs = dealt(nodes.withColumns({"_vs": F.col(vectors), "_first": F.get(vectors, F.lit(0))}), threshold, node_id, "_first", within, ("_vs",), 4)
    kind = dict(rows.dtypes)["_id"]
    return sent(rows.drop("_v"), pairs).groupBy("_l", "_r").applyInArrow(_partners_kernel(threshold, most), f"_i {kind}, _j {kind}, similarity double")
