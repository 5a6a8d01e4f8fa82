"""Exact k-means over integer vectors with ball trees that live in the partitions of the data.

Every task builds metric trees over its own vectors, at most TREE of them a tree: a ball has an integer centre, a radius,
the count and the componentwise integer sum of its vectors.  A round sends only the centroids out: a ball is
compared with its candidate centroids, a centroid goes when the triangle inequality puts it further from every vector
of the ball than the nearest one (its distance less the radius exceeds the nearest distance plus the radius), and
a ball with one candidate left is assigned whole, by its count and sum.  Otherwise its children are asked,
down to the leaves, whose vectors are compared exactly.  What comes back is a count and a sum per tree and
centroid; Spark adds them up, and the driver sees one row per centroid.

Vectors have a fixed number of components; component x counts as floor(1024 * x).  All arithmetic on vectors is in
integers; only the test with radii is in floating point, with a margin of one unit.  The trees are
written to the shared folder, so a lost executor costs its unfinished tasks.

Defined cases: a vector with another number of components, or with a null or non-finite one, or null itself, gives no row;
a vector with a null id is assigned and counted like any other, and starts a centroid only after all others; rows that repeat count each; equal
ids start in the order of their components; fewer vectors than centroids start as many centroids as there are vectors;
no vectors give an empty result; components so large that a squared distance need not fit a long (64 of them: 2^27)
raise an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm import common

#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 16_384, 48
#: Up to here sums of products of 64 components are exact in a double.
_EXACT = 1 << 22
_TREES = "ids array<bigint>, vectors binary, nodes binary, radii binary, centres binary, sums binary"


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (points x centroids), exact."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if most < _EXACT and points.shape[1] <= 128:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


class Tree:
    """A ball tree as arrays.  nodes: begin, end (of its vectors), left, right child (-1: a leaf)."""

    def __init__(self, ids: list, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray, centres: np.ndarray, sums: np.ndarray) -> None:
        self.ids, self.vectors, self.nodes, self.radii, self.centres, self.sums = ids, vectors, nodes, radii, centres, sums

    @classmethod
    def build(cls, ids: list, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, radii, centres, sums = np.arange(len(vectors)), [], [], [], []
        open_balls = [(0, len(vectors), -1, 0)]
        while open_balls:
            begin, end, parent, side = open_balls.pop()
            me, own = len(nodes), vectors[order[begin:end]]
            total = own.sum(0)
            centre = total // (end - begin)
            away = squares(own, centre[None, :])[:, 0]
            nodes.append([begin, end, -1, -1])
            radii.append(np.sqrt(float(away.max())))
            centres.append(centre)
            sums.append(total)
            if parent >= 0:
                nodes[parent][2 + side] = me
            if end - begin <= leaf or not away.any():
                continue
            # Halves along the line from one far vector to the vector furthest from it.
            one = own[away.argmax()]
            two = own[squares(own, one[None, :])[:, 0].argmax()]
            along = own.astype(np.float64) @ (two - one).astype(np.float64)
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(along, half)]
            open_balls += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
        return cls([ids[i] for i in order.tolist()], vectors[order], np.array(nodes, np.int32), np.array(radii), np.array(centres, np.int64), np.array(sums, np.int64))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whole balls, their centroid, vectors of undecided leaves, their centroid); equally near: the smaller number."""
        k = len(centroids)
        asked, candidates = np.zeros(1, np.int64), np.ones((1, k), bool)
        balls, at, rest, rest_at = [], [], [], []
        while len(asked):
            far = np.sqrt(squares(self.centres[asked], centroids).astype(np.float64))
            far[~candidates] = np.inf
            candidates = far <= far.min(1)[:, None] + 2 * self.radii[asked][:, None] + 1
            whole = candidates.sum(1) == 1
            balls.append(asked[whole])
            at.append(candidates[whole].argmax(1))
            asked, candidates = asked[~whole], candidates[~whole]
            leaves = self.nodes[asked, 2] < 0
            if leaves.any():
                spans = self.nodes[asked[leaves], :2]
                own = np.concatenate([np.arange(b, e) for b, e in spans.tolist()])
                exact = squares(self.vectors[own], centroids)
                # A centroid that is no candidate is further away than the nearest one, so it never wins.
                rest.append(own)
                rest_at.append(exact.argmin(1))
            children = self.nodes[asked[~leaves], 2:]
            asked, candidates = children.reshape(-1).astype(np.int64), np.repeat(candidates[~leaves], 2, axis=0)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (balls, at, rest, rest_at))

    def row(self) -> list:
        return [self.ids, *(np.ascontiguousarray(x).tobytes() for x in (self.vectors, self.nodes, self.radii, self.centres, self.sums))]

    @classmethod
    def of(cls, row: list, dims: int) -> Tree:
        shaped = lambda raw, kind, width: np.frombuffer(raw, kind).reshape(-1, width)
        ids, vectors, nodes, radii, centres, sums = row
        return cls(ids, shaped(vectors, np.int64, dims), shaped(nodes, np.int32, 4), np.frombuffer(radii, np.float64), shaped(centres, np.int64, dims), shaped(sums, np.int64, dims))


def _built(batches: Iterator[pa.RecordBatch], dims: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray]] = []
    size = 0

    def tree() -> pa.RecordBatch:
        ids = pa.concat_arrays([x for x, _ in held]).to_pylist()
        made = Tree.build(ids, np.concatenate([x for _, x in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made.row(), schema)], schema=schema)

    for rows in batches:
        flat = np.asarray(rows.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
        whole = np.floor(flat * 1024.0)
        if len(whole) and 4 * dims * np.abs(whole).max() ** 2 >= 1 << 62:
            raise ValueError(f"a component of {np.abs(flat).max()}: squared distances need not fit a long")
        for lo in range(0, rows.num_rows, TREE):
            some = rows.column(0).slice(lo, TREE)
            if held and size + len(some) > TREE:
                yield tree()
                size = 0
            held.append((some, whole[lo : lo + TREE].astype(np.int64)))
            size += len(some)
    if held:
        yield tree()


def vectors_of(rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that count, components as doubles."""
    parts = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where((F.size("embedding") == dims) & F.forall("embedding", fine))


def _start(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of prefix and id."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    whole = F.transform("embedding", lambda x: F.floor(x * 1024))
    first = vectors.select(key.alias("key"), whole.alias("whole")).orderBy(F.asc_nulls_last("key"), "whole").limit(k)
    return np.array([r["whole"] for r in first.collect()], dtype=np.int64)


def _summed(trees: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (count, sums)} over all trees; a row per centroid and component reaches the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns)):
                tree = Tree.of(list(row), dims)
                counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
                balls, at, rest, rest_at = tree.assign(centroids)
                np.add.at(counts, at, tree.nodes[balls, 1] - tree.nodes[balls, 0])
                np.add.at(sums, at, tree.sums[balls])
                for c in np.unique(rest_at):
                    own = tree.vectors[rest[rest_at == c]]
                    counts[c] += len(own)
                    sums[c] += own.sum(0)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "count", "sums"])

    parts = trees.mapInArrow(each, "cluster int, count bigint, sums array<bigint>")
    # A row per centroid and component: sums as decimals, since the whole need not fit a long.
    flat = parts.select("cluster", F.posexplode(F.concat(F.array("count"), F.col("sums"))).alias("i", "v")).groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[int, list[int]] = {}
    for r in flat.collect():
        found.setdefault(r["cluster"], [0] * (dims + 1))[r["i"]] = int(r["v"])
    return {c: (v[0], v[1:]) for c, v in found.items()}


def _assigned(trees: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns)):
                tree = Tree.of(list(row), dims)
                cluster = np.zeros(len(tree.vectors), np.int32)
                balls, at, rest, rest_at = tree.assign(centroids)
                for (begin, end), c in zip(tree.nodes[balls, :2].tolist(), at.tolist()):
                    cluster[begin:end] = c
                cluster[rest] = rest_at
                distance = ((tree.vectors - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(each, "vec_id bigint, cluster int, distance bigint")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, prefix: str = "3:") -> DataFrame:
    """One row per vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    common.prepare(spark)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = vectors_of(rows, dims)
    centroids = _start(vectors, k, prefix)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    types = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("vectors", "nodes", "radii", "centres", "sums"))])
    trees = common.materialize(vectors.mapInArrow(lambda it: _built(it, dims, types), _TREES), "ball-trees")
    for _ in range(rounds):
        for c, (count, sums) in _summed(trees, centroids, dims).items():
            centroids[c] = [s // count for s in sums]
    found = common.materialize(_assigned(trees, centroids, dims), "ball-clusters")
    # One row per centroid: its inertia and digest.
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    whole = F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))))
    names = F.array(*map(F.lit, digests))
    at = F.col("cluster")
    return found.select("vec_id", "cluster", "distance", whole[at].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), names[at].alias("centroid_sha256"))
