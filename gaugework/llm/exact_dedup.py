"""Exact dedup by an extendible-hash index on shared files.

Texts hash to 64 bits.  A directory maps the leading bits to buckets: starting from one bucket, every
bucket above its capacity is split by its next bit, and where it already uses all the directory's bits
the directory doubles.  The counts that decide it are one bounded aggregate (a number per leading-bit
prefix).  Tasks own key ranges: each owner reads its buckets' rows, chains entries of one hash, tells
collisions apart by comparing bytes, and writes its bucket files to the shared folder, with each text once.

The directory is stored beside the bucket files.  A later batch opens the index, adds its counts, splits the
buckets that are overfull now (doubling the directory where needed), and writes a new generation of only those buckets
that got rows or were split; the directory names each bucket's generation.

Copies are combined before they travel: a map task sends a text once with the ids of all its rows, so
a group with a third of all rows costs its owner one entry per map task.  A single hash cannot be
split by more bits; such a bucket stays a long chain, which is why copies are combined first.

Defined cases: a null text is equal to an empty one; of equal texts the largest doc_id stays (a null
doc_id is below all); rows that repeat with one doc_id count each, and all rows with the kept id are
marked kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import common

#: Leading bits by which rows are counted, so the deepest directory (more with more shuffle partitions, 20 at most);
#: and rows that a bucket may hold at least.
MOST_BITS, CAPACITY = 12, 500
#: Bytes of text that a map task holds while it combines copies.
COMBINE_BYTES = 24_000_000
INDEX = "bucket int, hash long, chain int, text_sha256 string, content binary, ids array<long>, n long, keep_id long"


def directory(counts: dict[int, int], capacity: int = CAPACITY, most_bits: int = MOST_BITS, buckets: list[int] | None = None) -> tuple[int, list[int]]:
    """(global depth, bucket of each directory slot) from the row counts of most_bits-bit prefixes.

    A bucket's number is its leading bits below a one, so it names its local depth too: 1 is the one bucket of a new index.
    buckets: those of an index that exists; they are split further, never merged.
    """
    table = np.zeros(1 << most_bits, dtype=np.int64)
    for prefix, n in counts.items():
        table[prefix] = n
    sums = np.concatenate([[0], np.cumsum(table)])
    done, full = [], list(buckets or [1])
    while full:
        bucket = full.pop()
        local = bucket.bit_length() - 1
        bits, shift = bucket - (1 << local), most_bits - local
        if local < most_bits and sums[(bits + 1) << shift] - sums[bits << shift] > capacity:
            full += [bucket << 1 | 1, bucket << 1]
        else:
            done.append(bucket)
    depth = max(b.bit_length() - 1 for b in done)  # a bucket that uses more bits than the directory has doubles it
    slots = [0] * (1 << depth)
    for bucket in done:
        shift = depth - bucket.bit_length() + 1
        first = (bucket << shift) - (1 << depth)
        slots[first : first + (1 << shift)] = [bucket] * (1 << shift)
    return depth, slots


def _combine(batches: Iterator[pa.RecordBatch], depth: int, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Within a map task: a text once, with its bucket and its rows' ids; texts are compared by their bytes."""
    held: dict[tuple[int, bytes], list] = {}
    size = 0
    for rows in batches:
        hashes = rows.column(0).to_numpy(zero_copy_only=False)
        buckets = slots[(hashes.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.full(len(hashes), slots[0])
        for slot, h, doc, text in zip(buckets.tolist(), hashes.tolist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            ids = held.get((h, text))
            if ids is None:
                held[h, text] = [slot, doc]
                size += len(text) + 200
            else:
                ids.append(doc)
                size += 16
        if size > COMBINE_BYTES:
            yield from _flush(held)
            held, size = {}, 0
    yield from _flush(held)


def _flush(held: dict) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for lo in range(0, len(items), 2000):
        some = items[lo : lo + 2000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([v[0] for _, v in some], pa.int32()),
                pa.array([k[0] for k, _ in some], pa.int64()),
                pa.array([k[1] for k, _ in some], pa.binary()),
                pa.array([v[1:] for _, v in some], pa.list_(pa.int64())),
            ],
            names=["bucket", "hash", "content", "ids"],
        )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows (bucket, hash, content, ids, chain, text_sha256) come ordered by bucket and hash, those of the index
    first and by chain: it holds one hash's chain at a time.  A text's first entry carries its content."""
    now, chain = None, []
    for rows in batches:
        out: list[tuple] = []
        for bucket, h, content, ids, number, digest in zip(*(rows.column(i).to_pylist() for i in range(6))):
            if (bucket, h) != now:
                now, chain = (bucket, h), []
            first = False
            if number is None:
                for number, (have, digest) in enumerate(chain):
                    if have == content:
                        break
                else:
                    number, digest, first = len(chain), hashlib.sha256(content).hexdigest(), True
            else:
                first = number == len(chain)
            if first:
                chain.append((content, digest))
            known = [i for i in ids if i is not None]
            out.append((bucket, h, number, digest, content if first else None, ids, len(ids), max(known) if known else None))
        c = list(zip(*out)) or [()] * 8
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


_ROWS = "bucket int, hash long, content binary, ids array<long>, chain int, text_sha256 string"


def build_index(docs: DataFrame, path: str, normalise=None) -> DataFrame:
    """Writes the index of docs (doc_id, text) to path, one entry per text and map task; returns it."""
    return _add(docs, path, normalise, {}, 0)


def extend_index(docs: DataFrame, path: str, normalise=None) -> DataFrame:
    """Adds docs as a new batch to the index at path; returns the whole index."""
    spark = docs.sparkSession
    last = max(r["gen"] for r in spark.read.parquet(f"{path}/directory").select("gen").distinct().collect())
    generation = {r["bucket"]: r["of"] for r in spark.read.parquet(f"{path}/directory").where(F.col("gen") == last).select("bucket", "of").distinct().collect()}
    return _add(docs, path, normalise, generation, last + 1)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of every bucket's own generation."""
    slots = spark.read.parquet(f"{path}/directory")
    last = slots.agg(F.max("gen")).first()[0]
    live = slots.where(F.col("gen") == last).select("bucket", F.col("of").alias("gen")).distinct()  # at most 2^20 rows
    return spark.read.parquet(f"{path}/buckets").join(F.broadcast(live), ["bucket", "gen"], "left_semi").drop("gen")


def _add(docs: DataFrame, path: str, normalise, generation: dict[int, int], gen: int) -> DataFrame:
    spark = docs.sparkSession
    common.prepare(spark)
    text: Column = common.text_or_empty() if normalise is None else F.coalesce(normalise(F.col("text")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("content")).withColumn("hash", F.xxhash64("content"))
    n_tasks = common.shuffle_partitions(spark)
    bits = max(MOST_BITS, min(20, (64 * n_tasks - 1).bit_length()), *(b.bit_length() - 1 for b in generation))
    prefix = F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("p")
    new = {r["p"]: r["n"] for r in rows.groupBy(prefix).agg(F.count("*").alias("n")).collect()}  # at most 2^20 rows
    old = open_index(spark, path) if generation else None
    counts = dict(new)
    for r in old.groupBy(prefix).agg(F.sum("n").alias("n")).collect() if generation else ():
        counts[r["p"]] = counts.get(r["p"], 0) + r["n"]
    depth, slots = directory(counts, max(CAPACITY, sum(counts.values()) // (16 * n_tasks)), bits, sorted(generation))
    touched = {slots[p >> (bits - depth)] for p in new}
    live = {b: generation.get(b, gen) if b not in touched else gen for b in set(slots)}
    table = np.array(slots, dtype=np.int32)
    owned = rows.select("hash", "doc_id", "content").mapInArrow(lambda it: _combine(it, depth, table), "bucket int, hash long, content binary, ids array<long>")
    owned = owned.select("*", F.lit(None).cast("int").alias("chain"), F.lit(None).cast("string").alias("text_sha256"))
    if generation:  # what the rewritten buckets held
        names = spark.createDataFrame([(i, b) for i, b in enumerate(slots) if live[b] == gen], "slot int, to int")
        slot = F.shiftrightunsigned("hash", 64 - depth).cast("int") if depth else F.lit(0)
        held = old.withColumn("slot", slot).join(F.broadcast(names), "slot")  # at most 2^20 rows
        owned = owned.unionByName(held.select(F.col("to").alias("bucket"), "hash", "content", "ids", "chain", "text_sha256"))
    # Owners: a bucket's key range stays in one task, many buckets to a task.
    order = ["bucket", "hash", F.col("chain").asc_nulls_last(), F.col("content").isNull()]
    owned = owned.repartition(n_tasks, "bucket").sortWithinPartitions(*order)
    common.materialize(owned.mapInArrow(_own, INDEX), "exact-index", f"{path}/buckets/gen={gen}")
    kept = spark.createDataFrame([(i, b, live[b]) for i, b in enumerate(slots)], "slot int, bucket int, of int")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory/gen={gen}")
    return open_index(spark, path)


def exact_groups(docs: DataFrame, path: str | None = None, normalise=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups_of(build_index(docs, path or common.scratch_path(docs.sparkSession, "exact-index"), normalise))


def groups_of(index: DataFrame) -> DataFrame:
    """One row per row of an index: doc_id, keep_id, group_size, kept, text_sha256."""
    totals = index.groupBy("bucket", "hash", "chain").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    placed = index.select("bucket", "hash", "chain", "text_sha256", "ids").join(totals, ["bucket", "hash", "chain"])
    return placed.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one_of_equals(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text no row with a larger doc_id has."""
    gone = exact_groups(docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("digest")).distinct()
    return common.without_rows(docs, gone, lambda text: F.unhex(F.sha2(text.cast("binary"), 256)))
