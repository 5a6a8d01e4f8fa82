"""N-gram Jaccard join by set-relation skipping (exact).

A document's set is its distinct k-word shingles.  Two documents link when
100 * |intersection| >= percent * |union|.  The work, in order:

1. One pass over the texts hashes the shingles in batches (numpy over Arrow bytes).  Every batch sends
   each distinct shingle to its hash bucket; a shingle that many documents of a batch share travels once.
   The number of buckets follows the bytes of text, so a bucket stays small whatever the input.
   A bucket's task counts documents per shingle and answers only for shingles of two documents or more.
   So a document learns how many of its shingles are unique and the frequency of all others.
2. A set ordered by (frequency, hash) needs only its first n - ceil(percent * n / 100) + 1 entries
   indexed.  Where the unique shingles fill that prefix, the document has no partner at all.
3. Equal sets become one class.  Index lists hold the classes' prefix entries with position and size.
4. Each list's pivot is its set with the fewest shingles of its own.  A member is verified against the pivot
   with which it shares most lists; linked ones become components; the other pivots are asked only where
   they would still join two components.  So groups of near copies are answered through a few pivots.
5. Lists that still hold several components are probed: dealt into random cells of CELL entries, every set
   asks the nearest set of another component in its cells (nearest by parity bits; two sets differ in at
   least as many shingles as these bits do).  This is linear in the entries and joins all but rare links.
6. What is left are pairs in one list but in different components.  Lists are cut into blocks by size and
   position; block pairs that cannot reach the overlap, or that lie in one component, are skipped whole.
   Of the pairs that sizes, places and parity bits leave, one per pair of components is asked at a time.
   Its answer is derived from a common pivot's: with d = |x - p|, the overlap of x and y lies in
   [o(p, y) - |p - x|, o(p, y) + d].  Only pairs that this leaves open are verified themselves.
Every merge of two components hands on one edge, so edges grow with the documents, not with their pairs.
Components that do not settle in 40 rounds of stars (a path of far over a million links) raise an error.

Hashes have 48 bits besides the bucket's; a wrong overlap needs a collision inside one pair of sets.

Defined cases: null or empty text has an empty set and no links; fewer than k words are one shingle;
rows with one doc_id are one node (each row is returned; should their texts differ,
one of them stands for the node); a null doc_id is returned with a null
component and takes no part; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common, word_hash
from gaugework.llm.components import connected_components

_U = np.uint64
#: Most documents in a batch (their numbers take 16 bits), and the bytes of text after which a batch is sent.
BATCH_ROWS, BATCH_BYTES = 60_000, 6_000_000
#: A shingle in so many documents of one batch is sent to its bucket once for the batch.
SHARED = 64
_ALL = _U(0xFFFF)
#: 64-bit words of a set's parity bits: two sets differ in at least as many shingles as their bits do.
PARITY = 8
#: Entries of a list's random cell, and rounds of probing in cells.
CELL, PROBES = 128, 2


def _batches(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    for rows in batches:
        offsets, data = common.utf8_buffers(rows.column(1))
        ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in common.chunks_by_bytes(offsets, BATCH_BYTES, BATCH_ROWS):
            off = offsets[lo : hi + 1] - offsets[lo]
            _, _, text, hashed = word_hash.words(off, data[offsets[lo] : offsets[hi]])
            owner, h = word_hash.shingles(text, hashed, hi - lo, k)
            yield _batch_rows(part << 32 | number, ids[lo:hi], owner, h, bits)
            number += 1


def _batch_rows(batch: int, ids: np.ndarray, owner: np.ndarray, h: np.ndarray, bits: int) -> pa.RecordBatch:
    bucket = (h >> _U(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    packed = (h << _U(16)) | owner.astype(np.uint64)
    order = np.argsort(bucket, kind="stable")
    packed, bucket = packed[order], bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
    sizes = np.zeros(len(ids), dtype=np.int64)
    out: list[tuple[int, int, bytes, bytes]] = []
    for b, lo, hi in zip(bucket[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(bucket)]):
        p = np.sort(packed[lo:hi])
        p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        docs = (p & _ALL).astype(np.int64)
        sizes += np.bincount(docs, minlength=len(ids))
        key = p >> _U(16)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.append(at, len(key)))
        count = b""
        if (runs >= SHARED).any():  # sent once, with its count; its documents stay with the batch
            common_run = np.repeat(runs >= SHARED, runs)
            out.append((b, 2, p[common_run].tobytes(), b""))
            once = (key[at[runs >= SHARED]] << _U(16)) | _ALL
            count = runs[runs >= SHARED].astype(np.uint32).tobytes()
            p = np.concatenate([once, p[~common_run]])
        out.append((b, 1, p.tobytes(), count))
    out.append((batch % (1 << bits), 0, ids.tobytes() + sizes.astype(np.int32).tobytes(), b""))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in out], pa.int32()),
            pa.array([batch] * len(out), pa.int64()),
            pa.array([x[1] for x in out], pa.int32()),
            common.binary_array([x[2] for x in out]),
            common.binary_array([x[3] for x in out]),
        ],
        names=["bucket", "batch", "kind", "data", "counts"],
    )


def _frequencies(key: tuple, rows: pa.Table) -> pa.Table:
    """One bucket: the number of documents of each shingle, sent back to the batches that have it."""
    rows = rows.combine_chunks()
    kinds = rows.column("kind").to_pylist()
    mine = [i for i, x in enumerate(kinds) if x == 1]
    data = [np.frombuffer(rows.column("data")[i].as_buffer(), dtype=np.uint64) for i in mine]
    counts = [np.frombuffer(rows.column("counts")[i].as_buffer(), dtype=np.uint32) for i in mine]
    keep = [i for i, x in enumerate(kinds) if x != 1]
    batch = [rows.column("batch")[i].as_py() for i in keep]
    payload = [rows.column("data")[i].as_py() for i in keep]
    df = [b""] * len(keep)
    out_kind = [kinds[i] for i in keep]
    if data:
        every = np.concatenate(data)
        weight = np.concatenate([np.concatenate([c, np.ones(len(d) - len(c), dtype=np.uint32)]) for c, d in zip(counts, data)])
        shingle = every >> _U(16)
        order = np.argsort(shingle, kind="stable")
        s = shingle[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(weight[order].astype(np.int64), at)
        each = np.empty(len(s), dtype=np.int64)
        each[order] = np.repeat(total, np.diff(np.append(at, len(s))))
        lo = 0
        for i, d in zip(mine, data):
            f = each[lo : lo + len(d)]
            lo += len(d)
            more = f > 1
            if more.any():
                batch.append(rows.column("batch")[i].as_py())
                out_kind.append(1)
                payload.append(d[more].tobytes())
                df.append(np.minimum(f[more], 0xFFFFFFFF).astype(np.uint32).tobytes())
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()] * len(batch), pa.int32()),
            "batch": pa.array(batch, pa.int64()),
            "kind": pa.array(out_kind, pa.int32()),
            "data": common.binary_array(payload),
            "counts": common.binary_array(df),
        }
    )


def _sets(rows: pa.Table, percent: int, bits: int) -> pa.Table:
    """One batch: each document's size and, if its prefix is not all unique, its shared shingles in order."""
    ids = sizes = None
    found: list[np.ndarray] = []
    once: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    shared: dict[int, np.ndarray] = {}
    docs, freq = [], []
    for r in rows.to_pylist():
        if r["kind"] == 0:
            n = len(r["data"]) // 12
            ids = np.frombuffer(r["data"], dtype=np.int64, count=n)
            sizes = np.frombuffer(r["data"], dtype=np.int32, offset=8 * n)
        elif r["kind"] == 2:
            shared[r["bucket"]] = np.frombuffer(r["data"], dtype=np.uint64)
        else:
            p = np.frombuffer(r["data"], dtype=np.uint64)
            f = np.frombuffer(r["counts"], dtype=np.uint32)
            all_of = (p & _ALL) == _ALL
            if all_of.any():
                key = p[all_of] >> _U(16)
                order = np.argsort(key)
                once[r["bucket"]] = (key[order], f[all_of][order])
            p, f = p[~all_of], f[~all_of]
            found.append(_full(p, r["bucket"], bits))
            docs.append((p & _ALL).astype(np.int64))
            freq.append(f)
    for b, p in shared.items():
        key, f = once[b]
        found.append(_full(p, b, bits))
        docs.append((p & _ALL).astype(np.int64))
        freq.append(f[np.searchsorted(key, p >> _U(16))])
    n_docs = len(ids)
    h = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    d = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    f = np.concatenate(freq).astype(np.int64) if freq else np.zeros(0, dtype=np.int64)
    n = sizes.astype(np.int64)
    unique = n - np.bincount(d, minlength=n_docs)
    prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    active = unique < prefix
    mine = active[d]
    h, d, f = h[mine], d[mine], f[mine]
    order = np.lexsort((h, f, d))
    h, d = h[order], d[order]
    ends = np.searchsorted(d, np.arange(n_docs + 1))
    mixed = word_hash.mix(h + _U(0x51ED2701))
    place = (mixed >> _U(20)).astype(np.int64) % (64 * PARITY)
    sets, heads, one, two, parity = [], [], [], [], []
    for i in range(n_docs):
        if active[i]:
            x = h[ends[i] : ends[i + 1]]
            sets.append(x.tobytes())
            heads.append(x[: prefix[i] - unique[i]].astype(np.int64))
            one.append(int(np.add.reduce(x).astype(np.int64)))
            two.append(int(np.add.reduce(mixed[ends[i] : ends[i + 1]]).astype(np.int64)))
            odd = np.bincount(place[ends[i] : ends[i + 1]], minlength=64 * PARITY) & 1
            parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        else:
            for c in (sets, heads, one, two, parity):
                c.append(None)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n": pa.array(n, pa.int64()),
            "n_unique": pa.array(unique, pa.int64()),
            "members": pa.array(sets, pa.binary()),
            "head": pa.array(heads, pa.list_(pa.int64())),
            "f1": pa.array(one, pa.int64()),
            "f2": pa.array(two, pa.int64()),
            "parity": pa.array(parity, pa.list_(pa.int64())),
        }
    )


def _full(p: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """The shingle's hash: the bucket's number, or its first 16 bits, above the 48 bits that travelled."""
    return p >> _U(16) | _U(bucket >> max(0, bits - 16)) << _U(48)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, a_set, b_set, n_a, n_b) -> (a, b, overlap, n_a, n_b), whole sets."""
    for rows in batches:
        a_set, b_set = rows.column(2), rows.column(3)
        out = np.zeros(rows.num_rows, dtype=np.int64)
        for i in range(rows.num_rows):
            a = np.frombuffer(a_set[i].as_buffer(), dtype=np.uint64)
            b = np.frombuffer(b_set[i].as_buffer(), dtype=np.uint64)
            both = np.sort(np.concatenate([a, b]))
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out), rows.column(4), rows.column(5)], names=["a", "b", "overlap", "n_a", "n_b"])


def _needed(n_a, n_b, percent: int):
    """Least overlap of two linked sets: overlap >= percent / (100 + percent) * (n_a + n_b), rounded up."""
    return F.ceil((n_a + n_b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9)).cast("long")


def document_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), n_unique, and for documents that may have partners members, head, f1, f2, parity."""
    spark = docs.sparkSession
    common.prepare(spark)
    bits = common.bucket_bits(common.text_bytes(docs), common.shuffle_partitions(spark))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    kind = "bucket int, batch long, kind int, data binary, counts binary"
    sent = texts.mapInArrow(lambda it: _batches(it, k, bits), kind)
    answers = sent.groupBy("bucket").applyInArrow(_frequencies, kind)
    return common.materialize(
        answers.groupBy("batch").applyInArrow(
            lambda rows: _sets(rows, percent, bits),
            "doc_id long, n long, n_unique long, members binary, head array<long>, f1 long, f2 long, parity array<long>",
        ),
        "ngram-sets",
    )


class _Answers:
    """What is known so far: every set's component, overlaps with pivots, and an edge for each merge of components."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.comps = sets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
        self.star: DataFrame | None = None
        self.edges: list[DataFrame] = []

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> (a, b, overlap, n_a, n_b)."""
        left = self.sets.select(F.col("doc_id").alias("a"), F.col("members").alias("a_set"), F.col("n").alias("n_a"))
        right = self.sets.select(F.col("doc_id").alias("b"), F.col("members").alias("b_set"), F.col("n").alias("n_b"))
        whole = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set", "n_a", "n_b")
        return whole.mapInArrow(_overlaps, "a long, b long, overlap long, n_a long, n_b long")

    def link(self) -> Column:
        return F.expr(f"100 * overlap >= {self.percent} * (n_a + n_b - overlap)")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose documents are in different components, with c_a and c_b."""
        one = self.comps.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
        two = self.comps.select(F.col("node").alias("b"), F.col("component").alias("c_b"))
        return pairs.drop("c_a", "c_b").join(one, "a").join(two, "b").where("c_a <> c_b")

    def merge(self, linked: DataFrame) -> None:
        """Takes links (a, b) between components; one edge of each pair of components is kept."""
        one = self.apart(linked).groupBy(F.least("c_a", "c_b").alias("u"), F.greatest("c_a", "c_b").alias("v")).agg(F.min(F.struct("a", "b")).alias("e"))
        one = common.materialize(one.select("u", "v", "e.a", "e.b"), "ngram-merges")
        if one.isEmpty():
            return
        self.edges.append(one.select("a", "b"))
        met = connected_components(one.select(F.col("u").alias("a"), F.col("v").alias("b")), "ngram-merged").select(F.col("node").alias("component"), F.col("component").alias("root"))
        self.comps = common.materialize(
            self.comps.join(met, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "ngram-comps"
        )

    def ask_pivots(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b) of a set and a pivot; each set keeps its best pivot's answer."""
        checked = common.materialize(self.overlaps(pairs), "ngram-stars")
        best = checked.groupBy(F.col("a").alias("x")).agg(F.max_by(F.struct("b", "overlap", "n_b"), F.struct("overlap", "b")).alias("s"))
        self.star = best if self.star is None else self.star.unionByName(best.join(self.star, "x", "left_anti"))
        self.merge(checked.where(self.link()).select("a", "b"))

    def decide(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b, n_a, n_b): by the answers of one pivot where both have it, else by their sets.

        With d(x) = |x - p| and o(x) = |x and p|, the overlap of x and y is at least o(y) - |p - x| and at most o(y) + d(x).
        """
        side = lambda name, to: self.star.select(F.col("x").alias(to), F.col("s").alias(name))
        both = pairs.select("a", "b", "n_a", "n_b").join(side("sa", "a"), "a", "left").join(side("sb", "b"), "b", "left")
        need = _needed(F.col("n_a"), F.col("n_b"), self.percent)
        low = F.col("sa.overlap") + F.col("sb.overlap") - F.col("sa.n_b")
        high = F.least(F.col("sb.overlap") + F.col("n_a") - F.col("sa.overlap"), F.col("sa.overlap") + F.col("n_b") - F.col("sb.overlap"))
        answer = F.when(F.col("sa.b") == F.col("sb.b"), F.when(low >= need, True).when(high < need, False))
        told = common.materialize(both.select("a", "b", answer.alias("answer")), "ngram-derived")
        checked = self.overlaps(told.where("answer is null")).where(self.link()).select("a", "b")
        return told.where("answer").select("a", "b").unionByName(checked)


def _pairs(left: DataFrame, on: list[str], percent: int) -> DataFrame:
    """Pairs of entries that meet in `on`, in different components, whose sizes, places and parity bits allow a link."""

    def side(tag: str) -> list:
        return [*on, *(F.col(c).alias(f"{c}_{tag}") for c in ("doc_id", "n", "pos", "component", "n_unique", "parity"))]

    need = _needed(F.col("n_a"), F.col("n_b"), percent)
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.col("n_unique_a") + F.col("n_unique_b"))
    return (
        left.select(side("a")).join(left.select(side("b")), on)
        .where("component_a <> component_b and (n_a < n_b or n_a = n_b and doc_id_a < doc_id_b)")
        .where(f"100 * n_a >= {percent} * n_b")
        .where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need)
        .where(differ <= F.col("n_a") + F.col("n_b") - 2 * need)
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "n_a", "n_b", differ.alias("differ"))
    )


def _open_lists(index: DataFrame, known: _Answers) -> DataFrame:
    """Entries of lists that hold different components, with those components and the list's length."""
    placed = index.drop("pivot").join(known.comps.select(F.col("node").alias("doc_id"), "component"), "doc_id")
    spread = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("length"))
    spread = common.materialize(spread.where("c0 <> c1").select("key", "length"), "ngram-spread")  # so that a hot list can be split
    return placed.join(spread, "key")


def _probe(index: DataFrame, known: _Answers, seed: int) -> bool:
    """Lists are dealt into random cells of about CELL entries; in them every set asks the nearest set of another component.

    Only entries early enough for a partner of equal size take part.  The work is linear in the entries.  It joins
    what most of a group links to, so that few pairs are left for the blocks, which see all entries.
    """
    index = index.where(F.col("n") - F.col("pos") >= _needed(F.col("n"), F.col("n"), known.percent))
    cell = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.ceil(F.col("length") / CELL).cast("long"))
    bits = known.sets.select("doc_id", "n_unique", "parity")
    near = _pairs(_open_lists(index, known).withColumn("cell", cell).join(bits, "doc_id"), ["key", "cell"], known.percent)
    asks = near.groupBy("a").agg(F.min_by(F.struct("b", "n_a", "n_b"), F.struct("differ", "b")).alias("s")).select("a", "s.*")
    asks = common.materialize(asks, "ngram-probe")
    if asks.isEmpty():
        return False
    known.merge(known.decide(asks))
    return True


def _block_pairs(index: DataFrame, known: _Answers) -> DataFrame:
    """All pairs (a, b, n_a, n_b, differ) that may still join two components, from lists cut into blocks.

    A block holds entries of one size class and of eight positions, apart for the list's largest component and for the
    others; pairs of blocks that cannot reach the overlap, or lie in one component, are skipped whole.
    """
    step = math.log(100 / known.percent) * 1.01
    entries = _open_lists(index, known)
    main = entries.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    main = common.materialize(main, "ngram-main")
    placed = common.materialize(
        entries.join(main, "key")
        .withColumn("sb", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)))
        .withColumn("pb", F.floor(F.col("pos") / 8) * 2 + (F.col("component") == F.col("main")).cast("int"))
        .drop("main", "length"),
        "ngram-open",
    )
    blocks = placed.groupBy("key", "sb", "pb").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("pos0"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    blocks = common.materialize(blocks, "ngram-blocks")
    one = blocks.select("key", *(F.col(c).alias(f"a_{c}") for c in ("sb", "pb", "n0", "n1", "pos0", "c0", "c1")))
    two = blocks.select("key", *(F.col(c).alias(f"b_{c}") for c in ("sb", "pb", "n0", "n1", "pos0", "c0", "c1")))
    reach = F.least(F.col("a_n1") - F.col("a_pos0"), F.col("b_n1") - F.col("b_pos0"))
    open_blocks = (
        one.join(two, "key")
        .where("b_sb in (a_sb, a_sb + 1)")
        .where(reach >= _needed(F.col("a_n0"), F.col("b_n0"), known.percent))
        .where("not (a_c0 = a_c1 and b_c0 = b_c1 and a_c0 = b_c0)")
        .select("key", "a_sb", "a_pb", "b_sb", "b_pb")
    )
    bits = known.sets.select("doc_id", "n_unique", "parity")
    placed = placed.join(bits, "doc_id")
    names = ("doc_id", "n", "pos", "component", "n_unique", "parity")
    a = placed.select("key", F.col("sb").alias("a_sb"), F.col("pb").alias("a_pb"), *(F.col(c).alias(f"{c}_a") for c in names))
    b = placed.select("key", F.col("sb").alias("b_sb"), F.col("pb").alias("b_pb"), *(F.col(c).alias(f"{c}_b") for c in names))
    need = _needed(F.col("n_a"), F.col("n_b"), known.percent)
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.col("n_unique_a") + F.col("n_unique_b"))
    return (
        a.join(open_blocks, ["key", "a_sb", "a_pb"])
        .join(b, ["key", "b_sb", "b_pb"])
        .where("component_a <> component_b and (n_a < n_b or n_a = n_b and doc_id_a < doc_id_b)")
        .where(f"100 * n_a >= {known.percent} * n_b")
        .where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need)
        .where(differ <= F.col("n_a") + F.col("n_b") - 2 * need)
        .groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "n_a", "n_b")
        .agg(F.min(differ).alias("differ"))
    )


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, _Answers]:
    """document_sets(), the copies (a, b) of a class's representative b, and what is known of the representatives when no list is open."""
    made = document_sets(docs, k, percent)
    active = made.where("members is not null")
    shared = active.where("n_unique = 0")  # only a set without a shingle of its own can have an equal
    classes = common.materialize(shared.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    copies = shared.join(classes, ["n", "f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = shared.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "f1", "f2"], "left_semi")
    reps = active.where("n_unique > 0").unionByName(first.select(active.columns))
    posted = reps.select("doc_id", "n", "n_unique", F.posexplode("head").alias("i", "key")).select(
        "key", "doc_id", "n", "n_unique", (F.col("i") + F.col("n_unique")).alias("pos")
    )
    # A list's pivot is the set with the fewest shingles of its own: of near copies, the least edited one.
    lists = posted.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min(F.struct("n_unique", "doc_id")).alias("p"))
    # Written first: between two plain tables a join by key can split a hot list.
    lists = common.materialize(lists.where("first <> last").select("key", F.col("p.doc_id").alias("pivot")), "ngram-lists")
    index = common.materialize(posted.drop("n_unique").join(lists, "key"), "ngram-index")
    sets = common.materialize(
        reps.join(index.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "n_unique", "members", "parity").dropDuplicates(["doc_id"]),
        "ngram-verify",
    )
    known = _Answers(sets, percent)
    size = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"))
    to_pivot = index.where("doc_id <> pivot").groupBy(F.col("doc_id").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a")).agg(F.count("*").alias("shared"))
    to_pivot = common.materialize(to_pivot.join(size, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "shared"), "ngram-pivots")
    nearest = to_pivot.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    known.ask_pivots(nearest)
    known.ask_pivots(known.apart(to_pivot.join(nearest, ["a", "b"], "left_anti")).select("a", "b"))
    for seed in range(PROBES):
        if not _probe(index, known, seed):
            break
    # What no probe has joined: all pairs that may link, asked component by component until none is open.
    left = common.materialize(_block_pairs(index, known), "ngram-rest")
    for last in (False, False, True):
        open_pairs = known.apart(left)
        if not last:
            pair = [F.least("c_a", "c_b").alias("u"), F.greatest("c_a", "c_b").alias("v")]
            open_pairs = open_pairs.groupBy(*pair).agg(F.min_by(F.struct("a", "b", "n_a", "n_b"), F.struct("differ", "a", "b")).alias("s")).select("s.*")
        asks = common.materialize(open_pairs.select("a", "b", "n_a", "n_b"), "ngram-asks")
        if asks.isEmpty():
            break
        known.merge(known.decide(asks))
        left = left.join(asks.select("a", "b"), ["a", "b"], "left_anti")
    return made, copies, known


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): document_sets(), and edges (a, b) whose components are those of all links.

    The edges are one per copy of a set and one per merge of two components, so they grow with the documents.
    """
    made, edges, known = _joined(docs, k, percent)
    for some in known.edges:
        edges = edges.unionByName(some)
    return made, edges


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id that links reach, itself included)."""
    made, copies, known = _joined(docs, k, percent)
    # Stars to least nodes already, but where rows of one doc_id have different texts.
    placed = known.comps.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    copied = copies.join(known.comps.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("b"))
    edges = placed.unionByName(copied)
    comps = connected_components(edges, "ngram-components")
    rows = (
        made.select("doc_id", F.col("n").alias("n_shingles"))
        .join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
    lost = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return rows.unionByName(lost)


def keep_one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's least one; rows without doc_id stay."""
    gone = ngram_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
