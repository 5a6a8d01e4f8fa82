"""Benchmark decontamination by spaced seeds.

A fixed mask selects some of SPAN consecutive token positions and ignores the others, so a seed still
matches where an ignored token was substituted.  The seeds of all test items and of all training texts are
joined by their hash.  Both sides carry the tokens around the seed, so a hit is verified where it is found:
the pair is contaminated when a run of min(item length, WINDOW) aligned tokens around the seed agrees in at
least `percent` of its positions.

Items shorter than SPAN have masks of their own length, one for each position that may be substituted
(from five tokens on one of them may, at 80 percent), or one that selects all; so they are found exactly,
and an item of one word contaminates every text with that word.  Only lengths that occur are looked for.
At 80 percent, of all ways to place the permitted substitutions in an item of 1 to 16 tokens all are found,
but for 3 of the 45 ways in items of 10 tokens; longer items have windows of 16.  Texts are tested at every position.

Before the join a bit table of the items' seeds, of at most 2^MOST_BITS bits whatever the size of the
benchmark, drops the training seeds that no item has.  With more items than it can tell apart it lets more
seeds through to the join; it never loses one.

Tokens are runs of lower-cased letters and digits (all characters beyond ASCII count as letters).

Defined cases: null or empty texts and items match nothing; a null item_id is not tested; a null doc_id is carried
as null; rows equal in doc_id and text are one; a text's or item's repeated seeds with equal surroundings count
once, so repeated words give no pairs of positions; an empty table on either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common, word_hash

_U = np.uint64
# Fixed masks: the selected positions among SPAN.
SPAN = 9
MASKS = ((0, 1, 3, 6, 8), (0, 2, 3, 5, 8), (0, 1, 4, 5, 7), (1, 5, 6, 7, 8))
WINDOW = 16
#: Tokens kept before a seed's first one, and in all.
BEFORE, CONTEXT = WINDOW - SPAN, 2 * WINDOW - SPAN
#: Bits of the table before the join: at least, for each seed, and at most.
LEAST_BITS, BITS_A_SEED, MOST_BITS = 20, 32, 28
CHUNK_BYTES, ROWS = 2_000_000, 20_000
PAIRS = "doc_id long, item_id long, doc_token long, item_token long, n_aligned long, n_equal long"
_RNG = np.random.Generator(np.random.PCG64(7))
_AT = _RNG.integers(1, 2**63, size=WINDOW, dtype=np.uint64) * _U(2) + _U(1)


def masks_for(length: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """The masks of items of `length` tokens; SPAN stands for all longer ones too."""
    if length >= SPAN:
        return MASKS
    every = tuple(range(length))
    if length - (percent * length + 99) // 100 < 1:
        return (every,)
    return tuple(every[:i] + every[i + 1 :] for i in every)


def _seeds(hashed: np.ndarray, ends: np.ndarray, mask: tuple[int, ...], reach: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one mask; ends: per token, the end of its text."""
    n = len(hashed) - reach + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, salt, dtype=np.uint64)
    for m in mask:
        total += hashed[m : m + n] * _AT[m]
    at = np.flatnonzero(np.arange(n) + reach <= ends[:n])
    return at, word_hash.mix(total[at])


def _context(tokens: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 32-bit token hashes around each position, 0 outside its text."""
    places = at[:, None] + np.arange(-BEFORE, CONTEXT - BEFORE)
    inside = (places >= first[:, None]) & (places < end[:, None])
    return np.where(inside, tokens[np.clip(places, 0, len(tokens) - 1)], np.uint32(0))


def _read(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, 32-bit hash, first, end) of every token."""
    _, _, text, hashed = word_hash.words(offsets, data, word_hash.NOT_WORD)
    counts = np.bincount(text, minlength=len(offsets) - 1) if len(text) else np.zeros(len(offsets) - 1, dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return text, hashed, np.maximum((hashed >> _U(32)).astype(np.uint32), np.uint32(1)), bounds[text], bounds[text + 1]


def _found(batches: Iterator[pa.RecordBatch], lengths: list[int], percent: int, table, bits: int) -> Iterator[pa.RecordBatch]:
    """(seed, id, digest, token, length, context), once for each text, seed and surroundings.

    lengths: of item classes; with a table the rows are training texts, otherwise items, of which each is in one class.
    """
    for rows in batches:
        offsets, data = common.utf8_buffers(rows.column(2))
        ids, digests = rows.column(0), rows.column(1)
        for lo, hi in common.chunks_by_bytes(offsets, CHUNK_BYTES):
            text, hashed, tokens, first, end = _read(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
            for length in lengths if len(text) else ():
                for k, mask in enumerate(masks_for(length, percent)):
                    at, seed = _seeds(hashed, end, mask, length, 64 * length + k + 1)
                    if table is not None:
                        slot = (seed >> _U(64 - bits)).astype(np.int64)
                        keep = (table.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    else:
                        n = (end - first)[at]
                        keep = n >= SPAN if length == SPAN else n == length
                    at, seed = at[keep], seed[keep]
                    for i in range(0, len(at), ROWS):
                        yield _rows(at[i : i + ROWS], seed[i : i + ROWS], text, tokens, first, end, ids, digests, lo)


def _rows(at, seed, text, tokens, first, end, ids, digests, lo: int) -> pa.RecordBatch:
    around = _context(tokens, at, first[at], end[at])
    mixed = word_hash.mix(seed + text[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (around.astype(np.uint64) * _AT_CONTEXT).sum(axis=1, dtype=np.uint64))
    once = np.sort(np.unique(mixed, return_index=True)[1])
    at, around = at[once], around[once]
    row = pa.array(text[at] + lo)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seed[once].view(np.int64)),
            ids.take(row),
            digests.take(row),
            pa.array(at - first[at], pa.int64()),
            pa.array(end[at] - first[at], pa.int64()),
            pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * CONTEXT), len(at), [None, pa.py_buffer(np.ascontiguousarray(around).tobytes())]).cast(pa.binary()),
        ],
        names=["seed", "id", "digest", "token", "length", "context"],
    )


_AT_CONTEXT = _RNG.integers(1, 2**63, size=CONTEXT, dtype=np.uint64) * _U(2) + _U(1)
_HITS = "seed long, id long, digest long, token long, length long, context binary"


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, token, context, item_id, item_token, length, item_context) -> the hits that agree, at their best place."""
    for rows in batches:
        n_rows = rows.num_rows
        a, b = (np.frombuffer(b"".join(rows.column(i).to_pylist()), dtype="<u4").reshape(n_rows, CONTEXT) for i in (3, 7))
        length = rows.column(6).to_numpy(zero_copy_only=False)
        equal = np.concatenate([np.zeros((n_rows, 1), dtype=np.int64), np.cumsum((a == b) & (a != 0), axis=1)], axis=1)
        solid = np.concatenate([np.zeros((n_rows, 1), dtype=np.int64), np.cumsum((a != 0) & (b != 0), axis=1)], axis=1)
        best, place = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
        width = np.minimum(length, WINDOW)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            # Windows that hold the whole seed; that of a short item is the seed itself.
            for s in range(BEFORE, max(-1, BEFORE + min(w, SPAN) - w - 1), -1):
                score = np.where(solid[mine, s + w] - solid[mine, s] == w, equal[mine, s + w] - equal[mine, s], 0)
                better = (100 * score >= percent * w) & (score > best[mine])
                best[mine[better]], place[mine[better]] = score[better], s
        keep = np.flatnonzero(best > 0)
        shift = pa.array(place[keep] - BEFORE)
        some = rows.take(pa.array(keep))
        move = lambda c: pc.add(c, shift)
        yield pa.RecordBatch.from_arrays(
            [some.column(0), some.column(1), some.column(4), move(some.column(2)), move(some.column(5)), pa.array(width[keep], pa.int64()), pa.array(best[keep], pa.int64())],
            names=["doc_id", "digest", "item_id", "doc_token", "item_token", "n_aligned", "n_equal"],
        )


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the seeds: at most 2^(bits - 6) numbers come to the driver, MOST_BITS of bits in all."""
    slot = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, {}) & 63 as int))".format(64 - bits))).alias("word"))
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in words.toLocalIterator():
        table[r["at"]] = r["word"]
    return table.view(np.uint8)


def _contaminated(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """(doc_id, digest, item_id, doc_token, item_token, n_aligned, n_equal), the best place of each text and item."""
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("digest"), F.lower("text").alias("text"))
    classes = list(range(1, SPAN + 1))
    wanted = common.materialize(items.mapInArrow(lambda it: _found(it, classes, percent, None, 0), _HITS), "leak-seeds")
    lengths = sorted({min(r["length"], SPAN) for r in wanted.select(F.least("length", F.lit(SPAN)).alias("length")).distinct().collect()})  # at most SPAN rows
    count = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_SEED * count).bit_length()))
    table = spark.sparkContext.broadcast(_bit_table(wanted, bits))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(common.text_or_empty()).alias("digest"), F.lower("text").alias("text"))
    hits = texts.mapInArrow(lambda it: _found(it, lengths, percent, table, bits), _HITS)
    wanted = wanted.select("seed", F.col("id").alias("item_id"), F.col("token").alias("item_token"), F.col("length").alias("item_length"), F.col("context").alias("item_context"))
    met = hits.join(wanted, "seed").select("id", "digest", "token", "context", "item_id", "item_token", "item_length", "item_context")
    kind = "doc_id long, digest long, item_id long, doc_token long, item_token long, n_aligned long, n_equal long"
    checked = met.mapInArrow(lambda it: _verify(it, percent), kind)
    best = F.max_by(F.struct("doc_token", "item_token", "n_aligned", "n_equal"), F.struct("n_equal", -F.col("doc_token"), -F.col("item_token")))
    return checked.groupBy("doc_id", "digest", "item_id").agg(best.alias("s")).select("doc_id", "digest", "item_id", "s.*")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id) with the window in which their tokens agree best: its places, tokens and equal tokens."""
    return _contaminated(docs, benchmark, percent).drop("digest")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that no item contaminates, each judged by its own text."""
    gone = common.materialize(_contaminated(docs, benchmark, percent).select("doc_id", "digest").distinct(), "leak-gone")
    return common.without_rows(docs, gone)
