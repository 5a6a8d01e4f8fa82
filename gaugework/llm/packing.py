"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue: its documents' tokens, each document with its end id, one after another, in slots of SLOT
tokens.  A window is one sequence.  In every window each queue is given its quantum, its target share of the
window's slots; the queues with the highest deficits send, whole slots at a time, until the window is full, and
what a queue was given but could not send stays its deficit for the windows after it.  So each sequence holds the
target proportions to about a slot per queue, and the deviation does not add up over windows.  Documents are
cut where a window's slots of their queue end.

The dealing repeats itself after about PERIOD slots, in which a queue's weight is a whole number of slots.  One period is
dealt out on the driver and sent to the tasks (16,384 small numbers); from it the place of any slot of any queue
is known without the windows before it.  Partitions therefore work on their own documents alone and carry
deficits across each other's windows.  Only when a queue runs dry do the weights change: that window is
filled from the queues that still have tokens, and a new phase starts.  There are about two phases a target, and a
handful where no targets are given.

Defined cases: a null text is empty (its end id alone); a null source is a queue of its own; sources without a
target of their own share one queue with the target of "" (0 if there is none); a queue of target 0 sends when
the others are dry; without any targets every source's target is its share of all tokens, and there the sources
with less than own_share of them (1 / OWN: half a slot of a sequence in 60) share one queue with the sum of their shares; rows
that repeat are packed each; an empty table gives an empty table; other columns are ignored.  Only the last sequence can be
shorter than `sequence`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm import common
from gaugework.llm.encoding import id_encoder

SEQUENCE = 1024
#: Tokens of a slot; slots of a period (about); without targets, a source with this part of all tokens has a queue of its own.
SLOT, PERIOD, OWN = 64, 1 << 14, 1 << 11


@dataclass
class Phase:
    """Some windows with fixed weights: the places of each queue's slots in a period; or windows filled queue after queue."""

    first: int  # window
    sent: np.ndarray  # tokens of each queue before this phase
    takes: np.ndarray | None = None  # tokens of each queue, one after another
    weights: np.ndarray | None = None  # slots of each queue in a period
    slots: np.ndarray | None = None  # their places, queue after queue
    period: int = 0

    def __post_init__(self) -> None:
        self.base = np.concatenate([[0], np.cumsum(self.weights if self.takes is None else self.takes)]).astype(np.int64)

    def place(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Where the queue's slots of these numbers lie among all slots of the phase."""
        w = self.weights[queue]
        return number // w * self.period + self.slots[self.base[queue] + number % w]

    def sent_before(self, queue: int, place: int) -> int:
        """The queue's slots that lie before a place."""
        own = self.slots[self.base[queue] : self.base[queue + 1]]
        return place // self.period * len(own) + int(np.searchsorted(own, place % self.period))


def deal(share: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, slots): each queue's slots in a period, and their places, queue after queue.

    A queue's deficit grows by its share with every slot and falls by one when it sends; the next slot goes to the queue
    whose deficit reaches half a slot first, the i-th time after (i + 0.5) / weight of the period.  Within a
    window the queues send in turn.  A queue with a share has one slot a period at least.
    """
    weights = np.where(share > 0, np.maximum(1, np.rint(share * PERIOD)), 0).astype(np.int64)
    queue = np.repeat(np.arange(len(share)), weights)
    nth = np.arange(len(queue)) - np.repeat(np.cumsum(weights) - weights, weights)
    queue = queue[np.argsort((nth + 0.5) / weights[queue], kind="stable")]
    whole = len(queue) // per_window * per_window  # a period is whole windows
    queue = queue[:whole]
    queue = queue[np.lexsort((queue, np.arange(whole) // per_window))]
    return np.bincount(queue, minlength=len(share)).astype(np.int64), np.argsort(queue, kind="stable").astype(np.int32)


def plan(tokens: list[int], targets: list[float] | None, window: int, slot: int) -> list[Phase]:
    """The phases for queues of so many tokens and target proportions (None: their shares of what is left)."""
    left = np.array(tokens, dtype=np.int64)
    total, per_window, first, phases = left.copy(), window // slot, 0, []
    wanted = None if targets is None else np.array(targets, dtype=float)
    while left.any():
        live = left > 0
        if left.sum() <= window or live.sum() == 1:  # no proportions are left to keep
            phases.append(Phase(first, total - left, takes=left))
            break
        share = np.where(live, left if wanted is None else wanted, 0.0)
        share = share / share.sum() if share.sum() > 0 else live / live.sum()
        weights, slots = deal(share, per_window)
        phase = Phase(first, total - left, weights=weights, slots=slots, period=len(slots))
        queues = np.flatnonzero(weights)
        n = int((phase.place(queues, left[queues] // slot) // per_window).min())  # the first window that a queue cannot serve in full
        sent = np.array([phase.sent_before(j, n * per_window) * slot if weights[j] else 0 for j in range(len(left))], dtype=np.int64)
        ahead = np.array([phase.sent_before(j, (n + 1) * per_window) * slot if weights[j] else 0 for j in range(len(left))], dtype=np.int64)
        if n:
            phases.append(phase)
        left = left - sent
        takes = np.minimum(left, ahead - sent)
        free = window - int(takes.sum())
        for j in sorted(np.flatnonzero(left > takes).tolist(), key=lambda j: (left[j] > 2 * slot, -left[j] if left[j] > 2 * slot else left[j])):
            more = min(free, int(left[j] - takes[j]))  # first what ends other queues, then from the longest
            takes[j] += more
            free -= more
        phases.append(Phase(first + n, total - left, takes=takes))
        left = left - takes
        first += n + 1
    return phases


def cuts(phases: list[Phase], queue: np.ndarray, at: np.ndarray, n: np.ndarray, window: int, slot: int) -> tuple[np.ndarray, ...]:
    """(row, start in the queue, length, position in the packed stream) of the pieces of rows with queue, first token and tokens."""
    found = []
    for i, p in enumerate(phases):
        begin = p.sent[queue]
        end = phases[i + 1].sent[queue] if i + 1 < len(phases) else at + n
        lo, hi = np.maximum(at, begin), np.minimum(at + n, end)
        row = np.flatnonzero(hi > lo)
        if not len(row):
            continue
        lo, hi, begin, q = lo[row], hi[row], begin[row], queue[row]
        # Blocks within which places are consecutive: slots, or sequences where queues follow one another.
        shift = np.zeros(len(row), dtype=np.int64) if p.takes is None else p.first * window + p.base[q]
        size = slot if p.takes is None else window
        one, two = (lo - begin + shift) // size, (hi - 1 - begin + shift) // size
        times = two - one + 1
        block = np.repeat(one, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, lo, hi, begin, q, shift = (np.repeat(x, times) for x in (row, lo, hi, begin, q, shift))
        start = np.maximum(lo, begin - shift + block * size)
        stop = np.minimum(hi, begin - shift + (block + 1) * size)
        position = start - begin + shift if p.takes is not None else p.first * window + p.place(q, block) * slot + (start - begin) % slot
        found.append(np.stack([row, start, stop - start, position]))
    if not found:
        return tuple(np.zeros((4, 0), dtype=np.int64))
    row, start, length, position = np.concatenate(found, axis=1)
    order = np.lexsort((start, row))
    row, start, length, position = row[order], start[order], length[order], position[order]
    # Neighbouring slots of one window are one piece.
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1] + length[:-1]) | (position[1:] // window != position[:-1] // window)
    head = np.flatnonzero(fresh)
    return row[head], start[head], np.add.reduceat(length, head), position[head]


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, encoder = TaskContext.get().partitionId(), id_encoder(tokenizer)
    tail = np.array([end], dtype=encoder.dtype).tobytes()
    reached: dict[str | None, int] = {}
    for rows in batches:
        for lo in range(0, rows.num_rows, 500):
            some = rows.slice(lo, 500)
            ids = [x + tail for x in encoder.encode(some.column(1).to_pylist())]
            n = [len(x) // encoder.dtype.itemsize for x in ids]
            at = []
            for source, size in zip(some.column(2).to_pylist(), n):
                at.append(reached.get(source, 0))
                reached[source] = at[-1] + size
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), common.binary_array(ids)],
                names=["doc_id", "source", "part", "at", "n", "ids"],
            )


def _cut(batches: Iterator[pa.RecordBatch], phases, window: int, slot: int, width: int) -> Iterator[pa.RecordBatch]:
    dtype = np.dtype(f"<u{width}")
    for rows in batches:
        for lo in range(0, rows.num_rows, 500):
            some = rows.slice(lo, 500)
            queue, at, n = (some.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            row, start, length, position = cuts(phases.value, queue, at, n, window, slot)
            ids = some.column(4)
            flat = np.frombuffer(b"".join(ids.to_pylist()), dtype=dtype).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            view = memoryview(flat)
            crcs = [zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start - at[row], length, crcs, n[row], position // window, position % window)), pieces.cast(pa.binary())],
                names=PIECES,
            )


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, targets: dict | None = None, slot: int = SLOT, own_share: float = 1 / OWN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian).

    targets: proportion of tokens per source (None: each source's share of all tokens, so that every sequence
    has the corpus's own mixture and all queues end together).  slot: tokens that a queue sends at a time; small slots
    hold the targets closely inside every sequence, large ones (up to `sequence`) keep documents in fewer pieces.
    own_share: without targets, the share of all tokens from which a source has a queue of its own; 0: every source has.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    slot = math.gcd(sequence, slot)
    texts = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"), F.col("source").cast("string").alias("source"))
    kind = "doc_id long, source string, part int, at long, n long, ids binary"
    encoded = common.materialize(texts.mapInArrow(lambda it: _encode(it, tokenizer, end_id), kind), "packing-ids")
    parts = common.materialize(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-parts")
    # Queues of their own: the named targets, or the sources with most tokens.  Only they come to the driver.
    sums = parts.groupBy("source").agg(F.sum("n").alias("tokens"))
    if targets is None:
        least = (sums.agg(F.sum("tokens")).first()[0] or 0) * own_share
        own = [r["source"] for r in sums.where(F.col("tokens") >= least).orderBy("source").collect()]  # at most 1 / own_share
    else:
        own = [s for s in targets if s != ""]
    names = spark.createDataFrame([(s, i) for i, s in enumerate(own)], "own string, queue int")
    queued = parts.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("own")), "left")  # a row per queue
    queued = queued.select("source", "part", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    of_part = queued.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    beside = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("queue", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    bases = queued.withColumn("beside", F.coalesce(F.sum("n").over(beside), F.lit(0))).join(offsets, ["queue", "part"])
    bases = common.materialize(bases.select(F.col("source").alias("of"), F.col("part").alias("in_part"), "queue", (F.col("beside") + F.col("before")).alias("base")), "packing-bases")
    tokens = [0] * (len(own) + 1)
    for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row per queue
        tokens[r["queue"]] = r["n"]
    wanted = None if targets is None else [float(targets[s]) for s in own] + [float(targets.get("", 0.0))]
    phases = spark.sparkContext.broadcast(plan(tokens, wanted, sequence, slot))
    width = id_encoder(tokenizer).dtype.itemsize
    placed = encoded.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    placed = placed.select("doc_id", "queue", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(lambda it: _cut(it, phases, sequence, slot, width), kind)
