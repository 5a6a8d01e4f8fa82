"""Substring dedup by sliding sentence spans.

A text is cut into sentences (ending at . ! ? or a line feed), and a sentence longer than CLAUSE words into clauses at
words that their own hash names, so that copies of a passage are cut alike wherever it begins.  Every run of at least
least_sentences consecutive sentences or clauses and least_words words that has no shorter such run from its first, or
to its last, sentence is hashed to 128 bits.  Longer runs repeat exactly where these do, so each sentence of a long enough
repeated passage lies in a hashed run inside the passage.  Runs meet globally by hash; the first
place of a hash, the least (doc_id, digest of the text, sentence), keeps it.  Sentences covered by any other place go.

A map task knows which of its own places are not first, so it sends one place per hash and batch to
the hash's bucket: a passage in a third of all documents costs its bucket one entry per batch.

Defined cases: null or empty text has no sentences and stays as it is (null as empty); rows with one
doc_id and one text share their places, so equal rows of one doc_id keep theirs; other texts of a doc_id are
documents of their own; a null doc_id is compared as the largest and its text is judged like any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common, word_hash

_U = np.uint64
SENTENCES, WORDS = 2, 20
#: A sentence of more words is cut into clauses, after one word in EVERY of those whose hash says so, LEAST words apart.
CLAUSE, EVERY, LEAST = 12, 8, 4
BATCH_BYTES = 6_000_000
#: Places in a row of those that pass through.
PIECE = 2_000
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_NO_ID = (1 << 63) - 1  # stands for null; a doc_id of this value counts as null
PLACE = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("a", "<i4"), ("b", "<i4")])
_WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[str]:
    """Pieces that give the text when joined; a piece without a word belongs to the sentence before it."""
    out: list[str] = []
    for piece in _SENTENCE.findall(text):
        if out and not any(c.isalnum() for c in piece):
            out[-1] += piece
        else:
            out.append(piece)
    return [clause for piece in out for clause in _clauses(piece)]


def _clauses(sentence: str) -> list[str]:
    words = _WORD.findall(sentence)
    if len(words) <= CLAUSE:
        return [sentence]
    words[0] = sentence[: len(sentence) - sum(map(len, words))] + words[0]  # white space before the first word
    out, begin = [], 0
    for i, word in enumerate(words):
        if i + 1 - begin >= LEAST and len(words) - i - 1 >= LEAST and zlib.crc32(word.strip().lower().encode()) % EVERY == 0:
            out.append("".join(words[begin : i + 1]))
            begin = i + 1
    return [*out, "".join(words[begin:])]


def _runs(words: np.ndarray, least_sentences: int = SENTENCES, least_words: int = WORDS) -> np.ndarray:
    """(first, last) of the shortest long-enough run from each sentence, forwards and backwards."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    last = np.maximum(np.searchsorted(sums, sums[:-1] + least_words, side="left") - 1, at + least_sentences - 1)
    first = np.minimum(np.searchsorted(sums, sums[1:] - least_words, side="right") - 1, at - least_sentences + 1)
    ahead = np.stack([at, last], axis=1)[last < n]
    behind = np.stack([first, at], axis=1)[(first >= 0) & (sums[1:] >= least_words)]
    runs = np.concatenate([ahead, behind])
    return np.stack(np.divmod(np.unique(runs[:, 0] * n + runs[:, 1]), n), axis=1) if n else runs


def _places(batches: Iterator[pa.RecordBatch], bits: int, least_sentences: int, least_words: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in batches:
        for doc, text, digest in zip(*(rows.column(i).to_pylist() for i in range(3))):
            if not text:
                continue
            found, keys, words = sentences(text), [], []
            for s in found:
                w = s.lower().split()
                keys.append(xxhash.xxh3_128_digest(" ".join(w)))
                words.append(len(w))
            runs = _runs(np.array(words, dtype=np.int64), least_sentences, least_words)
            if len(runs):
                power, back = word_hash.powers(_BASE, len(keys)), word_hash.powers(_INVERSE, len(keys))
                halves = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
                place = np.empty(len(runs), dtype=PLACE)
                for name, half in (("hash", halves[:, 0]), ("check", halves[:, 1])):
                    sums = np.zeros(len(keys) + 1, dtype=np.uint64)
                    np.cumsum(half * power, out=sums[1:])
                    place[name] = word_hash.mix((sums[runs[:, 1] + 1] - sums[runs[:, 0]]) * back[runs[:, 0]] + (runs[:, 1] - runs[:, 0]).astype(np.uint64))
                place["doc"] = _NO_ID if doc is None else doc
                place["text"] = digest
                place["a"], place["b"] = runs[:, 0], runs[:, 1]
                held.append(place)
            size += len(text)
            if size > BATCH_BYTES:
                yield _send(held, bits)
                held, size = [], 0
    if held:
        yield _send(held, bits)


def _new(p: np.ndarray) -> np.ndarray:
    """Which of the ordered places begin a run's hash."""
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p["hash"][1:] != p["hash"][:-1]) | (p["check"][1:] != p["check"][:-1])
    return new


def _not_first(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by hash and place, and which are elsewhere than their hash's first."""
    p = places[np.lexsort((places["a"], places["text"], places["doc"], places["check"], places["hash"]))]
    new = _new(p)
    first = p[np.flatnonzero(new)][np.cumsum(new) - 1]
    return p, (p["doc"] != first["doc"]) | (p["text"] != first["text"]) | (p["a"] != first["a"])


def _send(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    p, later = _not_first(np.concatenate(held)) if held else (np.zeros(0, dtype=PLACE), np.zeros(0, dtype=bool))
    gone, sent = p[later], p[_new(p)]
    bucket = (sent["hash"] >> _U(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    rows = [(int(bucket[x]), 1, sent[x:y].tobytes()) for x, y in zip(heads, [*heads[1:], len(bucket)])]
    # What is decided here already only passes through; it is dealt evenly over the buckets.
    start = int(word_hash.mix(gone["doc"][:1].astype(np.uint64))[0] >> _U(64 - bits)) if len(gone) else 0
    for i, lo in enumerate(range(0, len(gone), PIECE)):
        rows.append(((start + i) % (1 << bits), 0, gone[lo : lo + PIECE].tobytes()))
    c = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], names=["bucket", "kind", "places"])


def _meet(rows: pa.Table) -> pa.Table:
    """One bucket: its batches' first places against each other."""
    kinds, data = rows.column("kind").to_pylist(), rows.column("places").to_pylist()
    gone = [np.frombuffer(d, dtype=PLACE) for k, d in zip(kinds, data) if k == 0]
    sent = [np.frombuffer(d, dtype=PLACE) for k, d in zip(kinds, data) if k == 1]
    if sent:
        p, later = _not_first(np.concatenate(sent))
        gone.append(p[later])
    g = np.concatenate(gone) if gone else np.zeros(0, dtype=PLACE)
    return pa.table({"gone_id": pa.array(g["doc"].astype(np.int64)), "gone_text": pa.array(g["text"].astype(np.int64)), "a": pa.array(g["a"].astype(np.int32)), "b": pa.array(g["b"].astype(np.int32))})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        n, removed, kept = [], [], []
        for text, spans in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            found = sentences(text)
            stay = np.ones(len(found), dtype=bool)
            for s in spans or ():
                stay[s["a"] : s["b"] + 1] = False
            n.append(len(found))
            removed.append(len(found) - int(stay.sum()))
            kept.append("".join(s for s, k in zip(found, stay) if k) if spans else text)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])


def drop_repeated_spans(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_removed, text (what stays).

    A repeated run of fewer than least_sentences sentences or clauses, or least_words words, stays.
    """
    if least_sentences < 1 or least_words < 1:
        raise ValueError("a span has a sentence and a word at least")
    spark = docs.sparkSession
    common.prepare(spark)
    bits = common.bucket_bits(common.text_bytes(docs), common.shuffle_partitions(spark))
    texts = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).withColumn("digest", F.xxhash64("text"))
    places = texts.mapInArrow(lambda it: _places(it, bits, least_sentences, least_words), "bucket int, kind int, places binary")
    gone = places.groupBy("bucket").applyInArrow(_meet, "gone_id long, gone_text long, a int, b int")
    # A document's own spans, no more than twice its sentences.
    spans = gone.groupBy("gone_id", "gone_text").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = texts.join(spans, (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("gone_id")) & (F.col("digest") == F.col("gone_text")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, text string")
