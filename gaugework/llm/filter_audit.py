"""Filter interaction audit: what each filter removes in every order of the filters, from relational word counts.

Words are exploded and counted per (document, word), then per document, for totals and distincts: as Arrow tables in the
task that reads the document, so that no word and no text is shuffled (the same two aggregates as a DataFrame plan
take four times the CPU).  The flags that need other rows (copies, labels) are outer-joined.  Per part (language)
one aggregate then makes conditional counts for all 32 combinations of failures, of all documents, of good and
of toxic ones; every order's steps are sums of these columns.

Filters (a document that meets the condition fails): A under 100 words; B 100 * distinct words < 80 * words;
C 100 * capitals A-Z > 10 * code points; D holds one of # $ % & * |; E its text is also that of a smaller doc_id.

Defined cases: a null text is empty and fails A only (and E, as a copy of other empty texts); a null lang is the part
with an empty name, together with empty ones; every row counts, also where doc_id or the whole row repeats; a null
doc_id is smaller than none and has no smaller ones; a doc_id with several labels is good or toxic if any of them
says so; a document without labels is neither; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common

#: The filters' letters; bit i of a document's mask says that it fails the i-th.
FILTERS = "ABCDE"
_MASKS = 1 << len(FILTERS)
#: Bytes of text whose words are exploded at a time.
_WINDOW = 2 << 20
_KINDS = ("n", "good", "toxic")


def _word_totals(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of every text: explode, count per (text, word), then per text."""
    split = pc.ascii_split_whitespace(texts)
    exploded = pa.table({"row": pc.list_parent_indices(split), "word": pc.list_flatten(split)})
    exploded = exploded.filter(pc.not_equal(exploded["word"], ""))
    by_word = exploded.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
    by_row = by_word.group_by("row", use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    totals, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = by_row["row"].to_numpy()
    totals[at], distinct[at] = by_row["count_all_sum"].to_numpy(), by_row["count_all"].to_numpy()
    return totals, distinct


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text replaced by bit i for the i-th filter that looks at one text alone (A to D)."""
    for rows in batches:
        texts = rows.column(3)
        # Windows by bytes, so that the exploded words stay small beside any batch; a longer text stands alone.
        offsets, _ = common.utf8_buffers(texts)
        for lo, hi in common.chunks_by_bytes(offsets, _WINDOW):
            some, text = rows.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            words, distinct = _word_totals(text)
            capitals, points = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.count_substring_regex(text, "[A-Z]"), pc.utf8_length(text)))
            symbols = pc.match_substring_regex(text, "[#$%&*|]").to_numpy(zero_copy_only=False)
            fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols)
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(mask, pa.int32())], names=["doc_id", "part", "sha", "mask"])


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sha, mask) of every row: sha is the text's SHA-256, mask has the bits of the filters A to D."""
    common.prepare(docs.sparkSession)
    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, part string, sha binary, mask int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of docs; bit i of mask: it fails FILTERS[i]."""
    rows = common.materialize(text_failures(docs), "audit-rows")
    # Texts that several rows hold, with their smallest doc_id; written, so that the join deals out its rows anew and Spark can split a hot text.
    first = common.materialize(rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first_id"), "audit-copies")
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.expr("cast(quality = 1 as int)")).alias("good"), F.max(F.expr("cast(toxic = 1 as int)")).alias("toxic"))
    rows = rows.join(first, "sha", "left")
    rows = rows.join(marks, rows.doc_id == marks.l_id, "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return rows.select("part", F.col("mask").bitwiseOR(copied * (1 << FILTERS.index("E"))).alias("mask"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def combinations(failed: DataFrame) -> DataFrame:
    """One row per part: for each kind (n, good, toxic) the array of counts of documents by mask."""

    def count(kind: str, m: int) -> Column:
        hit = F.col("mask") == m
        return F.count_if(hit if kind == "n" else hit & (F.col(kind) == 1)).alias(f"{kind}_{m}")

    wide = failed.groupBy("part").agg(*(count(kind, m) for kind in _KINDS for m in range(_MASKS)))
    return wide.select("part", *(F.array(*(f"{kind}_{m}" for m in range(_MASKS))).alias(kind) for kind in _KINDS))


def _bits(letters: Column) -> Column:
    one = lambda x: F.pow(F.lit(2), F.instr(F.lit(FILTERS), x) - 1).cast("int")
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda got, x: got.bitwiseOR(one(x)))


def _total(kind: str, keep) -> Column:
    """The counts of the masks that keep(mask) holds for, summed."""
    masks = F.sequence(F.lit(0), F.lit(_MASKS - 1))
    return F.aggregate(F.filter(masks, keep), F.lit(0).cast("long"), lambda got, m: got + F.col(kind)[m])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    parts = combinations(failures(docs, labels)).select("*", F.explode(orders).alias("filter_order"))
    steps = parts.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("filter", _bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", _bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    fails, passed = lambda m: m.bitwiseAND(F.col("filter")) != 0, lambda m: m.bitwiseAND(F.col("before")) == 0
    counted = steps.select(
        "part",
        "filter_order",
        "step",
        _total("n", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("filter"))) == 0).alias("kept"),
        _total("n", lambda m: fails(m) & passed(m)).alias("removed"),
        _total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        F.col("n")[F.col("filter")].alias("unique_fails"),
        _total("good", lambda m: fails(m) & passed(m)).alias("good_lost"),
        _total("toxic", lambda m: fails(m) & passed(m)).alias("toxic_lost"),
        F.substr("filter_order", F.col("step"), F.lit(1)).alias("letter"),
    )
    # At most 600 rows a part.
    shapley = counted.groupBy(F.col("part").alias("s_part"), F.col("letter").alias("s_letter")).agg(F.sum("removed").alias("shapley"))
    joined = counted.join(shapley, (F.col("part") == F.col("s_part")) & (F.col("letter") == F.col("s_letter")))
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
