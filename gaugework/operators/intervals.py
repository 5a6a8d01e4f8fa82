"""Timelines: running cursors, containment, one-to-one nearest matches, segmentation, trailing cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.workers import share_package


def running_cursor(rows: DataFrame, by: list[str], order: list[str], duration: str, advances: str | None = None) -> DataFrame:
    """output_start = the durations before a row in its track, output_end = with its own; rows that do not advance add 0."""
    step = F.coalesce(F.col(duration), F.lit(0.0)) if advances is None else F.when(F.col(advances), F.coalesce(F.col(duration), F.lit(0.0))).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("output_start", start).withColumn("output_end", F.col("output_start") + step)


def first_containing(points: DataFrame, spans: DataFrame, by: list[str], width: float, slack: float = 1e-6) -> DataFrame:
    """Each point with the first span (by ordinal) of its group that contains it, else NULL.

    points: by..., point_id, start, end; spans: by..., ordinal, span_start, span_end.  Spans are dealt to the
    bins of `width` that they touch, so the join is an equi-join on (group, bin of the point's start).
    """
    bins = F.sequence(F.floor((F.col("span_start") - slack) / width).cast("long"), F.floor((F.col("span_end") + slack) / width).cast("long"))
    binned = spans.where("span_end >= span_start").withColumn("_bin", F.explode(bins))
    asked = points.withColumn("_bin", F.floor(F.col("start") / width).cast("long"))
    met = asked.join(binned, [*by, "_bin"]).where((F.col("start") >= F.col("span_start") - slack) & (F.col("end") <= F.col("span_end") + slack))
    first = met.groupBy(*by, "point_id").agg(F.min("ordinal").alias("ordinal"))
    return points.join(first, [*by, "point_id"], "left")


def _match(left: list[float], right: list[float], tolerance: float) -> list[tuple]:
    """Ascending left times each take the nearest unused right time within the tolerance; the earlier one on ties."""
    used, out, lo = [False] * len(right), [], 0
    for a in left:
        while lo < len(right) and right[lo] < a - tolerance:
            lo += 1
        best, i = None, lo
        while i < len(right) and right[i] <= a + tolerance:
            if not used[i] and (best is None or abs(right[i] - a) < abs(right[best] - a)):
                best = i
            i += 1
        if best is None:
            out.append((a, None, "left_only", 0.8))
        else:
            used[best] = True
            out.append((a, right[best], "matched", 1.0))
    return out + [(None, b, "right_only", 0.65) for b, u in zip(right, used) if not u]


def nearest_matches(times: DataFrame, by: str, tolerance: float) -> DataFrame:
    """(by, side left/right, at) -> one-to-one matches: by, left_at, right_at, kind, confidence.

    Times further apart than the tolerance cannot affect each other, so a group is first cut where
    neighbours lie more than that apart; each piece is matched on its own, and a busy group spreads over tasks.
    """
    share_package(times.sparkSession)
    w = Window.partitionBy(by).orderBy("at", "side")
    apart = (F.col("at") - F.lag("at").over(w) > tolerance).cast("int")
    cut = times.where("at is not null").withColumn("_apart", F.coalesce(apart, F.lit(0)))
    cut = cut.withColumn("piece", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = dict(times.dtypes)[by]

    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("at")))).alias(side) for side in ("left", "right")]
    pieces = cut.groupBy(by, "piece").agg(*sides).select(by, "left", "right")  # a piece is one chain of near times

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(key, *x) for key, left, right in zip(rows[by], rows["left"], rows["right"]) for x in _match(list(left), list(right), tolerance)]
            yield pd.DataFrame(found, columns=[by, "left_at", "right_at", "kind", "confidence"])

    return pieces.mapInPandas(match, f"{by} {kind}, left_at double, right_at double, kind string, confidence double")


def segments(cuts: DataFrame, by: str, most: float, least_gap: float = 3.0) -> DataFrame:
    """(by, duration, silences array<double>, boundaries array<double>) -> by, ordinal, start, end.

    Cuts at silences at least least_gap after the last cut; where a piece would exceed `most`, at its latest
    boundary, else at `most`.  One row holds one timeline.
    """
    share_package(cuts.sparkSession)
    kind = dict(cuts.dtypes)[by]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, duration, silences, boundaries in zip(rows[by], rows["duration"], rows["silences"], rows["boundaries"]):
                edges = [0.0]
                for s in sorted(silences if silences is not None else []):
                    if s - edges[-1] >= least_gap and s < duration:
                        edges.append(float(s))
                final, shots = [0.0], sorted(boundaries if boundaries is not None else [])
                for end in [*edges[1:], float(duration)]:
                    while end - final[-1] > most:
                        reach = [b for b in shots if final[-1] < b <= final[-1] + most]
                        final.append(float(reach[-1]) if reach else final[-1] + most)
                    final.append(end)
                out += [(key, i, a, b) for i, (a, b) in enumerate(zip(final, final[1:])) if b > a]
            yield pd.DataFrame(out, columns=[by, "ordinal", "start", "end"])

    return cuts.select(by, "duration", "silences", "boundaries").mapInPandas(cut, f"{by} {kind}, ordinal int, start double, end double")


#: Prime and base of each of the two hashes of a sequence; 16 ** 10 positions at most.
_HASHES = ((2147483647, 1103515245), (2147483629, 1664525017))


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent mod prime, by tables of the exponent's hexadecimal digits."""
    out = F.lit(1).cast("long")
    for k in range(0, 40, 4):
        table = F.array(*(F.lit(pow(base, d << k, prime)).cast("long") for d in range(16)))
        digit = F.shiftright(exponent.cast("long"), k).bitwiseAND(F.lit(15))
        out = out * F.element_at(table, (digit + 1).cast("int")) % prime
    return out


def trailing_cycles(rows: DataFrame, by: str, order: str, score: str, width: int = 4096) -> DataFrame:
    """by, cycles: whether the last p scores equal the p before them, for some p of at least 2, and are not constant.

    order: whole numbers.  Scores are counted from a group's end; with H(p) a hash of the last p scores, the periods are equal
    where H(2p) = H(p) + base ** p * H(p), in two 31-bit hashes.  A group is cut into ranges of `width` numbers; the
    ranges' sums carry the hashes on, so no group meets in one array or one task.
    """
    w = Window.partitionBy(by, "_range").orderBy(F.desc(order), F.desc(score))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    z = rows.select(by, F.col(order), F.col(score), F.floor(F.col(order) / width).cast("long").alias("_range")).withColumn("_j", F.row_number().over(w).cast("long"))
    z = z.withColumns({"_lo": F.min(score).over(run), "_hi": F.max(score).over(run)})
    for i, (prime, base) in enumerate(_HASHES):
        z = z.withColumn(f"_t{i}", F.pmod(F.xxhash64(score, F.lit(i)), F.lit(prime)) * _power(base, prime, F.col("_j")) % prime).withColumn(f"_h{i}", F.sum(f"_t{i}").over(run) % prime)
    sums = z.groupBy(by, "_range").agg(F.count("*").alias("_n"), F.min("_lo").alias("_l"), F.max("_hi").alias("_g"), *((F.sum(f"_t{i}") % p).alias(f"_s{i}") for i, (p, _) in enumerate(_HASHES)))
    later = Window.partitionBy(by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    for i, (prime, base) in enumerate(_HASHES):
        sums = sums.withColumn(f"_b{i}", _power(base, prime, F.col("_base"))).withColumn(f"_o{i}", F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_b{i}") % prime).over(later) % prime, F.lit(0)))
    held = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), "_base", *(f"_{c}{i}" for i in range(len(_HASHES)) for c in "bo"), F.min("_l").over(later).alias("_l"), F.max("_g").over(later).alias("_g"))
    whole = z.join(held, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_r"))).select(
        by, (F.col("_base") + F.col("_j")).alias("_p"), (F.least("_lo", "_l") < F.greatest("_hi", "_g")).alias("_mixed"),
        *(((F.col(f"_o{i}") + F.col(f"_b{i}") * F.col(f"_h{i}")) % p).alias(f"_h{i}") for i, (p, _) in enumerate(_HASHES)),
    )
    double = whole.where("_p % 2 = 0").select(by, F.expr("_p div 2").alias("_p"), *(F.col(f"_h{i}").alias(f"_d{i}") for i in range(len(_HASHES))))
    met = whole.unionByName(double, allowMissingColumns=True).groupBy(by, "_p").agg(*(F.max(c).alias(c) for c in ["_mixed", *(f"_{c}{i}" for i in range(len(_HASHES)) for c in "hd")]))
    equal = (F.col("_p") >= 2) & F.col("_mixed")
    for i, (prime, base) in enumerate(_HASHES):
        equal = equal & (F.col(f"_d{i}") == (F.col(f"_h{i}") + _power(base, prime, F.col("_p")) * F.col(f"_h{i}")) % prime)
    return met.groupBy(by).agg(F.coalesce(F.max(equal), F.lit(False)).alias("cycles"))
