"""Columns for text: tokens, overlaps, ordered pattern families, flags, templates, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def signature(text: Column) -> Column:
    return F.array_sort(tokens(text))


def plain(text: Column) -> Column:
    """Lower-cased letters and digits, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def first_family(text: Column, families: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that the lower-cased text has."""
    out = None
    for name, pattern in families:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def flags(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in checks)))


def shorten(text: Column, most: int) -> Column:
    """Whole text up to `most` code points, else its first most - 3 and three dots."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(max(0, most - 3))), F.lit("..."))).otherwise(text)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replaces the known {placeholders} only."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def stable_rank(seed: int | str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def short_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(length)))


def unfence(text: Column) -> Column:
    """JSON text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def transcript(timeline: Column) -> Column:
    """The words of lines `id,text,duration`, joined by blanks; clip headings and other lines do not count; quotes around a text go."""
    lines = F.transform(F.split(timeline, "\r\n|\n|\r"), lambda x: F.trim(x))
    pattern = r"^([^,]+),(.*),\s*([0-9]+(?:\.[0-9]+)?)$"
    words = F.transform(F.filter(lines, lambda x: x.rlike(pattern) & ~x.startswith("clip ")), lambda x: F.trim(F.btrim(F.trim(F.regexp_extract(x, pattern, 2)), F.lit('"'))))
    return F.coalesce(F.array_join(F.filter(words, lambda w: w != ""), " "), F.lit(""))


def summary_lines(*parts: Column) -> Column:
    """Parts of a validated summary, one a line: trimmed, without nulls and blank ones."""
    return F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda x: x.isNotNull() & (x != "")), "\n")
