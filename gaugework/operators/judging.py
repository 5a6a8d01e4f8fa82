"""Judges as pluggable engines: prompt, call, parse, validate.  Calls run in mapInPandas batches; a fake serves tests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.functions.text import fill, flags, unfence
from gaugework.workers import checkpoints, share_package


class Engine(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashEngine:
    """A deterministic engine: the score 1..5 comes from a hash of the prompt."""

    def generate(self, prompt: str) -> str:
        n = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
        return json.dumps({"score_1_to_5": 1 + n % 5, "rationale": f"digest {n % 1000}"})


def call(rows: DataFrame, key: str, prompt: str, make_engine: Callable[[], Engine], attempts: int = 3) -> DataFrame:
    """key, content (NULL after `attempts` failures), error.  A task that runs again repeats its calls; results are keyed."""
    share_package(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for part in batches:
            out = []
            for k, p in zip(part[key], part[prompt]):
                content = error = None
                for _ in range(attempts):
                    try:
                        content, error = engine.generate(p), None
                        break
                    except Exception as e:  # noqa: BLE001  an engine may fail in any way
                        error = f"{type(e).__name__}: {e}"
                out.append((k, content, error))
            yield pd.DataFrame(out, columns=[key, "content", "error"])

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, content string, error string")


def validate(content: Column, score_path: str = "$.score_1_to_5", lo: float = 1.0, hi: float = 5.0, rationale_path: str | None = "$.rationale") -> Column:
    """Flags of a judge's raw content: not_json, no_score, out_of_range, empty_rationale."""
    text = unfence(content)
    parsed = F.try_parse_json(text)
    score = S.json_number(text, score_path)
    checks = [
        ("not_json", parsed.isNull()),
        ("no_score", parsed.isNotNull() & score.isNull()),
        ("out_of_range", F.coalesce(~score.between(lo, hi), F.lit(False))),
    ]
    if rationale_path:
        said = F.try_variant_get(parsed, rationale_path, "string")
        checks.append(("empty_rationale", parsed.isNotNull() & (F.coalesce(F.trim(said), F.lit("")) == "")))
    return flags(checks)


def judge(samples: DataFrame, key: str, template: str, fields: dict[str, str], make_engine: Callable[[], Engine], score_path: str = "$.score_1_to_5") -> DataFrame:
    """key, judge_raw (only of valid output), flags, valid, error: one judge over all samples."""
    prompts = samples.select(key, fill(F.lit(template), {name: F.col(c) for name, c in fields.items()}).alias("prompt"))
    said = call(prompts, key, "prompt", make_engine).withColumn("flags", validate(F.col("content"), score_path))
    valid = F.col("error").isNull() & (F.size("flags") == 0)
    return said.select(key, F.when(valid, S.json_number(unfence(F.col("content")), score_path)).alias("judge_raw"), "flags", valid.alias("valid"), "error")


def extract(samples: DataFrame, key: str, template: str, fields: dict[str, str], make_engine: Callable[[], Engine], schema: str) -> DataFrame:
    """key, the schema's columns, valid, error: one structured answer an engine per sample (features, questions, tags, unit scores).

    An answer that is no JSON object gives NULL columns and is not valid; missing fields are NULL.
    """
    prompts = samples.select(key, fill(F.lit(template), {name: F.col(c) for name, c in fields.items()}).alias("prompt"))
    said = call(prompts, key, "prompt", make_engine)
    text = unfence(F.col("content"))
    object_ = F.col("error").isNull() & F.coalesce(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), F.lit(False))
    return said.select(key, F.from_json(F.when(object_, text), schema).alias("_a"), object_.alias("valid"), "error").select(key, "_a.*", "valid", "error")


def json_scores(rows: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, path, name, value) of every member with one of the names, at any depth of a JSON text; nothing below such a member.

    Bad or missing JSON, and an object that repeats a name, give no rows; values are kept as JSON text.  Every level of nesting is one
    step over the members found so far, written to the checkpoint folder; the last level ends it.
    """
    spark = rows.sparkSession
    checkpoints(spark)
    level = rows.select(F.col(key).alias("_id"), F.lit("$").alias("_path"), F.try_parse_json(text).alias("_v")).where("_v is not null")
    out = None
    while True:
        member = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
            "_id", F.concat("_path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("_path"), F.col("key").alias("_name"), F.col("value").alias("_v")
        )
        member = member.checkpoint()
        hit = F.coalesce(F.col("_name").isin(*names), F.lit(False))
        found = member.where(hit).select(F.col("_id").alias(key), F.col("_path").alias("path"), F.col("_name").alias("name"), F.to_json("_v").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = member.where(~hit & F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")).select("_id", "_path", "_v")
        if level.isEmpty():
            return out


class HashEmbedder:
    """A deterministic embedder: a text's vector comes from the bytes of its digest."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def embed(rows: DataFrame, key: str, text: str, make_embedder: Callable, batch: int = 256) -> DataFrame:
    """key, embedding: texts in batches through an embedder; a null text has none."""
    share_package(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for part in batches:
            vectors = [v for lo in range(0, len(part), batch) for v in embedder.embed(list(part[text][lo : lo + batch]))]
            yield pd.DataFrame({key: part[key], "embedding": vectors})

    some = rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")
    return some.unionByName(rows.where(F.col(text).isNull()).select(key, F.lit(None).cast("array<double>").alias("embedding")))
