"""Readers of rating and metadata files; each gives a DataFrame in one of the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions import scoring as S

ANNOTATION = T.StructType(
    [
        T.StructField("annotator", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_idx", T.StringType()),
        T.StructField("cell_key", T.StringType()),
        T.StructField("output_slot", T.StringType()),
        T.StructField("annotation", T.MapType(T.StringType(), T.StringType())),
    ]
)


def annotations(spark: SparkSession, root: str, pattern: str = "*_humaneval.json", models: list[str] | None = None, projects: list[str] | None = None) -> DataFrame:
    """Annotation files (one JSON document each, at any depth) in long form: item_id, rater, ..., dimension, raw, score.

    Corrupt files are dropped; a bad prompt index counts as 0.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(root).select("*", F.col("_metadata.file_path").alias("path"))
    rows = files.select("path", F.from_json("value", ANNOTATION, {"mode": "PERMISSIVE"}).alias("r")).where("r.annotation is not null").select("path", "r.*")
    if models:
        rows = rows.where(F.col("model").isin(models))
    if projects:
        rows = rows.where(F.col("project").isin(projects))
    rows = rows.withColumn("prompt_idx", F.coalesce(F.col("prompt_idx").try_cast("int"), F.lit(0)))
    keyed = rows.select(S.item_key(F.col("project"), F.col("prompt_idx").cast("string"), F.col("model")).alias("item_id"), F.col("annotator").alias("rater"), "project", "model", "prompt_idx", "path", F.explode("annotation").alias("dimension", "raw"))
    return keyed.withColumn("score", S.number(F.col("raw")))


def unit_annotations(spark: SparkSession, path: str, rubrics: list[str]) -> DataFrame:
    """Strict JSON lines item_id, unit_id, rubric_id, rating: a line that breaks a rule fails the query with its text."""
    schema = "item_id string, unit_id string, rubric_id string, rating variant, severity string, comment string, annotator_id string, timestamp string"
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema).alias("r")).select("value", "r.*")
    kind = F.schema_of_variant(F.col("rating"))
    rating = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get("rating", "$", "double"))
    wrong = F.coalesce(F.col("item_id").isNull() | F.col("unit_id").isNull() | ~F.col("rubric_id").isin(rubrics) | ~rating.between(1, 5), F.lit(True)) | rating.isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad annotation: "), F.col("value"))).cast("double")).otherwise(rating)
    return rows.select("item_id", "unit_id", "rubric_id", checked.alias("rating"), "severity", "comment", "annotator_id", "timestamp")


def piped_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines `file|score|prompt` (prompts may hold pipes): stem, score, prompt; bad lines go, the last line of a stem stays."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    p = F.split("value", r"\|", 3)
    rows = lines.where(F.size(p) == 3).select(F.regexp_replace(F.trim(p[0]), r"\.[^.]*$", "").alias("stem"), S.number(p[1]).alias("score"), F.trim(p[2]).alias("prompt"), "pos").where("score is not null and stem <> ''")
    return rows.groupBy("stem").agg(F.max_by(F.struct("score", "prompt"), "pos").alias("r")).select("stem", "r.*")


def rating_table(spark: SparkSession, path: str, key: str = "uid", sep: str = "\t") -> DataFrame:
    """A wide table with one `[sc, pq]` column per editor, unpivoted: uid, editor, sc, pq; values must be 0, .5 or 1."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    long = wide.unpivot([key], [c for c in wide.columns if c != key], "editor", "raw")
    pair = F.from_json(F.col("raw"), "array<double>")
    good = (F.size(pair) == 2) & F.forall(pair, lambda v: v.isin(0.0, 0.5, 1.0))
    checked = F.when(F.coalesce(good, F.lit(False)), pair).otherwise(F.raise_error(F.concat(F.lit("bad rating: "), F.coalesce("raw", F.lit("")))).cast("array<double>"))
    return long.withColumn("_p", checked).select(F.col(key).alias("uid"), "editor", F.col("_p")[0].alias("sc"), F.col("_p")[1].alias("pq"))


def median_labels(ratings: DataFrame) -> DataFrame:
    """(uid, editor, sc) of all raters: median and label."""
    m = ratings.groupBy("uid", "editor").agg(F.median("sc").alias("median_sc"), F.count("*").alias("n_raters"))
    near = lambda v: F.abs(F.col("median_sc") - v) < 1e-9
    return m.withColumn("label", F.when(near(0.0), "no").when(near(0.5), "partial").when(near(1.0), "yes").otherwise(S.INVALID))


def scored_edits(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """JSON lines with item_id, task_uid and human_score, joined to (task_uid, split).

    Repeated item ids and tasks without a split fail the query; the label and the halved score are added.
    """
    rows = spark.read.json(path)
    times = F.count("*").over(Window.partitionBy("item_id"))
    rows = rows.withColumn("_n", times).join(splits.select("task_uid", "split"), "task_uid", "left")
    fault = F.when(F.col("_n") > 1, "repeated item ").when(F.col("split").isNull(), "no split for item ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("item_id"))).cast("string")).otherwise(F.col("item_id"))
    return rows.withColumn("item_id", checked).drop("_n").withColumns({"target": S.label_of_score(F.col("human_score")), "score_0_1": F.col("human_score") / 2})


def level_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with item_id and three rater levels 0..3: ratings exploded to (item_id, rater, level, label)."""
    rows = spark.read.json(path)
    good = F.coalesce((F.size("levels") == 3) & F.forall("levels", lambda x: x.between(0, 3)), F.lit(False))
    checked = F.when(good, F.col("levels")).otherwise(F.raise_error(F.concat(F.lit("bad levels of "), F.col("item_id"))).cast("array<bigint>"))
    return rows.select("item_id", F.posexplode(checked).alias("rater", "level")).withColumn("label", S.label_of_level(F.col("level")))


def split_manifest(manifest: DataFrame) -> DataFrame:
    """(seed, train array, test array) -> (task_uid, split)."""
    return manifest.select(F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("test")), F.array("train", "test"))).alias("split", "ids")).select(F.explode("ids").alias("task_uid"), "split")


def listed_outputs(spark: SparkSession, root: str, pattern: str, glob: str = "*") -> DataFrame:
    """Files below root whose path matches a pattern with groups (project, index): path, project, prompt_idx, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    found = files.where(F.col("path").rlike(pattern))
    return found.select("path", F.regexp_extract("path", pattern, 1).alias("project"), F.regexp_extract("path", pattern, 2).cast("int").alias("prompt_idx"), F.col("length").alias("bytes"))


def asset_digests(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def timeline_clips(spark: SparkSession, root: str, glob: str = "*.otio") -> DataFrame:
    """Timeline JSON files flattened: path, track, kind, idx, name, duration in seconds, moves (a transition does not)."""
    time = "struct<value: double, rate: double>"
    child = f"struct<OTIO_SCHEMA: string, name: string, source_range: struct<duration: {time}, start_time: {time}>>"
    schema = f"tracks struct<children: array<struct<kind: string, children: array<{child}>>>>"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    tracks = files.select("path", F.from_json("value", schema).alias("t")).select("path", F.posexplode("t.tracks.children").alias("track", "c"))
    clips = tracks.select("path", "track", "c.kind", F.posexplode("c.children").alias("idx", "x"))
    d = F.col("x.source_range.duration")
    return clips.select("path", "track", "kind", "idx", F.col("x.name").alias("name"), F.when(d["rate"] > 0, d["value"] / d["rate"]).otherwise(0.0).alias("duration"), (~F.coalesce(F.col("x.OTIO_SCHEMA"), F.lit("")).startswith("Transition")).alias("moves"))
