"""Curated judge samples from project folders, notes and timelines; label files from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.scoring import item_key
from gaugework.sources.notes import assembly
from gaugework.sources.readers import timeline_clips

# Files of a project folder; the transcript is the first of POOLS that is there.
QUERY, CLIPS, POOLS, ASSETS = "user_query.json", "all_visual_clips.json", ("all_sentences.json", "aroll.json"), ("video_id_map.json", "all_visual_clips.json", "all_sentences.json", "user_query.json", "config.json")


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """project (its folder's name), name, path, content of the JSON files right below root's folders."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{root}/*").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return files.select(part(-2).alias("project"), part(-1).alias("name"), "path", "content")


def user_prompts(files: DataFrame) -> DataFrame:
    """project, prompt_idx, user_prompt, target_duration of every prompt of the projects' query files."""
    found = files.where(F.col("name") == QUERY).select("project", F.try_variant_get(F.try_parse_json("content"), "$.prompts", "array<variant>").alias("p"))
    rows = found.select("project", F.posexplode("p").alias("prompt_idx", "p"))
    return rows.select("project", "prompt_idx", F.coalesce(F.try_variant_get("p", "$.user_request", "string"), F.lit("")).alias("user_prompt"), F.try_variant_get("p", "$.target_duration", "double").alias("target_duration"))


def plain_path(path: Column) -> Column:
    """A path that compares equal with or without a local scheme (/a, file:/a, file:///a)."""
    return F.regexp_replace(path, "^file:/+", "/")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def curate(requests: DataFrame, files: DataFrame, notes: DataFrame, clips: DataFrame, captions_chars: int = 16_000, transcript_chars: int = 200_000) -> DataFrame:
    """One sample per request (project, prompt_idx, model, use_case, notes_path, otio_path, plan_path, output_video_path).

    files: project_files(); notes: (path, content); clips: timeline_clips().  Columns: item_id, the request's, user_prompt,
    target_duration, transcript_text, captions_excerpt, captions_path, assets (sorted), notes_assembly (struct), timeline (array of
    clips).  The assembly comes from the notes where that file is there, else from the timeline, else both are null.  A prompt index
    beyond the project's query file fails the query; without that file the prompt is empty.  JSON is kept as its file has it.
    """
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("content")))
    where = lambda name: F.max(F.when(F.col("name") == name, F.col("path")))
    projects = files.groupBy("project").agg(
        F.coalesce(*(of(n) for n in POOLS), F.lit("[]")).alias("_pool"), of(CLIPS).alias("_captions"), where(CLIPS).alias("captions_path"), where(QUERY).alias("_query"),
        F.collect_set(F.when(F.col("name").isin(*ASSETS), F.col("path"))).alias("_assets"),  # the fixed names at most
    )
    rows = requests.join(projects, "project", "left").join(user_prompts(files), ["project", "prompt_idx"], "left")
    missing = F.col("_query").isNotNull() & F.col("user_prompt").isNull()
    prompt = F.when(missing, F.raise_error(F.concat(F.lit("no prompt "), F.col("prompt_idx").cast("string"), F.lit(" in "), F.col("_query"))).cast("string")).otherwise(F.coalesce("user_prompt", F.lit("")))
    told = assembly(notes.select(F.col("path").alias("_np"), "content"), "_np", "content")
    told = told.select("_np", F.struct(*(c for c in told.columns if c != "_np")).alias("notes_assembly"))
    cut = clips.groupBy(F.col("path").alias("_op")).agg(F.array_sort(F.collect_list(F.struct("track", "idx", "kind", "name", "duration", "moves"))).alias("_timeline"))  # one timeline's clips
    rows = rows.join(told, plain_path(F.col("notes_path")) == plain_path(F.col("_np")), "left").join(cut, plain_path(F.col("otio_path")) == plain_path(F.col("_op")), "left")
    own = F.filter(F.array("notes_path", "otio_path", "plan_path", "output_video_path"), lambda p: F.coalesce(p != "", F.lit(False)))
    return rows.select(
        item_key(F.col("project"), F.col("prompt_idx").cast("string"), F.col("model")).alias("item_id"), *requests.columns, prompt.alias("user_prompt"), "target_duration",
        shortened(F.coalesce("_pool", F.lit("[]")), transcript_chars).alias("transcript_text"), shortened(F.coalesce("_captions", F.lit("")), captions_chars).alias("captions_excerpt"),
        F.coalesce("captions_path", F.lit("")).alias("captions_path"), F.array_sort(F.array_distinct(F.concat(F.coalesce("_assets", F.array().cast("array<string>")), own))).alias("assets"),
        "notes_assembly", F.when(F.col("notes_assembly").isNull(), F.col("_timeline")).alias("timeline"),
    )


def curated_samples(spark: SparkSession, requests: DataFrame, root: str, notes_root: str, otio_root: str) -> DataFrame:
    """curate() over folders: projects below root, notes (*.json) and timelines (*.otio) below theirs."""
    notes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(notes_root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return curate(requests, project_files(spark, root), notes, timeline_clips(spark, otio_root))


def write_labels(labels: DataFrame, edited: DataFrame, path: str, model: str, annotator: str, dimension: str) -> None:
    """Annotation documents from (stem, score) for the stems whose edited file is there (edited: stem): one folder and file per stem.

    A second run replaces the stems that it writes; annotations(..., pattern="*.txt") reads them.
    """
    rows = labels.where(F.col("score").isNotNull()).join(edited.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.max("score").alias("score"))
    note = F.to_json(F.struct(
        F.lit(annotator).alias("annotator"), F.col("stem").alias("project"), F.lit(0).alias("prompt_idx"), F.lit(model).alias("model"), F.lit(f"prompt_0__{model}").alias("cell_key"),
        F.lit(1).alias("output_slot"), F.struct(F.col("score").cast("double").alias(dimension), F.lit(True).alias("_complete")).alias("annotation"),
    ))
    rows.select("stem", note.alias("value")).repartition("stem").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").text(path)
