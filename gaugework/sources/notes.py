"""Assemblies from the notes of an edit run: nested JSON read as variants, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.text import transcript

# Names in the notes.
_STAGE, _OUTPUTS, _MAIN_TRACK = "OrchestratorRefine", ("finalClipIds", "finalSegments", "finalTracks"), "v1"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _last(items: Column) -> Column:
    return F.element_at(F.when(F.size(items) > 0, items), -1)


def assembly(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, final_clip_ids, trimmed_word_ids, timeline, segments, track_sizes, b_roll, transcript, notes_prompt: one row per row of notes.

    The stage read is the last one named OrchestratorRefine..., else the last with a known output.  Clip and word ids and segments are
    arrays of JSON texts (null where the notes have no such list; trimmed ids are empty beside clip ids); timeline: the last word
    view of its sub-stages; b_roll: the captioned clips of all tracks but the main one, by track name; a caption is a non-empty text.
    Notes that are no JSON object, or have no such stage, give nulls, an empty b_roll and an empty transcript.
    """
    v = F.col("_v")
    rows = notes.select(key, F.try_parse_json(text).alias("_v"))
    stages = F.coalesce(_get(v, "$.stages", "array<variant>"), F.array().cast("array<variant>"))
    named = F.filter(stages, lambda s: F.coalesce(_get(s, "$.name", "string").startswith(_STAGE), F.lit(False)))

    def useful(s: Column) -> Column:
        found = F.lit(False)
        for name in _OUTPUTS:
            found = found | _get(s, f"$.output.{name}", "variant").isNotNull()
        return found

    rows = rows.withColumn("_stage", F.coalesce(_last(named), _last(F.filter(stages, useful))))
    stage = F.col("_stage")
    as_text = lambda path: F.transform(_get(stage, path, "array<variant>"), lambda x: F.to_json(x))
    views = F.transform(F.coalesce(_get(stage, "$.subStages", "array<variant>"), F.array().cast("array<variant>")), lambda s: _get(s, "$.input.currentTimeline", "string"))
    rows = rows.select(
        key, "_v", "_stage", as_text("$.output.finalClipIds").alias("final_clip_ids"), as_text("$.output.finalSegments").alias("segments"), as_text("$.output.trimmedWordIds").alias("_trimmed"),
        _last(F.filter(views, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))).alias("_view"),
        F.filter(F.map_entries(_get(stage, "$.output.finalTracks", "map<string, variant>")), lambda e: _get(e["value"], "$", "array<variant>").isNotNull()).alias("_tracks"),
    )
    known = F.col("final_clip_ids").isNotNull()
    clip = lambda c: F.struct(
        F.to_json(_get(c, "$.video_id", "variant")).alias("video_id"), _get(c, "$.start_ms", "double").alias("start_ms"), _get(c, "$.end_ms", "double").alias("end_ms"), _get(c, "$.caption", "string").alias("caption")
    )
    others = F.filter("_tracks", lambda e: e["key"] != _MAIN_TRACK)
    clips = F.flatten(F.transform(others, lambda e: F.transform(_get(e["value"], "$", "array<variant>"), clip)))
    timeline = F.when(known, F.col("_view"))
    return rows.select(
        key, "final_clip_ids", F.when(known, F.coalesce("_trimmed", F.array().cast("array<string>"))).alias("trimmed_word_ids"), timeline.alias("timeline"), "segments",
        F.map_from_entries(F.transform("_tracks", lambda e: F.struct(e["key"], F.size(_get(e["value"], "$", "array<variant>"))))).alias("track_sizes"),
        F.coalesce(F.filter(clips, lambda c: F.coalesce(c["caption"] != "", F.lit(False))), F.array().cast("array<struct<video_id:string,start_ms:double,end_ms:double,caption:string>>")).alias("b_roll"),
        F.when(timeline.isNotNull(), transcript(timeline)).otherwise("").alias("transcript"), _get(v, "$.prompt", "string").alias("notes_prompt"),
    )
