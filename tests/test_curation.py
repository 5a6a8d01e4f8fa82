"""Curated samples and label files from small folders."""

import json

import pytest
from pyspark.sql import functions as F

from gaugework.sources import curation, readers


@pytest.fixture
def folders(tmp_path):
    for name, files in {
        "one": {"user_query.json": {"prompts": [{"user_request": "cut", "target_duration": 30}, {"user_request": "trim"}]}, "all_sentences.json": ["a"], "aroll.json": ["b"], "all_visual_clips.json": {"x": "y" * 50}},
        "two": {"aroll.json": [1, 2], "config.json": {}},
    }.items():
        (tmp_path / "projects" / name).mkdir(parents=True)
        for f, v in files.items():
            (tmp_path / "projects" / name / f).write_text(json.dumps(v))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.json").write_text(json.dumps({"prompt": "p", "stages": [{"name": "OrchestratorRefineV2", "output": {"finalClipIds": [1]}}]}))
    (tmp_path / "otio").mkdir()
    clip = {"OTIO_SCHEMA": "Clip.1", "name": "c", "source_range": {"duration": {"value": 48, "rate": 24}, "start_time": {"value": 0, "rate": 24}}}
    (tmp_path / "otio" / "t.otio").write_text(json.dumps({"tracks": {"children": [{"kind": "Video", "children": [clip, clip]}]}}))
    return tmp_path


REQUEST = "project string, prompt_idx int, model string, use_case string, notes_path string, otio_path string, plan_path string, output_video_path string"


def test_curated_samples(spark, folders):
    notes, otio = f"file://{folders}/notes/n.json", f"file://{folders}/otio/t.otio"
    rows = [("one", 0, "m", "u", notes, otio, "", "/v.mp4"), ("one", 1, "m", "u", "", otio, "/plan", "/v.mp4"), ("two", 0, "m", "u", None, "", None, ""), ("none", 3, "m", "u", "/gone.json", "", "", "")]
    got = {r["item_id"]: r for r in curation.curated_samples(spark, spark.createDataFrame(rows, REQUEST), f"file://{folders}/projects", f"file://{folders}/notes", f"file://{folders}/otio").collect()}
    assert set(got) == {"one::0::m", "one::1::m", "two::0::m", "none::3::m"}
    one = got["one::0::m"]
    assert (one["user_prompt"], one["target_duration"], one["transcript_text"]) == ("cut", 30.0, '["a"]') and one["notes_assembly"]["final_clip_ids"] == ["1"] and one["timeline"] is None
    assert one["captions_path"].endswith("one/all_visual_clips.json") and one["captions_excerpt"].startswith('{"x"') and len(one["assets"]) == 6 and one["assets"] == sorted(one["assets"])
    assert got["one::1::m"]["user_prompt"] == "trim" and got["one::1::m"]["notes_assembly"] is None and [c["duration"] for c in got["one::1::m"]["timeline"]] == [2.0, 2.0]
    two = got["two::0::m"]
    assert (two["user_prompt"], two["target_duration"], two["transcript_text"], two["captions_excerpt"]) == ("", None, "[1, 2]", "") and len(two["assets"]) == 1
    assert got["none::3::m"]["assets"] == ["/gone.json"] and got["none::3::m"]["transcript_text"] == "[]"


def test_curation_bounds(spark, folders):
    files = curation.project_files(spark, f"file://{folders}/projects")
    empty = spark.createDataFrame([], "path string, content string")
    clips = readers.timeline_clips(spark, f"file://{folders}/otio")
    short = curation.curate(spark.createDataFrame([("one", 0, "m", "u", "", "", "", "")], REQUEST), files, empty, clips, captions_chars=10).first()
    assert short["captions_excerpt"] == '{"x": "' + "..." and len(short["captions_excerpt"]) == 10
    with pytest.raises(Exception, match="no prompt 7"):
        curation.curate(spark.createDataFrame([("one", 7, "m", "u", "", "", "", "")], REQUEST), files, empty, clips).collect()
    assert [tuple(r) for r in curation.user_prompts(files).orderBy("prompt_idx").collect()] == [("one", 0, "cut", 30.0), ("one", 1, "trim", None)]
    assert curation.curate(spark.createDataFrame([], REQUEST), files, empty, clips).count() == 0


def test_label_files_are_read_as_annotations(spark, tmp_path):
    labels = spark.createDataFrame([("a", 3.5), ("b", 4.0), ("gone", 1.0), ("c", None)], "stem string, score double")
    edited = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "stem string")
    path = f"file://{tmp_path}/labels"
    for _ in range(2):
        curation.write_labels(labels, edited, path, "ve", "mos", "quality")
    got = readers.annotations(spark, path, "*.txt").where("dimension = 'quality'")
    assert sorted((r["item_id"], r["rater"], r["score"]) for r in got.collect()) == [("a::0::ve", "mos", 3.5), ("b::0::ve", "mos", 4.0)]
    assert got.select(F.count_distinct("path")).first()[0] == 2
