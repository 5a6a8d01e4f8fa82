"""Readers, logs and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from gaugework.sources import readers, state
from gaugework.streaming import debate, incremental


def test_annotations(spark, tmp_path):
    for i, (rater, project, idx, marks) in enumerate([("r1", "p", "4", {"d1": "5", "d2": ""}), ("r2", "p", "4", {"d1": " 3 "}), ("r1", "q", "x", {"d1": "nan"})]):
        folder = tmp_path / f"f{i}"
        folder.mkdir()
        (folder / f"{i}_humaneval.json").write_text(json.dumps({"annotator": rater, "project": project, "model": "m", "prompt_idx": idx, "annotation": marks}))
    (tmp_path / "bad_humaneval.json").write_text("{oops")
    got = {(r["item_id"], r["rater"], r["dimension"]): r["score"] for r in readers.annotations(spark, str(tmp_path)).collect()}
    assert got == {("p::4::m", "r1", "d1"): 5.0, ("p::4::m", "r1", "d2"): None, ("p::4::m", "r2", "d1"): 3.0, ("q::0::m", "r1", "d1"): None}
    assert readers.annotations(spark, str(tmp_path), projects=["q"]).count() == 1


def test_unit_annotations_are_strict(spark, tmp_path):
    line = {"item_id": "i", "unit_id": "u", "rubric_id": "r", "rating": 3}
    (tmp_path / "good.jsonl").write_text(json.dumps(line) + "\n\n")
    assert readers.unit_annotations(spark, str(tmp_path / "good.jsonl"), ["r"]).first()["rating"] == 3.0
    for i, wrong in enumerate([{"rating": 8}, {"rating": True}, {"rating": "3"}, {"rubric_id": "z"}, {"unit_id": None}]):
        (tmp_path / f"bad{i}.jsonl").write_text(json.dumps(line | wrong))
        with pytest.raises(Exception, match="bad annotation"):
            readers.unit_annotations(spark, str(tmp_path / f"bad{i}.jsonl"), ["r"]).collect()


def test_piped_labels(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.mp4|3.5|make it | red\nbroken\nb.mp4|x|p\na.mp4|4.5|again\n")
    assert [tuple(r) for r in readers.piped_labels(spark, str(tmp_path / "l.txt")).collect()] == [("a", 4.5, "again")]


def test_rating_tables_and_median(spark, tmp_path):
    for i, sc in enumerate(("0", "0.5", "1")):
        (tmp_path / f"r{i}.tsv").write_text(f"uid\te1\te2\nu1\t[{sc}, 1]\t[1, 0.5]\n")
    got = readers.median_labels(readers.rating_table(spark, str(tmp_path))).collect()
    assert {(r["editor"], r["median_sc"], r["label"], r["n_raters"]) for r in got} == {("e1", 0.5, "partial", 3), ("e2", 1.0, "yes", 3)}
    (tmp_path / "bad.tsv").write_text("uid\te1\nu1\t[2, 1]\n")
    with pytest.raises(Exception, match="bad rating"):
        readers.rating_table(spark, str(tmp_path / "bad.tsv")).collect()


def test_scored_edits_and_levels(spark, tmp_path):
    rows = [{"item_id": "a", "task_uid": "t", "human_score": 1.5833}, {"item_id": "b", "task_uid": "t", "human_score": 0.0}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    splits = readers.split_manifest(spark.createDataFrame([(42, ["t"], ["z"])], "seed int, train array<string>, test array<string>"))
    got = {r["item_id"]: (r["target"], r["split"]) for r in readers.scored_edits(spark, str(tmp_path / "s.jsonl"), splits).collect()}
    assert got == {"a": ("yes", "train"), "b": ("no", "train")}
    with pytest.raises(Exception, match="no split"):
        readers.scored_edits(spark, str(tmp_path / "s.jsonl"), splits.where("split = 'test'")).collect()
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, [rows[0], rows[0]])))
    with pytest.raises(Exception, match="repeated item"):
        readers.scored_edits(spark, str(tmp_path / "s.jsonl"), splits).collect()
    (tmp_path / "l.jsonl").write_text(json.dumps({"item_id": "a", "levels": [0, 1, 3]}))
    assert [r["label"] for r in readers.level_rows(spark, str(tmp_path / "l.jsonl")).orderBy("rater").collect()] == ["no", "partial", "yes"]


def test_file_listings(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "prompt_3_notes.json").write_text("{}")
    got = readers.listed_outputs(spark, str(tmp_path), r"([^/]+)/prompt_(\d+)_notes\.json$").first()
    assert (got["project"], got["prompt_idx"], got["bytes"]) == ("p1", 3, 2)
    assert len(readers.asset_digests(spark, str(tmp_path), "*.json").first()["sha256"]) == 64
    clip = {"OTIO_SCHEMA": "Clip.1", "name": "c", "source_range": {"duration": {"value": 72, "rate": 24}, "start_time": {"value": 0, "rate": 24}}}
    (tmp_path / "t.otio").write_text(json.dumps({"tracks": {"children": [{"kind": "Video", "children": [clip, {"OTIO_SCHEMA": "Transition.1", "name": "x"}]}]}}))
    clips = readers.timeline_clips(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(c["duration"], c["moves"]) for c in clips] == [(3.0, True), (0.0, False)]


def test_logs_replay_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    for seq, rows in enumerate(([("a", '{"v": 1}'), ("b", "2")], [("a", '{"v": 3}'), ("c", "{torn")])):
        state.append(spark.createDataFrame([(k, seq, v) for k, v in rows], state.LOG), path)
    done = state.read_log(spark, path)
    assert {r["key"]: r["value"] for r in done.collect()} == {"a": '{"v": 3}', "b": "2"}
    assert [r["key"] for r in state.unfinished(spark.createDataFrame([("a",), ("c",)], "key string"), done, ["key"]).collect()] == ["c"]
    (tmp_path / "log.jsonl").write_text('{"key": "k", "value": 1}\n{"key": "k", "value": {"x": 2}}\n{"key": "k", "val')
    assert state.read_json_log(spark, str(tmp_path / "log.jsonl")).first()["value"] == '{"x":2}'


def test_publish_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "units")
    state.publish(spark.createDataFrame([("i", 1.0, "u", "k1"), ("j", 2.0, "u", "k2")], "item_id string, start_seconds double, unit_id string, cache_key string"), path, "cache_key")
    state.publish(spark.createDataFrame([("i", 5.0, "v", "k1")], "item_id string, start_seconds double, unit_id string, cache_key string"), path, "cache_key")
    assert [(r["item_id"], r["unit_id"]) for r in state.query_units(spark.read.parquet(path)).collect()] == [("i", "v"), ("j", "u")]


def test_stream_skips_done_keys_and_reports(spark, tmp_path):
    source, results, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    judge = lambda rows: rows.select("key", F.when(F.col("key") != "bad", F.concat(F.lit("v"), "key")).alias("value"))
    for part in (["a", "b", "bad"], ["b", "c"]):
        spark.createDataFrame([(k,) for k in part], "key string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string").parquet(source)
        incremental.judge_stream(stream, judge, results, str(tmp_path / "ckpt"), lambda all_: seen.append(all_.count())).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(results).collect()) == ["a", "b", "c"] and seen[-1] == 3


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", "click", float(m)) for h in range(3) for m in range(0, 60, 7)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = incremental.windowed_scores(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, incremental.windowed_scores(rows).collect()))


def test_debates_converge(spark):
    turns = [("a", 1, 3.0), ("a", 2, 3.1), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, 1.0), ("b", 4, 3.0), ("c", 1, 1.0), ("c", 2, 2.0), ("c", 3, None)]
    got = {r["k"]: (r["stop_round"], r["final_score"], r["stop_reason"]) for r in debate.convergence(spark.createDataFrame(turns, "k string, round int, score double"), ["k"], 0.25, 6).collect()}
    assert got == {"a": (2, 3.1, "stable"), "b": (4, 3.0, "cycle"), "c": (2, 2.0, "open")}
