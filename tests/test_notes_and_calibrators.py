"""Notes, nested scores, calibrators as stages, alternating samples and batch logs, against brute force."""

import hashlib
import json
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from gaugework.operators import calibration, gramian, judging, sampling, trees
from gaugework.operators.calibrator import Calibrator, CalibratorModel
from gaugework.sources import notes, state

# -- nested JSON ------------------------------------------------------------------------------------------


def walk(value, names, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            if k in names:
                yield f"{path}.{k}", k, json.dumps(v, separators=(",", ":"))
            else:
                yield from walk(v, names, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, names, f"{path}[{i}]")


def test_json_scores_at_any_depth(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([None, True, 3, "x", "ü"])
        if kind < 0.5:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["score", "a", "b", "c", "value"]) + str(i) * (i > 3): made(depth - 1) for i in range(rng.randrange(5))}

    values = [made(6) for _ in range(60)] + [{"a": {"score": {"score": 1}}, "score": [1, 2]}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{"), (902, "5"), (903, '{"a": 1, "a": 2}')]
    got = judging.json_scores(spark.createDataFrame(rows, "id long, text string"), "id", "text", ["score", "value"])
    plain = lambda rows: sorted((i, path, name, json.dumps(json.loads(value), sort_keys=True)) for i, path, name, value in rows)
    assert plain(map(tuple, got.collect())) == plain((i, *x) for i, v in enumerate(values) for x in walk(v, {"score", "value"}))
    assert "Python" not in got._jdf.queryExecution().toString() and judging.json_scores(spark.createDataFrame([], "id long, text string"), "id", "text", ["k"]).count() == 0


def brute_assembly(text):
    empty = {"final_clip_ids": None, "trimmed_word_ids": None, "segments": None, "track_sizes": None, "captions": [], "transcript": "", "notes_prompt": None}
    try:
        n = json.loads(text)
    except (TypeError, ValueError):
        return empty
    stages = [s for s in n.get("stages") or [] if isinstance(s, dict)]
    named = [s for s in stages if str(s.get("name", "")).startswith("OrchestratorRefine")]
    useful = [s for s in stages if isinstance(s.get("output"), dict) and any(k in s["output"] for k in ("finalClipIds", "finalSegments", "finalTracks"))]
    stage = named[-1] if named else useful[-1] if useful else None
    out = empty | {"notes_prompt": n.get("prompt")}
    if stage is None:
        return out
    o = stage.get("output") or {}
    if isinstance(o.get("finalClipIds"), list):
        out["final_clip_ids"] = [json.dumps(x) for x in o["finalClipIds"]]
        out["trimmed_word_ids"] = [json.dumps(x) for x in o.get("trimmedWordIds") or []]
        views = [s["input"]["currentTimeline"] for s in stage.get("subStages") or [] if isinstance(s.get("input"), dict) and isinstance(s["input"].get("currentTimeline"), str) and s["input"]["currentTimeline"].strip()]
        if views:
            out["transcript"] = " ".join(x.split(",")[1].strip().strip('"') for x in views[-1].split("\n") if x.count(",") == 2 and not x.startswith("clip "))
    if isinstance(o.get("finalSegments"), list):
        out["segments"] = len(o["finalSegments"])
    if isinstance(o.get("finalTracks"), dict):
        lists = {k: v for k, v in o["finalTracks"].items() if isinstance(v, list)}
        out["track_sizes"] = {k: len(v) for k, v in lists.items()}
        out["captions"] = sorted(c["caption"] for k, v in lists.items() if k != "v1" for c in v if isinstance(c, dict) and c.get("caption"))
    return out


def test_assembly_from_notes(spark):
    refine = {"name": "OrchestratorRefineV2", "output": {"finalClipIds": [1, "b"], "trimmedWordIds": [4]}, "subStages": [{"input": {"currentTimeline": "clip 1,x,2\n1,one,0.5\n2,\"two\",1"}}, {"input": {"currentTimeline": " "}}, {"input": 4}, {}]}
    tracks = {"name": "x", "output": {"finalSegments": [{}, {}], "finalTracks": {"v1": [{"caption": "no"}], "v2": [{"caption": "yes", "video_id": "q", "start_ms": 5}, {"caption": ""}, 3, {}], "v3": "none", "v4": [{"caption": "also"}]}}}
    texts = [
        json.dumps({"prompt": "p", "stages": [tracks, refine]}), json.dumps({"prompt": "p", "stages": [tracks, {"name": "y", "output": {}}]}), json.dumps({"stages": [refine, {"name": "OrchestratorRefineV9", "output": {}}]}),
        json.dumps({"prompt": "p"}), json.dumps({"prompt": "p", "stages": "none"}), json.dumps({"stages": []}), None, "{", json.dumps({"stages": [{"name": "OrchestratorRefine", "output": {"finalClipIds": []}}]}),
    ]
    got = notes.assembly(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t").collect()
    for r in got:
        wanted = brute_assembly(texts[r["i"]])
        found = {k: r[k] for k in ("final_clip_ids", "trimmed_word_ids", "track_sizes", "transcript", "notes_prompt")}
        found |= {"segments": None if r["segments"] is None else len(r["segments"]), "captions": sorted(c["caption"] for c in r["b_roll"])}
        assert found == wanted, texts[r["i"]]
    assert len(got) == len(texts) and got[1]["b_roll"][0]["video_id"] == '"q"' and got[1]["b_roll"][0]["start_ms"] == 5.0


# -- calibrators as stages --------------------------------------------------------------------------------


def rated(spark, n=120):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(1, 6)), float(rng.randrange(4)), rng.choice([1.0, 2.0]), rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)]
    rows = [(g, x, z, min(5.0, max(1.0, 0.6 * x + 0.3 * z + rng.gauss(0, 0.2))), w, s, t, "no" if s < 35 else "partial" if t < 60 else "yes") for g, x, z, w, s, t in rows]
    return spark.createDataFrame(rows, "g string, judge_raw double, z double, human double, w double, s double, t double, label string").cache()


@pytest.mark.parametrize("kind", ["bias", "line", "linear", "ridge", "tree", "cutpoints", "gates"])
def test_calibrators_fit_save_load_and_transform(spark, tmp_path, kind):
    rows = rated(spark)
    labels = kind in ("cutpoints", "gates")
    settings = {"features": ["s", "t"], "target": "label", "output": "said"} if labels else {"by": ["g"], "features": ["judge_raw", "z"], "weight": "w", "output": "said"}
    model = Calibrator(kind=kind, **settings).fit(rows)
    got = model.transform(rows)
    assert got.columns == [*rows.columns, "said"] and got.count() == rows.count()
    model.write().overwrite().save(f"{tmp_path}/{kind}")
    again = CalibratorModel.load(f"{tmp_path}/{kind}")
    assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, got.collect())) and again.metadata() == model.metadata()
    if kind == "linear":
        fit = gramian.linear(rows.where("g = 'a'"), [], ["judge_raw", "z"], "human", "w").first()
        for r in got.where("g = 'a'").collect():
            assert r["said"] == pytest.approx(min(5.0, max(1.0, fit["intercept"] + fit["coefficients"][0] * r["judge_raw"] + fit["coefficients"][1] * r["z"])))
    if kind == "tree":
        direct = trees.predict(rows, trees.histogram_tree(rows, ["g"], ["judge_raw", "z"], "human", "w", 2, 2.0), ["g"], ["judge_raw", "z"], 2)
        assert sorted(r["said"] for r in got.where("g is not null").collect()) == pytest.approx(sorted(min(5.0, max(1.0, r["prediction"])) for r in direct.where("g is not null").collect()))
    if kind == "cutpoints":
        cuts = calibration.fit_cutpoints(rows.withColumn("target", F.col("label")), "s").first()
        assert {r["said"] for r in got.where(F.col("s") < cuts["low"]).collect()} == {"no"}
    if labels:
        assert got.where("said = label").count() >= 0.6 * rows.count()


def test_calibrators_in_a_pipeline_and_for_unknown_groups(spark, tmp_path):
    rows = rated(spark)
    pipeline = Pipeline(stages=[Calibrator(kind="line", by=["g"], output="first"), Calibrator(kind="tree", features=["first", "z"], output="second", depth=3)])
    fitted = pipeline.fit(rows)
    fitted.save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p").transform(rows)
    assert again.agg(F.avg(F.abs(F.col("second") - F.col("human")))).first()[0] < rows.agg(F.avg(F.abs(F.col("judge_raw") - F.col("human")))).first()[0]
    other = spark.createDataFrame([("new", 4.0, 1.0), ("a", None, 1.0), ("a", 9.0, 1.0)], "g string, judge_raw double, z double")
    said = [r["first"] for r in fitted.stages[0].transform(other).collect()]
    assert said[0] == 4.0 and said[1] is None and said[2] == 5.0
    with pytest.raises(ValueError, match="kind"):
        Calibrator(kind="none")
    with pytest.raises(ValueError, match="one group"):
        Calibrator(kind="gates", by=["g"], features=["s", "t"], target="label").fit(rows)


# -- alternating samples ----------------------------------------------------------------------------------


def rotation(rows, limit, seed):
    """Turn by turn over emptied queues."""
    rank = lambda r: (hashlib.sha256(f"{seed}::{r[2]}".encode()).hexdigest(), r[2])
    if limit >= len(rows):
        return [r[2] for r in sorted(rows, key=rank)]
    queues = {}
    for r in sorted(rows, key=rank):
        queues.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    turns, out = dict.fromkeys(queues, 0), []
    while len(out) < limit:
        for m in sorted(queues):
            live = sorted(k for k, v in queues[m].items() if v)
            if live:
                out.append(queues[m][live[turns[m] % len(live)]].pop(0))
                turns[m] += 1
                if len(out) == limit:
                    break
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_alternate_equals_the_rotation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for m in "abcd"[: rng.randrange(1, 5)]:
        for label in ("no", "partial", "yes", "z")[: rng.randrange(1, 5)]:
            rows += [(m, label, f"{m}{label}{i}") for i in range(rng.choice([0, 1, 2, 7, 23]))]
    rows = rows or [("a", "no", "x"), ("a", "no", "y")]
    frame = spark.createDataFrame(rows, "m string, label string, id string")
    for limit in {1, 2, len(rows) // 2 or 1, max(1, len(rows) - 1), len(rows)}:
        assert [r["id"] for r in sampling.alternate(frame, "m", "label", "id", limit, 44).collect()] == rotation(rows, limit, 44)
    assert sampling.alternate(frame.limit(0), "m", "label", "id", 3, 44).count() == 0
    with pytest.raises(ValueError):
        sampling.alternate(frame, "m", "label", "id", 0, 44)


# -- batch logs -------------------------------------------------------------------------------------------


def test_a_batch_that_fails_and_runs_again_is_written_once(spark, tmp_path, monkeypatch):
    schema = "key string, value string"
    for i in range(3):
        spark.createDataFrame([(f"k{i}{j}", "v") for j in range(20)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    whole, failed = state.append_batch, []

    def fails_after_writing(rows, path, batch):
        whole(rows, path, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(state, "append_batch", fails_after_writing)
    with pytest.raises(Exception):
        state.record_stream(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    state.record_stream(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    got = state.read_batches(spark, f"{tmp_path}/log", schema)
    assert failed == [1] and got.count() == 60 and got.select("key").distinct().count() == 60
    (tmp_path / "log" / "batch=1" / "_SUCCESS").unlink()
    assert {r["batch"] for r in state.read_batches(spark, f"{tmp_path}/log", schema).select("batch").distinct().collect()} == {0, 2}
