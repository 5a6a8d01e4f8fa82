"""Stateful debates against a sequential runner: every stop reason, restarts in mid-debate, rounds of many debates at once."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gaugework.streaming.debate_state import Rules, run_debates, verdicts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
SCHEMA = "item_id long, role string, round int, score double, valid boolean, failed boolean, finding array<string>, anchor double, initial_score double, ts timestamp"
REASONS = {"epsilon", "epsilon_human", "invalid_turn", "oscillation_detected", "semantic_stable", "max_rounds", "all_turns_failed"}


def sequential(turns, rules):
    """One debate after another, as a judge's runner would read it."""
    out = {}
    for item in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == item), key=lambda t: (t[2], t[1] == "judge"))
        previous = initial = own[0][8]
        scores, finding, stale, failed, reason, last = [], set(), 0, True, None, None
        for _, role, number, score, valid, bad, words, anchor, _, _ in own:
            failed = failed and bad
            if role != "judge":
                continue
            if not valid or score is None:
                reason = "all_turns_failed" if failed else "invalid_turn"
                break
            scores.append(score)
            last = score
            now = set(words or ())
            stale = stale + 1 if now and finding and len(now & finding) / len(now | finding) >= 0.9 else 0
            finding = now or finding
            if any(scores[-p:] == scores[-2 * p : -p] and len(set(scores[-p:])) > 1 for p in range(2, len(scores) // 2 + 1)):
                reason, last = "oscillation_detected", initial
            elif rules.grounded and anchor is not None:
                reason = "epsilon_human" if abs(score - anchor) < rules.epsilon else None
            elif previous is not None and abs(score - previous) < rules.epsilon:
                reason = "epsilon"
            if reason is None and stale >= 2:
                reason = "semantic_stable"
            previous = score
            if reason is None and number >= rules.max_rounds:
                reason = "max_rounds"
            if reason:
                break
        if reason:
            out[item] = (number, None if reason == "all_turns_failed" else last, reason)
    return out


def debates(seed, n, rounds=6):
    rng, out = random.Random(seed), []
    for item in range(n):
        kind = rng.choice(["any", "swing", "stubborn", "same", "broken"])
        for number in range(1, rounds + 1):
            if kind == "swing":
                score = [1.0, 4.0][number % 2]
            elif kind == "stubborn":
                score = 1.0 + (number % 5)
            else:
                score = rng.choice([1.0, 2.0, 3.0, 4.0, 5.0])
            words = ["same", "finding"] if kind == "same" else [f"w{rng.randrange(99)}"] if rng.random() < 0.5 else None
            broken = kind == "broken" or rng.random() < 0.03
            initial, anchor = [None, 2.0, 9.0][item % 3], [None, 3.0, 9.0, 4.0][item % 4]
            out.append((item, "proxy", number, None, not broken, broken, None, anchor, initial, None))
            out.append((item, "judge", number, None if broken else score, not broken, broken, words, anchor, initial, None))
    return out


@pytest.mark.parametrize("grounded", [False, True])
def test_verdicts_survive_restarts_and_equal_a_sequential_run(spark, tmp_path, grounded):
    rules, turns = Rules(epsilon=0.5, max_rounds=6, grounded=grounded), debates(11, 60)
    wanted = sequential(turns, rules)
    rng = random.Random(1)
    turns = [(*t[:9], f"2024-01-01 00:{t[2]:02d}:00") for t in turns]
    frame = spark.createDataFrame([], SCHEMA)
    for part in range(3):  # three runs of the query, each stopped in mid-debate
        some = [t for t in turns if (t[2] - 1) // 2 == part] + [t for t in turns if part and (t[2] - 1) // 2 == part - 1 and rng.random() < 0.2]  # some turns come again
        rng.shuffle(some)
        rows = [(*t[:9], t[9]) for t in some]
        spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/turns")
        query = verdicts(stream, ["item_id"], rules).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["item_id"]: (r["rounds"], r["final_score"], r["reason"]) for r in rows} == wanted and len(rows) == len(wanted)
    assert all(r["converged"] == (r["reason"] in ("epsilon", "epsilon_human", "semantic_stable")) for r in rows)
    if grounded:
        assert {r["reason"] for r in rows} >= REASONS - {"invalid_turn"}


def test_silent_debates_are_closed_by_a_timer(spark, tmp_path):
    rows = [(1, "judge", 1, 1.0, True, False, None, None, 5.0, "2024-01-01 00:00:00"), (2, "judge", 1, 1.0, True, False, None, None, 1.2, "2024-01-01 00:00:00")]
    later = [(3, "judge", 1, 1.0, True, False, None, None, 5.0, "2024-01-02 00:00:00")]
    last = [(3, "judge", 2, 3.0, True, False, None, None, 5.0, "2024-01-02 00:00:30")]
    for some in (rows, later, last):
        spark.createDataFrame(some, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(f"{tmp_path}/turns")
        query = verdicts(stream, ["item_id"], Rules(), "ts", "1 minute", silence=60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["item_id"]: (r["reason"], r["final_score"], r["converged"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("silent", 1.0, False), 2: ("epsilon", 1.0, True)}


class Speaker:
    """Answers from a script by case and round; counts its calls in a folder."""

    def __init__(self, folder, role):
        self.folder, self.role = folder, role

    def generate(self, prompt):
        import pathlib
        import re
        import uuid

        case, number = re.search(r"Case: (\w+)", prompt)[1], int(re.search(r"Round (\d+)", prompt)[1])
        pathlib.Path(self.folder, f"{self.role}-{case}-{number}-{uuid.uuid4().hex}").touch()
        if case == "dead" or case == "mute" and self.role == "judge":
            raise RuntimeError("no answer")
        if self.role == "judge" and pathlib.Path(self.folder, "stop").exists() and number == 3:
            raise SystemExit("stopped")
        assert number == 1 or f"[{number - 1} judge]" in prompt
        score = {"swing": [1, 4][number % 2], "climb": number, "near": 2, "steady": [2, 5, 2, 5, 2, 5][number % 6]}.get(case, 3)
        answer = {"score_1_to_5": score, "concede_rule": case == "near" and number == 2}
        if case == "climb":
            answer["semantic_summary"] = {"finding": "The sky, unchanged.", "more": ["a", "b"]}
        return f"```json\n{json.dumps(answer)}\n```"


def test_rounds_of_many_debates_and_their_resumption(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    items = spark.createDataFrame([("a", "swing", 3.0, None), ("b", "climb", None, None), ("c", "near", 2.1, None), ("d", "dead", 3.0, None), ("e", "mute", 3.0, None), ("f", "near", 4.0, 4.9)], "item_id string, case string, initial_score double, anchor double")
    folder, where = f"file://{tmp_path}/rounds", str(calls)
    (calls / "stop").touch()
    with pytest.raises(Exception):
        run_debates(items, lambda: Speaker(where, "proxy"), lambda: Speaker(where, "judge"), folder, Rules(grounded=True, max_rounds=5))
    (calls / "stop").unlink()
    before = len(list(calls.glob("*-1-*"))) + len(list(calls.glob("*-2-*")))
    got = {r["item_id"]: r for r in run_debates(items, lambda: Speaker(where, "proxy"), lambda: Speaker(where, "judge"), folder, Rules(grounded=True, max_rounds=5)).collect()}
    assert len(list(calls.glob("*-1-*"))) + len(list(calls.glob("*-2-*"))) == before  # finished rounds are not asked again
    assert {k: (r["reason"], r["rounds"], r["final_score"]) for k, r in got.items()} == {
        "a": ("oscillation_detected", 4, 3.0), "b": ("semantic_stable", 3, 3.0), "c": ("epsilon", 1, 2.0), "d": ("all_turns_failed", 1, None), "e": ("invalid_turn", 1, None), "f": ("max_rounds", 5, 2.0),
    }
    assert got["a"]["transcript"].count("[") >= 8 and "failed: RuntimeError" in got["e"]["transcript"]
    ab = run_debates(items.where("case in ('near', 'swing')"), lambda: Speaker(where, "proxy"), lambda: Speaker(where, "judge"), folder + "-ab", Rules(concede=True, max_rounds=3))
    assert {r["item_id"]: (r["reason"], r["rounds"], r["converged"]) for r in ab.collect()} == {"a": ("max_rounds", 3, False), "c": ("conceded", 2, True), "f": ("conceded", 2, True)}
