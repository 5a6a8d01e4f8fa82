"""Debates between a judge and a human's proxy as stateful streams, and rounds of many debates at once.

`verdicts` keeps one small row of state per debate (transformWithStateInPandas): turns may come in any micro-batch, a
verdict is put out the moment a debate stops, and a debate that falls silent is closed by an event-time timer.
`run_debates` plays the debates of a table: every round asks the engines for all open debates at once and
writes the round's table, so a stopped run goes on from its last whole round.  Both stop by the same rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugework.functions.text import fill
from gaugework.operators.judging import call, unfence
from gaugework.workers import done, share_package

STATE = "initial double, previous double, last double, scores array<double>, finding array<string>, stale int, rounds int, failed boolean, reason string"
_FIELDS = [c.split()[0] for c in STATE.split(", ")]


@dataclass(frozen=True)
class Rules:
    """epsilon: a score that moves less is settled; stale: so many rounds with the finding of the round before settle as well.

    grounded: with an anchor only a score within epsilon of it settles, so a stubborn judge does not.  concede: a debate about a
    rule, which stops when the judge concedes and by nothing else.
    """

    epsilon: float = 0.5
    max_rounds: int = 6
    grounded: bool = False
    stale: int = 2
    overlap: float = 0.9
    concede: bool = False


def opened(initial: float | None) -> dict:
    return {"initial": initial, "previous": initial, "last": None, "scores": [], "finding": [], "stale": 0, "rounds": 0, "failed": True, "reason": None}


def cycles(scores: list[float]) -> bool:
    """Whether the last p scores repeat the p before them, for some p of at least 2, and are not all equal."""
    n = len(scores)
    return any(scores[n - p :] == scores[n - 2 * p : n - p] and len(set(scores[n - p :])) > 1 for p in range(2, n // 2 + 1))


def advance(state: dict, turn: dict, rules: Rules) -> None:
    """Takes one turn (role, round, score, valid, failed, finding, conceded, anchor); sets state["reason"] when the debate stops."""
    state["failed"] = state["failed"] and bool(turn["failed"])
    if turn["role"] != "judge":
        return
    state["rounds"] = turn["round"]
    score = turn["score"] if turn["valid"] else None
    if rules.concede:
        if score is not None:
            state["last"] = score
        state["reason"] = "conceded" if turn["valid"] and turn["conceded"] else "max_rounds" if turn["round"] >= rules.max_rounds else None
        return
    if score is None:
        state["reason"] = "all_turns_failed" if state["failed"] else "invalid_turn"
        return
    finding, before = set(turn["finding"] or ()), set(state["finding"])
    same = bool(finding and before) and len(finding & before) >= rules.overlap * len(finding | before)
    state["stale"] = state["stale"] + 1 if same else 0
    state["finding"] = sorted(finding) if finding else state["finding"]
    state["scores"], state["last"] = [*state["scores"], score], score
    near = lambda other: other is not None and abs(score - other) < rules.epsilon
    anchored = rules.grounded and turn["anchor"] is not None
    if cycles(state["scores"]):
        state["reason"], state["last"] = "oscillation_detected", state["initial"]
    elif anchored and near(turn["anchor"]):
        state["reason"] = "epsilon_human"
    elif not anchored and near(state["previous"]):
        state["reason"] = "epsilon"
    elif state["stale"] >= rules.stale:
        state["reason"] = "semantic_stable"
    elif turn["round"] >= rules.max_rounds:
        state["reason"] = "max_rounds"
    state["previous"] = score


_SETTLED = ("epsilon", "epsilon_human", "semantic_stable", "conceded")


def _verdict(state: dict) -> tuple:
    final = None if state["reason"] == "all_turns_failed" else state["last"]
    delta = final - state["initial"] if final is not None and state["initial"] is not None else None
    return (state["rounds"], state["initial"], final, delta, state["reason"] in _SETTLED, state["reason"])


VERDICT = "rounds int, initial_score double, final_score double, score_delta double, converged boolean, reason string"


def _value(x):
    """Numpy scalars and arrays as plain values, NaN and NaT as None."""
    if hasattr(x, "tolist"):
        x = x.tolist()
    return None if x is None or isinstance(x, float) and x != x else x


class DebateProcessor(StatefulProcessor):
    """State of one debate per key; turns that come again or after the stop change nothing."""

    def __init__(self, by: list[str], rules: Rules, silence_ms: int | None) -> None:
        self.by, self.rules, self.silence_ms = by, rules, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("debate", STATE)

    def _read(self) -> dict | None:
        if not self.state.exists():
            return None
        state = dict(zip(_FIELDS, map(_value, self.state.get())))
        return state | {"scores": list(state["scores"] or ()), "finding": list(state["finding"] or ())}

    def _write(self, state: dict) -> None:
        self.state.update(tuple(state[f] for f in _FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = [{k: _value(v) for k, v in r.items()} for part in rows for r in part.to_dict("records")]
        # A round's proxy speaks before its judge.
        turns.sort(key=lambda t: (t["round"], t["role"] == "judge"))
        state = self._read() or opened(turns[0]["initial_score"])
        if state["reason"]:
            return
        for turn in turns:
            if turn["round"] > state["rounds"]:
                advance(state, turn, self.rules)
            if state["reason"]:
                break
        self._write(state)
        if self.silence_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not state["reason"]:
                self.handle.registerTimer(max(int(t["at_ms"]) for t in turns) + self.silence_ms)
        if state["reason"]:
            yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._read()
        if state and not state["reason"]:
            state["reason"] = "silent"
            self._write(state)
            yield self._row(key, state)

    def _row(self, key, state: dict) -> pd.DataFrame:
        names = [c.split()[0] for c in VERDICT.split(", ")]
        out = pd.DataFrame([(*map(_value, key), *_verdict(state))], columns=[*self.by, *names])
        return out.astype({"rounds": "int32"})

    def close(self) -> None:
        pass


def verdicts(turns: DataFrame, by: list[str], rules: Rules, ts: str | None = None, lateness: str = "10 minutes", silence: int | None = None) -> DataFrame:
    """A stream of turns (by..., role, round, score, valid, failed, finding, conceded, anchor, initial_score) -> a verdict per stopped debate.

    score, finding, conceded, anchor and initial_score may be missing or null; valid is whether the judge's answer could be read, failed
    whether the call failed.  silence: seconds of event time (`ts`) without a turn after which a debate is closed as "silent".
    A debate stops once; turns whose round is not above those seen are repeats.
    """
    spark = turns.sparkSession
    share_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    missing = {"finding": "array<string>", "conceded": "boolean", "anchor": "double", "initial_score": "double", "failed": "boolean"}
    for name, kind in missing.items():
        if name not in turns.columns:
            turns = turns.withColumn(name, F.lit(None).cast(kind))
    timed = silence is not None and ts is not None
    if timed:
        turns = turns.withWatermark(ts, lateness).withColumn("at_ms", F.unix_millis(F.col(ts)))
    columns = ["role", "round", "score", "valid", *missing, *(["at_ms", ts] if timed else [])]
    kinds = dict(turns.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + VERDICT
    rows = turns.where(F.col("round").isNotNull()).select(*by, *columns)
    return rows.groupBy(*by).transformWithStateInPandas(DebateProcessor(by, rules, 1000 * silence if timed else None), schema, "append", "EventTime" if timed else "None")


PROXY = "Case: {case}\nDebate so far:\n{transcript}\nRound {round}: argue for the human's view, as JSON."
JUDGE = "Case: {case}\nDebate so far:\n{transcript}\nRound {round}: revise or keep your score, as JSON."
_ROUND = f"item_id string, case string, anchor double, transcript string, {STATE}"


def _begun(items: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("double") if c in items.columns else F.lit(None).cast("double")
    state = {
        "initial": number("initial_score"), "previous": number("initial_score"), "last": F.lit(None).cast("double"), "scores": F.array().cast("array<double>"),
        "finding": F.array().cast("array<string>"), "stale": F.lit(0), "rounds": F.lit(0), "failed": F.lit(True), "reason": F.lit(None).cast("string"),
    }
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("case").cast("string").alias("case"), number("anchor").alias("anchor"), F.lit("").alias("transcript"), *(c.alias(n) for n, c in state.items()))


def _taken(asked: DataFrame, rules: Rules, number: int) -> DataFrame:
    """The round's answers taken into the states; one row per debate."""

    def parsed(content) -> dict | None:
        try:
            found = json.loads(content)
        except (TypeError, ValueError):
            return None
        return found if isinstance(found, dict) else None

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for r in part.to_dict("records"):
                state = {f: _value(r[f]) for f in _FIELDS} | {"scores": list(r["scores"]), "finding": list(r["finding"])}
                said = []
                for role in ("proxy", "judge"):
                    content, error = _value(r[f"{role}_content"]), _value(r[f"{role}_error"])
                    answer = parsed(content)
                    score = (answer or {}).get("score_1_to_5")
                    score = float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None
                    summary = (answer or {}).get("semantic_summary")
                    words = " ".join(" ".join(map(str, v)) if isinstance(v, list) else str(v) for v in summary.values()).lower().split() if isinstance(summary, dict) else []
                    valid = answer is not None and error is None and (rules.concede or score is not None)
                    finding = sorted({w.strip(".,:;!?()[]{}\"'") for w in words})
                    advance(state, {"role": role, "round": number, "score": score, "valid": valid, "failed": error is not None, "finding": finding, "conceded": (answer or {}).get("concede_rule") is True, "anchor": _value(r["anchor"])}, rules)
                    said.append(f"[{number} {role}] {content if error is None else 'failed: ' + error}")
                out.append((r["item_id"], r["case"], _value(r["anchor"]), "\n".join(filter(None, [r["transcript"], *said])), *(state[f] for f in _FIELDS)))
            yield pd.DataFrame(out, columns=["item_id", "case", "anchor", "transcript", *_FIELDS])

    return asked.mapInPandas(take, _ROUND)


def run_debates(items: DataFrame, make_proxy: Callable, make_judge: Callable, folder: str, rules: Rules = Rules(), proxy: str = PROXY, judge: str = JUDGE) -> DataFrame:
    """items (item_id, case, optionally initial_score, anchor) -> item_id, the verdict's columns, transcript.

    Round by round, all open debates at once: the proxy's call, then the judge's, each with the transcript so far.  A round is
    written to the folder when it is whole; a run that is started again reads the finished rounds and asks no engine for them.
    An engine that fails gives a failed turn.  At most rules.max_rounds rounds.
    """
    spark: SparkSession = items.sparkSession
    share_package(spark)
    now = _begun(items)
    for number in range(1, rules.max_rounds + 1):
        at = f"{folder}/round-{number}"
        if not done(spark, at):
            live = now.where("reason is null")
            fields = {"case": F.col("case"), "transcript": F.col("transcript"), "round": F.lit(str(number))}
            one = call(live.withColumn("_p", fill(F.lit(proxy), fields)), "item_id", "_p", make_proxy).select(F.col("item_id").alias("_i"), unfence(F.col("content")).alias("proxy_content"), F.col("error").alias("proxy_error"))
            # Written before the judge is asked: a proxy is asked once a round.
            if not done(spark, f"{at}-proxy"):
                one.write.mode("overwrite").parquet(f"{at}-proxy")
            one = spark.read.schema(one.schema).parquet(f"{at}-proxy")
            heard = live.join(one, F.col("item_id") == F.col("_i")).drop("_i")
            line = F.concat(F.lit(f"[{number} proxy] "), F.coalesce("proxy_content", F.concat(F.lit("failed: "), "proxy_error"), F.lit("")))
            said = F.concat_ws("\n", F.when(F.col("transcript") != "", F.col("transcript")), line)
            two = call(heard.withColumn("_p", fill(F.lit(judge), fields | {"transcript": said})), "item_id", "_p", make_judge).select(F.col("item_id").alias("_i"), unfence(F.col("content")).alias("judge_content"), F.col("error").alias("judge_error"))
            taken = _taken(heard.join(two, F.col("item_id") == F.col("_i")).drop("_i"), rules, number)
            taken.unionByName(now.where("reason is not null")).write.mode("overwrite").parquet(at)
        now = spark.read.schema(_ROUND).parquet(at)
        if now.where("reason is null").isEmpty():
            break
    final = F.when(F.col("reason") != "all_turns_failed", F.col("last"))
    return now.select("item_id", "rounds", F.col("initial").alias("initial_score"), final.alias("final_score"), (final - F.col("initial")).alias("score_delta"), F.col("reason").isin(*_SETTLED).alias("converged"), "reason", "transcript")
