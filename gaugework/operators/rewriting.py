"""The search for a better prompt: judge all cases, show the boundary cases to a rewriter, judge again, keep the best on held-out cases.

Judging is a DataFrame job over all cases; the rewriter sees a bounded number of cases and is called once a step.  Every step's
prompt and results are written to the search's folder, so a stopped search goes on from its last whole step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.operators.classification import class_metrics
from gaugework.operators.policies import guarded_best
from gaugework.operators.sampling import boundary_cases
from gaugework.workers import done

_TRIAL = (
    "step int, prompt string, stop_reason string, selected boolean, feedback_cases int, fit_accuracy double, fit_balanced double, fit_partial_f1 double, "
    "accuracy double, balanced double, partial_f1 double, partial_recall double"
)


def rewrite_search(
    cases: DataFrame, prompt: str, judge: Callable[[DataFrame, str], DataFrame], rewrite: Callable[[str, list[Row]], str], folder: str,
    max_steps: int = 3, per_bucket: int = 6, most_drop: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """(trials, results): a row per step, and item_id, split, target, prediction of the selected prompt.

    cases: item_id, target, task_uid, split ("fit" or "validation") and what the judge reads; judge: (cases, prompt) -> item_id, prediction;
    rewrite: (prompt, boundary cases of the fit split) -> a new prompt.  A step's boundary cases are up to per_bucket of each (target,
    prediction), a task's second case after all first ones.  The search stops when all fit cases are right ("fit_correct"), when the
    rewriter changes nothing ("optimizer_unchanged"), or after max_steps.  The best step is chosen by guarded_best on the
    validation cases, or on the fit cases where there are none, against the first prompt's accuracy; the earlier step on ties.
    """
    spark = cases.sparkSession
    known = cases.where(F.col("split").isin("fit", "validation"))
    held = known.where("split = 'validation'").head(1)
    chosen = "validation" if held else "fit"

    def results(step: int, text: str) -> DataFrame:
        at = f"{folder}/step-{step}"
        if not done(spark, f"{at}/results"):
            said = judge(known, text).select(F.col("item_id").alias("_i"), "prediction")
            told = known.select("item_id", "split", "task_uid", "target").join(said, F.col("item_id") == F.col("_i"), "left").drop("_i")
            told.write.mode("overwrite").parquet(f"{at}/results")
        return spark.read.schema(known.select("item_id", "split", "task_uid", "target").withColumn("prediction", F.lit("")).schema).parquet(f"{at}/results")

    def kept_prompt(step: int, make: Callable[[], str]) -> str:
        at = f"{folder}/step-{step}/prompt"
        if not done(spark, at):
            spark.createDataFrame([(make(),)], "prompt string").coalesce(1).write.mode("overwrite").parquet(at)
        return spark.read.schema("prompt string").parquet(at).first()["prompt"]

    def measured(rows: DataFrame) -> dict:
        return {r["split"]: r for r in class_metrics(rows, ["split"]).collect()}  # two rows at most

    now = kept_prompt(0, lambda: prompt)
    rows = results(0, now)
    found, trials, stop = measured(rows), [], "max_steps"
    trials.append((0, now, 0, found))
    for step in range(1, max_steps + 1):
        fit = rows.where("split = 'fit'").withColumn("bucket", F.concat_ws("/", "target", S.known_label(F.col("prediction"))))
        if not fit.where("prediction is null or prediction <> target").head(1):
            stop = "fit_correct"
            break
        feedback = boundary_cases(fit, "bucket", "task_uid", "item_id", per_bucket).join(cases.drop("target", "task_uid", "split"), "item_id").orderBy("bucket", "rank")
        shown: list[Row] = []

        def ask(before: str = now, feedback: DataFrame = feedback, shown: list = shown) -> str:
            shown += feedback.collect()  # per_bucket rows of each of at most twelve buckets
            return rewrite(before, shown)

        after = kept_prompt(step, ask)
        if after.strip() == now.strip():
            stop = "optimizer_unchanged"
            break
        now, rows = after, results(step, after)
        found = measured(rows)
        trials.append((step, now, len(shown) or feedback.count(), found))
    none = {k: None for k in ("accuracy", "balanced_accuracy", "f1_partial", "recall_partial")}
    of = lambda m, split: m.get(split) or none
    base = of(trials[0][3], chosen)["accuracy"] or 0.0
    rated = [(f"{k:06d}", (m := of(f, chosen))["accuracy"], m["balanced_accuracy"], m["f1_partial"], m["recall_partial"], len(p)) for k, p, _, f in trials]
    ranked = spark.createDataFrame(rated, "name string, accuracy double, balanced double, partial_f1 double, partial_recall double, n_chars int")
    best = int(guarded_best(ranked, [], F.lit(float(base)), most_drop).first()["name"])
    told = [
        (k, p, stop, k == best, n, of(f, "fit")["accuracy"], of(f, "fit")["balanced_accuracy"], of(f, "fit")["f1_partial"], (m := of(f, chosen))["accuracy"], m["balanced_accuracy"], m["f1_partial"], m["recall_partial"])
        for k, p, n, f in trials
    ]
    return spark.createDataFrame(told, _TRIAL), results(best, trials[best][1]).select("item_id", "split", "target", "prediction")
