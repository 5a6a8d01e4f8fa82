"""Debate rounds: when do a judge's turns converge?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.scoring import repeats_in_cycle


def convergence(turns: DataFrame, by: list[str], epsilon: float, most_rounds: int) -> DataFrame:
    """(by..., round, score) of a judge's valid turns -> by..., rounds, final_score, stop_round, stop_reason.

    Stops at the first round whose score moved by less than epsilon, else at the first that closes a cycle,
    else at most_rounds or the last turn.  A debate has few rounds.
    """
    w = Window.partitionBy(*by).orderBy("round")
    so_far = F.collect_list("score").over(w.rowsBetween(-2 * most_rounds, 0))
    moved = F.abs(F.col("score") - F.lag("score").over(w))
    rows = turns.where(F.col("score").isNotNull() & (F.col("round") <= most_rounds)).withColumns({"_moved": moved, "_all": so_far})
    reason = F.when(F.col("_moved") < epsilon, "stable").when(repeats_in_cycle(F.col("_all")), "cycle")
    marked = rows.withColumn("_reason", reason)
    ended = marked.groupBy(*by).agg(
        F.count("*").alias("rounds"),
        F.min_by(F.struct("round", "_reason", "score"), F.when(F.col("_reason").isNotNull(), F.col("round"))).alias("_stop"),
        F.max_by(F.struct("round", "score"), "round").alias("_last"),
    )
    stopped = F.col("_stop._reason").isNotNull()
    return ended.select(
        *by,
        "rounds",
        F.when(stopped, F.col("_stop.score")).otherwise(F.col("_last.score")).alias("final_score"),
        F.when(stopped, F.col("_stop.round")).otherwise(F.col("_last.round")).alias("stop_round"),
        F.when(stopped, F.col("_stop._reason")).when(F.col("_last.round") >= most_rounds, "max_rounds").otherwise("open").alias("stop_reason"),
    )


def last_turns(turns: DataFrame, by: list[str]) -> DataFrame:
    """The last turn of each role."""
    others = [c for c in turns.columns if c not in [*by, "role"]]
    return turns.groupBy(*by, "role").agg(F.max_by(F.struct(*others), "round").alias("t")).select(*by, "role", "t.*")
