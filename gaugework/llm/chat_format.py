"""Conversations from reply trees, in DataFrame functions only.

A message answers its parent, so the messages of a conversation form trees.  Iterative self-joins double the
step from a message to its ancestors (1, 2, 4, ... levels up), and the same tables then list, from each leaf
upwards, the messages of every path from a root to a leaf: as many joins as the depth has binary digits.  A path's
score is the mean score of its messages; the best `branches` paths of a conversation are chosen, and each
is formatted as one conversation.

The template is <turn ROLE>TEXT</turn> and a line feed per turn.  Inside texts a backslash is put before "turn" wherever it
follows "<" or "</" and any number of backslashes, so no text holds a mark; one backslash less gives the text
back.  In roles &, < and > are character references.  The loss mask is a list of byte ranges of the formatted text, one
per assistant text.

Defined cases: a null or empty text is an empty turn; a null role is an empty one; a null score counts as 0; a
null conv_id is a conversation of its own; a message whose parent is null or absent is a root; messages on a ring of
parents, and those below it, have no root and are on no path; of paths with equal scores the one with the smaller leaf
comes first; ids are unique in a conversation (`numbered` makes them so, ties and repeated rows included); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm import common

_CLOSE = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*)turn", r"$1\\turn")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*)\\turn", "$1turn")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as messages that each answer the one before it; equal turns in the order of role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("message_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))


def _up(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rows joined with links (conv_id, message_id, ancestor) where column `name` is the link's message; its ancestor is l_ancestor."""
    links = links.select(F.col("conv_id").alias("l_conv"), F.col("message_id").alias("l_id"), F.col("ancestor").alias("l_ancestor"))
    return rows.join(links, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col(name) == F.col("l_id")))


def ancestor_steps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (conv_id, message_id, ancestor) of steps 1, 2, 4, ... levels up, and the messages without a root, if there are any."""
    links = messages.select("conv_id", "message_id", F.col("parent_id").alias("ancestor"))
    there = links.withColumn("ancestor", F.lit(None).cast("long"))
    step = common.materialize(_up(links, there, "ancestor").select("conv_id", "message_id", "ancestor"), "reply-step-0")
    most = left = step.count()
    steps: list[DataFrame] = []
    # No chain is longer than the number of links; what has an ancestor further up goes round a ring.
    while left and 1 << len(steps) <= most:
        steps.append(step)
        wider = _up(step, step, "ancestor").select("conv_id", "message_id", F.col("l_ancestor").alias("ancestor"))
        step = common.materialize(wider, f"reply-step-{len(steps)}")
        left = step.count()
    return steps, step if left else None


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, message_id, up) of every path from a leaf to its root; up: levels above the leaf."""
    steps, rootless = ancestor_steps(messages)
    parents = messages.where("parent_id is not null").select(F.col("conv_id").alias("p_conv"), F.col("parent_id").alias("p_id")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("message_id") == F.col("p_id"))
    leaves = messages.select("conv_id", "message_id").join(parents, same, "left_anti")
    if rootless is not None:
        leaves = leaves.join(rootless.select(F.col("conv_id").alias("p_conv"), F.col("message_id").alias("p_id")), same, "left_anti")
    found = leaves.select("conv_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(steps))):
        higher = _up(found, steps[k], "message_id").select("conv_id", "leaf_id", F.col("l_ancestor").alias("message_id"), (F.col("up") + (1 << k)).alias("up"))
        found = common.materialize(found.unionByName(higher), f"reply-paths-{k}")
    return found


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf_id, message_id, up, rank): the paths of each conversation with the highest mean scores."""
    found = paths(messages)
    scores = messages.select(F.col("conv_id").alias("s_conv"), F.col("message_id").alias("s_id"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scored = found.join(scores, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("message_id") == F.col("s_id")))
    ranked = scored.groupBy("conv_id", "leaf_id").agg(F.avg("score").alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    ranked = ranked.select(F.col("conv_id").alias("r_conv"), F.col("leaf_id").alias("r_leaf"), "rank")
    return found.join(ranked, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("leaf_id") == F.col("r_leaf"))).drop("r_conv", "r_leaf")


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: conv_id, rank, leaf_id, formatted, loss (array of byte ranges: start, length)."""
    chosen = best_paths(messages, branches)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<turn "), _role_out(role), F.lit(">"))
    body = escaped(common.text_or_empty())
    texts = messages.select(F.col("conv_id").alias("m_conv"), F.col("message_id").alias("m_id"), (role == "assistant").alias("answer"), head.alias("head"), body.alias("body"))
    turns = chosen.join(texts, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("message_id") == F.col("m_id")))
    size = F.octet_length("head") + F.octet_length("body") + len(_CLOSE)
    before = Window.partitionBy("conv_id", "leaf_id").orderBy(F.desc("up"))
    end = F.sum(size).over(before)  # whole texts: a running sum per path, in the order of its turns
    start = (end - len(_CLOSE) - F.octet_length("body")).cast("int")
    turn = F.struct((-F.col("up")).alias("place"), "answer", start.alias("start"), F.octet_length("body").alias("length"), F.concat("head", "body", F.lit(_CLOSE)).alias("piece"))
    rows = turns.select("conv_id", "leaf_id", "rank", turn.alias("turn")).groupBy("conv_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["answer"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return rows.select("conv_id", "rank", "leaf_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    pieces = F.split(formatted, F.lit(_CLOSE), -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        role, text = F.substr(head, F.lit(len("<turn ") + 1)), F.substr(piece, F.char_length(head) + 2)
        return F.struct(_role_in(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped: array of texts."""
    raw = formatted.cast("binary")
    return F.transform(loss, lambda s: unescaped(F.substr(raw, s["start"] + 1, s["length"]).cast("string")))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from format_paths: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("under"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(told).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        sha(F.col("under")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
