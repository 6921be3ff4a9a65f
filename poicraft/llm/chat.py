"""Chat formatting of reply trees (DataFrame functions only).

A message names its parent; a tree has one conversation per leaf. Paths from the
root to each leaf are enumerated by iterative self-joins: round k adds, for every
message known to be on a path, its 2^k-th ancestor, so a tree of depth d takes
log2(d) rounds. The branches of a tree are ranked by the sum of their messages'
scores, and each chosen path is written as one text.

A turn reads ``[INST]role[/INST]text</s>``. Within roles and texts the characters
``[``, ``<`` and the escape character are written as two-character codes, so no
control string can occur there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poicraft.llm.common import prefix_sums, stored

OPEN, MID, END = "[INST]", "[/INST]", "</s>"
#: Characters and the codes that stand for them; the escape character is coded first and decoded last.
CODES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Rounds double the depth; more than this means that parents form a circle.
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    for raw, code in CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def chain(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages ``conv, tree, node, parent, role, text, score`` of conversations given
    as rows by turn: every row answers the one before it.

    Rows of equal turns stand in order of role and text; a null turn comes first.
    Null roles and texts are empty. A message's score is the length of its text.
    """
    r = rows.select(
        F.col(f"`{conv_id}`").alias("conv"), F.coalesce(F.col(f"`{conv_id}`").cast("string"), F.lit("~")).alias("tree"),
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    return r.select("conv", "tree", node.alias("node"), "role", "text").select(
        "conv", "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.length("text").cast("double").alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``tree, leaf, node, up``: every message on every root-to-leaf path, ``up`` steps above the leaf.

    A message whose parent is null, itself or missing is a root.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jump = stored(nodes.filter("parent != node").join(known, ["tree", "parent"], "left_semi").select(
        "tree", "node", F.col("parent").alias("anc")).distinct(), "chat-jump")
    parents = jump.select("tree", F.col("anc").alias("node")).distinct()
    path = stored(nodes.join(parents, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")).distinct(), "chat-path")
    for k in range(MAX_ROUNDS):
        if jump.isEmpty():
            return path
        above = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        path = stored(path.unionByName(above), "chat-path")
        on = jump.select("tree", F.col("node").alias("anc"), F.col("anc").alias("next"))
        jump = stored(jump.join(on, ["tree", "anc"]).select("tree", "node", F.col("next").alias("anc")), "chat-jump")
    raise ValueError("parents form a circle")


def best_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Paths of the ``top`` branches of each tree (all if None), with the branch's ``rank`` from 1.

    Branches are ranked by the sum of their messages' scores; ties go to the smaller leaf.
    """
    every = paths(messages)
    score = every.join(messages.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "leaf"))
    chosen = score.select("tree", "leaf", rank.alias("rank"))
    return every.join(chosen if top is None else chosen.filter(F.col("rank") <= top), ["tree", "leaf"])


def conversations(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """One row per chosen path: ``conv, rank, formatted, loss``.

    ``loss`` holds the ``[start, end)`` of the assistants' texts in ``formatted``, in
    code points. A path is one text and so one row, however long.
    """
    messages = stored(messages, "chat-messages")  # the paths read it again and again, without the texts
    rows = best_paths(messages, top).join(messages, ["tree", "node"])
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(
        F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
    parts = turns.select("conv", "rank", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned"))).alias("parts"))
    sizes = F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("bigint"))
    spans = F.zip_with("parts", "before", lambda p, b: F.struct(
        (b + F.length(p["head"])).alias("start"), (b + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["learned"].alias("learned")))
    return parts.select("*", prefix_sums(sizes).alias("before")).select(
        "conv", "rank", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["end"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a formatted text."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), MID, 1)).alias("role"),
        unescape(F.substring_index(p, MID, -1)).alias("text")))


def read_learned(formatted: Column, loss: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
