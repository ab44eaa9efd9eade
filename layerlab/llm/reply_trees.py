"""8. Chat formatting of reply trees, with DataFrame functions only.

Messages know their parent. Paths from each leaf to its root come from repeated
self-joins that double their reach: after k rounds a leaf has its ancestors up to
distance 2^k, so a conversation of n turns takes log2(n) rounds. Rounds carry keys
only and are written to the shared folder. A branch is ranked by the mean score of
its messages; the best branches of each tree are formatted as one conversation.

A turn is `<|im_start|>role<|im_sep|>text<|im_end|>`. Backslashes are doubled in
roles and texts, and a backslash is put into every control string of this and of
two other common templates, so that control strings are the template's own and
the escaping can be undone. The loss mask lists the assistant texts as code point
ranges of the formatted string.

Defined results: null roles and texts are empty. A message whose parent is null
or missing is a root. Messages on a cycle have no root and are not formatted.
Branches of equal score are ranked by their leaf; turns with equal numbers follow
each other by role and text; repeated rows are turns of their own. An empty table
gives no rows. One conversation is one output row, so its text must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.plans.materialize import via_parquet

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: the opening character, and what makes it a control string
CONTROL = r"([<\[])(\|im_(?:start|sep|end)\||/?INST\]|/?s>)"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_messages(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A table of numbered turns as messages: each replies to the turn before.

    The score of a message is the length of its text.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    place = rows.withColumn("place", F.row_number().over(order))
    before = F.struct("conv", (F.col("place") - 1).alias("place"))
    return place.select(
        F.struct("conv").alias("tree"),
        F.struct("conv", "place").alias("node"),
        F.when(F.col("place") > 1, before).alias("parent"),
        "role",
        "text",
        F.length("text").cast("double").alias("score"),
    )


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the messages of each branch, `up` steps from its leaf."""
    keys = via_parquet(messages.select("tree", "node", "parent"), "messages")
    known = keys.select(F.col("node").alias("up_node"))
    links = via_parquet(
        keys.join(known, keys["parent"] == known["up_node"], "left").select("tree", "node", "up_node"),
        "replies",
    )
    replied = links.select(F.col("up_node").alias("node")).distinct()
    leaves = links.join(replied, "node", "left_anti")
    paths = via_parquet(
        leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")),
        "paths",
    )
    jumps = links.filter("up_node IS NOT NULL").select("node", "up_node")
    reach, n = 1, keys.count()
    while reach <= n and not jumps.isEmpty():
        further = paths.join(jumps, "node").select(
            "tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + reach).alias("up")
        )
        paths = via_parquet(paths.unionByName(further), "paths")
        second = jumps.select(F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        jumps = via_parquet(
            jumps.join(second, "up_node").select("node", F.col("far").alias("up_node")), "jumps"
        )
        reach *= 2
    return paths


def best_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, up, role, text) of the best branches."""
    paths = root_to_leaf_paths(messages)
    scored = paths.join(messages.select("node", "score"), "node")
    branches = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    best = branches.withColumn("branch_rank", F.row_number().over(order)).filter(
        F.col("branch_rank") <= per_tree
    )
    chosen = paths.join(best.drop("tree"), "leaf")
    return chosen.join(messages.select("node", "role", "text"), "node").drop("node")


def formatted_branches(branches: DataFrame) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_mask)."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    turns = (
        branches.select(
            "tree", "leaf", "branch_rank", "branch_score", "up",
            (F.col("role") == "assistant").alias("learned"),
            F.concat(F.lit(START), role, F.lit(SEP)).alias("head"),
            text.alias("body"),
        )
        .withColumn("size", F.length("head") + F.length("body") + len(END))
    )
    branch = ("tree", "leaf", "branch_rank", "branch_score")
    before = Window.partitionBy(*branch).orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", start.cast("long"))
    turn = F.struct(
        (-F.col("up")).alias("place"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        "learned",
        "start",
        (F.col("start") + F.length("body")).alias("end"),
    )
    rows = placed.groupBy(*branch).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    mask = F.transform(
        F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"))
    )
    return rows.select(
        *branch,
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def format_chats(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best branches of each reply tree as conversations; see the module."""
    return formatted_branches(best_branches(messages, per_tree))


def turns_read_back(formatted: Column) -> Column:
    """array of (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(
        halves,
        lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")),
    )


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(
        loss_mask,
        lambda s: unescaped(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))),
    )
    return F.array_join(parts, "")
