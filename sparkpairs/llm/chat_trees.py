"""Chat formatting of reply trees (operator 2), DataFrame functions only.

Nodes reply to a parent. Root-to-leaf paths are enumerated by self-joins that
double their reach: with the parent 2**k steps up known for every node, one join
extends every path by up to 2**k nodes, and joining that table to itself doubles
the step, so a thread of n turns takes about log2(n) rounds. Only ids take part;
texts are joined at the end. Branches of a tree are ranked by the mean score of
their nodes (ties: smaller leaf), and each chosen path becomes one conversation.

Template: a turn is ``<s>``, role, ``[INST]``, text, ``</s>``. Inside roles and
texts a backslash is doubled and every control string (``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) gets a backslash after its first character, so marks
are found by plain splitting and texts come back unchanged (``turns``).

Ids need not grow from parent to reply. Nodes that reply to themselves in a circle
have no root: the doubled jumps that have not ended after as many steps as there are
nodes show them, and of each circle the smallest node becomes a root.

Edge cases: a null role or text is empty; a parent that is null, unknown or the node
itself makes the node a root; rows of one node id in one tree are
one node (the smallest by parent, role, text, score); null scores count 0; null
tree ids form one tree; rows without node id are left out; texts of any length are
joined to their path whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.session import materialize

OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "</s>"
_CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Nodes of linear conversations: each row replies to the row before it by ``turn``
    (rows of one turn in the order of role and text)."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(order).cast("bigint")
    return rows.select(F.col(conv).alias("tree_id"), n.alias("node_id"), (n - 1).alias("parent_id"), "role", "text",
                       F.lit(0.0).alias("score"))


def _parents(ids: DataFrame) -> DataFrame:
    """``tree_id, node_id, up_id`` of every node with a known parent; circles are cut at their smallest node."""
    known = ids.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    same = F.col("tree_id").eqNullSafe(F.col("t"))
    edges = materialize(ids.where("parent_id <> node_id").join(known, same & (F.col("parent_id") == F.col("n")), "left_semi")
                        .select("tree_id", "node_id", F.col("parent_id").alias("up_id")))
    if edges.where("up_id > node_id").isEmpty():
        return edges  # ids grow: there is no circle
    most = edges.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    # up: 2**k steps above, least: the smallest node on the way; what still has a node above it after more steps
    # than its tree has nodes is on a circle or above one's branch
    jump, step = edges.withColumn("least", F.least("node_id", "up_id")), 1
    while step <= most:
        j = jump.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up_id").alias("up2"), F.col("least").alias("least2"))
        jump = materialize(jump.join(j, same & (F.col("up_id") == F.col("n")))
                           .select("tree_id", "node_id", F.col("up2").alias("up_id"), F.least("least", "least2").alias("least")))
        if jump.isEmpty():
            return edges
        step *= 2
    # a node's way has gone round its circle at least once, from wherever it began: what it ends on is on the circle
    ends = jump.select(F.col("tree_id").alias("t"), F.col("up_id").alias("n")).distinct()
    on_circle = jump.join(ends, same & (F.col("node_id") == F.col("n")), "left_semi")
    cut = on_circle.where("node_id = least").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    return materialize(edges.join(cut, same & (F.col("node_id") == F.col("n")), "left_anti"))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree_id, leaf_id, node_id, up`` of every root-to-leaf path (``up``: steps above the leaf)."""
    ids = nodes.select("tree_id", "node_id", "parent_id")
    same = F.col("tree_id").eqNullSafe(F.col("t"))
    jump = _parents(ids)
    parents = jump.select(F.col("tree_id").alias("t"), F.col("up_id").alias("n")).distinct()
    reached = (ids.join(parents, same & (F.col("node_id") == F.col("n")), "left_anti")
               .select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("bigint").alias("up")))
    step = 1
    while not jump.isEmpty():
        j = jump.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "up_id")
        further = reached.join(j, same & (F.col("node_id") == F.col("n"))).select(
            "tree_id", "leaf_id", F.col("up_id").alias("node_id"), (F.col("up") + step).alias("up"))
        reached = materialize(reached.unionAll(further))
        jump = materialize(jump.join(j.withColumnRenamed("up_id", "up2"), same & (F.col("up_id") == F.col("n")))
                           .select("tree_id", "node_id", F.col("up2").alias("up_id")))
        step *= 2
    return reached


def format_trees(nodes: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree_id, leaf_id, branch`` (rank from 1), ``score, formatted, loss_turns`` (one flag
    per turn) and ``loss_spans`` (start and length in code points of each text under the loss
    mask) of the best ``branches`` paths of each tree."""
    content = (nodes.where("node_id IS NOT NULL").groupBy("tree_id", "node_id").agg(
        F.min(F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))).alias("c"))
        .select("tree_id", "node_id", "c.parent_id", "c.role", "c.text", "c.score"))
    content = materialize(content)
    on_path = paths(content)
    text = content.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "role", "text", "score")
    same = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))
    marks = content.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "score")
    ranked = (on_path.join(marks, same).groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"))
              .withColumn("branch", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), F.asc("leaf_id"))))
              .where(F.col("branch") <= branches)
              .select(F.col("tree_id").alias("bt"), F.col("leaf_id").alias("bl"), F.col("score").alias("path_score"), "branch"))
    chosen = on_path.join(ranked, F.col("tree_id").eqNullSafe(F.col("bt")) & (F.col("leaf_id") == F.col("bl"))).drop("bt", "bl")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turns = (chosen.join(text, same).withColumn("head", head).withColumn("body", escape(F.col("text")))
             .withColumn("turn", F.concat("head", "body", F.lit(CLOSE))).withColumn("loss", F.col("role") == loss_role))
    so_far = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("turn")).over(so_far) - F.length("turn") + F.length("head")
    one = F.struct((-F.col("up")).alias("at"), "turn", "loss", F.col("start"), F.length("body").cast("bigint").alias("length"))
    parts = (turns.withColumn("start", start).groupBy("tree_id", "leaf_id", "branch", "path_score")
             .agg(F.array_sort(F.collect_list(one)).alias("parts")))
    return parts.select(
        "tree_id", "leaf_id", "branch", F.col("path_score").alias("score"),
        F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"),
        F.transform("parts", lambda p: p["loss"]).alias("loss_turns"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_spans"))


def turns(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of role and text."""
    pieces = F.split(formatted, CLOSE, -1)

    def read(piece: Column) -> Column:
        at = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), r"\[INST\]", -1)
        return F.struct(unescape(at[0]).alias("role"), unescape(at[1]).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)
