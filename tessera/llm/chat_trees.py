"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer.  Pointer doubling (a self-join per
power of two of the depth) gives each message its root, depth and the score of
its path.  Leaves are ranked by score within their root; the paths of the
chosen leaves are enumerated by the same jump tables, highest power first, so
every ancestor is met once.  Each path is formatted as one conversation.

Template, per turn: ``<turn ROLE>`` newline TEXT newline ``</turn>`` newline.
Inside roles and texts ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and ``>``
becomes ``\\g``, so no text can hold a control string, and reading is exact.
The loss mask is a list of (start, length) spans in code points over the
formatted string: the assistant texts, without the marks around them.

Cases: null text and role are empty; a message whose parent is null or absent
is a root; messages on a reply cycle, or behind one, have no root and are left
out; equal scores go to the deeper leaf, then to the smaller id; null scores
count 0; message ids must be distinct; an empty table gives an empty result;
extra columns are ignored.  A formatted conversation is one string, so one
path must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own

LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    part = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def opening(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">\n"))


CLOSING = "\n</turn>\n"


def chosen_paths(messages: DataFrame, scratch: Scratch, branches: int) -> DataFrame:
    """``(leaf, id, depth)`` for every message on the best ``branches`` root-to-leaf paths of each root."""
    m = messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = m.select(F.col("id").alias("up"))
    j = m.join(ids, m.parent == ids.up, "left")
    # moving: rows known to have 2**k ancestors or more, with the one 2**k up; settled: rows that point to their root
    moving = scratch.write(j.where("up is not null").select("id", F.col("up").alias("anc"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")), "jump")
    settled = [j.where("up is null").select("id", F.col("id").alias("anc"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("sum"))]
    jumps, rows = [], m.count()
    while moving.take(1) and 1 << len(jumps) <= max(rows, 1):       # beyond that only cycles still move
        jumps.append(moving)
        b = moving
        for x in settled:
            b = b.unionByName(x)
        b = b.select(F.col("id").alias("b_id"), F.col("anc").alias("b_anc"), F.col("steps").alias("b_steps"), F.col("sum").alias("b_sum"))
        nxt = scratch.write(moving.join(b, moving.anc == b.b_id).select("id", F.col("b_anc").alias("anc"), (F.col("steps") + F.col("b_steps")).alias("steps"),
                                                                        (F.col("sum") + F.col("b_sum")).alias("sum")), "jump")
        settled.append(nxt.where(F.col("steps") < 1 << len(jumps)))
        moving = scratch.write(nxt.where(F.col("steps") == 1 << len(jumps)), "jump")
    full = settled[0]
    for x in settled[1:]:
        full = full.unionByName(x)
    root = m.join(ids, m.parent == ids.up, "left").where("up is null").select(F.col("id").alias("root"), F.col("score").alias("root_score"))
    at = full.join(root, full.anc == root.root).select("id", "root", F.col("steps").alias("depth"), (F.col("sum") + F.col("root_score")).alias("path_score"))
    leaves = at.join(m.select("parent").distinct(), F.col("id") == F.col("parent"), "left_anti")
    w = Window.partitionBy("root").orderBy(F.desc("path_score"), F.desc("depth"), "id")
    best = leaves.withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= branches)
    paths = scratch.write(best.select("root", F.col("id").alias("leaf"), "branch", "path_score", "id", "depth"), "paths")
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("id").alias("from"), "anc")
        above = paths.join(jump, paths.id == jump["from"]).select("root", "leaf", "branch", "path_score", F.col("anc").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = scratch.write(paths.unionByName(above), "paths")
    return paths


def format_trees(messages: DataFrame, id: str = "id", parent: str = "parent", tree: str = "conv_id", role: str = "role", text: str = "text",
                 score: str = "score", branches: int = 1) -> DataFrame:
    """Per chosen path: ``tree, root, leaf, branch, path_score, formatted, loss_spans``."""
    scratch = Scratch(messages.sparkSession, "chat-trees")
    m = own(messages, id, parent, tree, role, text, score).toDF("id", "parent", "tree", "role", "text", "score")
    m = scratch.write(m.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}), "messages")
    turns = chosen_paths(m, scratch, branches).join(m.select("id", "tree", "role", "text"), "id")
    body = escape(F.col("text"))
    turns = turns.select("tree", "root", "leaf", "branch", "path_score", "depth", "role", opening(F.col("role")).alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSING)
    w = Window.partitionBy("leaf").orderBy("depth")
    turns = turns.withColumn("start", F.sum(size).over(w) - size + F.length("head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    out = turns.groupBy("leaf").agg(
        F.first("root").alias("root"), F.first("branch").alias("branch"), F.first("path_score").alias("path_score"),
        F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(CLOSING)).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))
    formatted = F.array_join(F.col("turns.turn"), "")
    tree_of = m.select(F.col("id").alias("root"), "tree")
    return out.join(tree_of, "root").select("tree", "root", "leaf", "branch", "path_score", formatted.alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` back from a formatted conversation."""
    parts = F.filter(F.split(formatted, "\n</turn>\n"), lambda x: x != "")
    split = lambda x: F.struct(
        unescape(F.regexp_extract(x, "(?s)^<turn ([^>]*)>\n", 1)).alias("role"),
        unescape(F.regexp_replace(x, "(?s)^<turn [^>]*>\n", "")).alias("text"))
    return F.transform(parts, split)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
