"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The leaves of a tree (say domain / language / source) hold tokens.  The
budget goes down the tree: a node shares what it gets among its children by
weight; a child that can not use its share (tokens times ``max_epochs``) is
filled, and its shortage goes to its siblings by weight until they are full
too.  As a node never gets more than its subtree can use, a shortage leaves a
family only when the whole family is full, that is, siblings before ancestors.
All shares are whole tokens, rounded down.

A leaf with T tokens and a share of a tokens takes a div T whole epochs, and
from the next epoch the longest prefix of whole documents, in the order of
md5(seed | epoch | id), that fits in the rest.  The prefix sum is taken over
hash buckets of about ``BUCKET`` documents first and over single documents only
in the bucket where the rest runs out, so no task sorts a leaf.  Tokens are
words ``[^\\x20\\x09-\\x0D]+``.

Cases: null text has 0 tokens; nulls in a level are the node ``-``; nodes
without a weight weigh ``default_weight``, and weight 0 takes nothing; a leaf without
tokens gives nothing; rows with equal ids are taken together; a budget over
all capacity gives every leaf ``max_epochs`` epochs; an empty table gives an empty
result; extra columns are kept, names of the operator's own start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch

BUCKET = 1000
WORD = r"[^\x20\x09-\x0D]+"


def _path(levels: list[str], upto: int) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in levels[:upto]])


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(leaves: DataFrame, depth: int, weights: DataFrame, budget: Column, max_epochs: int, default_weight: int, scratch: Scratch) -> DataFrame:
    """``(path, tokens, rows, share)`` per leaf of ``leaves(p1 .. p<depth>, tokens, rows)``; p<k> is the path of level k."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    got = total.select(F.lit("").alias("parent"), F.least("cap", budget.cast("long")).alias("get"))
    for k in range(1, depth + 1):                            # a leaf below a weight of 0 is no capacity of the nodes above
        own = weights.select(F.col("path").alias(f"p{k}"), F.col("weight").cast("long").alias("w"))
        leaves = leaves.join(own, f"p{k}", "left").where(F.coalesce("w", F.lit(default_weight)) > 0).drop("w")
    for k in range(1, depth + 1):
        parent = F.lit("") if k == 1 else F.col(f"p{k - 1}")
        nodes = leaves.groupBy(parent.alias("parent"), F.col(f"p{k}").alias("path")).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(weights.select(F.col("path"), F.col("weight").cast("long").alias("w")), "path", "left") \
            .withColumn("w", F.coalesce("w", F.lit(default_weight))).where("w > 0").join(got, "parent")
        w = Window.partitionBy("parent").orderBy(F.col("cap") / F.col("w"), "path")
        n = nodes.withColumns({"before": F.sum("cap").over(w) - F.col("cap"), "left": F.sum("w").over(Window.partitionBy("parent")) - F.sum("w").over(w) + F.col("w")})
        # a prefix of the family is full; the first child that is not sets the level for the rest
        n = n.withColumn("full", F.col("w") * (F.col("get") - F.col("before")) >= F.col("cap") * F.col("left"))
        first = Window.partitionBy("parent")
        open_ = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "path", (F.col("get") - F.col("before")).alias("rest"), F.col("left")))).over(first)
        n = n.withColumn("open", open_).withColumn("give", F.when(F.col("full"), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.expr("(w * open.rest) div open.left"))))
        got = scratch.write(n.select(F.col("path").alias("parent"), F.col("give").alias("get")), "shares")
    return leaves.join(got, F.col(f"p{depth}") == F.col("parent")).select(F.col(f"p{depth}").alias("path"), "tokens", "rows", F.col("get").alias("share"))


def mix(docs: DataFrame, levels: list[str], weights: DataFrame, fraction: float, doc_id: str = "doc_id", text: str = "text",
        max_epochs: int = 2, seed: int = 17, default_weight: int = 1) -> DataFrame:
    """``docs`` rows once per epoch that takes them, plus ``epoch`` and ``leaf``; ``fraction``: the budget as a share of all tokens.

    ``weights(path, weight)``: whole weights by node path ("a", "a/b", "a/b/c").
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    d = len(levels)
    idc = F.col(f"`{doc_id}`").cast("string")
    skinny = scratch.write(docs.select(*[_path(levels, k).alias(f"p{k}") for k in range(1, d + 1)], idc.alias("id"), tokens_of(F.col(f"`{text}`")).alias("tokens")), "tokens")
    leaves = skinny.groupBy(*[f"p{k}" for k in range(1, d + 1)]).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = scratch.write(leaves, "leaves")
    got = shares(leaves, d, weights, F.floor(F.lit(fraction) * F.col("tokens")), max_epochs, default_weight, scratch)
    plan = got.where("tokens > 0").select("path", F.expr("cast(share div tokens as int)").alias("full"), F.expr("share % tokens").alias("rest"),
                                          F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BUCKET))).cast("int").alias("bits"))
    plan = scratch.write(plan, "plan")

    order = lambda epoch, i: F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(i, F.lit(""))))
    bucket_sql = "cast(conv(substring(h, 1, 7), 16, 10) as long) div cast(pow(2, 28 - least(bits, 28)) as long)"
    part = skinny.select(F.col(f"p{d}").alias("path"), "id", "tokens").join(plan, "path").select("path", "rest", "bits", "tokens", order(F.col("full"), F.col("id")).alias("h")) \
        .withColumn("bucket", F.expr(bucket_sql))
    part = scratch.write(part.select("path", "bucket", "h", "tokens", "rest"), "order")
    sums = part.groupBy("path", "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    w = Window.partitionBy("path").orderBy("bucket")
    edge = sums.withColumn("upto", F.sum("n").over(w)).where("upto > rest").groupBy("path").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("path", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    edge = scratch.write(edge, "edge")
    inside = part.join(edge, "path").where("bucket = edge").groupBy("path", "h").agg(F.sum("tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    wh = Window.partitionBy("path").orderBy("h")
    cut = inside.withColumn("upto", F.sum("n").over(wh) + F.col("before")).where("upto <= rest").groupBy("path").agg(F.max("h").alias("cut"))
    rule = plan.join(edge.select("path", "edge"), "path").join(cut, "path", "left")
    rule = scratch.write(rule.select(*[F.col(c).alias(f"__{c}") for c in ("path", "full", "bits", "edge", "cut")]), "rule")

    out = docs.withColumn("__p", _path(levels, d)).join(rule, F.col("__p") == F.col("__path")).withColumn("__h", order(F.col("__full"), idc))
    b = F.expr(bucket_sql.replace("(h,", "(__h,").replace("bits", "__bits"))
    last = (b < F.col("__edge")) | ((b == F.col("__edge")) & (F.col("__h") <= F.coalesce("__cut", F.lit(""))))
    n = F.col("__full") + last.cast("int")
    return out.withColumn("__n", n).where("__n > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("epoch"),
                                                            F.col("__p").alias("leaf"))
