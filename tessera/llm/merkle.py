"""Merkle manifest of a dataset with checkpoint-and-recompute proofs.

Every row is a leaf, the rows of each tree (a language) are ordered and hashed
upwards two by two, and the trees' roots are hashed alike to one root.

1. Leaves are digests of all fields, made where the rows lie.  Ranks come from
   a range sort by (tree, key): a row's place in its partition, plus what the
   partitions before it hold (one row per partition and tree).  Only ids and
   digests are sorted, and a tree of any size lies in many partitions.
2. Only the leaves and the nodes of every ``STRIDE``-th level are stored.  An
   aligned subtree is the ``2 ** STRIDE`` consecutive stored nodes below one
   stored node of the next checkpoint, so a group never holds more rows.
3. Proofs go downwards.  Each aligned subtree reads its stored descendants,
   makes its interior nodes again in one array, gives each descendant its
   siblings together with the proof of the subtree's own root, and forgets
   the interior nodes.

A proof is the list of ``(digest, left)`` from the leaf up, across the tree's
root to the dataset's root; a node without a sibling has a null digest, and is
hashed alone.

Cases: null fields are ``-``; the null tree is a tree of its own, before all
others; null ids come first and are never tampered with; rows of one id are ordered by
their digests; rows repeated in full are a leaf each; one row alone is its
tree's root; an empty table gives an empty result and no root; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own

STRIDE = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = "array<struct<digest:string,left:boolean>>"


def digest_of(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, each ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]).cast("binary"), 256)


def _shift(value: Column, bits) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def _up(nodes: Column) -> Column:
    """The level above: every two consecutive nodes, the last maybe alone."""
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)),
                       lambda i: F.sha2(F.concat(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))).cast("binary"), 256))


def _interior(nodes: Column, levels: Column) -> Column:
    """All levels of an aligned subtree, from its stored nodes to its root."""
    return F.aggregate(F.sequence(F.lit(1), levels), F.array(nodes), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))


def _siblings(interior: Column, at: Column, levels: Column) -> Column:
    def one(level):
        i = _shift(at, level)
        return F.struct(F.get(F.get(interior, level), i.bitwiseXOR(F.lit(1))).alias("digest"), (i % 2 == 1).alias("left"))
    return F.transform(F.sequence(F.lit(0), levels - 1), one)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc))
                                                          .otherwise(F.concat(acc, s["digest"])).cast("binary"), 256))


class Forest:
    """Trees over ``nodes(tree, key..., digest, more...)``; ``checkpoints`` holds what is stored, ``tops`` one row per tree."""

    def __init__(self, nodes: DataFrame, order: list[str], scratch: Scratch, stride: int = STRIDE):
        self.scratch, self.stride = scratch, stride
        spark = nodes.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the last key tells repeated rows apart, so that any number of them can be split
        nodes = nodes.withColumn("uid", F.monotonically_increasing_id())
        keys = ["tree", *order, "digest", "uid"]
        ranked = nodes.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
        ranked = scratch.write(ranked.drop("uid"), "ranked")
        # one row per partition and tree
        w = Window.partitionBy("tree")
        starts = ranked.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
        starts = starts.select("tree", "part", F.sum("k").over(w).alias("size"),
                               (F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k") - F.col("first")).alias("shift"))
        height = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
        leaves = ranked.join(starts, ["tree", "part"]).withColumns({"pos": F.col("at") + F.col("shift"), "height": height}).drop("part", "at", "shift", "size")
        self.checkpoints = [scratch.write(leaves, "checkpoint")]
        tops = [self.checkpoints[0].where("height = 0").select("tree", "height", "digest")]
        while True:
            c = len(self.checkpoints)
            groups = self.groups(c - 1).select("tree", "height", F.col("group").alias("pos"), F.get(F.element_at("interior", -1), F.lit(0)).alias("digest"))
            groups = scratch.write(groups, "checkpoint")
            tops.append(groups.where(F.col("height") <= c * stride).select("tree", "height", "digest"))
            more = groups.where(F.col("height") > c * stride)
            if not more.take(1):
                break
            self.checkpoints.append(more)
        top = tops[0]
        for t in tops[1:]:
            top = top.unionByName(t)
        self.tops = scratch.write(top, "tops")

    def groups(self, c: int) -> DataFrame:
        """The aligned subtrees on checkpoint ``c``: their stored nodes in order and all levels, made again."""
        at = self.checkpoints[c].where(F.col("height") > c * self.stride)
        rest = [x for x in at.columns if x not in ("tree", "height", "pos")]
        made = at.groupBy("tree", "height", _shift(F.col("pos"), self.stride).alias("group")).agg(
            F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("nodes"))
        made = made.withColumn("levels", F.least(F.lit(self.stride), F.col("height") - c * self.stride))
        return made.withColumn("interior", _interior(F.col("nodes.digest"), F.col("levels")))

    def proofs(self, above: DataFrame) -> DataFrame:
        """Every leaf row with its ``proof`` and ``above``'s further columns; ``above(tree, proof, more...)``: one row per tree."""
        own_columns = [x for x in self.checkpoints[0].columns if x not in ("pos", "height")]
        more = [x for x in above.columns if x not in ("tree", "proof")]
        tops = self.tops.select("tree", "height").join(above, "tree")
        down = None
        for c in reversed(range(len(self.checkpoints))):
            here = (F.col("height") > c * self.stride) & (F.col("height") <= (c + 1) * self.stride)
            parents = tops.where(here).select("tree", F.lit(0).cast("long").alias("group"), "proof", *more)
            if down is not None:
                parents = parents.unionByName(down.select("tree", F.col("pos").alias("group"), "proof", *more))
            made = self.groups(c).join(parents.withColumnRenamed("proof", "upper"), ["tree", "group"])
            made = made.select("tree", "levels", "interior", "upper", *more, F.posexplode("nodes").alias("i", "node"))
            proof = F.concat(_siblings(F.col("interior"), F.col("i"), F.col("levels")), F.col("upper"))
            down = made.select("tree", F.col("node.pos").alias("pos"), proof.alias("proof"), *more,
                               *([F.col(f"node.{x}").alias(x) for x in own_columns if x != "tree"] if c == 0 else []))
        alone = self.checkpoints[0].where("height = 0").join(above, "tree")
        return down.drop("pos").unionByName(alone.select(*[x for x in down.columns if x != "pos"]))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, doc_id: str = "doc_id", tree: str = "lang", altered: dict[str, Column] | None = None,
             tamper: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """Per row: ``doc_id, tree, leaf, subroot, root, proof, folded_root, verified``.

    ``tamper``: rows (a condition on the fields) whose ``altered`` fields are
    put in place of the original ones after the manifest was made; their
    folded root starts from the altered leaf.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    columns = list(dict.fromkeys([doc_id, tree, *fields]))
    d = own(docs, *columns)
    leaf = digest_of(*[F.col(f"`{f}`") for f in fields])
    changed = F.lit(None).cast("string")
    if tamper is not None:
        changed = F.when(tamper, digest_of(*[(altered or {}).get(f, F.col(f"`{f}`")) for f in fields]))
    name = F.col(f"`{tree}`").cast("string")
    # a tree's name, marked, so that null comes before every string
    leaves = scratch.write(d.select(F.coalesce(F.concat(F.lit("1"), name), F.lit("0")).alias("tree"), F.col(f"`{doc_id}`").alias("doc_id"),
                                    leaf.alias("digest"), changed.alias("changed")), "leaves")
    low = Forest(leaves, ["doc_id"], scratch, stride)
    subroots = low.tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    high = Forest(subroots, ["of"], scratch, stride)
    root = high.tops.select("digest").first()            # one row
    no_proof = high.tops.select("tree", F.array().cast(PROOF).alias("proof"))
    above = scratch.write(high.proofs(no_proof).select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot")), "above")
    out = low.proofs(above).withColumn("root", F.lit(root[0] if root else None).cast("string"))
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("proof")))
    return out.select("doc_id", F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30)).alias("tree"), F.col("digest").alias("leaf"), "subroot", "root", "proof", "folded_root",
                      F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"))


def levels_stored(rows: int, stride: int = STRIDE) -> int:
    """Checkpoints that a tree of ``rows`` leaves stores."""
    return max(1, math.ceil(math.ceil(math.log2(max(rows, 1))) / stride))
