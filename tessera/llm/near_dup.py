"""Near duplicates by a chosen-path set similarity join over 5-word shingle sets.

1. One pass hashes every text's distinct shingles and keeps, per row, the set
   size, a 128-bit digest of the set and ``TOKENS`` minwise tokens.  Rows with
   equal sets are one class from here on; only classes are joined.
2. Trees.  The root of a tree branches each class on one of its minwise
   tokens, and a node is the classes that share the tokens on its path.  Nodes
   of one class, or whose pairs are all decided already, end.  A node of at most ``NODE`` classes is
   compared exhaustively on the full sets, each of which travels to it once, if a class of about its size is there (in blocks
   against blocks only if it has more than ``LEAF`` classes and ``HELD`` shingles).  A larger one branches each class
   on two more tokens, chosen by a hash of the path, so two classes of
   similarity s share 2s children on average and stay together with
   probability q = (2s - 1) / s**2 however deep the tree is.  At ``DEPTH`` the
   rest is compared exhaustively too, in blocks of ``LEAF / 2`` against blocks.
3. Independent trees repeat until a link at the threshold is missed with
   probability ``(1 - s * q) ** trees <= 1 - recall``.  The first tree compares its large
   nodes in random blocks that share one pivot, which joins big groups of
   copies early.  The nodes come in waves (the first tree, the
   large nodes of the first two, the rest).
   After each, a class has a mark: the largest node in which all pairs were
   decided, else its component.  Classes of one mark are not compared again,
   nodes of one mark end, and a node's most frequent mark is the side
   that need not meet itself.  So a group of similar texts, linked or not, is
   compared with itself once and not once a tree.
4. Links are confirmed on full sets where they are found.  Connected components by large-star / small-star.

Cases: null text is empty; a text without words has an empty set, is linked
with nothing and is its own component; fewer than five words are one shingle;
equal sets are linked (similarity 1) whatever the texts; rows with a null id
take part, and a component of null ids only has a null id; repeated rows are
one class, of which the first row is kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import FEW, Scratch, components, own
from tessera.llm._words import NOT_SPACE, Words, chunks, shingles, slices

SHINGLE = 5
TOKENS = 32
LEAF = 512
NODE = 2048
HELD = 1 << 21
DEPTH = 6
RECALL = 0.99999

_U = np.uint64
_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_SIGNED = "uid long, doc_id long, text_key long, n long, key binary, tokens array<int>"


def trees_for(similarity: float, recall: float) -> int:
    """Trees that find a link at ``similarity`` with probability ``recall`` or more; at most ``TOKENS``, each with a root token of its own."""
    if not 0.5 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("the similarity must be above 0.5 and at most 1, the recall between 0 and 1")
    found = similarity * min(1.0, (2 * similarity - 1) / similarity ** 2)
    trees = 1 if found >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))
    if trees > TOKENS:
        raise ValueError(f"recall {recall} at similarity {similarity} needs {trees} trees, more than the {TOKENS} tokens")
    return trees


def _sets(texts: list[bytes], k: int):
    doc, val = shingles(Words(texts, NOT_SPACE), k)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return val, at


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches, "text"):
        val, at = _sets(texts, k)
        n = np.diff(at)
        tokens = np.zeros((len(texts), TOKENS), dtype=np.int32)
        full = np.flatnonzero(n)
        for j, a in enumerate(_ODD if len(full) else ()):
            tokens[full, j] = (np.minimum.reduceat(val * a, at[full]) >> _U(32)).astype(np.uint32).view(np.int32)
        sig = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * TOKENS), pa.array(tokens.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()),
             pa.array([_digest(val[at[i]:at[i + 1]]) for i in range(len(texts))], pa.binary()), sig],
            names=[x.split()[0] for x in _SIGNED.split(", ")])


def _shingled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of the classes asked for; a text whose digest is another's shares only the text key."""
    for b, texts in chunks(batches, "text"):
        val, at = _sets(texts, k)
        keys = b.column("key").to_pylist()
        sets = [val[at[i]:at[i + 1]].tobytes() for i in range(len(texts))]
        ok = [_digest(val[at[i]:at[i + 1]]) == keys[i] for i in range(len(texts))]
        out = pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])
        yield out.filter(pa.array(ok, pa.bool_()))


def _linked(ids: np.ndarray, sides: np.ndarray, roots: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between the sets of one node, as a forest: exhaustive comparison by a matrix product.

    sides: only pairs of different sides count; roots: sets of one root are linked already.
    """
    _, side, k = np.unique(sides, return_inverse=True, return_counts=True)
    main = side == k.argmax()                                # the largest side need not meet itself: its sets are columns only
    order = np.argsort(main, kind="stable")
    ids, side, roots, sets = ids[order], side[order], roots[order], [sets[i] for i in order.tolist()]
    rows = len(sets) - int(main.sum()) or 1
    vals = [np.frombuffer(s, dtype="<u8") for s in sets]
    n = np.array([len(v) for v in vals])
    flat, inv = np.unique(np.concatenate(vals), return_inverse=True)
    who = np.repeat(np.arange(len(vals)), n)
    shared = np.bincount(inv, minlength=len(flat)) > 1
    keep = shared[inv]
    col = (np.cumsum(shared) - 1)[inv[keep]]
    who = who[keep]
    inter = np.zeros((rows, len(vals)), dtype=np.int32)
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    step = 1024                                              # columns at a time: bounded memory whatever the texts' length
    for c in range(0, int(shared.sum()), step):
        a, z = np.searchsorted(col, (c, c + step))
        x = np.zeros((len(vals), step), dtype=np.float32)
        x[who[a:z], col[a:z] - c] = 1
        inter += (x[:rows] @ x.T).astype(np.int32)
    part = np.unique(roots, return_inverse=True)[1]
    out = []
    for i in range(rows):
        both = inter[i].astype(np.int64)
        ok = (100 * both >= percent * (n[i] + n - both)) & (side != side[i])
        parts, at = np.unique(part[ok], return_index=True)
        for p, j in zip(parts.tolist(), np.flatnonzero(ok)[at].tolist()):
            if p != part[i]:
                part[part == p] = part[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(node, id, side, root, set)`` sorted by node; a node's rows are held together."""
    now, rows = None, []

    def close():
        if len(rows) < 2:
            return []
        ids, sides, roots = (np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 1, 2))
        return _linked(ids, sides, roots, [r[3] for r in rows], percent)

    for b in slices(batches):
        found = []
        for node, *row in zip(*(c.to_pylist() for c in b.columns)):
            if node != now:
                found += close()
                now, rows = node, []
            rows.append(row)
        if found:
            yield _links(found)
    if found := close():
        yield _links(found)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _step(node: Column, tokens: Column, j: Column) -> Column:
    return F.xxhash64(node, j, F.element_at(tokens, j + 1))


def _small() -> Column:
    """Whether a node's classes all meet in one task, which holds their sets."""
    return (F.col("size") <= LEAF) | ((F.col("size") <= NODE) & (F.col("held") <= HELD))


class _Join:
    """The join of one call: classes ``(id, n, key, text_key, tokens)`` in, links between class ids out."""

    def __init__(self, spark, scratch: Scratch, rows: DataFrame, classes: DataFrame, percent: int, recall: float, k: int):
        self.spark, self.scratch, self.classes, self.percent, self.k = spark, scratch, classes, percent, k
        self.trees = trees_for(percent / 100, recall)
        # similarity >= p / 100 between different sets needs a union of 1 / (1 - p / 100) shingles at least
        least = math.ceil(percent / (100 - percent)) if percent < 100 else 1
        roots = classes.where(F.col("n") >= least).select(
            "id", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), _step(F.lit(t).cast("long"), F.col("tokens"), F.lit(t)).alias("node"))
                                      for t in range(self.trees)])).alias("x")).select("id", "n", "x.tree", "x.node")
        self.roots = scratch.write(self.several(roots, marks=None), "roots")
        wanted = self.roots.select("id").distinct().join(classes.select("id", "key", "text_key"), "id")
        # each text travels once; texts of one key (more than one only where hashes collide) are told apart by their digests
        texts = rows.groupBy("text_key").agg(F.collect_set("text").alias("texts")).join(wanted, "text_key").select("id", "key", F.explode("texts").alias("text"))
        self.sets = scratch.write(texts.mapInArrow(lambda it: _shingled(it, k), "id long, set binary"), "sets")
        self.links: list[DataFrame] = []
        self.decided: list[DataFrame] = []               # (id, size, node) of nodes in which every pair was decided

    def several(self, at: DataFrame, marks: DataFrame | None) -> DataFrame:
        """The rows of nodes with classes of two or more marks, with the node's ``size``, ``held`` shingles and ``first`` class."""
        if marks is not None:
            at = at.select("id", "n", "tree", "node").join(marks, at.id == marks.id_, "left").select(
                "id", "n", "tree", "node", F.coalesce("root_", "id").alias("root"), F.coalesce("mark_", F.xxhash64("id")).alias("mark"))
        else:
            at = at.select("id", "n", "tree", "node", F.col("id").alias("root"), F.xxhash64("id").alias("mark"))
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.min("id").alias("first"))
        # written: a join of two plain exchanges, whose hot nodes Spark may split
        sizes = self.scratch.write(sizes.where("low < high").select("node", "size", "held", "first"), "sizes")
        return at.join(sizes, "node")

    def compare(self, at: DataFrame) -> None:
        """``at(node, id, side, root)``: each node's sets meet in one task, streamed node by node."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        percent = self.percent
        at = self.scratch.write(at, "meet")
        if at.count() <= FEW:                            # 32 bytes a row: broadcast, and the sets stay where they lie
            at = F.broadcast(at)
        at = at.join(self.sets, "id").repartition(n, "node").sortWithinPartitions("node").select("node", "id", "side", "root", "set")
        self.links.append(self.scratch.write(at.mapInArrow(lambda it: _compare(it, percent), "a long, b long"), "links"))

    def whole(self, at: DataFrame) -> DataFrame:
        """Nodes that meet in one task, one row a class; classes of one mark need not meet.

        A link needs set sizes of a ratio of ``percent`` at least, so a class whose neighbours in
        order of size are both too small or too large is linked with nothing in the node and stays away."""
        w = Window.partitionBy("node").orderBy("n")
        at = at.withColumn("less", F.lag("n").over(w)).withColumn("more", F.lead("n").over(w))
        near = (100 * F.col("less") >= self.percent * F.col("n")) | (100 * F.col("n") >= self.percent * F.col("more"))
        return at.where(F.coalesce(near, F.lit(False))).select("node", "id", F.col("mark").alias("side"), "root")

    def blocks(self, at: DataFrame) -> DataFrame:
        """Large nodes in random blocks of about ``LEAF / 2``, the node's first class in each."""
        parts = F.ceil(F.col("size") / (LEAF // 2))
        mine = at.where("id <> first").select("node", "id", "root", F.pmod(F.xxhash64("id", "node"), parts).alias("block"))
        pivot = at.where("id = first").select("node", "id", "root", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("block"))
        return mine.unionByName(pivot).select(F.xxhash64("node", "block").alias("node"), "id", F.col("id").alias("side"), "root")

    def pairs(self, at: DataFrame) -> DataFrame:
        """Nodes too large to meet whole, block by block.  The classes of the most frequent mark have blocks of their own, which need not meet each other."""
        of = at.groupBy("node", "mark").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "mark")).alias("top"), F.sum("k").alias("size"))
        half = LEAF // 2
        of = self.scratch.write(of.select("node", F.col("top.mark").alias("most"), F.ceil(F.col("top.k") / half).alias("p"),
                                          F.ceil((F.col("size") - F.col("top.k")) / half).alias("q")), "halves")
        at = at.select("node", "id", "root", "mark").join(of, "node")
        main = F.col("mark") == F.col("most")
        block = F.when(main, F.pmod(F.xxhash64("id", "node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id", "node"), F.col("q")))
        at = at.select("node", "id", "root", block.alias("block"), F.explode(F.sequence(F.when(main, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)).alias("other"))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        return at.select(F.xxhash64("node", lo, hi).alias("node"), "id",
                         F.when(F.col("block") == F.col("other"), F.col("id")).when(F.col("block") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "root")

    def together(self) -> DataFrame:
        """``(node_, root_)``: components of the links so far."""
        edges = self.links[0]
        for x in self.links[1:]:
            edges = edges.unionByName(x)
        return components(self.spark, self.scratch, edges).select(F.col("node").alias("node_"), F.col("root").alias("root_"))

    def marks(self) -> DataFrame:
        """``(id_, root_, mark_)``: each class's component and the largest node in which its pairs were decided, else its component."""
        done = self.decided[0]
        for x in self.decided[1:]:
            done = done.unionByName(x)
        done = done.groupBy("id").agg(F.max(F.struct("size", "node")).alias("d")).select("id", F.xxhash64(F.lit("node"), "d.node").alias("mark"))
        same = self.together()
        both = done.join(same, done.id == same.node_, "full")
        return self.scratch.write(both.select(F.coalesce("id", "node_").alias("id_"), "root_", F.coalesce("mark", F.xxhash64(F.lit("root"), "root_")).alias("mark_")), "marks")

    def wave(self, at: DataFrame, marks: DataFrame) -> None:
        """Nodes ``(id, tree, node)`` and what grows below them."""
        at = self.several(at, marks)
        for depth in range(DEPTH + 1):
            at = self.scratch.write(at, "nodes")
            down = F.col("size") > (NODE if depth < DEPTH else 1 << 62)
            self.compare(self.whole(at.where(_small())).unionByName(self.pairs(at.where(~_small() & ~down))))
            self.decided.append(at.where(~down).select("id", "size", "node"))
            large = at.where(down)
            if not large.take(1):
                break
            j = [F.pmod(F.xxhash64("node", F.lit(s)), F.lit(TOKENS)).cast("int") for s in (1, 2)]
            j[1] = F.when(j[0] == j[1], F.pmod(j[1] + 1, F.lit(TOKENS))).otherwise(j[1])
            large = large.select("id", "n", "tree", "node").join(self.classes.select("id", "tokens"), "id")
            at = self.several(large.select("id", "n", "tree", F.explode(F.array(*[_step(F.col("node"), F.col("tokens"), x) for x in j])).alias("node")), marks)

    def run(self) -> DataFrame:
        first = self.roots.where("tree = 0")
        small = first.where(_small())
        self.compare(self.whole(small).unionByName(self.blocks(first.where(~_small()))))
        self.decided.append(small.select("id", "size", "node"))
        rest = self.roots.select("id", "n", "tree", "node", "size", "held")
        # the large nodes of the first two trees decide most pairs of big groups before the other nodes come
        large = (F.col("tree") <= 1) & ~_small()
        self.wave(rest.where(large), self.marks())
        self.wave(rest.where(~large & (F.col("tree") > 0)), self.marks())
        return self.together()


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, recall: float = RECALL, k: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id, text_key, n_shingles, component_id, kept``; linked: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    rows = own(docs, doc_id, text).toDF("doc_id", "text").select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = scratch.write(rows.mapInArrow(lambda it: _sign(it, k), _SIGNED), "signed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    classes = signed.where("n > 0").groupBy("key", "n").agg(F.min("uid").alias("id"), F.min("text_key").alias("text_key"),
                                                            F.any_value("tokens").alias("tokens"), best)
    classes = scratch.write(classes, "classes")
    found = _Join(spark, scratch, rows.select("text_key", "text"), classes, percent, recall, k).run()
    found = scratch.write(found, "components")
    # the smallest row of each component, then of each row
    named = classes.select("id", "key", "n", "best").join(found, classes.id == found.node_, "left").withColumn("root", F.coalesce("root_", "id"))
    least = named.groupBy("root").agg(F.min("best").alias("least"))
    named = named.join(least, "root").select("key", "n", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid"))
    full = signed.where("n > 0").select("uid", "doc_id", "text_key", "n", "key").join(named, ["key", "n"])
    none = signed.where("n = 0").select("uid", "doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.col("uid").alias("keep_uid"))
    return full.select("uid", "doc_id", "text_key", "n", "component_id", "keep_uid").unionByName(none).select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))
