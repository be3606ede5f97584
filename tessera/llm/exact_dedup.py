"""Exact duplicates through an extendible-hash index whose buckets are owned by tasks.

1. Map side.  Each task normalises its texts (every ``[\\x20\\x09-\\x0D]``
   byte deleted), and within each slice of ``SLICE_BYTES`` equal texts collapse to one
   *entry* that carries the text, the best row and the number of rows.  A text
   that a third of all rows share therefore leaves a task once per slice.
2. Directory.  A histogram of the top 16 bits of the entries' 64-bit keys (at
   most 65,536 counters) is all the driver sees.  Starting from one bucket, an
   overfull bucket splits on its next bit, and the directory doubles whenever
   a bucket is as deep as the directory.  Consecutive buckets form the key
   range of one owner task.
3. Owners.  Entries go to the owner of their bucket, are sorted by key (Spark's
   external sort) and streamed: entries with equal keys form a chain, and each
   new entry's bytes are compared with the texts in the chain.  The resolved
   index is written to the shared folder; a lost owner is simply run again.
4. Every row looks its entry up in the index (a join on the entry's id).

Of equal texts the row with the most code points in the original text stays,
then the smallest id (null ids last), then the first of repeated rows.

Cases: null text counts as empty, all empty texts are one group; a null id
stays a null id; rows repeated in full are separate rows of one group, of
which one is kept; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own
from tessera.llm._words import chunks, slices

SPACES = b" \t\n\x0b\x0c\r"
DIRECTORY_BITS = 16
BUCKET_BYTES = 8 << 20
OWNER_BYTES = 32 << 20
SLICE_BYTES = 8 << 20

_ROWS = "uid long, doc_id long, text_key long, rep long, sha binary, key long, norm binary, size long, cp long, best_doc long, best_uid long, n long"
_INDEX = "rep long, key long, chain int, keep_id long, keep_uid long, group_size long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches, "text", SLICE_BYTES):
        uid, doc, key_of, text = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)
        cps = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
        first: dict[bytes, int] = {}
        rep, sha, groups = [], [], []          # groups: position -> [best key, rows]
        at: dict[int, list] = {}
        shas: dict[int, bytes] = {}
        for i, t in enumerate(texts):
            norm = t.translate(None, SPACES)
            j = first.setdefault(norm, i)
            best = (-cps[i], doc[i] is None, doc[i] or 0, uid[i])
            if j == i:
                shas[i] = hashlib.sha256(norm).digest()
                at[i] = [best, 1, norm]
            else:
                g = at[j]
                g[0], g[1] = min(g[0], best), g[1] + 1
            rep.append(uid[j])
            sha.append(shas[j])
        none = [None] * len(uid)
        key, norm, size, cp, bd, bu, n = (list(none) for _ in range(7))
        for i, (best, rows, text_) in at.items():
            k = xxhash.xxh64_intdigest(text_)
            key[i], norm[i], size[i], n[i] = k - (1 << 64) if k >> 63 else k, text_, len(text_), rows
            cp[i], bd[i], bu[i] = -best[0], None if best[1] else best[2], best[3]
        i64 = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(doc, i64), key_of, pa.array(rep, i64), pa.array(sha, pa.binary()), pa.array(key, i64), pa.array(norm, pa.binary()),
             pa.array(size, i64), pa.array(cp, i64), pa.array(bd, i64), pa.array(bu, i64), pa.array(n, i64)],
            names=[x.split()[0] for x in _ROWS.split(", ")])


def build_directory(sizes: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> list[tuple[int, int]]:
    """Buckets ``(prefix, local depth)`` in key order, from bytes per ``bits``-bit slot.

    ``directory[i]`` is the bucket of slot i at the current global depth.
    """
    total = np.zeros(1 << bits, dtype=np.int64)
    for slot, size in sizes.items():
        total[slot] = size
    upto = np.concatenate(([0], np.cumsum(total)))
    filled = lambda p, d: int(upto[(p + 1) << (bits - d)] - upto[p << (bits - d)])
    depth, directory = 0, [(0, 0)]
    todo = [(0, 0)]
    while todo:
        p, d = todo.pop()
        if d == bits or filled(p, d) <= capacity:
            continue
        if d == depth:                                   # the directory doubles
            directory = [x for x in directory for _ in (0, 1)]
            depth += 1
        span = 1 << (depth - d - 1)                      # slots of each half
        at = p << (depth - d)
        for half in (0, 1):
            child = (2 * p + half, d + 1)
            directory[at + half * span:at + (half + 1) * span] = [child] * span
            todo.append(child)
    return list(dict.fromkeys(directory))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key: chain each key's entries by their bytes, then emit its groups."""
    out: list[tuple] = []
    names = [x.split()[0] for x in _INDEX.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "chain" else pa.int64()) for n in names])
    now, chain, members = None, [], []

    def close():
        for c, (_, best, rows, reps) in enumerate(chain):
            out.extend((r, now, c, None if best[1] else best[2], best[3], rows) for r in reps)

    for b in slices(batches):
        for rep, key, norm, cp, bd, bu, n in zip(*(c.to_pylist() for c in b.columns)):
            if key != now:
                close()
                now, chain = key, []
            best = (-cp, bd is None, bd or 0, bu)
            for link in chain:
                if link[0] == norm:                      # bytes
                    link[1], link[2] = min(link[1], best), link[2] + n
                    link[3].append(rep)
                    break
            else:
                chain.append([norm, best, n, [rep]])
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def resolve(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Per row: ``doc_id, text_key, keep_id, group_size, kept, text_sha256``.  The result reads tables in ``scratch``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    rows = own(docs, doc_id, text).toDF("doc_id", "text").select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = scratch.write(rows.mapInArrow(_entries, _ROWS), "rows")

    entries = rows.where("norm is not null")
    slot = F.shiftrightunsigned("key", 64 - DIRECTORY_BITS)
    sizes = {r[0]: r[1] for r in entries.groupBy(slot.alias("slot")).agg(F.sum(F.col("size") + 64)).collect()}
    buckets = build_directory(sizes, bucket_bytes)
    where, owner, filled = [], 0, 0
    for k, (p, d) in enumerate(buckets):                 # consecutive buckets up to owner_bytes: one owner
        slots = range(p << (DIRECTORY_BITS - d), (p + 1) << (DIRECTORY_BITS - d))
        size = sum(sizes.get(s, 0) for s in slots)
        if filled and filled + size > owner_bytes:
            owner, filled = owner + 1, 0
        filled += size
        where.append((slots.start, slots.stop - 1, k, d, owner))
    # at most 65,536 slots: a fixed bound on what is broadcast
    directory = spark.createDataFrame([(s, k, d, o) for a, z, k, d, o in where for s in range(a, z + 1) if s in sizes] or [(0, 0, 0, 0)],
                                      "slot long, bucket int, depth int, owner int")
    owned = entries.select("rep", "key", "norm", "cp", "best_doc", "best_uid", "n", slot.alias("slot")).join(F.broadcast(directory), "slot")
    owned = owned.repartitionById(owner + 1, F.col("owner")).sortWithinPartitions("key") \
        .select("rep", "key", "norm", "cp", "best_doc", "best_uid", "n")
    index = scratch.write(owned.mapInArrow(_own, _INDEX), "index")
    return rows.select("uid", "doc_id", "text_key", "rep", "sha").join(index.select("rep", "keep_id", "keep_uid", "group_size"), "rep").select(
        "doc_id", "text_key", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_rows(docs: DataFrame, verdict: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that ``verdict(doc_id, text_key, kept)``, one row per row of ``docs``, keeps; all columns.

    Rows are told apart by id and text.  Of rows equal in both, as many stay
    as ``verdict`` keeps: none (anti join), all, or the first (only those rows
    are ranked).  ``scratch``: the tables that only the verdict reads; they
    are deleted once the rows to drop are written.
    """
    v = verdict.groupBy("doc_id", "text_key").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("rows")).where("stay < rows") \
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "stay")
    v = Scratch(docs.sparkSession, "verdict").write(v.withColumnRenamed("stay", "__stay"), "drop")
    if scratch is not None:
        scratch.clear()
    cols = docs.columns
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__key"))
    whole = docs.join(v, on, "left_anti")
    part = v.where("__stay > 0")
    if is_none(part):
        return whole
    from pyspark.sql import Window
    w = Window.partitionBy("__id", "__key").orderBy(F.monotonically_increasing_id())
    some = docs.join(part, on).withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= F.col("__stay")).select(*[f"`{c}`" for c in cols])
    return whole.unionByName(some)


def is_none(df: DataFrame) -> bool:
    return not df.take(1)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    return drop_rows(docs, resolve(docs, doc_id, text, scratch=scratch), doc_id, text, scratch)
