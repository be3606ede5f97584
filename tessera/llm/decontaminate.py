"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark
items (an item of fewer words is one shorter window).  For each pattern
length m a shift table over hashed blocks of two words says how far the
search may move: a block that ends at word j of some pattern allows m - j,
an unknown block m - 1.  Cursors walk over segments of the documents in
lockstep (numpy); where the shift is 0 the patterns in the bucket of the
block's hash are the candidates, the hash of the first block discards most of
them, and the words' bytes are compared to confirm.

The pattern tables are broadcast in parts of at most ``part_bytes`` of
benchmark text; a larger benchmark takes more parts, each searched over all
documents, and the parts' hits are merged per document.

Cases: null or wordless text has no words and no hits; items of null or
wordless text are no patterns; items without an id are searched like any other
(hits, contamination) and count together as one item that has no place in the
digest of ids; repeated items count once per item id; a document repeated
in the table gives a row each time; an empty benchmark leaves every document
clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own, small_batches
from tessera.llm._words import ALNUM, Words, chunks, grams

WINDOW = 10
PART_BYTES = 1 << 20
TABLE_BITS = 20
SEGMENT = 256
_U = np.uint64
_PIECE = "uid long, doc_id long, n_words long, runs binary, items array<string>"


class Patterns:
    """Shift tables and buckets of one part of the benchmark; one table per pattern length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        w = Words([t for _, t in items], ALNUM)
        first = np.searchsorted(w.doc, np.arange(len(items)))
        by: dict[int, dict[bytes, set[str]]] = {}
        hs: dict[int, dict[bytes, np.ndarray]] = {}
        for d, (item, _) in enumerate(items):
            n, a = int(w.n[d]), int(first[d])
            m = min(n, window)
            for s in range(a, a + n - m + 1) if n else ():
                words = b" ".join(w.low[w.start[k]:w.end[k]].tobytes() for k in range(s, s + m))
                by.setdefault(m, {}).setdefault(words, set()).add(item)
                hs.setdefault(m, {})[words] = w.h[s:s + m]
        self.by_length = []
        for m, found in by.items():
            texts = list(found)
            self.by_length.append((m, *self._tables(m, np.array([hs[m][t] for t in texts])), texts, [list(found[t]) for t in texts]))

    @staticmethod
    def _tables(m: int, h: np.ndarray):
        b = min(m, 2)
        shift = np.full(1 << TABLE_BITS, m - b + 1, dtype=np.uint8 if m < 250 else np.uint16)
        # column k: the hash of the block that ends at word k + b
        blocks = np.stack([grams(h[:, k:k + b].reshape(-1), b)[::b] for k in range(m - b + 1)], axis=1)
        for k in range(blocks.shape[1]):
            np.minimum.at(shift, blocks[:, k] >> _U(64 - TABLE_BITS), m - b - k)
        order = np.argsort(blocks[:, -1], kind="stable")
        return shift, blocks[order, -1], blocks[order, 0], order

    def search(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """``(first word, one past the last, items)`` of every occurrence, in the words of ``w``."""
        for m, shift, last, first, order, texts, items in self.by_length:
            b = min(m, 2)
            g = grams(w.h, b)
            if not len(g):
                continue
            jump = shift[g >> _U(64 - TABLE_BITS)]
            for s in self._ends(w, m, b, jump):
                lo, hi = np.searchsorted(last, g[s], "left"), np.searchsorted(last, g[s], "right")
                hit = np.flatnonzero(hi > lo)
                head = s - (m - b)
                for i in hit:
                    for p in range(lo[i], hi[i]):
                        if first[p] != g[head[i]]:
                            continue
                        at, text = int(head[i]), texts[order[p]]
                        if b" ".join(w.low[w.start[k]:w.end[k]].tobytes() for k in range(at, at + m)) == text:
                            yield at, at + m, items[order[p]]

    @staticmethod
    def _ends(w: Words, m: int, b: int, jump: np.ndarray) -> Iterator[np.ndarray]:
        """Starts of last blocks where the shift is 0; cursors of all segments advance together."""
        bounds = np.concatenate(([0], np.cumsum(w.n)))
        lo, hi = bounds[:-1] + (m - b), bounds[1:] - b + 1                  # block starts that can end a pattern
        ok = hi > lo
        lo, hi = lo[ok], hi[ok]
        parts = -(-(hi - lo) // SEGMENT)                                    # long texts: several cursors
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        pos = np.repeat(lo, parts) + k * SEGMENT
        end = np.minimum(pos + SEGMENT, np.repeat(hi, parts))
        while len(pos):
            step = jump[pos]
            zero = step == 0
            if zero.any():
                yield pos[zero]
            pos = pos + np.maximum(step, 1)
            go = pos < end
            pos, end = pos[go], end[go]


def _hits(patterns: Patterns, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, list, list]]:
    """Slices with their words, hit word intervals per row (merged, from the row's first word) and items per row."""
    for b, texts in chunks(batches, "text"):
        w = Words(texts, ALNUM)
        base = np.concatenate(([0], np.cumsum(w.n)))
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for s, e, ids in patterns.search(w):
            d = int(w.doc[s])
            spans.setdefault(d, []).append((s - int(base[d]), e - int(base[d])))
            items.setdefault(d, set()).update(ids)
        merged = []
        for d in range(len(texts)):
            out: list[list[int]] = []
            for s, e in sorted(spans.get(d, ())):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            merged.append(out)
        yield b, w, merged, [_in_order(items.get(d, ())) for d in range(len(texts))]


def parts_of(benchmark: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> list:
    """One broadcast of patterns per part; a part holds about ``part_bytes`` of item text."""
    spark = benchmark.sparkSession
    b = own(benchmark, item_id, text).toDF("item_id", "text").where("text is not null") \
        .select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // part_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    return [spark.sparkContext.broadcast(Patterns([(r[0], r[1].encode()) for r in b.where(part == k).collect()], window)) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``."""
    small_batches(docs.sparkSession)
    rows = own(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_of(benchmark, item_id, item_text, window, part_bytes)
    if not parts:
        parts = [docs.sparkSession.sparkContext.broadcast(Patterns([], window))]
    if len(parts) == 1:
        bc = parts[0]
        return rows.mapInArrow(lambda it: _rows(_hits(bc.value, it)), _OUT)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # the row's id must be the same for every part: written once with the text
    rows = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    found = [rows.mapInArrow(lambda it, bc=bc: _pieces(_hits(bc.value, it)), _PIECE) for bc in parts]
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both.groupBy("uid").applyInPandas(_merge, _OUT)


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _batch(cols: list) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _OUT.split(", ")])


def _in_order(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join(x for x in items if x is not None).encode()).hexdigest()


def _rows(found) -> Iterator[pa.RecordBatch]:
    for b, w, spans, items in found:
        hit = [sum(e - s for s, e in x) for x in spans]
        yield _batch([b.column("doc_id").to_pylist(), w.n.tolist(), hit, [len(x) for x in items], [_digest(x) for x in items], [x > 0 for x in hit], items])


def _pieces(found) -> Iterator[pa.RecordBatch]:
    for b, w, spans, items in found:
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), pa.array(w.n, pa.int64()), pa.array([np.array(x, dtype="<i8").tobytes() for x in spans], pa.binary()),
             pa.array(items, pa.list_(pa.string()))], names=[x.split()[0] for x in _PIECE.split(", ")])


def _merge(p):
    """The parts' hits of one document (one row per part)."""
    import pandas as pd
    spans = sorted(tuple(x) for r in p["runs"] for x in np.frombuffer(r, dtype="<i8").reshape(-1, 2).tolist())
    hit, upto = 0, 0
    for s, e in spans:
        hit += max(0, e - max(s, upto))
        upto = max(upto, e)
    items = _in_order({x for r in p["items"] for x in r})
    return pd.DataFrame([[p["doc_id"].iloc[0], p["n_words"].iloc[0], hit, len(items), _digest(items), hit > 0, items]],
                        columns=[x.split()[0] for x in _OUT.split(", ")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without the rows in which any window occurs; all columns, decided row by row in one pass per part."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    for bc in parts_of(benchmark, item_id, item_text, window, part_bytes):
        docs = docs.mapInArrow(lambda it, bc=bc: _clean(bc.value, text, it), schema)
    return docs


def _clean(patterns: Patterns, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches, text):
        w = Words(texts, ALNUM)
        dirty = {int(w.doc[s]) for s, _, _ in patterns.search(w)}
        yield b.filter(pa.array([d not in dirty for d in range(len(texts))], pa.bool_())) if dirty else b
