"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The sum-of-squares identity scores all pairwise interactions in time linear
in the number of features of a text.

Features of a whole text: its distinct words hashed to ``WORD_BITS`` bits with
weight log(1 + count), scaled to length 1; structure statistics (shares of
character classes, word and line shapes, repetition) and the length, each cut
at the training sample's deciles and given as one active bin.  Id, language,
source and labels are never features.

Training: the labelled rows with ``crc32(id) mod FOLDS <> 0``; if there are
more than ``SAMPLE`` of them, those with the smallest hash of their id.  Only
this bounded sample's features reach the driver.  Every text is scored where
it lies, in one pass, with the model broadcast (its size is fixed by the
constants below).

Cases: null and empty texts score by their structure bins alone; no labels at
all score 0.5 everywhere, and labels of one class score that class's share;
ids labelled twice take the lower label; null labels and null ids are not
learned from; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import own, small_batches
from tessera.llm._words import NOT_SPACE, Words, chunks

WORD_BITS = 14
BINS = 10
RANK = 8
FOLDS = 5
SAMPLE = 12_000
EPOCHS = 6
BATCH = 256
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3

_CLASS = np.full(256, 6, dtype=np.uint8)                 # 6: non-ASCII and control
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 5
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False
STATS = 16


def _per(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.float64)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes per text: ``(number per text, text, hash, count)``."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return _per(d[at], n), d[at], v[at], np.diff(np.concatenate((at, [len(d)])))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(stats[n, STATS], text, bucket, weight)`` of the texts; the last three list the word features."""
    n = len(texts)
    w = Words(texts, NOT_SPACE)
    size = np.diff(w.base) - 1
    kinds = _CLASS[w.raw]
    kind = np.stack([np.add.reduceat(kinds == k, w.base[:-1], dtype=np.int64) for k in range(7)], axis=1).astype(np.float64)
    kind[:, 4] -= 1                                      # the separator
    L = np.maximum(size, 1)
    words = np.maximum(w.n, 1)
    length = w.end - w.start
    types, doc, h, count = _distinct(w.doc, w.h, n)
    last = _CLASS[w.raw[w.end - 1]]
    head = _CLASS[w.raw[w.start]]
    tail = (last == 5) & (length > 2) & (_CLASS[w.raw[np.maximum(w.end - 2, 0)]] == 5)
    lines = Words(texts, _NOT_NEWLINE)
    kinds_of_line = _distinct(lines.doc, lines.h, n)[0]
    n_lines = np.maximum(lines.n, 1)
    stats = np.column_stack([
        np.log1p(size), np.log1p(w.n), kind[:, 0] / L, kind[:, 2] / L, kind[:, 5] / L, kind[:, 6] / L, kind[:, 3] / L,
        _per(w.doc, n, length) / words, types / words, _per(w.doc, n, tail) / words, _per(w.doc, n, (last == 5)) / words,
        _per(w.doc, n, (head == 0) & (last == 0) & (length > 1)) / words, _per(w.doc, n, (length == 1) & (last == 5)) / words,
        np.log1p(lines.n), kinds_of_line / n_lines, np.log1p(w.n / n_lines)])
    weight = np.log1p(count)
    norm = np.sqrt(_per(doc, n, weight ** 2))
    bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return stats, doc, bucket, weight / np.maximum(norm[doc], 1e-12)


@dataclass
class Machine:
    edges: np.ndarray                                    # STATS x (BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, stats, doc, bucket, weight):
        """All features as ``(row, feature, value)``, ordered by row."""
        n = len(stats)
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(STATS)], axis=1)
        feature = (1 << WORD_BITS) + np.arange(STATS) * BINS + bins
        row = np.concatenate((np.repeat(np.arange(n), STATS), doc))
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate((feature.reshape(-1), bucket))[order], np.concatenate((np.full(n * STATS, 0.25), weight))[order]

    def logit(self, n, row, feature, value):
        at = np.searchsorted(row, np.arange(n))          # every row has its STATS bins, so none is empty
        vx = self.v[feature] * value[:, None]
        s = np.add.reduceat(vx, at) if n else np.zeros((0, RANK))
        q = np.add.reduceat(vx ** 2, at) if n else s
        linear = np.bincount(row, weights=self.w[feature] * value, minlength=n)
        return self.w0 + linear + 0.5 * (s ** 2 - q).sum(axis=1), s

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.w) == 0:
            return np.full(len(texts), self.w0)
        stats, doc, bucket, weight = features(texts)
        return 1 / (1 + np.exp(-self.logit(len(texts), *self.rows(stats, doc, bucket, weight))[0]))


def learn(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 11) -> Machine:
    """Mini-batch Adam on the logistic loss.  ``words``: (buckets, weights) per row."""
    if len(label) == 0:
        return Machine(np.zeros((0, 0)), 0.5, np.zeros(0), np.zeros((0, 0)))
    share = float(label.mean())
    if share in (0.0, 1.0):
        return Machine(np.zeros((0, 0)), share, np.zeros(0), np.zeros((0, 0)))
    rng = np.random.Generator(np.random.PCG64(seed))
    size = (1 << WORD_BITS) + STATS * BINS
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    m = Machine(np.ascontiguousarray(edges), float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    t = 0
    for epoch in range(max(EPOCHS, EPOCHS * 2000 // len(label))):
        order = rng.permutation(len(label))
        for s in range(0, len(order), BATCH):
            ids = order[s:s + BATCH]
            n = len(ids)
            doc = np.repeat(np.arange(n), [len(words[i][0]) for i in ids])
            row, f, x = m.rows(stats[ids], doc, np.concatenate([words[i][0] for i in ids]).astype(np.int64),
                               np.concatenate([words[i][1] for i in ids]).astype(np.float64))
            z, sums = m.logit(n, row, f, x)
            err = (1 / (1 + np.exp(-z)) - label[ids]) / n
            e = err[row] * x
            active, inv = np.unique(f, return_inverse=True)
            gw = np.bincount(inv, weights=e, minlength=len(active))
            gv = np.stack([np.bincount(inv, weights=e * (sums[row, k] - m.v[f, k] * x), minlength=len(active)) for k in range(RANK)], axis=1)
            m.w0 -= RATE * float(err.sum())
            t += 1
            for p, g, (a, b) in ((m.w, gw, mom[0]), (m.v, gv, mom[1])):
                g = g + DECAY * p[active]
                a[active] = 0.9 * a[active] + 0.1 * g
                b[active] = 0.999 * b[active] + 0.001 * g * g
                p[active] -= RATE * (a[active] / (1 - 0.9 ** t)) / (np.sqrt(b[active] / (1 - 0.999 ** t)) + 1e-8)
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in chunks(batches, "text"):
        stats, doc, bucket, weight = features(texts)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        cut = lambda a, t: pa.array([a[at[i]:at[i + 1]].astype(t).tobytes() for i in range(len(texts))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([s.tobytes() for s in stats], pa.binary()),
                                          cut(bucket, np.uint16), cut(weight, np.float32)], names=["doc_id", "label", "stats", "bucket", "weight"])


def held_out(doc_id, folds: int = FOLDS):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    known = own(labels, doc_id, label).toDF("doc_id", "label").where("doc_id is not null and label is not null") \
        .groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).where(~held_out("doc_id"))
    # at most ``sample`` rows: a fixed bound on what is broadcast and collected
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own(docs, doc_id, text).toDF("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
    small_batches(docs.sparkSession)
    got = rows.mapInArrow(_featured, "doc_id long, label int, stats binary, bucket binary, weight binary").toArrow().sort_by("doc_id")
    stats = np.frombuffer(b"".join(got.column("stats").to_pylist()), dtype=np.float64).reshape(-1, STATS)
    words = [(np.frombuffer(a, dtype=np.uint16), np.frombuffer(b, dtype=np.float32))
             for a, b in zip(got.column("bucket").to_pylist(), got.column("weight").to_pylist())]
    return learn(stats, words, np.array(got.column("label").to_pylist(), dtype=np.float64))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(bc.value.score(texts), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = own(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accept(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score below the threshold; all columns, in one pass."""
    small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b, texts in chunks(batches, text):
            yield b.filter(pa.array(bc.value.score(texts) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
