"""Vectorised word splitting and hashing of UTF-8 texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)      # a random odd value per byte
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z and every non-ASCII byte
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_pow = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p)
    a, b = _pow[0][:n], _pow[1][:n]
    if len(_pow[0]) > 1 << 20:          # one huge text must not leave its tables behind
        _pow[0], _pow[1] = _pow[0][:1], _pow[1][:1]
    return a, b


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """Words of a list of texts: ``h`` hash, ``doc`` index, ``start``/``end`` in ``low`` (lower-cased bytes)."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        blob = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(blob, dtype=np.uint8)
        self.low = LOWER[raw]
        ok = table[self.low]
        edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
        if ok[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes)))          # where each text begins
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        p, inv = _powers(len(raw))
        c = np.zeros(len(raw) + 1, dtype=np.uint64)                  # one array, filled in place: texts may be huge
        np.take(_BYTE, self.low, out=c[1:])
        c[1:] *= p
        np.cumsum(c[1:], out=c[1:])
        self.h = mix((c[self.end] - c[self.start]) * inv[self.start])
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.raw = raw


_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every k consecutive word hashes (k <= 10)."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out += mix(h[j:j + n] * _STEP[j])
    return mix(out)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of distinct k-word shingles, sorted by text; with fewer words the whole sequence is one."""
    g = grams(w.h, k)
    keep = np.flatnonzero(w.doc[:len(g)] == w.doc[k - 1:k - 1 + len(g)]) if len(g) else np.zeros(0, dtype=np.int64)
    doc, val = w.doc[keep], g[keep]
    few = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(few):
        first = np.searchsorted(w.doc, few)
        extra = np.array([mix(grams(w.h[s:s + w.n[d]], int(w.n[d])) + _U(int(w.n[d])))[0] for d, s in zip(few, first)], dtype=np.uint64)
        doc, val = np.concatenate((doc, few)), np.concatenate((val, extra))
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    if len(doc):
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (val[1:] != val[:-1])
        doc, val = doc[new], val[new]
    return doc, val


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` text bytes each (one longer text stands alone); null texts are empty."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= limit):
                size += sizes[end]
                end += 1
            yield b.slice(at, end - at), [t or b"" for t in column.slice(at, end - at).to_pylist()]
            at = end


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few rows at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
