"""Token counts as a public tokenizer file gives them, by overlap resynchronisation.

A text is cut into overlapping chunks of ``CHUNK`` characters, which the
library encodes with offsets.  Neighbouring encodings are spliced at a position in the overlap that is a token boundary in both, lies at least
``MARGIN`` characters from either chunk's edge, and is provably stable: white
space, or an ASCII letter or digit followed by ASCII that is no letter, where
the pre-tokenizer always cuts.  If an overlap holds no such position it is
widened, up to the whole text.

A text within one chunk has nothing to splice.  The tokenizer drops white space
and never lets a token cross it, so ASCII white space is a stable boundary too:
its count is the sum over the pieces between, each distinct piece encoded once
a task (the library does the encoding) and kept in a bounded table of counts.

Special strings inside texts are the library's business: none holds white
space, and the margin exceeds the longest one, so no splice cuts one.

Cases: null counts as the empty text, 0 tokens; repeated rows count each;
null ids stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import own, small_batches

CHUNK = 8_192
OVERLAP = 256
MARGIN = 32
LIMIT = 2048
PIECES = 1_200_000

_start, _end = itemgetter(0), itemgetter(1)


class Offsets:
    """Character offsets in the whole text of a chunk's tokens from ``first`` on, read one by one: a splice needs those of the overlap only."""

    def __init__(self, encoding, base: int, first: int = 0):
        self.encoding, self.base, self.first = encoding, base, first

    def __len__(self) -> int:
        return len(self.encoding) - self.first

    def __getitem__(self, i: int) -> tuple[int, int]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        s, e = self.encoding.token_to_chars(self.first + i)
        return self.base + s, self.base + e

    def since(self, i: int) -> Offsets:
        return Offsets(self.encoding, self.base, self.first + i)


class Counter:
    """Counts with one loaded tokenizer; lives in a Python worker."""

    def __init__(self, file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.pieces: dict[bytes, int] = {}
        self.widened = 0

    def counts(self, texts: list[bytes]) -> list[int]:
        out, split = [0] * len(texts), {}
        for i, t in enumerate(texts):
            if len(t) > self.chunk and len(s := t.decode()) > self.chunk:
                out[i] = self.spliced(s)
            else:
                split[i] = t.split()                     # ASCII white space
        known = self.pieces
        new = list({p for p in chain.from_iterable(split.values()) if p not in known})
        if len(known) + len(new) > PIECES:               # bounded: start over, with what is needed now
            known = self.pieces = {}
            new = list(set(chain.from_iterable(split.values())))
        # a piece is its lower-cased stem and a tail of full stops and commas, where the stem is ASCII (the tokenizer composes
        # before it lowers) and a letter or digit ends it
        stems = {p: (p[:len(r)].lower(), p[len(r):]) for p in new if b"<" not in p and (r := p.rstrip(b".,")) and r.isascii() and r[-1:].isalnum()}
        todo = list({x for p in new for x in stems.get(p, (p,)) if x and x not in known})
        for p, e in zip(todo, self.tokenizer.encode_batch_fast([p.decode() for p in todo], add_special_tokens=False)):
            known[p] = len(e)
        for p, (stem, tail) in stems.items():
            known[p] = known[stem] + (known[tail] if tail else 0)
        for i, ps in split.items():
            out[i] = sum(map(known.__getitem__, ps))
        return out

    def offsets(self, text: str, a: int, b: int) -> Offsets:
        return Offsets(self.tokenizer.encode(text[a:b], add_special_tokens=False), a)

    def spliced(self, text: str) -> int:
        """Tokens of a text of several chunks, each spliced to the one before."""
        n, at, done = len(text), 0, 0                    # ``done`` tokens end at or before the splice ``at``
        end = min(n, self.chunk)
        left = self.offsets(text, 0, end)
        while end < n:
            wide = self.overlap
            while True:
                start = max(at, end - wide)
                stop = min(n, max(end, start) + self.chunk)
                right = self.offsets(text, start, stop)
                p = self._splice(text, left, right, start, end, at)
                if p is not None:
                    break
                self.widened += 1
                if start == at:                          # the whole rest so far lies in the overlap: encode it in one
                    right, p = self.offsets(text, at, stop), at
                    break
                wide *= 2
            done += bisect_right(left, p, key=_end)
            left = right.since(bisect_left(right, p, key=_start))
            at, end = p, stop
        return done + len(left)

    @staticmethod
    def _splice(text: str, left: Offsets, right: Offsets, start: int, end: int, at: int) -> int | None:
        """The last provably stable boundary of both encodings in the overlap ``start..end``."""
        inside = lambda offs: {x for s, e in offs for x in range(s + 1, e)}
        left = [left[k] for k in range(bisect_right(left, start, key=_end), len(left))]
        right = [right[k] for k in range(bisect_left(right, end, key=_start))]
        lo, hi = (start + MARGIN if start > at else start + 1), end - MARGIN
        cut = inside((s, e) for s, e in left if e > lo) | inside((s, e) for s, e in right if s < hi)
        for p in range(hi - 1, lo, -1):
            c, d = text[p - 1], text[p]
            stable = d in " \t\n\x0b\x0c\r" or (c.isascii() and c.isalnum() and d.isascii() and not d.isalpha())
            if stable and p not in cut:
                if [x for x in left if p <= x[0] and x[1] < hi] == [x for x in right if p <= x[0] and x[1] < hi]:
                    return p
        return None


_counters: dict[tuple, Counter] = {}


def _run(batches: Iterator[pa.RecordBatch], file: str, chunk: int, overlap: int, limit: int) -> Iterator[pa.RecordBatch]:
    key = (file, chunk, overlap)
    if key not in _counters:
        _counters[key] = Counter(*key)
    c = _counters[key]
    for b in batches:
        texts = b.column(1)
        size = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0)
        n = c.counts([t or b"" for t in texts.cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), size.cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                         names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``.  ``file``: a tokenizer file that every executor has."""
    small_batches(docs.sparkSession)
    rows = own(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _run(it, file, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
