"""Language identification by unigrams over pieces, summed over all segmentations.

A word (lower-cased letters, a word mark before them) is a sequence of pieces
of a fixed public vocabulary, drawn independently with the language's piece
probabilities.  Its probability is the sum over all its segmentations, by the
forward algorithm; a text's is the product over its words.  The prediction is
the language of the largest posterior, and the score is that posterior.

Learning.  The distinct words of each language and their counts, over all
training rows, are gathered in bounded tables per task and written; every
round of expectation-maximisation passes over this table, its expected piece
counts (at most pieces x languages numbers, whatever the input) are summed and
give the next probabilities, smoothed by ``ALPHA``.

Long words are cut at ``RUN`` letters, in learning and scoring alike.  A
character that the vocabulary lacks is the piece ``<unk>``.  Forward sums are
kept as logarithms, so no length underflows.

Cases: texts that are null or have no letter are ``und`` with score 0; so is
every text if nothing was learned; a language is any non-null value of the
column; rows of a null id are not learned from; repeated rows count and are
scored each; equal posteriors go to the first language in order; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own, small_batches
from tessera.llm._words import chunks, slices

FOLDS, HELD_OUT = 4, 2
ROUNDS = 2
ALPHA = 0.01
RUN = 256
TABLE_WORDS = 300_000
CACHE_WORDS = 500_000
BLOCK = 2048
MARK = "▁"
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]{1,%d}" % RUN)


def words_of(text: str, most: int = 1 << 20) -> Iterator[list[str]]:
    """The words of a text, in lists of at most ``most`` letters or words."""
    low = text.lower()
    if len(low) <= most:
        yield _WORD.findall(low)
        return
    found = (m.group() for m in _WORD.finditer(low))
    while part := list(islice(found, most // 8)):
        yield part


def pieces_of(file: str) -> list[str]:
    """The vocabulary of a SentencePiece model file, in its order."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size())]


class Edges:
    """The pieces that occur in some words, as edges between positions; positions count over all words."""

    def __init__(self, start: np.ndarray, size: np.ndarray, piece: np.ndarray, first: np.ndarray, width: np.ndarray):
        order = np.argsort((start - first[start] + size) * len(first) + start)       # by the edges' end within their word, then by word
        self.start, self.piece = start[order], piece[order]
        self.end = self.start + size[order]
        self.first, self.width = np.unique(first), width               # a word's positions: first .. first + width
        at = self.end - first[self.start]
        new = np.flatnonzero(np.concatenate(([True], self.end[1:] != self.end[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
        self.runs = self._steps(new, at)

    @staticmethod
    def _steps(new: np.ndarray, at: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Per step: its edges ``a..z`` and where, from ``a``, each node's edges begin."""
        bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), [len(at)])) if len(at) else [0]
        cut = np.searchsorted(new, bounds)
        return [(int(a), int(z), new[i:j] - a) for a, z, i, j in zip(bounds[:-1], bounds[1:], cut[:-1], cut[1:])]


class Segmenter:
    """Forward sums and expected counts over all segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.unknown = pieces.index("<unk>")
        self.useful = {p: i for i, p in enumerate(pieces) if p and all(c.isalpha() or c == MARK for c in p)}
        node = {"": 0}
        for p in sorted({p[:k] for p in self.useful for k in range(1, len(p) + 1)}):
            node[p] = len(node)
        arcs = sorted(((node[p[:-1]] << 21) | ord(p[-1]), k, self.useful.get(p, -1)) for p, k in node.items() if p)
        self.arcs, self.target, self.ends = (np.array(c, dtype=np.int64) for c in zip(*arcs)) if arcs else (np.zeros(0, dtype=np.int64),) * 3

    def edges(self, words: list[str]) -> Edges:
        width = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        code = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        upto = np.cumsum(width)
        limit, base = np.repeat(upto, width), np.repeat(upto - width, width)
        pos, node, found, k = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), [], 0
        while len(pos) and len(self.arcs):
            want = (node << 21) | code[pos + k]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            ok = self.arcs[arc] == want
            piece = np.where(ok, self.ends[arc], -1)
            k += 1
            if k == 1:
                piece[piece < 0] = self.unknown          # a character is a piece, known or not
            hit = piece >= 0
            found.append((pos[hit], np.full(int(hit.sum()), k), piece[hit]))
            pos, node = pos[ok], self.target[arc[ok]]
            more = pos + k < limit[pos]
            pos, node = pos[more], node[more]
        if not len(self.arcs):
            found.append((pos, np.ones(len(pos), dtype=np.int64), np.full(len(pos), self.unknown)))
        start, size, piece = (np.concatenate(c) for c in zip(*found))
        # a word of width w has w + 1 positions
        word = np.repeat(np.arange(len(words)), width)
        return Edges(start + word[start], size, piece, *self._positions(base, word, width))

    @staticmethod
    def _positions(base: np.ndarray, word: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(width + 1) - width - 1
        return np.repeat(first, width + 1), width

    def forward(self, words: list[str], prob: np.ndarray, keep: bool = False):
        """Log probabilities ``[word, language]``; ``keep``: also the edges, each with its share of the sum at its end."""
        e = self.edges(words)
        logs = np.zeros((int(e.width.sum()) + len(words), prob.shape[1]))        # log forward sums by position
        shares = np.zeros((len(e.start), prob.shape[1])) if keep else None
        for a, z, at in e.runs:
            end = e.end[a:z]
            part = prob[e.piece[a:z]] * np.exp(logs[e.start[a:z]] - logs[end - 1])
            step = np.add.reduceat(part, at)
            logs[end[at]] = logs[end[at] - 1] + np.log(step)
            if keep:
                shares[a:z] = part / np.repeat(step, np.diff(np.concatenate((at, [z - a]))), axis=0)
        total = logs[e.first + e.width]
        return (total, e, shares) if keep else total

    def expected(self, words: list[str], weights: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts ``[piece, language]`` of words that occur ``weights[word, language]`` times."""
        _, e, shares = self.forward(words, prob, keep=True)
        positions, out = int(e.width.sum()) + len(words), []
        for lang in range(prob.shape[1]):                # one language at a time: plain vectors
            flow, mass = np.ascontiguousarray(shares[:, lang]), np.zeros(positions)
            mass[e.first + e.width] = weights[:, lang]
            for a, z, _ in reversed(e.runs):             # all that ends later has been passed down
                flow[a:z] *= mass[e.end[a:z]]
                np.add.at(mass, e.start[a:z], flow[a:z])
            out.append(np.bincount(e.piece, weights=flow, minlength=self.n))
        return np.stack(out, axis=1)


def block_of(words: list[str], at: int, langs: int) -> list[str]:
    """Words from ``at`` on, shorter ones first, as many as a bounded array of sums takes."""
    end = at + BLOCK
    longest = len(words[min(end, len(words)) - 1])
    return words[at:at + max(1, min(BLOCK, (1 << 18) // (longest * langs)))]


class Model:
    """Piece probabilities by language; scores texts, with a bounded table of known words."""

    def __init__(self, pieces: list[str], langs: list[str], prior: np.ndarray, prob: np.ndarray):
        self.pieces, self.langs, self.prior, self.prob = pieces, langs, prior, prob

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "langs", "prior", "prob")}

    def ready(self) -> None:
        if not hasattr(self, "known"):
            self.segmenter, self.known, self.rows = Segmenter(self.pieces), {}, np.zeros((1 << 16, len(self.langs)))

    def log_probs(self, words: list[str]) -> np.ndarray:
        """``[word, language]``, through a bounded table of known words."""
        at = list(map(self.known.get, words))
        if None in at:
            new = {w for w, k in zip(words, at) if k is None}
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, new = {}, set(words)
            todo, done = sorted(new, key=len), 0
            while len(self.known) + len(todo) > len(self.rows):
                self.rows = np.concatenate([self.rows, self.rows])
            while done < len(todo):
                part = block_of(todo, done, len(self.langs))
                n = len(self.known)
                self.rows[n:n + len(part)] = self.segmenter.forward(part, self.prob)
                self.known.update(zip(part, range(n, n + len(part))))
                done += len(part)
            at = list(map(self.known.__getitem__, words))
        return self.rows[at]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        self.ready()
        sums = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), dtype=bool)
        short: list[tuple[int, list[str]]] = []
        waiting = 0
        for k, t in enumerate(texts):
            for part in words_of(t.decode()):
                letters[k] = letters[k] or any(map(str.isalpha, part)) or any(c.isalpha() for w in part for c in w)
                short.append((k, part))
                waiting += len(part)
                if waiting > TABLE_WORDS:
                    self._add(short, sums)
                    waiting = 0
        self._add(short, sums)
        z = self.prior + sums
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return [(self.langs[b], float(z[k, b])) if letters[k] else (UNDETERMINED, 0.0) for k, b in enumerate(best.tolist())]

    def _add(self, parts: list[tuple[int, list[str]]], sums: np.ndarray) -> None:
        every = [w for _, p in parts for w in p]
        if every:
            some = [(k, len(p)) for k, p in parts if p]
            first = np.cumsum([0] + [n for _, n in some[:-1]])
            np.add.at(sums, [k for k, _ in some], np.add.reduceat(self.log_probs(every), first))
        parts.clear()


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, Counter] = {}

    def flush():
        rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    for b, texts in chunks(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), texts):
            c = total.setdefault(lang, Counter())
            for part in words_of(text.decode()):
                c.update(part)
        if sum(map(len, total.values())) > TABLE_WORDS:
            yield flush()
    if any(total.values()):
        yield flush()


def _expect(batches: Iterator[pa.RecordBatch], pieces: list[str], langs: list[str], prob: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(word, counts)`` in; the task's sums ``(piece, lang, count)`` out, once."""
    s, total = Segmenter(pieces), np.zeros(prob.shape)
    number = {x: k for k, x in enumerate(langs)}
    for b in slices(batches, 4 * BLOCK):
        counts = dict(zip(b.column("word").to_pylist(), b.column("counts").to_pylist()))
        todo, at = sorted(counts, key=len), 0
        while at < len(todo):
            part = block_of(todo, at, len(langs))
            weights = np.zeros((len(part), len(langs)))
            for k, w in enumerate(part):
                for c in counts[w]:
                    weights[k, number[c["lang"]]] = c["n"]
            total += s.expected(part, weights, prob)
            at += len(part)
    piece, lang = np.nonzero(total)
    if len(piece):
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], names=["piece", "lang", "count"])


def fit(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rounds: int = ROUNDS, alpha: float = ALPHA) -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-id")
    pieces = pieces_of(file)
    rows = own(docs, doc_id, text, lang).toDF("doc_id", "text", "lang").where("lang is not null").where(~held_out("doc_id"))
    # one number per language
    share = {r[0]: r[1] for r in rows.where("text is not null").groupBy("lang").count().collect()}
    langs = sorted(share)
    if not langs:
        return Model(pieces, [], np.zeros(0), np.zeros((0, 0)))
    types = rows.where("text is not null").select("lang", "text").mapInArrow(_count, "lang string, word string, n long") \
        .groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
    types = scratch.write(types, "types")
    prob = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        now = prob
        sums = types.mapInArrow(lambda it: _expect(it, pieces, langs, now), "piece long, lang long, count double") \
            .groupBy("piece", "lang").agg(F.sum("count").alias("count")).toArrow()      # at most pieces x languages
        count = np.full(prob.shape, alpha)
        count[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["count"].to_numpy()
        prob = count / count.sum(axis=0)
    scratch.clear()
    prior = np.array([share[x] for x in langs], dtype=np.float64)
    return Model(pieces, langs, np.log(prior / prior.sum()), prob)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``."""
    spark = docs.sparkSession
    small_batches(spark)
    bc = spark.sparkContext.broadcast(model)             # pieces x languages numbers

    def run(batches):
        for b, texts in chunks(batches, "text"):
            got = bc.value.predict(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = own(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
