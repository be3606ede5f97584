"""Spelling variants by a frequency-vector trie over the words of a corpus.

1. Counting.  Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, with only
   A-Z lower-cased, of whole texts.  Tasks count them in bounded tables, so a
   word that fills a third of the corpus leaves a task as a few rows.  A
   deterministic share of the runs (``crc32("<id>:<run>") mod ONE_IN = 0``)
   loses one letter: planted slips, by which the grouping can be judged.
2. Vectors.  Letters are dealt to ``GROUPS`` groups of about equal weight
   (the corpus's letter counts, at most 90 numbers, decide); a word's vector
   is its length, then its letter count per group.  The words, arranged by
   these numbers one after the other, are a trie.
3. Two words at distance one differ by at most one surplus and one deficit:
   a longer word has one letter more in one group, a replaced letter moves
   one count from a group to another or stays within one.  The trie is cut
   at depth ``depth`` into subtrees, the shallowest depth at which a subtree holds ``SUBTREE``
   words in the mean.  A word travels to those subtrees that the budget lets
   it reach (7 at depth 2); a subtree that is still larger is cut into blocks
   of ``SUBTREE`` words, each visited by all its guests.
4. In a task, a depth-first search walks many guests through the subtree at
   once; each level leaves a count as it is or spends the surplus or the
   deficit.  A pair is looked for from one side only: from the shorter word
   or, at equal length, from the lexicographically smaller vector.  Words at
   the leaves are verified by common prefix and suffix.  Tasks give each
   word's number of near words and its best one, never the pairs.
5. The form of a word is its most frequent near word if that is ``RATIO``
   times as frequent; forms are followed to the last by pointer doubling.

Cases: null and empty texts have no words; a null id counts as an empty one;
repeated rows count each time; ties go to the word that is smaller in
code-point order; words of any length take part; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own
from tessera.llm._words import chunks, mix, slices

LEAST_LENGTH = 6
LEAST_COUNT = 5
ONE_IN = 199
RATIO = 5
GROUPS = 12
SUBTREE = 5_000
CHUNK_WORDS = 30_000
TABLE_WORDS = 200_000
CELLS = 1 << 25

_U = np.uint64
_RUN = re.compile("[a-zÀ-ÿ]+")
# the state of a guest's budget: what it has spent above the subtree
SAME, SAME_PLUS, SAME_BOTH, LONGER, LONGER_PLUS, TARGET = range(6)


def _count(batches: Iterator[pa.RecordBatch], least: int, one_in: int) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` of the results of at least ``least`` letters, pre-aggregated."""
    total: dict[str, int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for b, texts in chunks(batches, "text"):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts):
            start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for w, k in Counter(m for m in _RUN.findall(text.lower().decode()) if len(m) >= least).items():
                h = crc32(w.encode(), start)
                if one_in and h % one_in == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                    if len(w) < least:
                        continue
                total[w] = total.get(w, 0) + k
        if len(total) > TABLE_WORDS:
            yield flush()
    if total:
        yield flush()


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``(word, n)`` of the corpus's words; ``one_in``: 0 plants no slips."""
    rows = own(docs, doc_id, text).toDF("doc_id", "text").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    parts = rows.mapInArrow(lambda it: _count(it, least_length, one_in), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deal_letters(weights: dict[str, int], groups: int = GROUPS) -> dict[str, int]:
    """Letters to groups of about equal weight, the heaviest letters first."""
    load, out = [0] * groups, {}
    for c in sorted(weights, key=lambda c: (-weights[c], c)):
        out[c] = g = load.index(min(load))
        load[g] += weights[c]
    return out


class Letters:
    """Words as Latin-1 bytes and their vectors."""

    def __init__(self, group_of: dict[str, int], groups: int):
        self.groups = groups
        self.table = np.zeros(256, dtype=np.int64)
        for c, g in group_of.items():
            self.table[ord(c)] = g

    def vectors(self, words: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(len(words)), size)
        return np.bincount(row * self.groups + self.table[flat], minlength=len(words) * self.groups).reshape(len(words), self.groups)


def _subtree(length: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    key = mix(length.astype(_U))
    for k in range(prefix.shape[1]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + prefix[:, k].astype(_U))
    return key.view(np.int64)


def _routes(length: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(state, rows, subtree)``: all subtrees that the words may visit from their side of a pair."""
    p, rows = prefix.shape[1], np.arange(len(length))
    yield SAME, rows, _subtree(length, prefix)
    yield LONGER, rows, _subtree(length + 1, prefix)
    for i in range(p):
        plus = prefix.copy()
        plus[:, i] += 1
        yield SAME_PLUS, rows, _subtree(length, plus)
        yield LONGER_PLUS, rows, _subtree(length + 1, plus)
        for j in range(i + 1, p):                        # the first difference is the surplus: the pair's one side
            ok = np.flatnonzero(prefix[:, j] > 0)
            both = plus[ok]
            both[:, j] -= 1
            yield SAME_BOTH, ok, _subtree(length[ok], both)


def _route(batches: Iterator[pa.RecordBatch], letters: Letters, depth: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 20_000):
        words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        prefix = letters.vectors(words)[:, :depth]
        found = [(TARGET, np.arange(len(words)), _subtree(length, prefix)), *_routes(length, prefix)]
        for state, rows, subtree in found:
            span = length[rows] + (state in (LONGER, LONGER_PLUS))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(span, pa.int64()), pa.array(subtree, pa.int64()), pa.array(np.full(len(rows), state, dtype=np.int32)),
                                              b.column("word").take(at), b.column("n").take(at)], names=["span", "subtree", "state", "word", "n"])


class Trie:
    """Targets by subtree, then by the counts of the groups from ``depth`` on; children are found in sorted arrays."""

    def __init__(self, subtree: np.ndarray, vectors: np.ndarray):
        cols = [subtree, *vectors.T]
        self.order = np.lexsort(cols[::-1])
        self.tops, node = np.unique(subtree[self.order], return_inverse=True)
        self.keys = []
        for col in cols[1:]:
            keys, node = np.unique((node.astype(np.int64) << 32) | col[self.order], return_inverse=True)
            self.keys.append(keys)
        leaves = len(self.keys[-1]) if self.keys else len(self.tops)
        self.first = np.searchsorted(node, np.arange(leaves + 1))                # the words of each leaf, in ``order``

    def search(self, subtree: np.ndarray, vectors: np.ndarray, state: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(guest, leaf)`` of every leaf within the budget: a depth-first search, all guests in step."""
        at = np.searchsorted(self.tops, subtree)
        at[at == len(self.tops)] = 0
        guest = np.flatnonzero(self.tops[at] == subtree)
        todo = [(0, guest, at[guest], state)]
        while todo:
            level, guest, node, state = todo.pop()
            if not len(guest):
                continue
            if level == len(self.keys):
                if state not in (SAME_PLUS, LONGER):     # half a replacement, or an insertion never made
                    yield guest, node
                continue
            keys, count = self.keys[level], vectors[guest, level]
            steps = [(0, state)]
            if state in (SAME, LONGER):
                steps.append((1, SAME_PLUS if state == SAME else LONGER_PLUS))
            elif state == SAME_PLUS:
                steps.append((-1, SAME_BOTH))
            for step, then in steps:
                want = (node << 32) | np.maximum(count + step, 0)
                child = np.searchsorted(keys, want)
                child[child == len(keys)] = 0
                ok = (keys[child] == want) & (count + step >= 0)
                todo.append((level + 1, guest[ok], child[ok], then))


def _matrix(words: list[bytes], right: bool, pad: int) -> np.ndarray:
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(size.max()) if len(words) else 0
    out = np.full((len(words), width), pad, dtype=np.uint8)
    at = np.arange(width)[None, :]
    out[at >= width - size[:, None] if right else at < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return out


def _equal_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading equal columns."""
    w = min(a.shape[1], b.shape[1])
    differ = a[:, :w] != b[:, :w]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), w)


class _Words:
    """Words of one side, ready to be verified: matrices from the left and, reversed, from the right."""

    def __init__(self, words: list[bytes], pad: int):
        self.words = words
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.left = _matrix(words, False, pad)
        self.right = _matrix(words, True, pad)[:, ::-1]


def _near(g: _Words, guest: np.ndarray, t: _Words, target: np.ndarray) -> np.ndarray:
    """Which pairs are one letter apart; a target is as long as the guest or one letter longer."""
    longer = t.size[target] - g.size[guest]
    head = _equal_run(g.left[guest], t.left[target])
    tail = _equal_run(g.right[guest], t.right[target])
    return np.where(longer == 1, head + tail >= g.size[guest], (head < g.size[guest]) & (head + tail >= g.size[guest] - 1))


class _Found:
    """Per word of a chunk: number of near words and the best of them."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def close(self, word: list[bytes], n: np.ndarray) -> pa.RecordBatch | None:
        """``word``, ``n``: both sides' words, one after the other; pairs are positions in them."""
        if not self.pairs:
            return None
        a = np.concatenate([x for x, _ in self.pairs] + [y for _, y in self.pairs])
        b = np.concatenate([y for _, y in self.pairs] + [x for x, _ in self.pairs])
        rank = np.empty(len(word), dtype=np.int64)
        rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        say = lambda ids: pa.array([word[i].decode("latin-1") for i in ids.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([say(a[at]), pa.array(np.diff(np.concatenate((at, [len(a)])))), pa.array(n[b[at]]), say(b[at])],
                                          names=["word", "n_near", "best_n", "best"])


def _search(targets: list[tuple], guests: list[tuple], letters: Letters, depth: int) -> pa.RecordBatch | None:
    """``targets`` and ``guests``: rows ``(subtree, state, word, n)`` of whole subtrees."""
    if not targets or not guests:
        return None
    guests.sort(key=lambda r: r[1])
    sub = [np.array([r[0] for r in rows], dtype=np.int64) for rows in (targets, guests)]
    words = [[r[2].encode("latin-1") for r in rows] for rows in (targets, guests)]
    n = np.array([r[3] for r in targets] + [r[3] for r in guests], dtype=np.int64)
    state = np.array([r[1] for r in guests])
    vec = [letters.vectors(w)[:, depth:] for w in words]
    t, g = _Words(words[0], 254), _Words(words[1], 255)
    trie, found = Trie(sub[0], vec[0]), _Found()
    step = max(1, CELLS // 4 // max(1, t.left.shape[1]))
    for s in np.unique(state).tolist():
        a, z = np.searchsorted(state, (s, s + 1))
        for guest, leaf in trie.search(sub[1][a:z], vec[1][a:z], s):
            size = trie.first[leaf + 1] - trie.first[leaf]
            upto = np.cumsum(size)
            lo = 0
            while lo < len(leaf):                        # leaf words are verified, a bounded number of pairs at a time
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step)))
                k = size[lo:hi]
                who = np.repeat(guest[lo:hi], k) + a
                target = trie.order[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(trie.first[leaf[lo:hi]], k)]
                ok = _near(g, who, t, target)
                who, target = who[ok], target[ok]
                if s == SAME:                            # equal vectors meet from both sides: one of them counts
                    twice = (vec[1][who] == vec[0][target]).all(axis=1)
                    once = ~twice | np.fromiter((words[1][i] < words[0][j] for i, j in zip(who.tolist(), target.tolist())), dtype=bool, count=len(who))
                    who, target = who[once], target[once]
                if len(who):
                    found.pairs.append((target, who + len(targets)))
                lo = hi
    return found.close(words[0] + words[1], n)


def _visit(batches: Iterator[pa.RecordBatch], letters: Letters, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(span, subtree, block, state, word, n)`` sorted so, a block's targets (the smallest state) before its guests."""
    now, targets, guests, width = None, [], [], 1
    for b in slices(batches, 5_000):
        for span, subtree, block, order, state, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if (span, subtree, block) != now:
                now = (span, subtree, block)
                if (len(targets) + len(guests)) * max(width, span) > CELLS or len(targets) > CHUNK_WORDS:
                    if out := _search(targets, guests, letters, depth):
                        yield out
                    targets, guests, width = [], [], 1
                where = hash(now)                        # a block of a subtree is a subtree of its own
            width = max(width, span)
            if state == TARGET:
                targets.append((where, state, word, n))
            else:
                guests.append((where, state, word, n))
                if len(guests) * width > CELLS:          # all targets of the subtree are here already
                    if out := _search(targets, guests, letters, depth):
                        yield out
                    guests = []
    if out := _search(targets, guests, letters, depth):
        yield out


def _depth(words: DataFrame, letters: Letters, groups: int, subtree_words: int) -> int:
    """The shallowest depth at which a word's subtree holds ``subtree_words`` words in the mean."""
    def cells(batches):
        for b in slices(batches, 20_000):
            ws = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            length, vec = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)), letters.vectors(ws)
            for d in range(groups):
                sub, k = np.unique(_subtree(length, vec[:, :d]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sub), d, dtype=np.int32)), pa.array(sub), pa.array(k)], names=["depth", "subtree", "k"])

    sizes = words.select("word").mapInArrow(cells, "depth int, subtree long, k long").groupBy("depth", "subtree").agg(F.sum("k").alias("k"))
    mean = {r[0]: r[1] for r in sizes.groupBy("depth").agg(F.sum(F.col("k").cast("double") * F.col("k")) / F.sum("k")).collect()}
    return next((d for d in range(groups) if mean.get(d, 0) <= subtree_words), groups)


def near_words(words: DataFrame, scratch: Scratch, groups: int = GROUPS, subtree_words: int = SUBTREE) -> DataFrame:
    """``(word, n_near, form_n, form)``: the most frequent near word of each word of ``words(word, n)`` that has any."""
    spark = words.sparkSession
    # the alphabet has at most 26 + 64 letters
    weights = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    letters = Letters(deal_letters({r[0]: r[1] for r in weights}, groups), groups)
    depth = _depth(words, letters, groups, subtree_words)
    routed = scratch.write(words.mapInArrow(lambda it: _route(it, letters, depth), "span long, subtree long, state int, word string, n long"), "routed")
    is_target = F.col("state") == TARGET
    blocks = routed.where(is_target).groupBy("span", "subtree").agg(F.ceil(F.count(F.lit(1)) / subtree_words).alias("blocks"))
    many = routed.join(blocks, ["span", "subtree"])      # guests of subtrees without words end here
    block = F.when(is_target, F.array(F.pmod(F.xxhash64("word"), F.col("blocks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    many = many.select("span", "subtree", F.explode(block).alias("block"), F.when(is_target, 0).otherwise(1).alias("guest"), "state", "word", "n")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.repartition(n, "subtree", "block").sortWithinPartitions("span", "subtree", "block", "guest")
    got = dealt.mapInArrow(lambda it: _visit(it, letters, depth), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best"))).alias("b")
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.low")).alias("form_n"), F.col("b.best").alias("form"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: every form is more frequent than its word, so paths end."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.write(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = not new.where("moved").take(1)
        scratch.drop(at)
        at = new.select("word", "root")
        at._scratch_path = new._scratch_path
        if done:
            return at


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                   one_in: int = ONE_IN, ratio: int = RATIO, groups: int = GROUPS, subtree_words: int = SUBTREE) -> DataFrame:
    """Per word: ``word, n, n_near, form, form_n, root``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(count_words(docs, doc_id, text, least_length, least_count, one_in), "words")
    near = scratch.write(near_words(words, scratch, groups, subtree_words), "near")
    all_ = words.join(near, "word", "left").withColumn("ok", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    all_ = scratch.write(all_.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(F.col("ok"), F.col("form")).alias("form"), F.when(F.col("ok"), F.col("form_n")).alias("form_n")), "forms")
    last = roots(all_.where("form is not null"), scratch)
    return all_.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
