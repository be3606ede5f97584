"""Spelling variants, Merkle manifests and language identification: brute force, SQL and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, language_id, merkle, oracle, spelling
from tessera.llm._shared import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, tree string, pos long, word string, n long, digest string"


def docs_of(spark, rows):
    """``(id, text, lang)`` with clashing extra columns."""
    return spark.createDataFrame([(i, t, x, "src", len(t or ""), 1, "t", 2, "w", 3, "d") for i, t, x in rows], DOCS)


def say(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def sql_rows(sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = con.execute(oracle.LLM_ORACLE[name])
    return [x[0] for x in got.description], Counter(got.fetchall())


@pytest.mark.parametrize("name", ["op11_spelling", "op12_merkle"])
def test_query_equals_its_sql(spark, name):
    columns, want = sql_rows(SF, name)
    got = catalog.LLM_QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == want


# spelling variants

def brute_variants(rows, least=6, count=5, one_in=199, ratio=5):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (t or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    near, cut = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            c = w[:i] + w[i + 1:]
            cut[i, c].append(w)
            if c in n:
                near[w].add(c)
                near[c].add(w)
    for ws in cut.values():
        for a in ws:
            near[a].update(b for b in ws if a != b)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    out = {}
    for w in n:
        last = w
        while last in form:
            last = form[last]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, last)
    return out


def variants(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def slips():
    """Words with one-letter slips of many kinds, anagrams, ties, long words and accents."""
    rng = random.Random(5)
    letters = "abcdeéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abcdef", "bacdef", "fedcba", "a" * 3000, "b" + "a" * 2999]
    words = []
    for k, w in enumerate(base):
        words += [w] * (300 // (k + 1) + 1)
        for _ in range(12):
            i = rng.randrange(len(w))
            words += [rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]))] * rng.randrange(1, 5)
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::60]).upper() if k % 7 == 0 else "-".join(words[k::60])) for k in range(60)]
    return rows + [(None, " ".join(words[:40])), (3, rows[3][1]), (90, None), (91, ""), (92, "12 !"), (93, "abcdefg " * 30_000)]


@pytest.mark.parametrize("groups,subtree", [(12, 5000), (3, 4), (1, 5000), (5, 20)])
def test_spelling_against_brute_force(spark, slips, groups, subtree):
    """Few groups and small subtrees: long leaves, depth to the end, many blocks."""
    got = variants(spelling.group_variants(docs_of(spark, [(i, t, "en") for i, t in slips]), least_length=3, least_count=2, one_in=19, ratio=2, groups=groups, subtree_words=subtree))
    assert got == brute_variants(slips, 3, 2, 19, 2)
    assert sum(v[2] is not None for v in got.values()) > 20 and max(v[1] for v in got.values()) > 3


def test_spelling_chunks(spark, slips, monkeypatch):
    """Tasks that must search again and again give the same."""
    words = spark.createDataFrame(list(Counter(w for _, t in slips for w in re.findall("[a-zÀ-ÿ]+", (t or "").encode().lower().decode())).items()), "word string, n long")
    want = {tuple(r) for r in spelling.near_words(words, Scratch(spark, "t"), 4, 50).collect()}
    rows = [(4, 7, 0, 0, spelling.TARGET, "abcd", 3), (4, 7, 0, 1, spelling.SAME_PLUS, "abce", 2)]
    assert len(rows) == 2 and len(want) > 100
    monkeypatch.setattr(spelling, "CELLS", 64)
    monkeypatch.setattr(spelling, "CHUNK_WORDS", 2)
    one = list(spelling._visit(iter(_routed(words)), spelling.Letters(spelling.deal_letters({}, 2), 2), 0))
    total = Counter()
    for b in one:
        for r in b.to_pylist():
            total[r["word"]] += r["n_near"]
    assert total == {r[0]: r[1] for r in want}


def _routed(words):
    """All words as one task would get them at depth 0 with one letter group too few to tell any apart."""
    import pyarrow as pa
    rows = words.toArrow()
    letters = spelling.Letters({}, 2)
    out = []
    for b in spelling._route(iter(rows.to_batches()), letters, 0):
        out += [(r["span"], r["subtree"], 0, int(r["state"] != spelling.TARGET), r["state"], r["word"], r["n"]) for r in b.to_pylist()]
    out.sort(key=lambda r: r[:4])
    names = ["span", "subtree", "block", "guest", "state", "word", "n"]
    return [pa.RecordBatch.from_pydict({n: [r[k] for r in out[s:s + 50]] for k, n in enumerate(names)}) for s in range(0, len(out), 50)]


def test_spelling_of_nothing(spark):
    docs = docs_of(spark, [(1, "x", "en")])
    assert spelling.group_variants(docs.limit(0)).count() == 0
    assert spelling.group_variants(docs).count() == 0
    assert variants(spelling.group_variants(docs_of(spark, [(1, "lonesome " * 5, None)]), one_in=0)) == {"lonesome": (5, 0, None, None, "lonesome")}


# Merkle manifest

def brute_manifest(rows, tamper):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, x, n: h(part(i), part("src"), part(x), part(n), part(t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            a = levels[-1]
            levels.append([h(*a[k:k + 2]) for k in range(0, len(a), 2)])
        return levels

    def climb(levels, at):
        return [(levels[k][(at >> k) ^ 1] if (at >> k) ^ 1 < len(levels[k]) else None, (at >> k) % 2 == 1) for k in range(len(levels) - 1)]

    by = defaultdict(list)
    for i, t, x in rows:
        by[x].append((i is not None, i or 0, leaf(i, t, x, len(t or "")), i, t))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    low = {x: tree([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    high = tree([low[x][-1][0] for x in langs])
    out = Counter()
    for k, x in enumerate(langs):
        for at, (_, _, digest, i, t) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            proof = climb(low[x], at) + climb(high, k)
            node = leaf(i, t, x, len(t or "") + 1) if tamper(i) else digest
            for s, left in proof:
                node = h(node) if s is None else h(s, node) if left else h(node, s)
            out[i, x, digest, low[x][-1][0], high[-1][0], h(*[s for s, _ in proof if s]), node, node == high[-1][0]] += 1
    return out


@pytest.mark.parametrize("stride,sizes", [(6, (1,)), (1, (2,)), (6, (70, 9, 1, 64)), (2, (70, 9, 1, 64)), (1, (5, 4, 3, 2, 1, 1, 1))])
def test_merkle_against_brute_force(spark, stride, sizes):
    names = [None, "", "en", "é", "z", "\U0001f600", "￿"]
    rows = [(k * 3 + j, f"t{k}" if k % 3 else None, names[j]) for j, size in enumerate(sizes) for k in range(size)]
    rows += [(None, "x" * 100_000, names[0]), (0, "t0", names[0]), (0, "t0", names[0])] if len(sizes) == 4 else []
    docs = docs_of(spark, rows)
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, tamper=tamper, stride=stride)
    proof = F.sha2(F.array_join(F.col("proof.digest"), "").cast("binary"), 256)
    got = Counter(tuple(r) for r in got.select("doc_id", "tree", "leaf", "subroot", "root", proof, "folded_root", "verified").collect())
    assert got == brute_manifest(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0)


def test_merkle_stores_every_few_levels_and_folds_any_leaf(spark):
    rows = [(k, f"text {k}", "en") for k in range(300)]
    leaves = docs_of(spark, rows).select(F.lit("en").alias("tree"), "doc_id", merkle.digest_of(F.col("doc_id"), F.col("text")).alias("digest"))
    forest = merkle.Forest(leaves, ["doc_id"], Scratch(spark, "t"), stride=3)
    assert [c.count() for c in forest.checkpoints] == [300, 38, 5] and merkle.levels_stored(300, 3) == 3
    assert forest.tops.count() == 1
    assert merkle.manifest(docs_of(spark, rows).limit(0)).count() == 0


# language identification

def brute_log_prob(word, prob, lang, segmenter):
    """The sum over all segmentations, one by one."""
    s = language_id.MARK + word

    def total(at):
        if at == len(s):
            return 1.0
        out, found = 0.0, False
        for e in range(at + 1, len(s) + 1):
            p = segmenter.useful.get(s[at:e], -1)
            if p >= 0:
                out += prob[p, lang] * total(e)
                found = found or e == at + 1
        return out if found else out + prob[segmenter.unknown, lang] * total(at + 1)

    return math.log(total(0))


PIECES = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab", "cd", ",", "<s>"]


def test_forward_sums_all_segmentations():
    s = language_id.Segmenter(PIECES)
    rng = np.random.Generator(np.random.PCG64(2))
    prob = rng.random((s.n, 3))
    words = ["a", "b", "ab", "aba", "abab", "cd", "acdb", "d", "c", "xyz", "ababababab", "bbbbb"]
    got = s.forward(words, prob)
    for k, w in enumerate(words):
        for lang in range(3):
            assert abs(got[k, lang] - brute_log_prob(w, prob, lang, s)) < 1e-9
    assert np.allclose(got, np.concatenate([s.forward([w], prob) for w in words]))
    long = s.forward(["ab" * 5000], prob * 1e-6)         # no underflow
    assert np.isfinite(long).all()


def test_expected_counts_are_the_gradient():
    """The expected count of a piece is the derivative of the log probability by the log of its probability."""
    s = language_id.Segmenter(PIECES)
    rng = np.random.Generator(np.random.PCG64(3))
    prob = rng.random((s.n, 2))
    words, weights = ["ab", "abab", "acdba", "b"], np.array([[1, 0], [2, 1], [0, 3], [1, 1]], dtype=np.float64)
    got = s.expected(words, weights, prob)
    for p in range(s.n):
        for lang in range(2):
            up, down = prob.copy(), prob.copy()
            up[p, lang] *= math.exp(1e-6)
            down[p, lang] *= math.exp(-1e-6)
            slope = ((s.forward(words, up) - s.forward(words, down))[:, lang] * weights[:, lang]).sum() / 2e-6
            assert abs(slope - got[p, lang]) < 1e-5


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), catalog.tokenizer_file("piece_bpe_32k.model"))


def test_language_of_held_out_rows(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark, model, monkeypatch):
    word = "erblethou the and of "
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ² _!", "en"), (None, word, "en"), (5, word, None), (5, word, None), (6, word * 40_000, "en"), (7, "x" * 5000, None), (8, "日本", "en")]
    got = language_id.predict(docs_of(spark, rows), model).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)] and len(by[5]) == 2 and by[5][0][0] == by[None][0][0] == by[6][0][0] == "en"
    assert by[7][0][0] in model.langs and by[8][0][0] in model.langs
    # a bounded table that must be emptied gives the same
    monkeypatch.setattr(language_id, "CACHE_WORDS", 3)
    monkeypatch.setattr(language_id, "TABLE_WORDS", 2)
    texts = [b"the and of", b"erblethou der die", b"", b"la el de que"]
    fresh = language_id.Model(model.pieces, model.langs, model.prior, model.prob)
    small = fresh.predict(texts)
    monkeypatch.undo()
    assert [x for x, _ in small] == [x for x, _ in model.predict(texts)]
    assert language_id.predict(docs_of(spark, rows).limit(0), model).count() == 0
    none = language_id.fit(docs_of(spark, rows).where("lang is null"), catalog.tokenizer_file("piece_bpe_32k.model"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs_of(spark, rows), none).collect()} == {("und", 0.0)}


def test_learning_reads_neither_the_held_out_fold_nor_null_ids(spark):
    file = catalog.tokenizer_file("piece_bpe_32k.model")
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "the and of erblethou" if i % 2 else "der die und über", "en" if i % 2 else "de") for i in ids]
    a = language_id.fit(docs_of(spark, rows), file)
    b = language_id.fit(docs_of(spark, rows + [(i, "la la la", "xx") for i in held] + [(None, "el el", "yy")]), file)
    assert a.langs == b.langs == ["de", "en"] and np.allclose(a.prob, b.prob)
