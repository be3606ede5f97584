"""The llm operators on small fixtures: brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import _shared, catalog, chat_trees, decontaminate, exact_dedup, licenses, line_dedup, mixing, near_dup, quality_fm, token_counts, warc_index

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, node string, label int, path string"


def docs_of(spark, texts):
    """Rows with clashing extra columns; a text may be None."""
    return spark.createDataFrame([(i, t, "en", "src0", None, 5, "x", 1, "p") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]


@pytest.fixture(scope="module")
def odd_texts(words):
    """Nulls, empties, repeats, ties, near copies and one long text."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    out = [None, "", " \n\t", "a b c", "A  b c", "a b c", say(4), say(5), base, base, base.upper(), base.replace(" ", "  ")]
    for k in range(40):
        w = base.split()
        for _ in range(k // 8):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [say(rng.randrange(1, 200)) for _ in range(30)] + [say(30_000)]
    return list(enumerate(out)) + [(8, base), (None, base), (None, None), (70, "a b c")]


def test_exact_dedup(spark, odd_texts):
    got = exact_dedup.resolve(docs_of(spark, odd_texts)).collect()
    groups = defaultdict(list)
    for i, t in odd_texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for norm, rows in groups.items():
        keep = min(rows)
        for r in rows:
            want[(None if r[1] else r[2], None if keep[1] else keep[2], len(rows), hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.deduplicate(docs_of(spark, odd_texts))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()) == Counter(groups.keys())


def test_directory_doubles_only_where_overfull():
    sizes = {0: 10, 1: 10, 2: 10, 3: 10, 12: 5}
    buckets = exact_dedup.build_directory(sizes, 10, bits=4)
    assert buckets[:4] == [(0, 4), (1, 4), (2, 4), (3, 4)] and buckets[-1] == (1, 1)
    assert (3, 4) in exact_dedup.build_directory({3: 10**9}, 10, bits=4)       # one slot can not split further
    assert exact_dedup.build_directory({}, 10) == [(0, 0)]


def brute_components(texts, percent=85):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[s:s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= percent * (len(a) + len(sets[j]) - n) and n:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(texts):
        t = top(i)
        least[t] = d if least[t] is None else least[t] if d is None else min(d, least[t])
    return Counter((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(texts))


@pytest.mark.parametrize("leaf,node,depth", [(512, 2048, 6), (6, 12, 2)])
def test_near_dup_against_brute_force(spark, odd_texts, monkeypatch, leaf, node, depth):
    """The small limits force pivots, branching and block pairs."""
    for k, v in (("LEAF", leaf), ("NODE", node), ("DEPTH", depth)):
        monkeypatch.setattr(near_dup, k, v)
    got = near_dup.link(docs_of(spark, odd_texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(odd_texts)


@pytest.mark.parametrize("held", [near_dup.HELD, 0])
def test_near_dup_sends_each_set_once_to_a_node(spark, monkeypatch, held):
    """A group of alike, mostly unlinked texts larger than ``LEAF`` meets whole; only one with more than ``HELD`` shingles in blocks."""
    rng = random.Random(3)
    texts = []
    for i in range(240):
        w = [f"w{k}" for k in range(60)]
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        texts.append((i, " ".join(w)))
    met, compare = [], near_dup._Join.compare
    monkeypatch.setattr(near_dup, "LEAF", 20)
    monkeypatch.setattr(near_dup, "HELD", held)
    monkeypatch.setattr(near_dup._Join, "compare", lambda self, at: (met.append(at.count()), compare(self, at)))
    got = near_dup.link(docs_of(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)
    if held:
        assert sum(met) <= 7 * len(texts)


@pytest.mark.parametrize("percent", [60, 80])
def test_near_dup_at_other_similarities(spark, odd_texts, percent, monkeypatch):
    for k, v in (("LEAF", 8), ("NODE", 16), ("DEPTH", 2)):
        monkeypatch.setattr(near_dup, k, v)
    recall = 0.999 if percent == 60 else near_dup.RECALL
    got = near_dup.link(docs_of(spark, odd_texts), percent=percent, recall=recall).collect()
    want = brute_components(odd_texts, percent)
    missed = sum((want - Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)).values())
    assert missed <= 0.02 * len(odd_texts)


@pytest.mark.parametrize("percent", [40, 50, 52, 101])
def test_near_dup_refuses_what_it_can_not_reach(percent):
    with pytest.raises(ValueError):
        near_dup.trees_for(percent / 100, near_dup.RECALL)


def test_near_dup_of_many_similar_unlinked_texts(spark):
    """A group of alike texts, few of them linked, larger than a node: every link is found, and pairs are not compared once a tree."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(1500):
        w = list(base)
        for _ in range(rng.randrange(3, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        texts.append((i, " ".join(w)))
    got = near_dup.link(docs_of(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)


def brute_hits(text, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, found = find(text), set(), set()
    for item, t in items:
        v = find(t)
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if v else 0):
            for s in range(len(w) - m + 1):
                if w[s:s + m] == v[i:i + m]:
                    hit.update(range(s, s + m))
                    found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part_bytes", [1 << 20, 100])
def test_decontaminate(spark, words, part_bytes):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, say(25)), (2, say(10)), (10, say(3)), (11, "!!"), (12, None), (13, ""), (1, say(12)), (14, "éa 9z"), (None, say(15)), (None, say(11))]
    texts = [(0, None), (1, ""), (2, say(50)), (3, say(40) + ". " + items[0][1].upper() + "; " + say(300)), (4, items[1][1].replace(" ", "--")),
             (5, " ".join(items[1][1].split()[:9])), (6, items[2][1] + " " + items[2][1]), (7, items[6][1] + say(3)), (8, "x Éa 9z éa 9Z y"), (3, say(9)), (9, say(20) + items[8][1] + " " + say(5) + " " + items[9][1] + " " + items[1][1]), (10, items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs_of(spark, texts), bench, part_bytes=part_bytes).collect()
    want = Counter((i, *brute_hits(t, items)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    left = decontaminate.decontaminate(docs_of(spark, texts), bench, part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter((i, t) for i, t in texts if not brute_hits(t, items)[4])
    assert decontaminate.scan(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer
    file = catalog.tokenizer_file()
    whole = Tokenizer.from_file(file)
    rng = random.Random(3)
    parts = ["don't ", "é", "é", " ", " ", "<|endoftext|>", "a" * 50, "'''ll", "123", "Σας ", "가", "日本", "\U0001f600", "\t\n", "x-y.z", "'s", "End.,"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(200)))) for k in range(120)] + [(200, None), (201, ""), (202, "b" * 3000), (None, "x y")]
    got = token_counts.count_tokens(docs_of(spark, texts), file, chunk=100, overlap=70, limit=20).collect()
    n = lambda t: len(whole.encode(t or "", add_special_tokens=False))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), n(t), n(t) > 20) for i, t in texts)


def test_quality_fm_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_fm.score(docs, quality_fm.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    accuracy = sum(r.predicted == r.quality for r in rows) / len(rows)
    print("held out:", len(rows), accuracy, auc)
    assert len(rows) > 50 and accuracy >= 0.9 and auc >= 0.98


def test_quality_fm(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_fm.fit(docs, labels)
    rows = quality_fm.score(docs, machine).join(labels, "doc_id").where("not held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    odd = docs_of(spark, [(1, None), (2, ""), (None, "x"), (3, "a " * 200_000), (3, "b")])
    got = quality_fm.score(odd, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_fm.score(odd, quality_fm.fit(docs, labels.limit(0))).collect()} == {0.5}
    one = quality_fm.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality_fm.score(odd, one).collect()} == {1}
    # the sum of squares is the sum over pairs
    import numpy as np
    rng = np.random.Generator(np.random.PCG64(1))
    m = quality_fm.Machine(machine.edges, 0.1, rng.normal(size=len(machine.w)), rng.normal(size=machine.v.shape))
    row, f, x = m.rows(*quality_fm.features([b"one two three two"]))
    pairs = sum(float(m.v[f[i]] @ m.v[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
    assert abs(m.logit(1, row, f, x)[0][0] - (0.1 + float(m.w[f] @ x) + pairs)) < 1e-6


def test_chat_trees(spark):
    text = "a\\l<b>\\g </turn>\n<turn user> \\\\"
    rows = [("r", None, 1, "user", text, 1.0), ("a", "r", 1, "assistant", text, 1.0), ("b", "r", 1, "assistant", "better", 2.0), ("c", "a", 1, "user", None, 0.5),
            ("d", "c", 1, "assistant", "deep", 3.0), ("o", "gone", 2, None, "orphan", None), ("x", "y", 3, "user", "loop", 1.0), ("y", "x", 3, "user", "loop", 1.0)]
    m = spark.createDataFrame(rows, "id string, parent string, conv_id long, role string, text string, score double")
    out = chat_trees.format_trees(m, branches=2)
    got = {r["leaf"]: r for r in out.select("leaf", "tree", "branch", "path_score", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                                            chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {"d", "b", "o"}
    assert [(t.role, t.text) for t in got["d"].turns] == [("user", text), ("assistant", text), ("user", ""), ("assistant", "deep")]
    assert got["d"].loss == text + "deep" and got["d"].branch == 1 and got["d"].path_score == 5.5 and got["b"].branch == 2
    assert [(t.role, t.text) for t in got["o"].turns] == [("", "orphan")] and got["o"].loss == ""
    assert chat_trees.format_trees(m.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://www.a.com/x?b=2&a=1", "same"), (2, "https://a.com/x?a=1&b=2#f", "same"), (3, None, None), (4, "http://b.org", ""), (4, "http://b.org", ""),
            (5, "http://a.com:8080/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" + "é" * 5000), (None, "x", "same"), (6, "http://a.com/x?a=1&b=2", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("ts", F.timestamp_seconds(1000 - F.col("page_id")))
    got = sorted(warc_index.archive_and_index(pages).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.urlkey, r.ts or -1) for r in got] == sorted((r.urlkey, r.ts or -1) for r in got)
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([
        (1, "revisit", 2, 4), (2, "response", None, 4), (None, "revisit", 2, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (4, "revisit", 4, 0),
        (5, "response", None, len(rows[5][2].encode())), (6, "response", None, 5)])
    key = "com,a)/x?a=1&b=2"
    assert [(r.page_id, r.capture_no) for r in got if r.urlkey == key] == [(6, 1), (2, 2), (1, 3)]
    assert warc_index.archive_and_index(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_line_dedup(spark):
    page = lambda n: f"<p>menu</p><p>page {n} says</p><div>again {n // 2}</div><script>x</script>"
    rows = [(n, "http://A.com/" + str(n), page(n)) for n in range(10)] + [(20, "http://b.com/", page(0)), (21, None, page(1)), (22, "http://a.com", None), (0, "http://a.com/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.host): (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(pages).collect()}
    assert got[(4, "a.com")] == (3, 1, "page 4 says\nagain 2") and got[(20, "b.com")][1] == 0 and got[(21, "")][1] == 0 and got[(22, "a.com")] == (0, 0, "")
    assert line_dedup.drop_lines(pages.limit(0)).count() == 0
    small = spark.createDataFrame([(n, f"http://c.com/{n}", page(n)) for n in range(4)] + [(9, "http://d.com", page(9) + "<p>" + "x" * 300_000 + "</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.n_dropped for r in line_dedup.drop_lines(small).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 9: 0}


def test_mixing_shares_siblings_first(spark):
    """x/a is short: its shortage goes to x/b before y gets anything of it."""
    rows = [(i, "w " * 10, "x", "a") for i in range(3)] + [(10 + i, "w " * 10, "x", "b") for i in range(50)] + [(100 + i, "w " * 10, "y", "c") for i in range(47)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, s string").withColumn("path", F.lit("clash"))
    weights = spark.createDataFrame([("x", 1), ("y", 1)], "path string, weight long")
    got = mixing.mix(docs, ["d", "s"], weights, 0.6, max_epochs=1).groupBy("leaf").agg(F.count("*").alias("n")).collect()
    assert {r.leaf: r.n for r in got} == {"x/a": 3, "x/b": 27, "y/c": 30}
    twice = mixing.mix(docs, ["d", "s"], weights, 5.0, max_epochs=2)
    assert twice.count() == 200 and twice.where("epoch = 1").count() == 100
    assert mixing.mix(docs.limit(0), ["d", "s"], weights, 0.6).count() == 0


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = " ".join(f"word{k} the of and is" for k in range(50))
    rows = [(1, "a/LICENSE", mit), (2, "a/b/COPYING.txt", filler + "\n" + gpl), (3, "a/b/c/x.py", filler), (4, "a/z.py", None), (5, "q/z.py", ""), (6, None, filler),
            (7, "a/b/own.py", filler + "\n" + mit + "\n" + filler), (7, "a/b/own.py", filler + "\n" + mit + "\n" + filler), (8, "top.py", filler)]
    got = Counter((r.doc_id, r.license, r.origin, r.from_path) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == Counter([(1, "MIT", "own", "a/LICENSE"), (2, "GPL-3.0", "own", "a/b/COPYING.txt"), (3, "GPL-3.0", "inherited", "a/b/COPYING.txt"),
                           (4, "MIT", "inherited", "a/LICENSE"), (5, None, "none", None), (6, None, "none", None), (7, "MIT", "own", "a/b/own.py"),
                           (7, "MIT", "own", "a/b/own.py"), (8, None, "none", None)])


@pytest.mark.parametrize("name", ["exact", "near", "tokens", "fm", "scan"])
def test_empty_tables(spark, name):
    docs = docs_of(spark, [(1, "a b")]).limit(0)
    run = {"exact": lambda: exact_dedup.deduplicate(docs), "near": lambda: near_dup.link(docs), "tokens": lambda: token_counts.count_tokens(docs, catalog.tokenizer_file()),
           "fm": lambda: quality_fm.score(docs, quality_fm.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))),
           "scan": lambda: licenses.scan(docs)}[name]
    assert run().count() == 0


def test_pipeline_stages(spark):
    """Each stage against what it must keep of its own input."""
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    assert P.quality(spark, docs, SF).columns == docs.columns
    exact = P.exact(spark, docs, SF)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert exact.columns == docs.columns and Counter(norm(r.text) for r in exact.collect()) == Counter({norm(r.text) for r in rows})
    near = P.near(spark, docs, SF)
    want = brute_components([(r.doc_id, r.text) for r in rows], 80)
    assert {r.doc_id for r in near.collect()} == {d for d, _, c in want if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in P.clean(spark, docs, SF).collect()}
    assert clean == {r.doc_id for r in rows if not brute_hits(r.text, bench)[4]}
    assert P.run(spark, SF).columns == [*docs.columns, "epoch", "leaf"]


def test_near_stage_links_at_80_percent(spark, odd_texts):
    """Near copies of similarity 0.80 to 0.85 go too."""
    import corpus_pipeline as P
    rows = odd_texts[:-4]                                    # unique ids
    want = {percent: {d for d, _, c in brute_components(rows, percent) if d == c} for percent in (80, 85)}
    got = [r.doc_id for r in P.near(spark, docs_of(spark, rows), SF).collect()]
    assert sorted(got) == sorted(want[80]) and len(want[80]) < len(want[85])


def test_licenses_of_headers(spark):
    """Headers over several lines, BSD texts and notices inside a line; scores against a brute-force cosine."""
    import math
    import textwrap
    wrap = lambda text, mark: "\n".join(mark + x for x in textwrap.wrap(text, 70))
    gnu = licenses._GNU.format
    bsd2, bsd3 = licenses._BSD + licenses._BSD_REST, licenses._BSD + licenses._BSD_NAMES + licenses._BSD_REST
    code = "\nint alpha = beta;\n"
    heads = {1: ("GPL-3.0", "/*\n" + wrap(gnu("General Public License", "3"), " * ") + "\n */"), 2: ("AGPL-3.0", "#!/bin/sh\n" + wrap(gnu("Affero General Public License", "3"), "# ")),
             3: ("BSD-2-Clause", "/*\n" + bsd2.replace("met: ", "met:\n").replace("disclaimer. ", "disclaimer.\n") + "\n*/"), 4: ("BSD-3-Clause", wrap(bsd3, "// ")),
             5: ("LGPL-2.1", wrap(gnu("Lesser General Public License", "2.1"), "-- ")), 6: (None, "/* beta of alpha */")}
    rows = [(i, f"src{i}/x.c", head + code) for i, (_, head) in heads.items()]
    rows += [(7, "src7/x.c", "alpha beta gamma delta epsilon zeta eta theta iota kappa. This work is licensed under the GNU General Public License, version 2."),
             (8, "t/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "alpha beta " * 500), (9, "b/LICENSE", bsd2)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: r.license for i, r in got.items()} == {**{i: lic for i, (lic, _) in heads.items()}, 7: "GPL-2.0", 8: "GPL-3.0", 9: "BSD-2-Clause"}
    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    vocabulary = {x for _, t in licenses.TEMPLATES for x in terms(t)}
    top, sets = math.log(1 + len(rows)) + 1, [set(terms(t)) for _, _, t in rows]
    idf = {x: math.log((1 + len(rows)) / (1 + sum(x in s for s in sets))) + 1 for x in vocabulary}

    def cosine(unit, text):
        u, v = Counter(terms(unit)), Counter(terms(text))
        norm = math.sqrt(sum((n * idf[x]) ** 2 if x in idf else n * top ** 2 for x, n in u.items()))
        return sum(u[x] * v[x] * idf[x] ** 2 for x in v) / norm / math.sqrt(sum((n * idf[x]) ** 2 for x, n in v.items()))

    for i in (1, 3, 4, 5):
        score, lic = max((round(cosine(heads[i][1], t), 6), name) for name, t in licenses.TEMPLATES)
        assert got[i].license == lic and abs(got[i].score - score) < 2e-6


def test_token_counts_compose_before_lower_case(spark):
    from tokenizers import Tokenizer
    file = catalog.tokenizer_file()
    whole = Tokenizer.from_file(file)
    texts = [(1, "J\u030culy"), (2, "AH\u0331MED"), (3, "July, AHMED.")]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(spark, texts), file).collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False)) for i, t in texts}


def test_mixing_gives_nothing_for_leaves_of_weight_zero(spark):
    """x/a has weight 0: what x can not use goes to y."""
    rows = [(i, "w " * 10, "x", "a") for i in range(10)] + [(100, "w " * 10, "x", "b")] + [(200 + i, "w " * 10, "y", "c") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, s string")
    weights = spark.createDataFrame([("x", 1), ("y", 1), ("x/a", 0)], "path string, weight long")
    got = mixing.mix(docs, ["d", "s"], weights, 0.48, max_epochs=1).groupBy("leaf").agg(F.count("*").alias("n")).collect()
    assert {r.leaf: r.n for r in got} == {"x/b": 1, "y/c": 9}


def test_near_whole_nodes_hold_sizes_that_can_link(spark):
    """In a node that meets whole, a class far from every other in size stays away; those at the ratio stay."""
    join = near_dup._Join.__new__(near_dup._Join)
    join.percent = 85
    sizes = {1: [85, 100, 200], 2: [10, 20], 3: [7, 7], 4: [84, 100], 5: [9], 6: [10, 11, 12, 14]}
    rows = [(node, 100 * node + i, n, 100 * node + i, 100 * node + i) for node, ns in sizes.items() for i, n in enumerate(ns)]
    at = spark.createDataFrame(rows, "node long, id long, n long, mark long, root long")
    assert sorted(r.id for r in join.whole(at).collect()) == [100, 101, 300, 301, 600, 601, 602, 603]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_need_few_tasks(spark, monkeypatch, few):
    monkeypatch.setattr(_shared, "FEW", few)
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for e in edges if e[0] != e[1] for x in e}
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        scratch = _shared.Scratch(spark, "test-components")
        monkeypatch.setattr(scratch, "drop", lambda df: None)
        found = _shared.components(spark, scratch, spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in linked}
        steps = [p for p in pathlib.Path(scratch.base.removeprefix("file:")).iterdir() if p.name.startswith(("large", "small"))]
        assert steps and all(len(list(p.glob("part-*"))) <= _shared.LEAST_TASKS for p in steps)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
