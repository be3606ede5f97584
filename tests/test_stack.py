"""End-to-end stacked model on the smallest driver tables with small settings:
invariants (scores in [0,1], memberships sum to 1, known cells untouched,
imputed cells filled), evaluation tables, persistence round trip."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.plans import models, stacking
from tessera.sources import single_row

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver tables absent")


@pytest.fixture(scope="module")
def trained(spark):
    cfg = models.doc_config()
    cfg.impute_specs = [dict(s, max_iter=5) for s in cfg.impute_specs]
    cfg.gbt = dict(max_iter=5, max_depth=3)
    cfg.ann = dict(hidden=[8], max_iter=10, class_copies={0: 4, 1: 11})
    cfg.meta_hidden = [8]
    cfg.meta_iter = (5, 5)
    cfg.fcm_phase1 = dict(m=5.0, error=1e-4, maxiter=30)
    cfg.fcm_final = dict(m=2.0, error=1e-8, maxiter=30)
    cfg.knn_k = 5
    raw = models.doc_table(spark, SF)
    parts, art = stacking.prepare(raw, cfg)
    stacking.train(parts, art)
    return raw, parts, art


def test_prepare_invariants(trained):
    raw, parts, art = trained
    for name in ("train_set", "test_set"):
        df = parts[name]
        assert df.where(" or ".join(f"{c} is null" for c in art.cfg.features)).count() == 0
    tr = parts["train_set"]
    n1, n2 = parts["train1"].count(), parts["train2"].count()
    assert n1 + n2 == tr.count()
    # imputation flags mark exactly the cells that were zero in the raw table
    flagged = tr.where("digit_share_imputed").select("doc_id")
    zeros = raw.where("digit_share = 0").select("doc_id")
    assert flagged.subtract(zeros).count() == 0


def test_scores_and_memberships(trained):
    _, parts, art = trained
    out = stacking.score(parts["test_set"], art, "batch", raw=False)
    cols = art.score_names + ["u0", "u1", "p_meta"]
    bad = out.where(" or ".join(f"{c} < -1e-9 or {c} > 1 + 1e-9 or {c} is null" for c in cols)).count()
    assert bad == 0
    assert out.where("abs(u0 + u1 - 1) > 1e-9").count() == 0
    assert out.count() == parts["test_set"].count()


def test_evaluate_tables(trained):
    _, parts, art = trained
    ev = {r["model"]: r for r in stacking.evaluate(parts["test_set"], art).collect()}
    assert set(ev) == {"ANN", "KNN", "LightGBM", "RSVM", "LinearSVM", "meta"}
    n = parts["test_set"].count()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == n for r in ev.values())
    with pytest.raises(ValueError):
        stacking.evaluate_imputers(parts["train_set"], parts["test_set"], art)
    imp = {(r["target"], r["split"]): r for r in stacking.evaluate_imputers(parts["train_given"], parts["test_given"], art).collect()}
    assert set(imp) == {(t, s) for t in ("digit_share", "upper_share") for s in ("train", "val")}
    # by hand: the first imputer on the held-out rows whose target is known
    known = parts["test_given"].where("digit_share is not null")
    got = [(r["digit_share"], r["__pred"]) for r in art.imputers["digit_share"].transform(known).collect()]
    mean = sum(y for y, _ in got) / len(got)
    sse, sst = sum((y - p) ** 2 for y, p in got), sum((y - mean) ** 2 for y, _ in got)
    assert imp["digit_share", "val"]["n"] == len(got)
    assert imp["digit_share", "val"]["mse"] == pytest.approx(sse / len(got))
    assert imp["digit_share", "val"]["r2"] == pytest.approx(1 - sse / sst)


def test_persistence_and_single_row(spark, trained):
    _, parts, art = trained
    d = tempfile.mkdtemp(prefix="tessera-art-")
    stacking.save_artifacts(art, d)
    back = stacking.load_artifacts(spark, d)
    assert back.cfg == art.cfg
    a = stacking.score(parts["test_set"], art, "fitted", raw=False).select("doc_id", "p_meta")
    b = stacking.score(parts["test_set"], back, "fitted", raw=False).select("doc_id", "p_meta")
    j = a.join(b.withColumnRenamed("p_meta", "p2"), "doc_id")
    assert j.where("abs(p_meta - p2) > 1e-12").count() == 0
    # one row in fitted mode: scores do not collapse to 0 as batch mode would
    row = parts["test_set"].drop("label").limit(1).collect()[0].asDict()
    one = single_row(spark, {k: float(v) for k, v in row.items() if k in art.cfg.features}, key="doc_id")
    r = stacking.score(one, back, "fitted", raw=False).collect()[0]
    assert 0.0 <= r["p_meta"] <= 1.0
    # one raw row (a zero is a missing share) through the whole chain
    given = parts["test_given"].select("doc_id", *art.cfg.features).limit(1).collect()[0].asDict()
    one = single_row(spark, {c: float(given[c] or 0) if c != "digit_share" else 0.0 for c in art.cfg.features}, key="doc_id")
    r = stacking.score(one, back, "fitted").collect()[0]
    assert 0.0 <= r["p_meta"] <= 1.0 and r["digit_share_imputed"] and r["pred"] in (0, 1)


def test_resume_after_phase_one(spark, trained):
    _, parts, art = trained
    d = tempfile.mkdtemp(prefix="tessera-phase1-")
    half = stacking.Artifacts(**{**vars(art), "meta": None, "centers": None})
    stacking.save_artifacts(half, d)
    back = stacking.load_artifacts(spark, d)
    assert back.meta is None and back.centers is None
    base, phase1 = back.base, back.meta_phase1
    stacking.train(parts, back)
    assert back.base is base and back.meta_phase1 is phase1 and back.meta is not None
    a = stacking.score(parts["test_set"], art, "fitted", raw=False).select("doc_id", "p_meta")
    b = stacking.score(parts["test_set"], back, "fitted", raw=False).selectExpr("doc_id", "p_meta p2")
    assert a.join(b, "doc_id").where("abs(p_meta - p2) > 1e-6").count() == 0


def test_prepare_makes_its_input_once(spark):
    """Split, bounds and imputers pass over a written table, not over the plan that makes the columns (a checkpoint runs it twice)."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(i):
        made.add(1)
        return float(i % 17)

    rows = 300
    df = spark.range(0, rows, 1, 2).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"),
                                           costly("id").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    cfg = stacking.StackConfig(features=["a", "b"], key="key", label="label", zero_missing=["b"], required=["a"],
                               impute_specs=[dict(target="b", features=["a"], max_iter=1, max_depth=1)])
    parts, _ = stacking.prepare(df, cfg)
    assert parts["train_set"].count() + parts["test_set"].count() == rows
    assert made.value <= 2 * rows


def test_shares_count_characters(spark):
    texts = ["", "a1B2, \U0001F600-Ü9", "...", "AB\n\n cd", "é1é2"]
    text = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    path = tempfile.mkdtemp()
    text.write.parquet(f"{path}/documents.parquet")
    text.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r for r in models.doc_table(spark, path).collect()}
    for i, t in enumerate(texts):
        n = max(len(t), 1)
        for name, chars in (("digit_share", "0123456789"), ("upper_share", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("punct_share", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):
            assert got[i][name] == pytest.approx(sum(c in chars for c in t) / n), (t, name)
