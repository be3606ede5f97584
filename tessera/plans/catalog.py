"""Registered queries on the driver tables, each paired with DuckDB oracle SQL.

Every query reads whole tables (no id subsets, no row caps; a ``limit``
appears only where a top-k report is the feature) and runs the library's own
operators.  Computed floats are rounded to 6 digits on both sides so that a
different summation order cannot change the value hash.

Stand-in inputs (which column plays the label, which columns are features)
are plain projections of the tables; all the work is done by the operators.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean, fuzzy, metrics, neighbors, outliers, profile, scale, split
from tessera.operators import impute as imp
from tessera.operators import stack as stk

# fixed inputs of the registered queries --------------------------------------
L = ["l_extendedprice", "l_discount", "l_quantity", "l_tax"]          # lineitem features
L_SORTED = sorted(L)
SEED = 42
EV = ["value", "k"]                                                   # events features
FCM_CENTERS = [[20.0, 30.0], [150.0, 70.0]]                          # fixed centres (raw units)
SVM_W = {"value": 0.03, "k": -0.02}
SVM_B = 0.5
DOMAINS = {"l_quantity": (1.0, 49.0), "l_discount": (0.0, 0.09), "l_tax": (0.0, 0.07),
           "l_extendedprice": (1000.0, 100000.0)}
LEN_T = 1000


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# stand-in inputs --------------------------------------------------------------

def lineitem_features(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return clean.zero_as_missing(li.select("l_orderkey", "l_linenumber", "l_returnflag", *L), L)


def events_features(spark, sf) -> DataFrame:
    ev = _t(spark, sf, "events")
    return ev.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def events_halves(spark, sf) -> DataFrame:
    return split.hash_split(events_features(spark, sf), "event_id", 0.5, SEED)


def docs_labelled(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = _t(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


def docs_rule_preds(spark, sf) -> DataFrame:
    d = docs_labelled(spark, sf)
    return d.select("doc_id", F.col("quality").alias("label"),
                    (F.col("n_chars") > LEN_T).cast("int").alias("m_len"),
                    (F.col("lang") == "en").cast("int").alias("m_lang"),
                    (F.col("n_chars") < 5 * LEN_T).cast("int").alias("m_short"))


# queries ----------------------------------------------------------------------

def q_zero_as_missing_profile(spark, sf):
    return profile.missing_profile(lineitem_features(spark, sf), L)


def q_required_dropna(spark, sf):
    return clean.drop_missing(lineitem_features(spark, sf), L).select("l_orderkey", "l_linenumber", *L)


def q_iqr_bounds(spark, sf):
    b = outliers.iqr_bounds(lineitem_features(spark, sf), L)
    return b.select("column_name", *[_r(c).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")])


def q_outlier_filter(spark, sf):
    df = lineitem_features(spark, sf)
    b = outliers.iqr_bounds(df, L)
    return outliers.outlier_filter(df, b).select("l_orderkey", "l_linenumber", *L)


def q_outlier_filter_split(spark, sf):
    ev = events_halves(spark, sf)
    train, test = ev.where("split = 'first'"), ev.where("split = 'second'")
    b = outliers.iqr_bounds(train, EV)
    return outliers.outlier_filter(test, b).select("event_id", "value", "k")


def q_outlier_counts(spark, sf):
    ev = events_features(spark, sf)
    return outliers.outlier_counts(ev, outliers.iqr_bounds(ev, EV))


def q_corr_matrix(spark, sf):
    return profile.corr_matrix(lineitem_features(spark, sf), L_SORTED)


def q_corr_with_label(spark, sf):
    df = lineitem_features(spark, sf).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return profile.corr_with_label(df, L_SORTED, "label")


def q_complete_pairs(spark, sf):
    return profile.complete_pairs(lineitem_features(spark, sf), L_SORTED)


def q_value_counts(spark, sf):
    return profile.value_counts(_t(spark, sf, "orders"), "o_orderpriority")


def q_stratified_split(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, SEED)


def q_split_proportions(spark, sf):
    s = q_stratified_split(spark, sf)
    return profile.class_proportions(s, "split").select(
        F.col("value").alias("split"), F.col("count").alias("rows"), "share")


def q_hash_split(spark, sf):
    return events_halves(spark, sf).select("event_id", "split")


def q_minmax_fit(spark, sf):
    return scale.minmax_fit(events_halves(spark, sf).where("split = 'first'"), EV)


def q_minmax_transform(spark, sf):
    ev = events_halves(spark, sf)
    st = scale.minmax_fit(ev.where("split = 'first'"), EV)
    out = scale.minmax_transform(ev.where("split = 'second'"), st, EV)
    return out.select("event_id", *[_r(c).alias(c) for c in EV])


def q_class_weights(spark, sf):
    return profile.class_weights(_t(spark, sf, "labels"), "quality", 1.5, 1)


def q_conditional_fill(spark, sf):
    df = lineitem_features(spark, sf)
    filled = imp.group_mean_fill(df, ["l_discount", "l_tax"], "l_returnflag")
    return filled.select("l_orderkey", "l_linenumber", "l_returnflag",
                         _r("l_discount").alias("l_discount"), _r("l_tax").alias("l_tax"),
                         "l_discount_imputed", "l_tax_imputed")


def q_imputed_flags(spark, sf):
    df = lineitem_features(spark, sf)
    filled = imp.group_mean_fill(df, ["l_discount", "l_tax"], "l_returnflag")
    return imp.imputation_summary(filled, ["l_discount", "l_tax"])


def _embeddings(spark, sf):
    e = _t(spark, sf, "embeddings")
    return neighbors.as_vector(e.withColumn("y", (F.col("label") >= 5).cast("int")), "vec_id", "embedding", "y")


def q_knn_chebyshev(spark, sf):
    v = _embeddings(spark, sf)
    nb = neighbors.knn(v, v.select("key", "vec"), 22, "chebyshev")
    return nb.select("q_key", "rank", "n_key", _r("distance").alias("distance"))


def q_knn_classify(spark, sf):
    v = _embeddings(spark, sf)
    out = neighbors.knn_classify(v, v.select("key", "vec"), 22, "chebyshev")
    return out.select("key", _r("p_pos").alias("p_pos"), "pred")


KNN_GRID_METRICS = ["chebyshev", "manhattan", "euclidean", "cosine", ("minkowski", 3.0), ("minkowski", 4.0), ("minkowski", 5.0)]
KNN_GRID_K = list(range(1, 101)) + [125, 150, 200]


def q_knn_metric_grid(spark, sf):
    from tessera.operators import search
    v = _embeddings(spark, sf)
    halves = split.hash_split(v, "key", 0.5, SEED)
    train = halves.where("split = 'first'").drop("split")
    val = halves.where("split = 'second'").drop("split")
    res = search.knn_grid(train, val, KNN_GRID_METRICS, KNN_GRID_K, ["uniform", "distance"])
    return metrics.top_k(res, "accuracy", 5, ["k", "metric", "weights"]).select(
        "metric", "weights", "k", _r("accuracy").alias("accuracy"))


def q_fcm_memberships(spark, sf):
    ev = events_features(spark, sf)
    u = fuzzy.memberships(ev, EV, FCM_CENTERS, 2.0)
    return u.select("event_id", _r("u0").alias("u0"), _r("u1").alias("u1"))


FCM_ITER = 5            # maxiter: 4 c-means iterations, no early stop (error 0)


def q_fcm_centers(spark, sf):
    ev = events_features(spark, sf)
    st = scale.minmax_fit(ev, EV)
    scaled = scale.minmax_transform(ev, st, EV)
    centers, _, _ = fuzzy.fcm_fit(scaled, EV, "event_id", c=2, m=2.0, error=0.0, maxiter=FCM_ITER, seed=SEED)
    return fuzzy.centers_frame(spark, centers, EV).select(
        F.col("cluster").cast("int").alias("cluster"), *[_r(c).alias(c) for c in EV])


def q_svm_score_minmax(spark, sf):
    ev = events_features(spark, sf)
    s = ev.withColumn("s", F.col("value") * SVM_W["value"] + F.col("k") * SVM_W["k"] + F.lit(SVM_B))
    out = stk.normalize_scores(s, ["s"], mode="batch")
    return out.select("event_id", _r("s").alias("score"))


def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(docs_rule_preds(spark, sf), "label", "m_len")


def q_binary_metrics(spark, sf):
    return metrics.binary_metrics(docs_rule_preds(spark, sf), "label", "m_len")


def q_classification_report(spark, sf):
    return metrics.classification_report(docs_rule_preds(spark, sf), "label", "m_len")


def q_log_loss(spark, sf):
    d = docs_labelled(spark, sf).withColumn("p", F.col("n_chars") / (F.col("n_chars") + F.lit(float(LEN_T))))
    return metrics.log_loss(d, "quality", "p")


def q_best_model_diff(spark, sf):
    p = docs_rule_preds(spark, sf)
    p = p.withColumn("meta", ((F.col("m_len") + F.col("m_lang") + F.col("m_short")) >= 2).cast("int"))
    long = p.unpivot(["doc_id", "label"], ["m_len", "m_lang", "m_short", "meta"], "model", "pred")
    m = metrics.binary_metrics(long, "label", "pred", group=["model"])
    return metrics.best_model_diff(m, "model", "meta", "accuracy")


def _lineitem_reg(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    li = li.withColumn("rk", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    h = split.hash_split(li, "rk", 0.5, SEED, names=("train", "val"))
    means = h.where("split = 'train'").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("pred"))
    return h.join(means, "l_returnflag")      # one row per flag value: AQE broadcasts it


def q_regression_metrics(spark, sf):
    return metrics.regression_metrics(_lineitem_reg(spark, sf), "l_quantity", "pred", group=["split"])


def q_overfit_bucket(spark, sf):
    m = metrics.regression_metrics(_lineitem_reg(spark, sf), "l_quantity", "pred", group=["split"], digits=None)
    w = m.groupBy().pivot("split", ["train", "val"]).agg(F.first("r2"))
    gap = F.col("train") - F.col("val")
    return w.select(_r("train").alias("r2_train"), _r("val").alias("r2_val"), _r(gap).alias("gap"),
                    metrics.overfit_bucket(gap).alias("bucket"))


def q_domain_violations(spark, sf):
    return clean.domain_summary(lineitem_features(spark, sf), DOMAINS)


def q_parse_inputs(spark, sf):
    ev = _t(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", r":(.*)}", 1).alias("k_text"),
        F.col("value").cast("string").alias("value_text"), F.col("event_type").alias("type_text"))
    p = clean.parse_inputs(ev, "event_id", ["k_text", "value_text", "type_text"], zero_missing=["k_text"])
    return p.select("event_id", F.col("k_text").alias("k"), F.col("value_text").alias("value"),
                    F.size("rejected").alias("n_rejected"), "ok")


def q_scored_export(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    o = o.withColumn("actual", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    p = o.withColumn("p", F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(150000.0)))
    out = stk.scored_export(p, "p", label="actual", positive_text="High", negative_text="Low")
    return out.select("o_orderkey", _r("predicted_probability").alias("predicted_probability"),
                      "predicted_outcome", "outcome_text", "correct")


def q_weighted_union(spark, sf):
    ev = events_halves(spark, sf)
    u = stk.weighted_union([(ev.where("split = 'first'"), 1.0), (ev.where("split = 'second'"), 5.0)])
    return u.select("event_id", "split", F.col("w").alias("w"))


QUERIES = {
    "zero_as_missing_profile": q_zero_as_missing_profile,
    "required_dropna": q_required_dropna,
    "iqr_bounds": q_iqr_bounds,
    "outlier_filter": q_outlier_filter,
    "outlier_filter_split": q_outlier_filter_split,
    "outlier_counts": q_outlier_counts,
    "corr_matrix": q_corr_matrix,
    "corr_with_label": q_corr_with_label,
    "complete_pairs": q_complete_pairs,
    "value_counts": q_value_counts,
    "stratified_split": q_stratified_split,
    "split_proportions": q_split_proportions,
    "hash_split": q_hash_split,
    "minmax_fit": q_minmax_fit,
    "minmax_transform": q_minmax_transform,
    "class_weights": q_class_weights,
    "conditional_fill": q_conditional_fill,
    "imputed_flags": q_imputed_flags,
    "knn_chebyshev": q_knn_chebyshev,
    "knn_classify": q_knn_classify,
    "knn_metric_grid": q_knn_metric_grid,
    "fcm_memberships": q_fcm_memberships,
    "fcm_centers": q_fcm_centers,
    "svm_score_minmax": q_svm_score_minmax,
    "confusion_matrix": q_confusion_matrix,
    "binary_metrics": q_binary_metrics,
    "classification_report": q_classification_report,
    "log_loss": q_log_loss,
    "best_model_diff": q_best_model_diff,
    "regression_metrics": q_regression_metrics,
    "overfit_bucket": q_overfit_bucket,
    "domain_violations": q_domain_violations,
    "parse_inputs": q_parse_inputs,
    "scored_export": q_scored_export,
    "weighted_union": q_weighted_union,
}


def q_fold_assignment(spark, sf):
    return split.hash_folds(events_features(spark, sf), "event_id", 5, SEED).select("event_id", "fold")


def q_predefined_split(spark, sf):
    ev = events_halves(spark, sf)
    roles = split.predefined_split(ev.where("split = 'first'").drop("split"), ev.where("split = 'second'").drop("split"))
    return roles.select("event_id", "role")


def q_outlier_flags(spark, sf):
    ev = events_features(spark, sf)
    return outliers.outlier_flags(ev, outliers.iqr_bounds(ev, EV)).select("event_id", "out_value", "out_k")


def q_f1_stabilised(spark, sf):
    m = metrics.binary_metrics(docs_rule_preds(spark, sf), "label", "m_len", digits=None)
    return m.select(_r("precision").alias("precision"), _r("recall").alias("recall"),
                    _r(metrics.f1_stabilised(F.col("precision"), F.col("recall"))).alias("f1_stable"))


def q_train_val_comparison(spark, sf):
    p = split.hash_split(docs_rule_preds(spark, sf), "doc_id", 0.5, SEED, names=("train", "val"))
    long = p.unpivot(["doc_id", "label", "split"], ["m_len", "m_lang", "m_short"], "model", "pred")
    return metrics.binary_metrics(long, "label", "pred", group=["model", "split"])


def q_head_rows(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy("o_orderkey").limit(5)


QUERIES.update({
    "fold_assignment": q_fold_assignment,
    "predefined_split": q_predefined_split,
    "outlier_flags": q_outlier_flags,
    "f1_stabilised": q_f1_stabilised,
    "train_val_comparison": q_train_val_comparison,
    "head_rows": q_head_rows,
})


def q_quality_profile(spark, sf):
    """The flagship pass (``entry``) on any scale."""
    from tessera.plans.flagship import quality_profile
    return quality_profile(spark, sf)


QUERIES["quality_profile"] = q_quality_profile


def q_row_lookup(spark, sf):
    """Orders looked up by the keys of returned line items (key set from the data)."""
    keys = _t(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return clean.row_lookup(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", keys)


QUERIES["row_lookup"] = q_row_lookup


def q_knn_events(spark, sf):
    """Neighbours in two dimensions (events' value and k), where the grid prunes: second half against first."""
    ev = events_halves(spark, sf).dropna(subset=EV)
    train, val = (neighbors.as_vector(ev.where(F.col("split") == s), "event_id", EV) for s in ("first", "second"))
    nb = neighbors.knn(train, val, 10, "euclidean")
    return nb.select("q_key", "rank", "n_key", _r("distance").alias("distance"))


QUERIES["knn_events"] = q_knn_events


def q_class_copies(spark, sf):
    """Whole copies of each label's rows in the ratio of the class weights."""
    from tessera.operators import learners
    lab = _t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return learners.class_replication(lab, "label", learners.balanced_copies(lab, "label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_copies"))


QUERIES["class_copies"] = q_class_copies


DIMS = 64
NOISE = 0.01            # embedding readings nearer to 0 than this count as missing


def embedding_columns(spark, sf) -> DataFrame:
    """Embeddings as 64 columns ``d00`` .. ``d63``, readings below the noise floor NULL, and the label."""
    def reading(k):
        x = F.col("embedding")[k].cast("double")
        return F.when(F.abs(x) >= NOISE, x).alias(f"d{k:02d}")
    return _t(spark, sf, "embeddings").select("vec_id", "label", *[reading(k) for k in range(DIMS)])


def q_corr_wide(spark, sf):
    """All 2,016 pairs of the embedding dimensions, pairwise complete, in one scan."""
    from tessera.operators import gram
    return gram.corr_wide(embedding_columns(spark, sf), [f"d{k:02d}" for k in range(DIMS)])


def q_corr_wide_with_label(spark, sf):
    from tessera.operators import gram
    return gram.corr_wide_with_label(embedding_columns(spark, sf), [f"d{k:02d}" for k in range(DIMS)], "label")


QUERIES.update({"corr_wide": q_corr_wide, "corr_wide_with_label": q_corr_wide_with_label})


# the scoring chain with given models: the weights are inputs of the query
CHAIN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHAIN_IMPUTERS = {"l_tax": (["l_quantity", "l_extendedprice"], [0.0004, 1e-7], 0.025),
                  "l_discount": (["l_quantity", "l_tax"], [0.0005, 0.25], 0.03)}
CHAIN_SCALER = {"l_quantity": (1.0, 50.0), "l_extendedprice": (900.0, 105000.0), "l_discount": (0.01, 0.1), "l_tax": (0.01, 0.08)}
CHAIN_BASE = [("net", "probability", [0.75, -1.5, 2.0, -0.5], -0.25), ("margin_a", "decision", [1.25, -0.75, 0.5, 1.0], -0.875),
              ("margin_b", "decision", [-0.5, 1.5, -1.25, 2.0], -0.5)]
CHAIN_RANGES = {"margin_a": (-1.25, 1.5), "margin_b": (-2.0, 2.25)}
CHAIN_CENTERS = [[0.25, 0.25, 0.5, 0.5, 0.4, 0.3, 0.4], [0.75, 0.5, 0.5, 0.5, 0.6, 0.7, 0.6]]
CHAIN_META = ([0.5, -0.25, 1.0, -1.0, 2.0, 1.5, -1.75, 0.5, -0.5], -0.75)


def chain(spark, sf):
    """Line items with a return label and the artifacts of the given models."""
    from tessera.operators.learners import given_linear
    from tessera.plans import stacking
    df = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"), *CHAIN)
    cfg = stacking.StackConfig(features=CHAIN, key="l_orderkey", label="label", zero_missing=["l_discount", "l_tax"], required=[],
                               impute_specs=[{"target": t, "features": f} for t, (f, _, _) in CHAIN_IMPUTERS.items()])
    art = stacking.Artifacts(cfg, imputers={t: imp.LinearImputer(*v) for t, v in CHAIN_IMPUTERS.items()}, scaler=CHAIN_SCALER,
                             base=[given_linear(n, k, CHAIN, w, b, cfg.key) for n, k, w, b in CHAIN_BASE],
                             score_ranges=CHAIN_RANGES, centers=CHAIN_CENTERS)
    art.meta = given_linear("meta", "probability", art.meta_features, *CHAIN_META, cfg.key)
    return df, art


def _scored_chain(spark, sf, mode):
    from tessera.plans import stacking
    out = stacking.score(*chain(spark, sf), mode)
    return out.select("l_orderkey", "l_linenumber", *[_r(c).alias(c) for c in [n for n, *_ in CHAIN_BASE] + ["u0", "u1", "p_meta"]],
                      "pred", "l_tax_imputed", "l_discount_imputed")


def q_score_chain_batch(spark, sf):
    """Raw rows to the meta class: zeros as missing, chained imputers, scaling, base scores over the batch's range, memberships, meta."""
    return _scored_chain(spark, sf, "batch")


def q_score_chain_fitted(spark, sf):
    """The same chain with stored score ranges, clamped to 0..1: each row by itself."""
    return _scored_chain(spark, sf, "fitted")


def q_score_chain_metrics(spark, sf):
    """Metrics of every base learner and the meta model on raw rows, one aggregate over the long form."""
    from tessera.plans import stacking
    return stacking.evaluate(*chain(spark, sf), "fitted", raw=True)


QUERIES.update({"score_chain_batch": q_score_chain_batch, "score_chain_fitted": q_score_chain_fitted,
                "score_chain_metrics": q_score_chain_metrics})
