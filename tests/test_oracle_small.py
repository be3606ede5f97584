"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans.catalog import QUERIES
from tessera.plans.models import MODEL_QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="driver tables absent")

FAST = ["zero_as_missing_profile", "required_dropna", "iqr_bounds", "outlier_filter", "outlier_filter_split",
        "outlier_counts", "corr_matrix", "corr_with_label", "complete_pairs", "value_counts", "stratified_split",
        "split_proportions", "hash_split", "minmax_fit", "minmax_transform", "class_weights", "conditional_fill",
        "imputed_flags", "knn_chebyshev", "knn_classify", "fcm_memberships", "fcm_centers", "svm_score_minmax",
        "confusion_matrix", "binary_metrics", "classification_report", "log_loss", "best_model_diff",
        "regression_metrics", "overfit_bucket", "domain_violations", "parse_inputs", "scored_export",
        "weighted_union", "fold_assignment", "predefined_split", "outlier_flags", "f1_stabilised",
        "train_val_comparison", "head_rows", "quality_profile", "row_lookup", "score_chain_batch", "score_chain_fitted",
        "score_chain_metrics", "corr_wide", "corr_wide_with_label"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["orders", "lineitem", "events", "documents", "embeddings", "labels"]:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted(map(tuple, pdf.to_numpy().tolist()), key=repr)


def test_every_query_has_oracle_or_is_model():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {*QUERIES, *MODEL_QUERIES} - set(o) <= {"gbt_impute", "base_scores", "stack_train_score"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    mine = E.queries()[name](spark, SF).toPandas()
    ref = con.execute(E.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(ref.columns)
    assert len(mine) == len(ref)
    assert _norm(mine) == _norm(ref)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) == {"column_name", "n_rows", "missing", "missing_pct", "n_outliers"}
