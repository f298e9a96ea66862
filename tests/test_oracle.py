"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from assayer.plans import catalog

SF = "/root/testdata/sf0.001"
CHECKED = ["qc_normalised", "qc_expected_value", "qc_limits", "qc_rolling", "qc_risk_scores", "qc_risk_summary", "qc_top10_risk", "feature_imputed", "dup_model", "standardised_features", "profile_by_flag", "missing_ranked", "numeric_columns_describe", "hist_100", "box_stats", "user_drilldown", "op_csv_roundtrip", "op_casts", "op_conditionals", "qc_edge_rows", "box_stats_results", "hist_100_blank", "hist_100_standard", "op_strict_timestamp", "op_finite", "op_text_codes", "op_sort_date", "hist_30", "sample_type_counts", "export_rows", "export_types", "export_unreadable", "layer_by_year", "op_rowid_writeback", "kmeans_clusters", "cluster_profile", "cluster_by_status", "iforest_scores", "top10_with_anomaly", "anomaly_by_status", "anomaly_list"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "NaT":
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
