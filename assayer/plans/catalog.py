"""The registered queries of the QC library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.plans import model_sql
from assayer.plans import queries as q
from assayer.plans.sql import ORACLES

#: The same tables under the names of the charts that they are drawn as.
CHARTS = {
    "chart_missing_bar": "missing_ranked", "chart_box": "box_stats", "chart_value_hist": "hist_30", "chart_risk_bar": "qc_risk_summary", "chart_top10": "top10_with_anomaly",
    "chart_anomalies_by_type": "anomalies_by_sample_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: getattr(q, k) for k in (*ORACLES, *model_sql.ORACLES)}
    return found | {chart: found[k] for chart, k in CHARTS.items()}


def oracle_sql() -> dict[str, str]:
    found = ORACLES | model_sql.ORACLES
    return found | {chart: found[k] for chart, k in CHARTS.items()}
