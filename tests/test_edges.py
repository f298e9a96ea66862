"""One row for each trap of typing, imputation, limits, rules and risk."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from assayer.functions.numeric import clip, mentions, rounded, same_text, strict_timestamp
from assayer.operators import pipeline, precision, profile
from assayer.sources.results import NUMBERS, TEXT, typed, write_csv
from assayer.sources.results import read_results as read

COLUMNS = ["row_id", *TEXT, "ANALYSED_DATE", *NUMBERS]
DAY = "2024-05-01 10:00:00"


def results(spark, *rows):
    """Typed results from dicts; what a dict leaves out is missing."""
    base = {"ANALYTICAL_TYPE": "Blank", "JOB_CODE": "J", "ANALYTE_CODE": "K", "ANALYSED_DATE": DAY}
    made = [tuple(None if (v := {**base, "row_id": i, **r}.get(c)) is None else str(v) for c in COLUMNS) for i, r in enumerate(rows)]
    return typed(spark.createDataFrame(made, ", ".join(f"{c} string" for c in COLUMNS)))


def by_id(df):
    return {r["row_id"]: r for r in df.collect()}


def test_missing_tokens_and_junk(spark):
    words = ["NA", "N/A", "nan", "null", ""]
    got = by_id(pipeline.normalise(results(spark, *[{"ANALYTE_CODE": w} for w in words])))
    assert {r["Analyte"] for r in got.values()} == {"Unknown"}
    texts = ["<0.5", "1,000", "1d", "1.0F", "0x10", "NaN", "inf", " 12 ", "1e3", "-43.7"]
    got = by_id(results(spark, *[{"NUMERIC_FINAL_VALUE": t} for t in texts]))
    assert [got[i]["NUMERIC_FINAL_VALUE"] for i in range(10)] == [None] * 7 + [12.0, 1000.0, -43.7]
    keep = typed(spark.createDataFrame([("NA",)], "ANALYTE_CODE string"), {"ANALYTE_CODE": ("",)}).first()
    assert keep["ANALYTE_CODE"] == "NA"


def test_bad_date_counts_in_medians_but_goes(spark):
    df = results(spark, {"NUMERIC_FINAL_VALUE": 10, "ANALYSED_DATE": "not a date"}, {"NUMERIC_FINAL_VALUE": 20})
    out = by_id(pipeline.prepare(df))
    assert list(out) == [1] and out[1]["ExpectedValue"] == 15.0


def test_expected_value_cascade(spark):
    df = results(
        spark,
        {"NUMERIC_FINAL_VALUE": 1, "INTERNAL_TARGET_VALUE": 9, "PARENT_NUMERIC_FINAL_VALUE": 8},
        {"NUMERIC_FINAL_VALUE": 2, "PARENT_NUMERIC_FINAL_VALUE": 8},
        {"NUMERIC_FINAL_VALUE": 6},
        {"ANALYTICAL_TYPE": "Standard"},
        {"ANALYTICAL_TYPE": "Standard", "ANALYTE_CODE": "ZN"},
    )
    out = by_id(pipeline.impute_expected(pipeline.normalise(df)))
    assert [out[i]["ExpectedValue"] for i in range(5)] == [9.0, 8.0, 2.0, 2.0, 2.0]


def test_limits_and_flags(spark):
    df = results(
        spark,
        {"NUMERIC_FINAL_VALUE": 5, "INTERNAL_TARGET_VALUE": 0},
        {"NUMERIC_FINAL_VALUE": -10, "INTERNAL_TARGET_VALUE": -10},
        {"NUMERIC_FINAL_VALUE": 5, "INTERNAL_TARGET_VALUE": 5, "INTERNAL_MIN_VALUE": 5},
        {"NUMERIC_FINAL_VALUE": 100, "INTERNAL_TARGET_VALUE": 100, "PRECISION_STATUS": "IgnoreFailure"},
        {"NUMERIC_FINAL_VALUE": 100, "INTERNAL_TARGET_VALUE": 100, "STANDARD_STATUS": "a WARNING"},
        {"NUMERIC_FINAL_VALUE": 100, "INTERNAL_TARGET_VALUE": 100},
        {"NUMERIC_FINAL_VALUE": 91, "INTERNAL_TARGET_VALUE": 100},
    )
    out = by_id(pipeline.prepare(df).transform(pipeline.deviation_features).transform(pipeline.traffic_light))
    assert (out[0]["LowerLimit"], out[0]["UpperLimit"], out[0]["RuleFlag"], out[0]["DeviationPct"]) == (0.0, 0.0, "Red", 0.0)
    assert math.isclose(out[1]["LowerLimit"], -9.0) and math.isclose(out[1]["UpperLimit"], -11.0) and out[1]["RuleFlag"] == "Red"
    assert (out[2]["LowerLimitSource"], out[2]["UpperLimitSource"]) == ("Real", "Proxy") and out[2]["RuleFlag"] == "Yellow"
    assert [out[i]["RuleFlag"] for i in (3, 4, 5, 6)] == ["Red", "Yellow", "Green", "Yellow"]
    assert [out[i]["RuleFlagScore"] for i in (3, 4, 5)] == [2, 1, 0]


def test_relative_differences(spark):
    df = results(spark, {"ANALYTICAL_TYPE": " duplicate ", "NUMERIC_FINAL_VALUE": 5, "PARENT_NUMERIC_FINAL_VALUE": -5}, {"ANALYTICAL_TYPE": "Duplicate", "NUMERIC_FINAL_VALUE": -5, "PARENT_NUMERIC_FINAL_VALUE": -6})
    pairs = precision.of_type(df, "duplicate")
    assert pairs.count() == 2
    b, c = by_id(precision.pair_measures(pairs)), by_id(precision.signed_rpd(pairs))
    a = by_id(pipeline.prepare(df).transform(pipeline.deviation_features))
    assert a[0]["RPD"] is b[0]["RPD"] is c[0]["RPD"] is None
    assert math.isclose(a[1]["RPD"], 200 / 11) and b[1]["RPD"] == -18.18 and math.isclose(c[1]["RPD"], -200 / 11)
    assert c[1]["LOG_MEAN"] is None
    assert a[0]["SampleType"] == " duplicate " and a[1]["SampleType"] == "Duplicate samples"


def test_recovery_and_risk_levels(spark):
    df = results(spark, {"ANALYTICAL_TYPE": "MatrixSpike", "NUMERIC_FINAL_VALUE": 40, "INTERNAL_TARGET_VALUE": 50})
    row = pipeline.assess(df).first()
    assert row["RecoveryPct"] == 80.0
    assert row["RiskScore"] == 20 / 40 * 30 + 3.75 + 15
    levels = spark.createDataFrame([(x,) for x in (30.0, 30.01, 60.0, 60.01, 100.0, 100.5, None)], "s double").select(pipeline.risk_level(F.col("s"))).collect()
    assert [r[0] for r in levels] == ["Low", "Medium", "Medium", "High", "High", None, None]
    summary = {r["RiskLevel"]: (r["Count"], r["Percent"]) for r in pipeline.risk_summary(pipeline.assess(df)).collect()}
    assert summary == {"Low": (0, 0.0), "Medium": (1, 100.0), "High": (0, 0.0)}


def test_rounding_and_text(spark):
    row = spark.range(1).select(rounded(F.lit(0.545)).alias("a"), rounded(F.lit(-0.001)).alias("b"), clip(F.lit(None).cast("double"), 0, 1).alias("c"), same_text(F.lit("\tDuplicate\n"), "duplicate").alias("d"), mentions(F.lit(None).cast("string"), "x").alias("e")).first()
    assert row["a"] == 0.55 and math.copysign(1, row["b"]) == 1 and row["c"] is None and row["d"] is True and row["e"] is False


def test_strict_dates_raise(spark):
    with pytest.raises(Exception, match="CAST|cast|malformed"):
        spark.createDataFrame([("no",)], "t string").select(strict_timestamp(F.col("t"))).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    assert [r["n"] for r in profile.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sum(r["n"] for r in profile.histogram(same, "x", 4).collect()) == 2
    assert sum(r["n"] for r in profile.histogram(df.filter("x > 99"), "x", 4).collect()) == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a b", "1.5", DAY), ("2", "NA", "<3", "?")], "row_id string, ANALYTE_CODE string, NUMERIC_FINAL_VALUE string, ANALYSED_DATE string")
    write_csv(df, str(tmp_path / "out"), single_file=True)
    got = by_id(read(spark, str(tmp_path / "out"), df.columns))
    assert got[1]["ANALYTE_CODE"] == "a b" and got[1]["NUMERIC_FINAL_VALUE"] == 1.5 and str(got[1]["ANALYSED_DATE"]) == DAY
    assert tuple(got[2])[1:] == (None, None, None)


def test_empty_table(spark):
    df = results(spark, {"NUMERIC_FINAL_VALUE": 1}).filter("row_id > 5")
    assert pipeline.assess(df).count() == 0
    assert [r["Count"] for r in pipeline.risk_summary(pipeline.assess(df)).collect()] == [0, 0, 0]
