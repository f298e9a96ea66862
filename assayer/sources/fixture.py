"""The event table in the shape of a QC result export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, kind = F.col("event_id"), F.col("event_id") % 5
    null = F.lit(None)
    double = lambda c: c.cast("double")
    sample = F.when(kind == 0, "Blank").when(kind == 1, "Standard").when(kind == 2, "Replicate").when(kind == 3, "Duplicate").otherwise("MatrixSpike")
    pair = kind.isin(2, 3)
    status = lambda c: F.when(i % 13 == 0, "Warning").otherwise("Pass") if c else None
    return e.select(
        i.alias("row_id"),
        F.col("user_id").cast("string").alias("JOB_CODE"),
        F.col("user_id").alias("ANALYSED_BY_USER_ID"),
        F.when(i % 101 != 0, F.col("event_type")).alias("ANALYTE_CODE"),
        sample.alias("ANALYTICAL_TYPE"),
        F.col("ts").cast("timestamp_ntz").alias("ANALYSED_DATE"),
        double(F.col("value")).alias("NUMERIC_FINAL_VALUE"),
        F.when(pair, F.get_json_object("props", "$.k").try_cast("double")).alias("PARENT_NUMERIC_FINAL_VALUE"),
        double(F.when(i % 7 == 0, null).when(kind == 0, 0.0).when(kind == 1, 35.0).when(kind == 4, 50.0)).alias("INTERNAL_TARGET_VALUE"),
        double(F.when(kind == 0, -1.0).when(kind == 1, 5.0)).alias("INTERNAL_MIN_VALUE"),
        double(F.when(kind == 0, 60.0).when(kind == 1, 120.0)).alias("INTERNAL_MAX_VALUE"),
        double(null).alias("INTERNAL_MIN_WARNING_VALUE"),
        double(null).alias("INTERNAL_MAX_WARNING_VALUE"),
        F.when(kind == 1, F.when(i % 17 == 0, "Failure").otherwise(status(True))).alias("STANDARD_STATUS"),
        F.when(pair, F.when(i % 17 == 0, "Failure").when(i % 19 == 0, "IgnoreFailure").otherwise(status(True))).alias("PRECISION_STATUS"),
        double(F.when(pair, 10.0 + 5 * (i % 2))).alias("LIM_REP_VALUE"),
        double(F.when(pair, 15.0)).alias("LIM_REP_DUP_VALUE"),
        double(F.when(pair, 0.025)).alias("STAT_DL_VALUE"),
        double(F.when(pair, 0.05)).alias("STAT_DL_DUP_VALUE"),
        F.lit("MG_KG").alias("UNIT_CODE"),
    )


def edge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results with missing and infinite values, missing dates, negative targets and given warning limits among them."""
    i = F.col("row_id")
    return qc_results(spark, sf_dir).withColumns(
        {
            "ANALYSED_DATE": F.when(i % 23 != 0, F.col("ANALYSED_DATE")),
            "NUMERIC_FINAL_VALUE": F.when(i % 29 == 0, F.when(i % 2 == 0, float("inf")).otherwise(float("nan"))).when(i % 31 != 0, F.col("NUMERIC_FINAL_VALUE")),
            "PARENT_NUMERIC_FINAL_VALUE": F.when(i % 37 == 0, float("-inf")).otherwise(F.col("PARENT_NUMERIC_FINAL_VALUE")),
            "INTERNAL_TARGET_VALUE": F.when(i % 11 == 0, -5.0).otherwise(F.col("INTERNAL_TARGET_VALUE")),
            "INTERNAL_MIN_WARNING_VALUE": F.when(i % 9 == 0, 10.0),
            "INTERNAL_MAX_WARNING_VALUE": F.when(i % 9 == 0, 30.0),
        }
    )
