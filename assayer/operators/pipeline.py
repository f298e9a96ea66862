"""The QC pipeline: normalise, impute, limits, features, traffic light and risk, each from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.numeric import clip, finite, mentions, ratio, rounded
from assayer.functions.order import rolling
from assayer.functions.quantiles import exact_quantiles
from assayer.functions.shared import cut
from assayer.operators.stages import MedianImputer

# Sample types as exports name them, and as reports do.
SAMPLE_TYPES = {"Replicate": "Duplicate samples", "Duplicate": "Duplicate samples", "Blank": "Blank samples", "Standard": "Standard samples"}
PAIRED, SPIKE = "Duplicate samples", "MatrixSpike"
PROXY, WARNING_SHARE, SMALL, WINDOW = 0.10, 0.10, 1e-9, 7
FEATURES = ("Value", "ExpectedValue", "Deviation", "DeviationPct", "RollingMean", "RollingStd", "RPD", "RecoveryPct", "RuleFlagScore")
RISK_LEVELS = ("Low", "Medium", "High")


def normalise(results: DataFrame) -> DataFrame:
    """One row for each result, under report names; missing codes get defaults, sample types are recoded, and numbers that are not
    finite become missing."""
    job, kind = F.coalesce("JOB_CODE", F.lit("JOB-UNKNOWN")), F.coalesce("ANALYTICAL_TYPE", F.lit("Unknown"))
    recoded = kind
    for k, v in SAMPLE_TYPES.items():
        recoded = F.when(kind == k, v).otherwise(recoded)
    analyte = F.coalesce("ANALYTE_CODE", F.lit("Unknown"))
    return results.select(
        "row_id",
        F.concat_ws("-", job, F.col("row_id").cast("string")).alias("SampleID"),
        recoded.alias("SampleType"),
        F.col("ANALYSED_DATE").alias("AnalysisDate"),
        finite(F.col("NUMERIC_FINAL_VALUE")).alias("Value"),
        finite(F.col("INTERNAL_TARGET_VALUE")).alias("ExpectedValue"),
        finite(F.col("INTERNAL_MIN_VALUE")).alias("LowerLimit"),
        finite(F.col("INTERNAL_MAX_VALUE")).alias("UpperLimit"),
        finite(F.col("INTERNAL_MIN_WARNING_VALUE")).alias("WarningLower"),
        finite(F.col("INTERNAL_MAX_WARNING_VALUE")).alias("WarningUpper"),
        finite(F.col("PARENT_NUMERIC_FINAL_VALUE")).alias("ParentValue"),
        analyte.alias("Analyte"),
        job.alias("JobCode"),
        F.coalesce("STANDARD_STATUS", F.lit("")).alias("StandardStatus"),
        F.coalesce("PRECISION_STATUS", F.lit("")).alias("PrecisionStatus"),
        F.when(recoded == PAIRED, F.concat_ws("-", job, analyte)).alias("DuplicateGroup"),
    )


def impute_expected(df: DataFrame, medians_of: DataFrame | None = None) -> DataFrame:
    """Expected value: target, else parent, else the median value of analyte and sample type, of the analyte, of all rows.

    Medians are those of another table if given: the whole one, where `df` is a part of it with more columns."""
    whole = df if medians_of is None else medians_of
    # medians of all three levels from the same two readings; a row for each analyte and sample type at most
    found = exact_quantiles(whole, ["Value"], [0.5], ["Analyte", "SampleType"], [2, 1, 0])
    by_both, by_one, of_all = (found[level].withColumn("Value", F.get("Value", F.lit(0))).withColumnRenamed("Value", f"__m{level}") for level in (2, 1, 0))
    joined = df.join(by_both, ["Analyte", "SampleType"], "left").join(by_one, "Analyte", "left").join(F.broadcast(of_all), F.lit(True), "left")
    return joined.withColumn("ExpectedValue", F.coalesce("ExpectedValue", "ParentValue", "__m2", "__m1", "__m0")).select(*df.columns)


def derive_limits(df: DataFrame) -> DataFrame:
    """Where limits come from, proxies for those that are missing, and a warning band inside them."""
    low = F.coalesce(F.col("LowerLimit"), F.col("ExpectedValue") * (1 - PROXY))
    high = F.coalesce(F.col("UpperLimit"), F.col("ExpectedValue") * (1 + PROXY))
    source = lambda c: F.when(F.col(c).isNotNull(), "Real").otherwise("Proxy")
    span = (high - low) * WARNING_SHARE
    return df.withColumns(
        {
            "LowerLimitSource": source("LowerLimit"),
            "UpperLimitSource": source("UpperLimit"),
            "LowerLimit": low,
            "UpperLimit": high,
            "WarningLower": F.coalesce(F.col("WarningLower"), low + span),
            "WarningUpper": F.coalesce(F.col("WarningUpper"), high - span),
        }
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["AnalysisDate", "Value"])


def prepare(results: DataFrame) -> DataFrame:
    return drop_incomplete(results.transform(normalise).transform(impute_expected).transform(derive_limits))


def deviation_features(df: DataFrame) -> DataFrame:
    """Deviation, its share of the expected value (0 where there is none), relative difference to the parent, and recovery."""
    v, e, p = F.col("Value"), F.col("ExpectedValue"), F.col("ParentValue")
    mean = F.abs((v + p) / 2)
    return df.withColumns(
        {
            "Deviation": v - e,
            "DeviationPct": F.coalesce(ratio(v - e, e) * 100, F.lit(0.0)),
            "RPD": F.when(p.isNotNull() & (mean > SMALL), ratio(F.abs(v - p), mean) * 100),
            "RecoveryPct": F.when((F.col("SampleType") == SPIKE) & (F.abs(e) > SMALL), ratio(v, e) * 100),
        }
    )


def rolling_features(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of an analyte's last seven values."""
    out = rolling(df, "Analyte", ["AnalysisDate", "row_id"], "Value", WINDOW, {"RollingMean": F.avg("Value"), "RollingStd": F.stddev_samp("Value")})
    return out.withColumn("RollingStd", F.coalesce("RollingStd", F.lit(0.0)))


def traffic_light(df: DataFrame) -> DataFrame:
    """Red beyond a limit or on a failure status, yellow beyond a warning limit or on a warning status, else green; 2, 1, 0."""
    v = F.col("Value")
    status = lambda part: mentions(F.col("StandardStatus"), part) | mentions(F.col("PrecisionStatus"), part)
    red = (v < F.col("LowerLimit")) | (v > F.col("UpperLimit")) | status("Failure")
    yellow = (v < F.col("WarningLower")) | (v > F.col("WarningUpper")) | status("Warning")
    flag = F.when(red, "Red").when(yellow, "Yellow").otherwise("Green")
    return df.withColumn("RuleFlag", flag).withColumn("RuleFlagScore", F.when(F.col("RuleFlag") == "Red", 2).when(F.col("RuleFlag") == "Yellow", 1).otherwise(0))


def risk_level(score):
    return F.when((score > -0.01) & (score <= 30), "Low").when((score > 30) & (score <= 60), "Medium").when((score > 60) & (score <= 100), "High")


def risk_score(df: DataFrame, scale_of: DataFrame | None = None) -> DataFrame:
    """The sum of five capped components, 0 to 100, and its level. `scale_of` may be a cheaper table with the same RollingStd."""
    scale = F.broadcast((df if scale_of is None else scale_of).agg(F.greatest(F.stddev_samp("RollingStd"), F.lit(1.0)).alias("__scale")))
    gap = F.when(F.col("SampleType") == SPIKE, F.abs(F.coalesce("RecoveryPct", F.lit(100.0)) - 100)).otherwise(F.lit(0.0))
    parts = (
        clip(F.abs("DeviationPct"), 0, 40) / 40 * 30
        + clip(F.col("RollingStd") / F.col("__scale"), 0, 3) / 3 * 20
        + clip(F.coalesce("RPD", F.lit(0.0)), 0, 50) / 50 * 20
        + clip(F.greatest(gap - 10, F.lit(0.0)), 0, 40) / 40 * 15
        + F.when(F.col("RuleFlag") == "Red", 15.0).when(F.col("RuleFlag") == "Yellow", 7.5).otherwise(0.0)
    )
    scored = df.join(scale, F.lit(True), "left").withColumn("RiskScore", rounded(parts)).drop("__scale")
    return scored.withColumn("RiskLevel", risk_level(F.col("RiskScore")))


def assess(results: DataFrame) -> DataFrame:
    """All of the above. Windows come before imputation, which they do not need, so that their statistics read the scan alone."""
    base = normalise(results)
    rolled = rolling_features(drop_incomplete(base))
    full = derive_limits(impute_expected(rolled, medians_of=base))
    return full.transform(deviation_features).transform(traffic_light).transform(lambda df: risk_score(df, scale_of=rolled))


def risk_summary(df: DataFrame) -> DataFrame:
    """Count and share of every level, also of those without rows."""
    spark = df.sparkSession
    levels = spark.createDataFrame([(name, i) for i, name in enumerate(RISK_LEVELS)], "RiskLevel string, risk_rank int")
    counts = cut(df.groupBy("RiskLevel").agg(F.count(F.lit(1)).alias("n")))  # a row for each level, read twice
    total = counts.agg(F.sum("n").alias("total"))
    filled = levels.join(counts, "RiskLevel", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return filled.select("RiskLevel", n.alias("Count"), F.coalesce(rounded(ratio(n.cast("double"), F.col("total").cast("double")) * 100), F.lit(0.0)).alias("Percent"), "risk_rank")


def top_risk(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("RiskScore"), "row_id").limit(n).select("SampleID", "SampleType", "Analyte", "AnalysisDate", "Value", "RuleFlag", "RiskScore", "RiskLevel")


def imputed_features(df: DataFrame) -> DataFrame:
    """The model's nine features: missing and infinite ones take their column's median, or 0 where a column has no value at all. The
    table is read twice for the medians, by one aggregate each."""
    return MedianImputer(list(FEATURES)).fit(df).transform(df).select("row_id", *FEATURES)
