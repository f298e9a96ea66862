"""The registered QC queries over the event table in the shape of a result export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.numeric import clip, finite, in_years, mentions, ratio, rounded, same_text, strict_timestamp, stripped, to_double, to_timestamp
from assayer.functions.order import places
from assayer.functions.quantiles import medians
from assayer.functions.shared import cut, shared_folder
from assayer.operators import pipeline, precision, profile
from assayer.operators.clusters import KMeansRestarts
from assayer.operators.forest import IsolationForest
from assayer.operators.stages import MedianImputer
from assayer.sources.exports import read_export
from assayer.sources.fixture import edge_results, qc_results
from assayer.sources.layer import publish, read_layer, save_bucketed
from assayer.sources.results import read_results, write_csv

COUNTED = ["Value", "ExpectedValue", "LowerLimit", "UpperLimit"]


def _r(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


def _results(spark: SparkSession, d: str) -> DataFrame:
    return qc_results(spark, d)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.prepare(qc_results(spark, d))


def _complete(spark: SparkSession, d: str) -> DataFrame:
    """Rows with date and value, for what needs no imputed column."""
    return pipeline.drop_incomplete(pipeline.normalise(qc_results(spark, d)))


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).transform(pipeline.traffic_light)


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.assess(qc_results(spark, d))


def _pairs(spark: SparkSession, d: str, kind: str = "duplicate") -> DataFrame:
    return precision.of_type(qc_results(spark, d), kind)


def _analyte_pairs(spark: SparkSession, d: str) -> DataFrame:
    return precision.signed_rpd(precision.of_analyte(_pairs(spark, d), "click"))


# the pipeline


def qc_normalised(spark, d):
    return pipeline.normalise(_results(spark, d))


def qc_expected_value(spark, d):
    return _r(pipeline.impute_expected(pipeline.normalise(_results(spark, d))).select("row_id", "ExpectedValue"), ["ExpectedValue"])


def qc_limits(spark, d):
    columns = ["ExpectedValue", "LowerLimit", "UpperLimit", "WarningLower", "WarningUpper"]
    return _r(_prepared(spark, d).select("row_id", *columns, "LowerLimitSource", "UpperLimitSource"), columns)


def qc_rule_flags(spark, d):
    return _ruled(spark, d).select("row_id", "SampleType", "RuleFlag", "RuleFlagScore")


def qc_rule_summary(spark, d):
    return profile.value_counts(_ruled(spark, d), "RuleFlag")


def qc_features(spark, d):
    columns = ["Deviation", "DeviationPct", "RPD", "RecoveryPct"]
    return _r(pipeline.deviation_features(_prepared(spark, d)).select("row_id", *columns), columns)


def qc_rolling(spark, d):
    return _r(pipeline.rolling_features(_complete(spark, d)).select("row_id", "RollingMean", "RollingStd"), ["RollingMean", "RollingStd"])


def qc_risk_scores(spark, d):
    return _assessed(spark, d).select("row_id", "SampleID", "SampleType", "Analyte", "RuleFlag", "RiskScore", "RiskLevel")


def qc_risk_summary(spark, d):
    return pipeline.risk_summary(_assessed(spark, d))


def qc_top10_risk(spark, d):
    return pipeline.top_risk(_assessed(spark, d))


def qc_risk_by_sample_type(spark, d):
    return _assessed(spark, d).groupBy("SampleType", "RiskLevel").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("RiskScore"), 4).alias("mean_score"))


def feature_imputed(spark, d):
    return _r(pipeline.imputed_features(cut(_assessed(spark, d).select("row_id", *pipeline.FEATURES))), list(pipeline.FEATURES))


def qc_edge_rows(spark, d):
    """The whole pipeline over results with missing dates and values, negative targets and warning limits of their own."""
    out = pipeline.assess(edge_results(spark, d))
    columns = ["ExpectedValue", "LowerLimit", "UpperLimit", "WarningLower", "WarningUpper", "DeviationPct", "RollingMean"]
    return _r(out.select("row_id", *columns, "RuleFlag", "RiskScore", "RiskLevel"), columns)


# precision


def dup_extract(spark, d):
    return _pairs(spark, d)


def rep_extract(spark, d):
    return _pairs(spark, d, "replicate")


def dup_model(spark, d):
    return precision.pair_measures(_pairs(spark, d))


def rep_model(spark, d):
    return precision.pair_measures(_pairs(spark, d, "replicate"))


def dup_signed_rpd(spark, d):
    return _r(precision.signed_rpd(_pairs(spark, d)).select("row_id", "ABS_DIFF", "MEAN_CONC", "RPD"), ["ABS_DIFF", "MEAN_CONC", "RPD"])


def analyte_subset(spark, d):
    return precision.of_analyte(_pairs(spark, d), "click")


def log_mean_features(spark, d):
    return _r(_analyte_pairs(spark, d).filter(precision.usable()).select("row_id", "RPD", "LOG_MEAN"), ["RPD", "LOG_MEAN"])


def excluded_rows(spark, d):
    return precision.excluded_rows(_analyte_pairs(spark, d))


def standardised_features(spark, d):
    z = profile.standardise(_analyte_pairs(spark, d).filter(precision.usable()).select("row_id", "RPD", "LOG_MEAN"), ["RPD", "LOG_MEAN"])
    return _r(z.select("row_id", "RPD_z", "LOG_MEAN_z"), ["RPD_z", "LOG_MEAN_z"], 5)


def profile_by_flag(spark, d):
    return precision.group_profile(_ruled(spark, d), "RuleFlag", ["Value", "ExpectedValue"], 5)


def status_by_flag(spark, d):
    return precision.contingency(_ruled(spark, d), "RuleFlag", "PrecisionStatus")


# profiles


def missing_profile_2dp(spark, d):
    return profile.missing(_results(spark, d))


def missing_profile_1dp(spark, d):
    return profile.missing(_results(spark, d), 1)


def missing_ranked(spark, d):
    # rows come in no order to a reader that sorts them anew, so the place is a column
    rank = F.row_number().over(Window.orderBy(F.desc("MissingCount"), "column_name"))  # one row for each column of the table
    return profile.missing(_results(spark, d)).select("column_name", "MissingCount", rank.alias("place"))


def describe_values(spark, d):
    return profile.describe(cut(_prepared(spark, d).select(*COUNTED)), COUNTED)  # imputed once, read twice


def numeric_columns_describe(spark, d):
    df = _results(spark, d)
    return profile.describe(df, [c for c in profile.numeric_columns(df) if "WARNING" not in c], 4)


def sample_type_counts(spark, d):
    return profile.value_counts(_complete(spark, d), "SampleType")


def analyte_counts(spark, d):
    return profile.value_counts(_results(spark, d), "ANALYTE_CODE")


def status_counts_with_null(spark, d):
    return profile.value_counts(_results(spark, d), "PRECISION_STATUS", with_null=True)


def hist_30(spark, d):
    return profile.histogram(_complete(spark, d), "Value", 30)


def hist_100(spark, d):
    return profile.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", 100)


def box_stats(spark, d):
    return profile.box_stats(spark.read.parquet(f"{d}/part.parquet"), ["p_retailprice", "p_size"])


def box_stats_results(spark, d):
    df = _results(spark, d)
    return profile.box_stats(df, profile.numeric_columns(df))


def _of_2024(spark, d, kind):
    df = _results(spark, d)
    return df.filter((F.col("ANALYTICAL_TYPE") == kind) & in_years(F.col("ANALYSED_DATE"), [2024]))


def hist_100_blank(spark, d):
    return profile.histogram(_of_2024(spark, d, "Blank"), "NUMERIC_FINAL_VALUE", 100)


def hist_100_standard(spark, d):
    return profile.histogram(_of_2024(spark, d, "Standard"), "NUMERIC_FINAL_VALUE", 100)


def identity_extent(spark, d):
    return profile.identity_extent(_pairs(spark, d), "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE")


def date_range(spark, d):
    return _results(spark, d).agg(F.min("ANALYSED_DATE").alias("first"), F.max("ANALYSED_DATE").alias("last"))


def value_diff(spark, d):
    return _r(_results(spark, d).select("row_id", (F.col("NUMERIC_FINAL_VALUE") - F.col("INTERNAL_TARGET_VALUE")).alias("value_diff")), ["value_diff"])


def minmax_norm(spark, d):
    return _r(profile.min_max(_results(spark, d).select("row_id", "NUMERIC_FINAL_VALUE"), "NUMERIC_FINAL_VALUE", "norm").select("row_id", "norm"), ["norm"])


# exploration


def year_filter_blank(spark, d):
    return profile.drill_down(_results(spark, d), "Blank", [2024])


def year_filter_standard(spark, d):
    return profile.drill_down(_results(spark, d), "Standard", [2024])


def user_drilldown(spark, d):
    return profile.drill_down(_results(spark, d), "Blank", [2024], user=5)


def user_analyte_drilldown(spark, d):
    return profile.drill_down(_results(spark, d), "Standard", [2024], user=5, analyte="click")


def common_users(spark, d):
    df = _results(spark, d)
    return profile.common(df.filter("ANALYTICAL_TYPE = 'Blank'"), df.filter("ANALYTICAL_TYPE = 'Standard'"), "ANALYSED_BY_USER_ID")


def common_users_by_analyte(spark, d):
    df = precision.of_analyte(_results(spark, d), "click")
    return profile.common(df.filter("ANALYTICAL_TYPE = 'Blank'"), df.filter("ANALYTICAL_TYPE = 'Standard'"), "ANALYSED_BY_USER_ID")


# models


def _scaled_pairs(spark, d):
    """Pairs of the analyte; both features are standardised over the rows that have both, and null elsewhere."""
    ok = precision.usable()
    features = {f"{c}_z": F.when(ok, F.col(c)) for c in ("RPD", "LOG_MEAN")}
    rows = cut(_analyte_pairs(spark, d).withColumns(features))
    return profile.standardise(rows, list(features)).drop(*features).withColumnsRenamed({f"{c}_z": c for c in features})


def _clustered(spark, d):
    pairs = _scaled_pairs(spark, d)
    return KMeansRestarts(["RPD_z", "LOG_MEAN_z"]).fit(pairs).transform(pairs)


def kmeans_clusters(spark, d):
    """Every pair of the analyte with its cluster; rows without features keep none."""
    return _r(_clustered(spark, d).select("row_id", "RPD", "LOG_MEAN", "CLUSTER"), ["RPD", "LOG_MEAN"])


def cluster_counts(spark, d):
    """Rows of each cluster, and of none."""
    return profile.value_counts(_clustered(spark, d), "CLUSTER", with_null=True)


def cluster_profile(spark, d):
    return precision.group_profile(_clustered(spark, d), "CLUSTER", ["RPD", "MEAN_VALUE", "LOG_MEAN", "ABS_DIFF"])


def cluster_by_status(spark, d):
    return precision.contingency(_clustered(spark, d), "CLUSTER", "PRECISION_STATUS")


def _scored(spark, d, more: tuple[str, ...] = ()):
    """Scores of all assessed rows, which are computed once; `more` names columns of theirs to keep. Scores are added to the rows that
    they belong to, so nothing is joined back."""
    kept = {c: f"kept_{c}" for c in more}
    df = cut(_assessed(spark, d).select("row_id", *pipeline.FEATURES, *[F.col(c).alias(k) for c, k in kept.items()]))
    filled = MedianImputer(list(pipeline.FEATURES)).fit(df).transform(df)
    scored = IsolationForest(list(pipeline.FEATURES), trees=250).fit_scored(filled)[1]
    return scored.select("row_id", "IForestScore", "IForestAnomaly", *[F.col(k).alias(c) for c, k in kept.items()])


def iforest_scores(spark, d):
    return _r(profile.min_max(_scored(spark, d), "IForestScore", "IForestScoreNorm"), ["IForestScore", "IForestScoreNorm"])


def anomaly_counts(spark, d):
    return profile.value_counts(_scored(spark, d), "IForestAnomaly")


def anomalies_by_sample_type(spark, d):
    return _scored(spark, d, ("SampleType",)).filter("IForestAnomaly").groupBy("SampleType").agg(F.count(F.lit(1)).alias("AnomalyCount"))


def value_trend(spark, d):
    return _scored(spark, d, ("AnalysisDate", "Value")).select("row_id", "AnalysisDate", "Value", "IForestAnomaly")


def top10_with_anomaly(spark, d):
    """The shortlist of highest risk with the model's verdict, nine columns."""
    shown = ("SampleID", "SampleType", "Analyte", "AnalysisDate", "Value", "RuleFlag", "RiskScore", "RiskLevel")
    return _scored(spark, d, shown).orderBy(F.desc_nulls_last("RiskScore"), "row_id").limit(10).select(*shown, "IForestAnomaly")


def _strange_pairs(spark, d):
    """Pairs of the analyte with ANOMALY_SCORE -1 or 1; rows without features keep null."""
    out = IsolationForest(["RPD_z", "LOG_MEAN_z"]).fit_scored(_clustered(spark, d))[1]
    return out.withColumn("ANOMALY_SCORE", F.when(F.col("IForestAnomaly"), -1).when(~F.col("IForestAnomaly"), 1))


def anomaly_score_counts(spark, d):
    return profile.value_counts(_strange_pairs(spark, d), "ANOMALY_SCORE", with_null=True)


def anomaly_by_status(spark, d):
    return precision.contingency(_strange_pairs(spark, d), "ANOMALY_SCORE", "PRECISION_STATUS")


def anomaly_list(spark, d):
    shown = ("row_id", "JOB_CODE", "ANALYTE_CODE", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE", "ABS_DIFF", "MEAN_VALUE", "RPD", "LOG_MEAN", "PRECISION_STATUS", "CLUSTER", "ANOMALY_SCORE")
    return _strange_pairs(spark, d).filter("ANOMALY_SCORE = -1").select(*shown).transform(_r, ["ABS_DIFF", "MEAN_VALUE", "RPD", "LOG_MEAN"]).orderBy(F.desc_nulls_last("RPD"), "row_id")


# single operators


def op_csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    df = _results(spark, d).select("row_id", "JOB_CODE", "ANALYTE_CODE", "ANALYTICAL_TYPE", "ANALYSED_DATE", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE")
    header = df.columns
    write_csv(df.withColumn("ANALYSED_DATE", F.date_format("ANALYSED_DATE", "yyyy-MM-dd HH:mm:ss.SSSSSS")), path)
    return read_results(spark, path, header, ["row_id", "JOB_CODE", "ANALYTE_CODE", "ANALYSED_DATE", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE"])


def op_preview(spark, d):
    return _results(spark, d).orderBy("row_id").limit(10).select("row_id", "ANALYTE_CODE", "NUMERIC_FINAL_VALUE")


def op_shape(spark, d):
    df = _results(spark, d)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def op_schema_info(spark, d):
    return profile.non_null_counts(_results(spark, d).select("row_id", "JOB_CODE", "ANALYTE_CODE", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE", "STANDARD_STATUS"))


def op_project_drop_reorder(spark, d):
    return _results(spark, d).drop("UNIT_CODE", "PRECISION_STATUS").select(F.col("NUMERIC_FINAL_VALUE").alias("value"), F.col("ANALYTE_CODE").alias("analyte"), "row_id")


def op_predicates(spark, d):
    v, p = F.col("NUMERIC_FINAL_VALUE"), F.col("PARENT_NUMERIC_FINAL_VALUE")
    df = _results(spark, d).filter(((v < 5) | (v > 90) | p.isNull()) & F.col("ANALYTE_CODE").isNotNull()).dropna(subset=["ANALYSED_DATE", "NUMERIC_FINAL_VALUE"])
    return df.withColumn("paired", p.isNotNull()).filter(~F.col("paired")).select("row_id", "NUMERIC_FINAL_VALUE")


def op_conditionals(spark, d):
    p = F.col("PARENT_NUMERIC_FINAL_VALUE")
    return _results(spark, d).select("row_id", F.when(p > 50, "high").otherwise("low").alias("side"), F.nullif(p, F.lit(0.0)).alias("safe"), rounded(ratio(F.col("NUMERIC_FINAL_VALUE"), p), 6).alias("share"))


def op_casts(spark, d):
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "<").otherwise(""), F.col("value").cast("string"), F.when(F.col("event_id") % 5 == 0, "d").otherwise(""))
    day = F.when(F.col("event_id") % 4 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", to_double(text).alias("number"), to_timestamp(day).alias("day"), F.col("value").cast("int").alias("whole"), F.col("event_id").cast("string").alias("id_text"))


def op_strict_timestamp(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", strict_timestamp(text).alias("read_back"))


def op_finite(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit("Infinity").cast("double")).when(F.col("event_id") % 3 == 1, F.lit("NaN").cast("double")).otherwise(F.col("value"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", finite(odd).alias("kept"))


def op_text_codes(spark, d):
    """Instrument codes with leading zeros go through CSV as text, and a token of missing values may be a code."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    code = F.when(F.col("row_id") % 10 == 0, "NA").otherwise(F.lpad(F.col("ANALYSED_BY_USER_ID").cast("string"), 6, "0"))
    df = _results(spark, d).select("row_id", code.alias("INSTRUMENT_ID"), "NUMERIC_FINAL_VALUE")
    write_csv(df, path)
    return read_results(spark, path, df.columns, ["row_id", "INSTRUMENT_ID"], {"INSTRUMENT_ID": ("",)})


def op_date_parts(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def op_math(spark, d):
    v, p = F.col("NUMERIC_FINAL_VALUE"), F.col("PARENT_NUMERIC_FINAL_VALUE")
    gap = v - p
    return _results(spark, d).select("row_id", rounded(F.abs(gap), 6).alias("gap"), rounded(clip(v, 10, 40), 6).alias("clipped"), rounded(F.greatest(v - 10, F.lit(0.0)), 6).alias("over"), rounded(v, 2).alias("cents"))


def op_strings(spark, d):
    s = F.concat(F.lit(" \t"), F.col("event_type"), F.lit("\n "))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", stripped(s).alias("clean"), F.concat_ws("-", F.col("event_type"), F.col("event_id").cast("string")).alias("tag"), same_text(s, "CLICK").alias("is_click"), mentions(F.col("event_type"), "IC").alias("has_ic"))


def op_scalar_aggs(spark, d):
    v = F.col("NUMERIC_FINAL_VALUE")
    return _results(spark, d).agg(rounded(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(F.col("PARENT_NUMERIC_FINAL_VALUE").isNull()).alias("missing"))


def op_distinct(spark, d):
    return _results(spark, d).select("ANALYTE_CODE").distinct()


def op_group_size(spark, d):
    return _results(spark, d).groupBy("ANALYTICAL_TYPE").agg(F.count(F.lit(1)).alias("n"))


def op_partition_median(spark, d):
    df = pipeline.normalise(_results(spark, d)).select("row_id", "Analyte", "SampleType", "Value")
    return _r(df.join(medians(df, ["Analyte", "SampleType"], "Value", "middle"), ["Analyte", "SampleType"], "left").select("row_id", "middle"), ["middle"])


def op_sort_date(spark, d):
    # the place within an analyte, bucket by bucket, so that no sort gathers the table or a hot analyte
    rows = _complete(spark, d).select("row_id", "Analyte", "AnalysisDate")
    return places(rows, "Analyte", ["AnalysisDate", "row_id"], "place").select("row_id", "Analyte", "place")


def op_sort_desc(spark, d):
    w = Window.orderBy(F.desc_nulls_last("PARENT_NUMERIC_FINAL_VALUE"), "row_id")
    top = _results(spark, d).orderBy(F.desc_nulls_last("PARENT_NUMERIC_FINAL_VALUE"), "row_id").limit(20)
    return top.select("row_id", "PARENT_NUMERIC_FINAL_VALUE", F.row_number().over(w).alias("place"))


def op_rowid_writeback(spark, d):
    """Which pairs have features, written back by row id: both tables lie in the same buckets, so the join moves no row."""
    folder = f"{shared_folder(spark)}/writeback-{uuid.uuid4().hex}"
    pairs = _analyte_pairs(spark, d)
    every = save_bucketed(pairs.select("row_id"), f"{folder}/pairs", "row_id", 8)
    flagged = save_bucketed(pairs.filter(precision.usable()).select("row_id", F.lit(True).alias("has_features")), f"{folder}/flags", "row_id", 8)
    return every.join(flagged, "row_id", "left")


# exports and the typed layer


def _mixed_export(spark, d):
    """The event table as an export of many files with two orders of columns, values of mixed kinds, and lines with a value too many."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    i = F.col("event_id")
    lines = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        F.when(i % 50 == 7, F.concat(i.cast("string"), F.lit(",extra"))).otherwise(i.cast("string")).alias("LOT"),
        F.col("event_type").alias("ANALYTE_CODE"),
        F.when(i % 11 == 0, "NA").when(i % 13 == 0, F.concat(F.lit("<"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")).alias("NUMERIC_FINAL_VALUE"),
        F.when(i % 97 == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).otherwise(F.col("user_id").cast("string")).alias("SHARE"),
        F.when(i % 3 == 0, "true").otherwise("false").alias("OK"),
        F.date_format("ts", "yyyy-MM-dd").alias("SEEN"),
        F.when(i % 89 == 5, "repeat").otherwise((i % 7).cast("string")).alias("REMARK"),
    )
    orders = ("LOT", "ANALYTE_CODE", "NUMERIC_FINAL_VALUE", "SHARE", "OK", "SEEN", "REMARK"), ("REMARK", "SEEN", "LOT", "OK", "NUMERIC_FINAL_VALUE", "ANALYTE_CODE", "SHARE")
    for k, order in enumerate(orders):
        line = F.concat_ws(",", *order).alias(",".join(order))  # one column to the writer, so that it quotes nothing
        lines.filter(i % 2 == k).orderBy("event_id").select(line).write.option("header", True).option("sep", "\x01").csv(f"{folder}/{k}")
    return read_export(spark, [f"{folder}/{k}" for k in range(len(orders))])


def export_rows(spark, d):
    """Readable lines with inferred types, numbered in file order."""
    return _mixed_export(spark, d).rows


def export_types(spark, d):
    """The type of each column from all its values in all files."""
    return spark.createDataFrame(list(_mixed_export(spark, d).types.items()), "column_name string, type string")


def export_unreadable(spark, d):
    """Lines with a wrong number of values, by their number in file order."""
    return _mixed_export(spark, d).unreadable.select("row_id", "line")


def layer_by_year(spark, d):
    """Results published by year, one year of them anew, and two years read back."""
    path = f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}"
    later = F.make_ym_interval((F.col("row_id") % 3).cast("int"), F.lit(0))
    results = _results(spark, d).select("row_id", "ANALYTE_CODE", (F.col("ANALYSED_DATE") + later).alias("ANALYSED_DATE"), "NUMERIC_FINAL_VALUE")
    publish(results, path)
    publish(results.filter((F.col("row_id") % 3 == 1) & (F.col("row_id") % 2 == 0)).withColumn("NUMERIC_FINAL_VALUE", F.col("NUMERIC_FINAL_VALUE") * 2), path)
    return read_layer(spark, path, [2025, 2026]).select("row_id", "ANALYTE_CODE", "ANALYSED_DATE", "NUMERIC_FINAL_VALUE", "analysed_year")


# chart data


def chart_parent_vs_dup(spark, d):
    return _pairs(spark, d).select("row_id", "PARENT_NUMERIC_FINAL_VALUE", "NUMERIC_FINAL_VALUE")


def chart_rpd_hist(spark, d):
    return profile.histogram(precision.pair_measures(_pairs(spark, d)), "RPD", 30)


def chart_clusters(spark, d):
    return _r(_clustered(spark, d).select("row_id", "LOG_MEAN", "RPD", "CLUSTER"), ["LOG_MEAN", "RPD"])
