"""Duplicate and replicate precision: pairs stand on one row, so no join is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.numeric import log_mean, ratio, rounded, same_text
from assayer.functions.quantiles import exact_quantiles

# The columns of exports and reports, in their order.
PAIR_COLUMNS = ("NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE", "ANALYSED_DATE", "ANALYTE_CODE", "STAT_DL_VALUE", "STAT_DL_DUP_VALUE", "LIM_REP_VALUE", "LIM_REP_DUP_VALUE", "UNIT_CODE", "PRECISION_STATUS")
MODEL_COLUMNS = ("ANALYTE_CODE", "ANALYSED_DATE", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE", "ABS_DIFF", "MEAN_CONC", "RPD", "PRECISION_STATUS", "STAT_DL_VALUE", "STAT_DL_DUP_VALUE", "LIM_REP_VALUE", "LIM_REP_DUP_VALUE", "UNIT_CODE")


def of_type(results: DataFrame, kind: str) -> DataFrame:
    """Rows of a sample type whatever its case and outer white space, with the pair columns, their id and job."""
    return results.filter(same_text(F.col("ANALYTICAL_TYPE"), kind)).select("row_id", "JOB_CODE", *PAIR_COLUMNS)


def pair_measures(pairs: DataFrame) -> DataFrame:
    """Absolute difference, mean, and signed relative difference rounded to two places; null where the mean is 0."""
    v, p = F.col("NUMERIC_FINAL_VALUE"), F.col("PARENT_NUMERIC_FINAL_VALUE")
    diff, mean = F.abs(v - p), (v + p) / 2
    return pairs.withColumns({"ABS_DIFF": diff, "MEAN_CONC": mean, "RPD": F.when(v + p != 0, rounded(ratio(diff, mean) * 100))}).select("row_id", *MODEL_COLUMNS)


def signed_rpd(pairs: DataFrame) -> DataFrame:
    """The same measures unrounded, and the logarithm of positive means."""
    v, p = F.col("NUMERIC_FINAL_VALUE"), F.col("PARENT_NUMERIC_FINAL_VALUE")
    diff, mean = F.abs(v - p), (v + p) / 2
    return pairs.withColumns({"ABS_DIFF": diff, "MEAN_CONC": mean, "MEAN_VALUE": mean, "RPD": F.when(mean != 0, ratio(diff, mean) * 100), "LOG_MEAN": log_mean(mean)})


def of_analyte(results: DataFrame, analyte: str) -> DataFrame:
    return results.filter(F.col("ANALYTE_CODE") == analyte)


def usable():
    """Whether a row has both model features."""
    return F.col("RPD").isNotNull() & F.col("LOG_MEAN").isNotNull()


def excluded_rows(pairs: DataFrame) -> DataFrame:
    ok = F.count_if(usable())
    return pairs.agg(F.count(F.lit(1)).alias("total"), ok.alias("usable"), (F.count(F.lit(1)) - ok).alias("excluded"))


def group_profile(df: DataFrame, key: str, columns: list[str], places: int = 6) -> DataFrame:
    """Count, mean, median, least and greatest of each column by group; rows without a group are left out. Two readings of the table."""
    r = lambda x: rounded(x, places)
    moments = [a for c in columns for a in (F.count(c).alias(f"{c}_count"), r(F.avg(c)).alias(f"{c}_mean"), r(F.min(c)).alias(f"{c}_min"), r(F.max(c)).alias(f"{c}_max"))]
    found = exact_quantiles(df.filter(F.col(key).isNotNull()), columns, [0.5], [key], more=moments)
    middle = found[1].select(key, *[r(F.get(c, F.lit(0))).alias(f"{c}_median") for c in columns])
    return found.base.join(middle, key, "left")


def contingency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of both together; rows without either are left out."""
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
