"""Result exports: schemas, lenient reading of CSV, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assayer.functions.numeric import NA_TOKENS, known, to_double, to_timestamp

TEXT = ("ANALYTICAL_TYPE", "JOB_CODE", "ANALYTE_CODE", "STANDARD_STATUS", "PRECISION_STATUS", "UNIT_CODE", "INSTRUMENT_ID", "ANALYSED_BY_USER_ID")
NUMBERS = (
    "NUMERIC_FINAL_VALUE", "INTERNAL_TARGET_VALUE", "INTERNAL_MIN_VALUE", "INTERNAL_MAX_VALUE", "INTERNAL_MIN_WARNING_VALUE", "INTERNAL_MAX_WARNING_VALUE",
    "PARENT_NUMERIC_FINAL_VALUE", "LIM_REP_VALUE", "LIM_REP_DUP_VALUE", "STAT_DL_VALUE", "STAT_DL_DUP_VALUE",
)
TIMES = ("ANALYSED_DATE",)
ROW_ID = "row_id"


def raw_schema(columns: list[str]) -> StructType:
    """Every column as text: junk in a column never changes its type."""
    return StructType([StructField(c, StringType()) for c in columns])


def read_results(spark: SparkSession, path: str, header: list[str], columns: list[str] | None = None, na_tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A CSV export with this header line, pruned to `columns` if given, with typed values.

    Tokens for missing values become null (`na_tokens` may name other tokens for a column), numbers and times that can't be
    read become null. If the file has no `row_id`, rows are numbered in no particular order."""
    raw = spark.read.schema(raw_schema(header)).option("header", True).csv(path)
    raw = raw.select(*columns) if columns else raw
    return typed(raw, na_tokens)


def typed(raw: DataFrame, na_tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    tokens = na_tokens or {}
    out = {}
    for c in raw.columns:
        text = known(F.col(c), tokens.get(c, NA_TOKENS))
        out[c] = to_double(text) if c in NUMBERS else to_timestamp(text) if c in TIMES else text.try_cast("long") if c == ROW_ID else text
    made = raw.select(*[x.alias(c) for c, x in out.items()])
    return made if ROW_ID in raw.columns else made.withColumn(ROW_ID, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Replace a folder of CSV files; one file only where the table is known to be tiny."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
