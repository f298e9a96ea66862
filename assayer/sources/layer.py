"""The typed layer: results as Parquet by year, published in versions, and tables bucketed by row id for joins without a shuffle.

A publish writes its years into folders of its own and then appends one row for each of them to a manifest; readers follow the
manifest. A write that fails appends nothing, so readers keep what they had, and years that a publish does not hold stay."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.numeric import in_years

YEAR, DATE = "analysed_year", "ANALYSED_DATE"
MANIFEST = "publish_id string, version long, analysed_year int"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(results: DataFrame, path: str) -> int:
    """Replace the years that `results` holds (null: a partition of its own) by its rows, all at once; gives the version.

    One writer at a time. Rows of a year go to as many files as there are tasks with rows of it; sort or repartition before, if that
    matters."""
    spark = results.sparkSession
    version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    publish_id = uuid.uuid4().hex
    folder = f"{path}/data/publish_id={publish_id}"
    results.withColumn(YEAR, F.year(DATE)).write.partitionBy(YEAR).parquet(folder)
    years = spark.read.parquet(folder).select(YEAR).distinct()  # from the partitions' names
    entry = years.select(F.lit(publish_id).alias("publish_id"), F.lit(version).cast("long").alias("version"), F.col(YEAR).cast("int").alias(YEAR))
    entry.coalesce(1).write.mode("append").json(f"{path}/manifest")  # one small file, which appears whole or not at all
    return version


def read_layer(spark: SparkSession, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """The published rows, with their year; only the folders of `years`, if given, and their rows of these years by date."""
    newest = _manifest(spark, path).groupBy(YEAR).agg(F.max_by("publish_id", "version").alias("publish_id")).collect()  # a row a year
    if not newest:
        raise ValueError(f"nothing is published in {path}")
    ids = sorted({r["publish_id"] for r in newest})
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/publish_id={i}" for i in ids])
    of = lambda i: [r[YEAR] for r in newest if r["publish_id"] == i]
    own = F.lit(False)
    for i in ids:
        in_year = F.col(YEAR).isin([y for y in of(i) if y is not None])
        own = own | ((F.col("publish_id") == i) & (in_year | F.col(YEAR).isNull() if None in of(i) else in_year))
    rows = rows.filter(own)
    if years is not None:
        rows = rows.filter(F.col(YEAR).isin(list(years)) & in_years(F.col(DATE), list(years)))
    return rows.drop("publish_id")


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write a table in buckets of `key`, sorted within; what is saved with the same number of buckets joins bucket by bucket."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
