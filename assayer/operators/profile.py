"""Profiles of a table, and the data behind its charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from assayer.functions.numeric import in_years, ratio, rounded
from assayer.functions.quantiles import exact_quantiles

WHISKER = 1.5


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("SCHEME_VERSION", "row_id")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def missing(df: DataFrame, places: int = 2) -> DataFrame:
    """Columns with missing values: how many, and their share of all rows in percent. One pass over the table."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("MissingCount")) for c in df.columns])
    long = row.select("__n", F.explode(cells).alias("f")).select("__n", "f.column_name", "f.MissingCount")
    return long.filter("MissingCount > 0").select("column_name", "MissingCount", rounded(ratio(F.col("MissingCount").cast("double"), F.col("__n").cast("double")) * 100, places).alias("MissingPercent"))


def non_null_counts(df: DataFrame) -> DataFrame:
    """Every column with its type and how many values it has."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col(c).alias("non_null")) for c, t in df.dtypes])
    return row.select(F.explode(cells).alias("f")).select("f.*")


def _by_column(row: DataFrame, cells: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each column from one wide row: `column_name` and the given values."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[v.alias(n) for n, v in values.items()]) for c, values in cells.items()])).alias("f")).select("f.*")


def describe(df: DataFrame, columns: list[str], places: int = 2) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each column that has values, from two readings of the table."""
    x = {c: F.col(c).cast("double") for c in columns}
    moments = [a for c in columns for a in (F.count(x[c]).alias(f"n_{c}"), F.avg(x[c]).alias(f"mean_{c}"), F.stddev_samp(x[c]).alias(f"std_{c}"), F.min(x[c]).alias(f"low_{c}"), F.max(x[c]).alias(f"high_{c}"))]
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], more=moments)
    r = lambda c: rounded(c, places)
    cells = {c: {"n": F.col(f"n_{c}"), "mean": r(F.col(f"mean_{c}")), "std": r(F.col(f"std_{c}")), "low": r(F.col(f"low_{c}")), **{f"q{i + 1}": r(F.get(c, F.lit(i))) for i in range(3)}, "high": r(F.col(f"high_{c}"))} for c in columns}
    return _by_column(found.base.join(F.broadcast(found[0]), F.lit(True), "left"), cells).filter("n > 0")


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    rows = df if with_null else df.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, which falls into the last; empty bins count 0.

    Where all values are equal, the range is one wide around them."""
    values = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    span = F.broadcast(values.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("low"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("high")))
    place = F.least(F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)).cast("int")
    counts = values.join(span, F.lit(True)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return every.join(F.broadcast(counts), "bin", "left").join(span, F.lit(True)).select("bin", rounded(F.col("low") + width * F.col("bin"), 6).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and the number of outliers of each column that has
    values, from three readings of the table."""
    quartiles = F.broadcast(exact_quantiles(df, columns, [0.25, 0.5, 0.75])[0].select(*[F.col(c).alias(f"__q_{c}") for c in columns]))
    q = lambda c, i: F.get(f"__q_{c}", F.lit(i))
    aggs = []
    for c in columns:
        x, reach = F.col(c).cast("double"), (q(c, 2) - q(c, 0)) * WHISKER
        inside = (x >= q(c, 0) - reach) & (x <= q(c, 2) + reach)
        aggs += [F.any_value(f"__q_{c}").alias(f"q_{c}"), F.min(F.when(inside, x)).alias(f"low_{c}"), F.max(F.when(inside, x)).alias(f"high_{c}"), F.count_if(~inside).alias(f"out_{c}")]
    r = lambda c: rounded(c, places)
    of = lambda c, i: r(F.get(f"q_{c}", F.lit(i)))
    cells = {c: {"q1": of(c, 0), "med": of(c, 1), "q3": of(c, 2), "whisker_low": r(F.col(f"low_{c}")), "whisker_high": r(F.col(f"high_{c}")), "outliers": F.col(f"out_{c}")} for c in columns}
    return _by_column(df.join(quartiles, F.lit(True)).agg(*aggs), cells).filter("q1 IS NOT NULL")


def identity_extent(df: DataFrame, a: str, b: str) -> DataFrame:
    """Where a line of equal values begins and ends on a chart of two columns."""
    return df.agg(F.least(F.min(a), F.min(b)).alias("low"), F.greatest(F.max(a), F.max(b)).alias("high"))


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale a column to 0..1 over its range."""
    span = F.broadcast(df.agg(F.min(column).alias("__a"), F.max(column).alias("__b")))
    return df.join(span, F.lit(True), "left").withColumn(name, (F.col(column) - F.col("__a")) / (F.col("__b") - F.col("__a") + 1e-9)).drop("__a", "__b")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a column without spread becomes 0. Adds <column>_z."""
    stats = F.broadcast(df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))]))
    z = {f"{c}_z": F.when(F.col(c).isNotNull(), F.coalesce(ratio(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0))) for c in columns}
    return df.join(stats, F.lit(True), "left").withColumns(z).select(*df.columns, *z)


def drill_down(results: DataFrame, kind: str, years: list[int], user: int | str | None = None, analyte: str | None = None) -> DataFrame:
    """Values and targets over time of a sample type, of one user and one analyte if given, in long form."""
    rows = results.filter((F.col("ANALYTICAL_TYPE") == kind) & in_years(F.col("ANALYSED_DATE"), years))
    rows = rows if user is None else rows.filter(F.col("ANALYSED_BY_USER_ID") == F.lit(user))
    rows = rows if analyte is None else rows.filter(F.col("ANALYTE_CODE") == analyte)
    return rows.select("row_id", "ANALYSED_DATE", "NUMERIC_FINAL_VALUE", "INTERNAL_TARGET_VALUE").unpivot(["row_id", "ANALYSED_DATE"], ["NUMERIC_FINAL_VALUE", "INTERNAL_TARGET_VALUE"], "measure", "reading")


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that both have."""
    return a.select(column).intersect(b.select(column))
