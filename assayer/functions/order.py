"""Windows and numbers over ordered rows that never gather a whole group in one task.

Groups with more than ROWS rows are cut into ranges of their order, as many as their counts ask for: along the first column of the
order where it varies, along the next one inside a single value of it, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.shared import cut, small_side

#: Rows that a task may order at once, and parts that one round cuts a range into.
ROWS, PARTS = 1_000_000, 64


def _number(df: DataFrame, column: str) -> Column:
    """The column as a number in the same order."""
    return (F.col(column).cast("timestamp") if df.schema[column].dataType.typeName().startswith("timestamp") else F.col(column)).cast("double")


def ranges(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add `__range`, an array that ascends with the order within a group and that ROWS rows share, or a few more.

    Each round counts all ranges and cuts those that hold too many at quantiles of their first column that varies; a value that is
    itself such a quantile becomes a range of its own, and is cut along the next column in the next round. Rows that agree in the
    whole order stay together. Key and order are not null; order columns are numbers or times."""
    rows = df.withColumns({"__range": F.array().cast("array<int>"), **{f"__o{i}": _number(df, c) for i, c in enumerate(order)}})
    shares = F.array(*[F.lit((i + 1) / (PARTS + 1)) for i in range(PARTS)])
    while True:
        stats = [F.count(F.lit(1)).alias("n")]
        for i in range(len(order)):
            stats += [(F.min(f"__o{i}") < F.max(f"__o{i}")).alias(f"v{i}"), F.percentile_approx(f"__o{i}", shares, F.lit(1_000)).alias(f"e{i}")]
        which = F.coalesce(*[F.when(F.col(f"v{i}"), F.lit(i)) for i in range(len(order))])
        edges = F.array_distinct(F.get(F.array(*[F.col(f"e{i}") for i in range(len(order))]), F.col("which")))
        full = cut(rows.groupBy(key, "__range").agg(*stats).filter(F.col("n") > ROWS).withColumn("which", which).filter("which IS NOT NULL").select(key, "__range", "which", edges.alias("edges")))
        if full.isEmpty():
            return rows.drop(*[f"__o{i}" for i in range(len(order))])
        value = F.get(F.array(*[F.col(f"__o{i}") for i in range(len(order))]), F.col("which"))
        part = F.size(F.filter("edges", lambda e: e < F.col("__at"))) + F.size(F.filter("edges", lambda e: e <= F.col("__at")))
        joined = rows.join(small_side(full), [key, "__range"], "left").withColumn("__at", value)
        rows = joined.withColumn("__range", F.concat("__range", F.array(F.when(F.col("which").isNull(), 0).otherwise(part)))).drop("which", "edges", "__at")


def rolling(df: DataFrame, key: str, order: list[str], value: str, width: int, out: dict[str, Column]) -> DataFrame:
    """Add aggregates of the last `width` rows of a group, the row itself included, in the order of `order` (unique within a group).

    `out` maps names to aggregates over the column `value`. A range of a group is given the last rows of the ranges before
    it, so windows are whole although groups are cut. Keys and order are not null."""
    kept, carried = df.columns, list(dict.fromkeys([*order, value]))
    rows = ranges(df, key, order)
    last = Window.partitionBy(key, "__range").orderBy(*[F.desc(c) for c in order])
    # the planner keeps `width` rows of a range in each task before they move
    tails = rows.select(key, "__range", *carried).withColumn("__back", F.row_number().over(last)).filter(F.col("__back") < width)
    earlier = Window.partitionBy(key).orderBy("__range", *order).rowsBetween(-(width - 1), -1)
    handed = tails.select(key, "__range", "__back", F.count(F.lit(1)).over(Window.partitionBy(key, "__range")).alias("__size"), F.collect_list(F.struct(*carried)).over(earlier).alias("__rows"))
    halo = handed.filter(F.col("__back") == F.col("__size")).select(key, "__range", F.explode("__rows").alias("__r")).select(key, "__range", *[F.col(f"__r.{c}").alias(c) for c in carried], F.lit(True).alias("__halo"))
    both = rows.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    frame = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(-(width - 1), 0)
    return both.withColumns({k: c.over(frame) for k, c in out.items()}).filter(~F.col("__halo")).select(*kept, *out)


def places(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 1 in the order of `order` (unique within a group), range by range. Keys and order are not null."""
    kept = df.columns
    rows = ranges(df, key, order)
    sizes = rows.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__range")  # one row for each range
    before = sizes.select(key, "__range", (F.sum("__n").over(earlier) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    return rows.join(before, [key, "__range"]).withColumn(name, (own + F.col("__before")).cast("int")).select(*kept, name)
