"""Delimited exports read as lines: headers matched by name, rows numbered in file order, types inferred from all values, and lines
that can't be read kept in a table of their own.

A value may hold delimiters and quotes but no line break. Files of one export may have their columns in any order, and columns that
others lack. Blank lines don't count."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.numeric import NA_TOKENS, NUMBER, known, to_double, to_timestamp
from assayer.functions.shared import cut, small_side
from assayer.sources.results import NUMBERS, ROW_ID, TEXT, TIMES

#: Different header lines that the files of one export may have.
HEADERS = 256
BAD = "unreadable_line"

WHOLE = r"^\s*[+-]?[0-9]{1,18}\s*$"
# Words of truth in exports.
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
#: Kinds of a text value, as bits, so that kinds of parts of a table are merged by one `or` in any order.
BOOLEAN, LONG, DOUBLE, TIME, STRING = 1, 2, 4, 8, 16


def kind_of(value: Column) -> Column:
    """The narrowest kind of a text; 0 for a missing one."""
    return (
        F.when(value.isNull(), 0)
        .when(value.isin(list(TRUTH)), BOOLEAN)
        .when(value.rlike(WHOLE), LONG)
        .when(value.rlike(NUMBER), DOUBLE)
        .when(to_timestamp(value).isNotNull(), TIME)
        .otherwise(STRING)
    )


def join_of(kinds: int) -> str:
    """The type that holds all these kinds: whole numbers widen to decimal ones, and anything else mixed is text. A column without
    values is a number, as every missing one is."""
    if kinds & ~(LONG | DOUBLE) == 0:
        return "bigint" if kinds == LONG else "double"
    return {BOOLEAN: "boolean", TIME: "timestamp_ntz"}.get(kinds, "string")


def infer_types(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Types of text columns from all their values, in one aggregate: a kind is a bit, and the bits of a column are or-ed."""
    if not columns:
        return {}
    row = text.agg(*[F.bit_or(kind_of(F.col(c))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return {c: join_of(row[f"k{i}"] or 0) for i, c in enumerate(columns)}


def as_type(text: Column, kind: str) -> Column:
    """A text of this type; null if it is none."""
    if kind == "double":
        return to_double(text)
    return to_timestamp(text) if kind == "timestamp_ntz" else text if kind == "string" else F.trim(text).try_cast(kind)


@dataclass
class Export:
    """`rows`: typed values with row_id; `unreadable`: row_id, file and text of lines whose number of values is not the header's;
    `types`: the type of each column."""

    rows: DataFrame
    unreadable: DataFrame
    types: dict[str, str]


def numbered_lines(spark: SparkSession, paths: str | Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """`value`, `file`, `header` and `row_id` of all lines but headers, and the table of headers by file.

    Rows are numbered 0, 1, 2... by file path and line, whatever the partitions: lines of a file block follow one another in one
    partition, so a block's first number is the number of lines before it, and blocks are few."""
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    meta = F.col("_metadata")
    lines = text.select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block")).filter(F.col("value").rlike(r"\S")).withColumn("at", F.monotonically_increasing_id())
    blocks = cut(lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min_by("value", "at").alias("line")))
    # a row for each block of 128 MB or so
    ordered = blocks.selectExpr("*", "sum(n) OVER (PARTITION BY file ORDER BY block) - n AS before", "first_value(line) OVER (PARTITION BY file ORDER BY block) AS header", "row_number() OVER (PARTITION BY file ORDER BY block) AS k")
    files = blocks.groupBy("file").agg(F.sum("n").alias("lines")).selectExpr("file", "sum(lines - 1) OVER (ORDER BY file) - (lines - 1) AS earlier")
    placed = small_side(cut(ordered.join(files, "file").selectExpr("file", "block", "first", "header", "earlier + before - 1 AS base", "k = 1 AS leads")))
    joined = lines.join(placed, ["file", "block"]).filter(~(F.col("leads") & (F.col("at") == F.col("first"))))
    return joined.select("value", "file", "header", (F.col("base") + F.col("at") - F.col("first")).alias(ROW_ID)), placed.select("file", "header").distinct()


def read_export(spark: SparkSession, paths: str | Iterable[str], columns: Sequence[str] | None = None, na_tokens: dict[str, tuple[str, ...]] | None = None, delimiter: str = ",") -> Export:
    """An export from one or many files, pruned to `columns` if given.

    Tokens for missing values become null (`na_tokens` may name other tokens for a column). Columns that this library knows have
    their types; others take the type that holds all their values in all files. A column that a file lacks is null there. A column
    named row_id, if whole numbers, is the row's number in place of its position."""
    lines, headers = numbered_lines(spark, paths)
    found = [r["header"] for r in headers.select("header").distinct().limit(HEADERS + 1).collect()]
    if len(found) > HEADERS:
        raise ValueError(f"the files have more than {HEADERS} different header lines")
    names = {h: [c.strip().lstrip("﻿") for c in next(csv.reader([h], delimiter=delimiter))] for h in sorted(found)}
    every = list(dict.fromkeys(c for own in names.values() for c in own))
    wanted = [c for c in (columns or every) if c != BAD]
    if missing := [c for c in wanted if c not in every]:
        raise ValueError(f"no file has the columns {missing}")

    def cells(h: str, own: list[str]) -> Column:
        schema = ", ".join(f"`{'c' + str(i)}` string" for i in range(len(own))) + f", `{BAD}` string"
        parsed = F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "sep": delimiter, "quote": '"', "escape": '"'})
        at = {c: i for i, c in enumerate(own)}
        return F.transform(F.array(parsed), lambda p: F.struct(*[(p[f"c{at[c]}"] if c in at else F.lit(None).cast("string")).alias(c) for c in wanted], p[BAD].alias(BAD)))[0]

    parsed = None
    for h, own in names.items():
        parsed = F.when(F.col("header") == h, cells(h, own)) if parsed is None else parsed.when(F.col("header") == h, cells(h, own))
    wide = lines.select(F.col(ROW_ID).alias("__at"), "file", "value", parsed.alias("p")) if parsed is not None else None
    if wide is None:
        empty = spark.createDataFrame([], f"{ROW_ID} long")
        return Export(empty, spark.createDataFrame([], f"{ROW_ID} long, file string, line string"), {})
    unreadable = wide.filter(F.col("p")[BAD].isNotNull()).select(F.col("__at").alias(ROW_ID), "file", F.col("value").alias("line"))
    tokens = na_tokens or {}
    text = wide.filter(F.col("p")[BAD].isNull()).select("__at", *[known(F.col("p")[c], tokens.get(c, NA_TOKENS)).alias(c) for c in wanted])
    fixed = {c: "double" for c in NUMBERS} | {c: "timestamp_ntz" for c in TIMES} | {c: "string" for c in TEXT}
    types = {c: fixed[c] for c in wanted if c in fixed} | infer_types(text, [c for c in wanted if c not in fixed])
    types = {c: types[c] for c in wanted}
    rows = text.select(*([] if types.get(ROW_ID) == "bigint" else [F.col("__at").alias(ROW_ID)]), *[as_type(F.col(c), types[c]).alias(c) for c in wanted if c != ROW_ID or types[c] == "bigint"])
    return Export(rows, unreadable, types)
