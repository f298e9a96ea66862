"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.shared import cut as cut
from assayer.functions.shared import shared_folder as shared_folder

#: Parts that a hot key is dealt into before rows of one key meet.
SALTS = 64
_MIX = np.random.default_rng(5).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an array expression once for each row and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text: what stands between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_share(*values: Column) -> Column:
    """A place in [0, 1) by hash, in steps of 2^-52: fine enough that a small share of a very large table never rounds to no row."""
    h = F.xxhash64(*values)
    return (F.pmod(h, F.lit(1 << 20)) * F.lit(float(1 << 32)) + F.pmod(F.shiftrightunsigned(h, 20), F.lit(1 << 32))) / F.lit(float(1 << 52))


def first_of_group(df: DataFrame, keys: list[str], order: Column, first: str, count: str, repeated_only: bool = False) -> DataFrame:
    """Attach to every row the least `order` value of the rows with the same keys, and how many they are.

    With `repeated_only`, rows whose keys occur once are left out.
    Keys may hold a third of all rows: rows meet by (keys, salt) first, only one row for each salt meets by keys, and
    the way back is a join by (keys, salt) again. Null keys group together."""
    salt = "__salt"
    named = [f"__key{i}" for i in range(len(keys))]
    salted = df.withColumn("__order", order).withColumn(salt, F.pmod(F.xxhash64("__order"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(salt).alias("__s")).agg(F.min("__order").alias("__f"), F.count(F.lit(1)).alias("__n"))
    whole = part.groupBy(*[F.col(n).alias(f"{n}w") for n in named]).agg(F.min("__f").alias(first), F.sum("__n").alias(count))
    whole = whole.filter(F.col(count) > 1) if repeated_only else whole
    same = F.lit(True)
    for n in named:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}w"))
    back = part.join(whole, same).select(*named, "__s", first, count)
    on = F.col(salt) == F.col("__s")
    for k, n in zip(keys, named, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return salted.join(back, on).drop(*named, "__s", salt, "__order")


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint ranges of bytes or code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    values = (codes[within + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)) * (_MIX[within % 4096] + (within // 4096).astype(np.uint64) * np.uint64(2))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return (total[at[1:]] - total[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)
