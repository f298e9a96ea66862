"""Exact quantiles and windows over ranges against pandas and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import order, quantiles
from assayer.functions.order import places, ranges, rolling
from assayer.functions.quantiles import exact_quantiles, medians


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 3_000
    frame = pd.DataFrame({"id": np.arange(n), "k": rng.choice(["hot", "a", "b"], n, p=[0.8, 0.19, 0.01]), "j": rng.choice(["p", "q"], n), "x": np.round(rng.lognormal(size=n), 2), "y": rng.choice([0.0, 1.0, 2.0], n, p=[0.7, 0.2, 0.1])})
    frame["z"] = np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n))
    frame["t"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 900, n), unit="s")
    return frame


def spark_table(spark, frame):
    return spark.createDataFrame(frame).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


# (points, accuracy, values held, groups of one task): one round, and several rounds of narrowing
GRIDS = [(200, 1_000, 50_000, 2_000), (200, 1_000, 50_000, 0), (40, 400, 300, 2_000), (40, 400, 30, 0)]


@pytest.mark.parametrize("grid", GRIDS)
def test_quantiles_of_all_levels(spark, table, grid, monkeypatch):
    for name, x in zip(("POINTS", "ACCURACY", "HELD", "GROUPS"), grid, strict=True):
        monkeypatch.setattr(quantiles, name, x)
    shares = [0.0, 0.25, 0.95]
    columns = ["x", "y", "z"]
    found = exact_quantiles(spark_table(spark, table), columns, shares, ["k", "j"], [2, 1, 0], [F.avg("x").alias("mean")])
    for level, keys in ((2, ["k", "j"]), (1, ["k"])):
        got = {tuple(r[k] for k in keys): r for r in found[level].collect()}
        groups = list(table.groupby(keys))
        assert len(got) == len(groups)
        for k, g in groups:
            for c in columns:
                assert (got[k][c] is None and g[c].isna().all()) or np.allclose(got[k][c], g[c].quantile(shares)), (level, k, c)
    row = found[0].first()
    assert all(np.allclose(row[c], table[c].quantile(shares)) for c in columns)
    means = {(r["k"], r["j"]): r["mean"] for r in found.base.collect()}
    assert all(np.isclose(means[k], g["x"].mean()) for k, g in table.groupby(["k", "j"]))


def test_heavy_values_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 100)
    rng = np.random.default_rng(5)
    for x in (np.r_[np.zeros(9_000), rng.normal(size=1_000)], np.full(500, 7.0), np.arange(20_000.0), np.r_[rng.normal(size=3), np.ones(4_000), np.full(4_000, 2.0)]):
        df = spark.createDataFrame(pd.DataFrame({"x": rng.permutation(x)})).repartition(13)
        got = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9])[0].first()["x"]
        assert np.allclose(got, np.quantile(x, [0.1, 0.5, 0.9]))


def test_quantiles_without_values(spark):
    empty = spark.createDataFrame([], "k string, x double, y int")
    assert exact_quantiles(empty, ["x", "y"], [0.5])[0].first() in (None, (None, None))
    assert exact_quantiles(empty, ["x"], [0.5], ["k"])[1].count() == 0
    some = spark.createDataFrame([("a", None, 1), ("b", 2.0, None)], "k string, x double, y int")
    got = {r["k"]: (r["x"], r["y"]) for r in exact_quantiles(some, ["x", "y"], [0.5], ["k"])[1].collect()}
    assert got == {"a": (None, [1.0]), "b": ([2.0], None)}


def test_median_of_equal_and_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 7.0), ("c", None), ("d", 1.0), ("d", 2.0)], "k string, x double")
    got = {r["k"]: r["m"] for r in medians(df, ["k"], "x", "m").collect()}
    assert got == {"a": 1.0, "b": 7.0, "d": 1.5}


@pytest.mark.parametrize("most", [1_000_000, 200, 20])
def test_rolling(spark, table, most, monkeypatch):
    monkeypatch.setattr(order, "ROWS", most)
    df = spark.createDataFrame(table[["id", "k", "x"]]).join(spark.createDataFrame(table[["id", "t"]]).select("id", F.col("t").cast("timestamp_ntz").alias("t")), "id")
    got = rolling(df, "k", ["t", "id"], "x", 7, {"mean": F.avg("x"), "std": F.stddev_samp("x"), "n": F.count("x")}).toPandas().set_index("id").sort_index()
    want = table.sort_values(["t", "id"])
    mean = want.groupby("k")["x"].transform(lambda s: s.rolling(7, min_periods=1).mean())
    std = want.groupby("k")["x"].transform(lambda s: s.rolling(7, min_periods=2).std())
    assert len(got) == len(table)
    assert np.allclose(got["mean"], mean.sort_index())
    assert np.allclose(got["std"], std.sort_index(), equal_nan=True)


def test_rolling_first_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 10)], "k string, i int, x double").withColumn("t", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("i"))).cast("timestamp_ntz"))
    got = {r["i"]: r for r in rolling(df, "k", ["t", "i"], "x", 7, {"mean": F.avg("x"), "std": F.stddev_samp("x")}).collect()}
    assert (got[7]["mean"], got[8]["mean"], got[1]["std"]) == (4.0, 5.0, None) and round(got[2]["std"], 4) == 0.7071


def test_one_analyte_at_one_time_is_cut(spark, monkeypatch):
    """A hot group whose rows nearly all share one time is cut by row id, in order, and no range holds much more than its share."""
    monkeypatch.setattr(order, "ROWS", 5_000)
    time = F.when(F.col("id") % 1_000 == 0, F.col("id")).otherwise(500_000)
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.timestamp_seconds(time)).cast("timestamp_ntz").alias("t"), "id")
    sizes = ranges(df, "k", ["t", "id"]).groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("__range").collect()
    assert max(r["n"] for r in sizes) <= 2 * 5_000 and sum(r["n"] for r in sizes) == 200_000
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:], strict=False))
    rolled = rolling(df, "k", ["t", "id"], "id", 7, {"first": F.min("id"), "n": F.count("id")})
    numbered = places(rolled, "k", ["t", "id"], "place")
    assert numbered.filter("n < 7").count() == 6 and numbered.filter("n <> least(7, place)").count() == 0
    assert numbered.select("place").distinct().count() == 200_000


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_places_count_through_ranges(spark, table, most, monkeypatch):
    monkeypatch.setattr(order, "ROWS", most)
    df = spark.createDataFrame(table[["id", "k", "t"]])
    got = places(df, "k", ["t", "id"], "place").toPandas().set_index("id").sort_index()["place"]
    want = table.sort_values(["t", "id"]).groupby("k").cumcount() + 1
    assert got.tolist() == want.sort_index().tolist()


def test_rows_equal_in_the_whole_order_stay_together(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 10)
    df = spark.range(100).select(F.lit("k").alias("k"), F.lit(1).alias("a"))
    assert ranges(df, "k", ["a"]).select("__range").distinct().count() == 1
