"""Invariants of the models: planted outliers, determinism, cost, path lengths, and saving and loading."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from assayer.operators import profile
from assayer.operators.clusters import KMeansModel, KMeansRestarts
from assayer.operators.forest import PLACES, SAMPLE, UNIT, IsolationForest, IsolationForestModel, Scorer, average_path, depth_limit, grow, samples
from assayer.operators.stages import MedianImputer, Standardiser


def forest(df, columns, **more):
    return IsolationForest(columns, "id", **more).fit_scored(df)[1]


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(1_000, 2)), columns=["a", "b"])
    frame.loc[:9] = rng.normal(size=(10, 2)) + 9
    frame["id"] = np.arange(1_000)
    df = spark.createDataFrame(frame)
    one = forest(df.repartition(2), ["a", "b"]).toPandas().sort_values("id")
    two = forest(df.repartition(5), ["a", "b"]).toPandas().sort_values("id")
    assert np.array_equal(one["IForestScore"], two["IForestScore"])
    assert set(one.nlargest(10, "IForestScore")["id"]) == set(range(10))
    assert one["IForestAnomaly"].sum() == 50
    assert one["IForestScore"].between(0, 1).all()


def test_kmeans_separates_and_numbers_clusters(spark):
    rows = [(i, float(10 * (i % 3)) + 0.01 * (i // 3), None if i == 29 else float("inf") if i == 28 else 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = KMeansRestarts(["x", "y"], "id").fit(df).transform(df).collect()
    assert all(r["CLUSTER"] == (None if r["id"] in (28, 29) else r["id"] % 3) for r in got)


def test_models_without_rows(spark):
    df = spark.createDataFrame([(1, None)], "id int, x double")
    for stage in (KMeansRestarts(["x"], "id"), IsolationForest(["x"], "id"), MedianImputer(["x"]), Standardiser(["x"])):
        for table in (df, df.limit(0)):
            out = stage.fit(table).transform(df).first()
            assert all(out[c] in (None, 0.0) for c in out.asDict() if c not in ("id",))


def test_standardise_and_min_max(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    for got in (profile.standardise(df, ["a", "b"]).collect(), Standardiser(["a", "b"]).fit(df).transform(df).collect()):
        assert [r["a_z"] for r in got] == [-1.0, 1.0, None] and [r["b_z"] for r in got] == [0.0, 0.0, 0.0]
    assert profile.min_max(df, "a", "n").agg(F.max("n")).first()[0] <= 1.0


def test_missing_features_keep_null_scores(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else float("inf") if i == 4 else 1.0 * i) for i in range(60)], "id long, a double, b double")
    got = {r["id"]: r for r in forest(df, ["a", "b"]).collect()}
    assert len(got) == 60 and all((got[i]["IForestScore"] is None and got[i]["IForestAnomaly"] is None) == (i in (3, 4)) for i in got)
    empty = forest(df.filter("id < 0"), ["a", "b"])
    assert empty.count() == 0 and "IForestAnomaly" in empty.columns


def test_path_lengths_by_plain_recursion():
    """Lengths of a forest equal those of walking every tree node by node, and leaves hold the depth and what their rows would add."""
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(200, 3)), np.repeat(rng.normal(size=(1, 3)), 20, axis=0)]), 6)
    limit = depth_limit(64)
    trees = [{n[0]: n for n in grow(x[rng.choice(len(x), 64, replace=False)], 5, k, limit)} for k in range(12)]

    def walk(tree, row, node=1, steps=0):
        _, feature, cut, length = tree[node]
        return (length, steps) if feature is None else walk(tree, row, 2 * node + int(row[feature] >= cut), steps + 1)

    nodes = pd.DataFrame([(k, *n) for k, t in enumerate(trees) for n in t.values()], columns=["tree", "node", "feature", "cut", "length"])
    assert Scorer(nodes, 12, limit).lengths(x).tolist() == [sum(walk(t, row)[0] for t in trees) for row in x]
    for tree in trees:
        for row in x[:50]:
            length, steps = walk(tree, row)
            assert length >= steps * UNIT and steps <= limit
    harmonic = lambda n: 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    assert [average_path(n) for n in (0, 1, 2)] == [0, 0, UNIT] and all(abs(average_path(n) / UNIT - harmonic(n)) < 1e-6 for n in (3, 64, 256))


def test_every_row_can_be_drawn(spark):
    df = spark.range(20_000).withColumn("a", F.col("id").cast("double"))
    drawn = samples(df, "id", ["a"], 100, 42, 20_000).toPandas()
    sizes = drawn.groupby("tree").size()
    assert len(sizes) == 100 and sizes.min() >= SAMPLE and drawn["place"].between(0, 1).all()
    assert drawn["id"].nunique() > 15_000 and not drawn.duplicated(["tree", "id"]).any()
    assert abs(drawn["id"].mean() - 10_000) < 200


def test_kmeans_cost_is_the_least_of_all_splits(spark):
    """Eight points on a line: the best of all assignments to two clusters is found."""
    x = [0.0, 0.2, 0.5, 4.0, 4.1, 9.0, 9.3, 9.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double")
    got = [r["CLUSTER"] for r in KMeansRestarts(["x"], "id", k=2).fit(df).transform(df).orderBy("id").collect()]
    cost = lambda own: sum(((g := np.array([v for v, o in zip(x, own, strict=True) if o == c])) - g.mean()) @ (g - g.mean()) for c in (0, 1) if c in own)
    assert np.isclose(cost(got), min(cost([i >> k & 1 for k in range(8)]) for i in range(1, 255)))


def test_kmeans_reads_the_table_once_a_round(spark):
    """However many runs there are, a round is one job over the rows, whatever the partitions, and partitions don't change centres."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "x": rng.normal(size=500), "y": rng.normal(size=500)}))
    one = KMeansRestarts(["x", "y"], "id").fit(df.repartition(3)).state
    assert one == KMeansRestarts(["x", "y"], "id").fit(df.repartition(7)).state and len(one["centres"]) == 3


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(600), "x": rng.normal(size=600), "y": rng.lognormal(size=600)})
    frame.loc[::50, "x"] = np.nan
    return spark.createDataFrame(frame)


def test_saved_pipeline_scores_as_before(spark, readings, tmp_path):
    stages = [MedianImputer(["x", "y"]), Standardiser(["x", "y"]), KMeansRestarts(["x_z", "y_z"], "id"), IsolationForest(["x", "y"], "id", trees=20)]
    fitted = Pipeline(stages=stages).fit(readings)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    second = readings.select((F.col("id") + 1_000).alias("id"), (F.col("x") * 3).alias("x"), (F.col("y") + 1).alias("y"))
    for table in (readings, second):
        before, after = (sorted(map(repr, m.transform(table).collect())) for m in (fitted, loaded))
        assert before == after and "IForestAnomaly=True" in "".join(after)
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    assert Pipeline.load(str(tmp_path / "plan")).fit(readings).stages[3].state == fitted.stages[3].state


def test_saved_models_score_a_stream(spark, readings, tmp_path):
    fitted = Pipeline(stages=[MedianImputer(["x", "y"]), IsolationForest(["x", "y"], "id", trees=10)]).fit(readings)
    fitted.save(str(tmp_path / "model"))
    readings.write.parquet(str(tmp_path / "in"))
    stream = PipelineModel.load(str(tmp_path / "model")).transform(spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(repr, fitted.transform(readings).collect()))


def test_single_models_load(readings, tmp_path):
    KMeansRestarts(["y"], "id").fit(readings).save(str(tmp_path / "k"))
    IsolationForest(["y"], "id", trees=3).fit(readings).save(str(tmp_path / "f"))
    assert len(KMeansModel.load(str(tmp_path / "k")).state["centres"]) == 3
    model = IsolationForestModel.load(str(tmp_path / "f"))
    assert model.state["size"] == SAMPLE and model.nodes["tree"].nunique() == 3 and PLACES == 1e6
