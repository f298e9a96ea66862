"""Isolation Forest whose every choice is a hash, so that any engine with md5 grows the same trees.

The published method: each tree isolates a sample of the rows by random splits, and rows that are isolated after few splits are
strange. Samples come from hashes of row ids, the split of a node from hashes of (seed, tree, node), and path lengths are whole
millionths, so neither partitions nor the order of adding change a score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasSeed
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.quantiles import exact_quantiles
from assayer.functions.shared import cut
from assayer.operators.stages import FittedModel, SavedEstimator, number

#: Rows of a tree, and how many times that a window of hashes holds on average, so that hardly any tree gets fewer.
SAMPLE, SLACK = 256, 1.4
#: Features are read to six places, path lengths to a millionth of a step.
PLACES, UNIT = 1_000_000.0, 1_000_000
SPAN = float(1 << 52)


def feature(c: str) -> Column:
    return F.rint(number(c) * PLACES) / PLACES + F.lit(0.0)


def average_path(n: int) -> int:
    """Mean depth, in units, at which a search for a missing key ends in a random tree of n keys."""
    if n <= 1:
        return 0
    return UNIT if n == 2 else round((2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n) * UNIT)


def depth_limit(size: int) -> int:
    return math.ceil(math.log2(max(size, 2)))


def samples(df: DataFrame, row_id: str, columns: list[str], trees: int, seed: int, n: int) -> DataFrame:
    """`tree`, `place`, the id and columns of the rows that each tree may draw: some SAMPLE * SLACK of all n rows, chosen by hashes.

    A row's hash is its place on a circle, and a tree takes the rows in its own arc; trees whose arcs would not fit on the circle side by
    side use further hashes. So the work is about one hash a row where the table is large."""
    arc = min(1.0, SAMPLE * SLACK / max(n, 1))
    each = max(1, int(1 / arc))
    place = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)), F.lit(str(k))).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(SPAN)
    picks = df.select(row_id, *columns, F.posexplode(F.array(*[place(k) for k in range(-(-trees // each))])).alias("__round", "__u"))
    slot = F.least(F.floor(F.col("__u") / arc), F.lit(each)).cast("int")
    drawn = picks.withColumn("tree", F.col("__round") * each + slot).filter((slot < each) & (F.col("tree") < trees))
    return drawn.select("tree", (F.col("__u") / arc - slot).alias("place"), row_id, *columns)


def grow(rows: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple[int, int | None, float | None, int | None]]:
    """Nodes of one tree on a sample: number (children of h are 2h and 2h+1), feature and cut of a split, path length of a leaf.

    Of the features that vary in a node the one with the least hash is split, at a hash's place between its extremes."""
    digest = lambda *key: hashlib.md5(":".join(map(str, (seed, tree, *key))).encode()).hexdigest()
    out, todo = [], [(1, rows, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varies = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varies):
            out.append((node, None, None, depth * UNIT + average_path(len(rows))))
            continue
        f = min(varies.tolist(), key=lambda i: digest(node, i))
        at = min(low[f] + (high[f] - low[f]) * ((int(digest(node)[:13], 16) + 1) / SPAN), high[f])
        at = at if at > low[f] else high[f]  # in (low, high], so both sides get rows
        out.append((node, f, float(at), None))
        todo += [(2 * node, rows[rows[:, f] < at], depth + 1), (2 * node + 1, rows[rows[:, f] >= at], depth + 1)]
    return out


class Scorer:
    """Trees as arrays, trees x nodes: feature, cut, left child (right is next) and path length. A leaf is its own left child with an
    endless cut, so that rows stay in it."""

    def __init__(self, nodes: pd.DataFrame, trees: int, limit: int) -> None:
        width = 1 << (limit + 1)
        self.trees, self.limit, self.width = trees, limit, width
        self.feature, self.cut, self.left, self.length = np.zeros(trees * width, np.int64), np.full(trees * width, np.inf), np.arange(trees * width), np.zeros(trees * width, np.int64)
        at = nodes["tree"].to_numpy(np.int64) * width + nodes["node"].to_numpy(np.int64)
        split = nodes["feature"].notna().to_numpy()
        self.feature[at[split]] = nodes["feature"].to_numpy(np.float64)[split].astype(np.int64)
        self.cut[at[split]] = nodes["cut"].to_numpy(np.float64)[split]
        self.left[at[split]] = at[split] + nodes["node"].to_numpy(np.int64)[split]
        self.length[at[~split]] = nodes["length"].to_numpy(np.float64)[~split].astype(np.int64)

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Path lengths of rows without missing values, summed over all trees, in units."""
        out = np.zeros(len(x), np.int64)
        roots = np.arange(self.trees)[:, None] * self.width + 1
        for start in range(0, len(x), 1_000):
            part = x[start : start + 1_000]
            flat, row = part.ravel(), np.arange(len(part)) * part.shape[1]
            at = np.repeat(roots, len(part), axis=1)
            for _ in range(self.limit):
                at = self.left[at] + (flat[row + self.feature[at]] >= self.cut[at])
            out[start : start + 1_000] = self.length[at].sum(axis=0)
        return out


class IsolationForest(SavedEstimator, HasInputCols, HasSeed):
    """Each tree draws SAMPLE rows from all rows by hashes of their ids and is grown in a task of its own. Rows with a missing or
    infinite feature take no part. The limit is the exact quantile of scores that leaves `contamination` of the rows above it."""

    trees = Param(Params._dummy(), "trees", "number of trees", typeConverter=TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of rows that are anomalies", typeConverter=TypeConverters.toFloat)
    idCol = Param(Params._dummy(), "idCol", "column that names a row", typeConverter=TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, id_column: str = "row_id", trees: int = 100, contamination: float = 0.05, seed: int = 42) -> None:
        super().__init__()
        self._set(inputCols=columns or [], idCol=id_column, trees=trees, contamination=contamination, seed=seed)

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        return self.fit_scored(dataset)[0]

    def fit_scored(self, dataset: DataFrame) -> tuple[IsolationForestModel, DataFrame]:
        """The model, and the fitted table with its scores, which the limit needs anyway."""
        columns, row_id, trees, seed = self.getInputCols(), self.getOrDefault("idCol"), self.getOrDefault("trees"), self.getSeed()
        used = dataset.select(F.col(row_id).alias("__id"), *[feature(c).alias(f"f{i}") for i, c in enumerate(columns)]).dropna(subset=[f"f{i}" for i in range(len(columns))])
        names = [f"f{i}" for i in range(len(columns))]
        n = used.count()
        size = min(SAMPLE, n)
        limit = depth_limit(size)

        def tree(group: pd.DataFrame) -> pd.DataFrame:
            k = int(group["tree"].iloc[0])
            rows = group.sort_values(["place", "__id"]).head(SAMPLE)[names].to_numpy(dtype=np.float64)
            return pd.DataFrame([(k, *node) for node in grow(rows, seed, k, limit)], columns=["tree", "node", "feature", "cut", "length"])

        # SAMPLE * 2 nodes a tree at most
        drawn = samples(used, "__id", names, trees, seed, n).groupBy("tree")
        nodes = drawn.applyInPandas(tree, NODES).toPandas() if n else pd.DataFrame({c: [] for c in ("tree", "node", "feature", "cut", "length")})
        model = self._copyValues(IsolationForestModel({"trees": trees, "size": size, "limit": None}))
        model.nodes = nodes
        scored = cut(model.scored(dataset))
        found = exact_quantiles(scored, ["IForestScore"], [1 - self.getOrDefault("contamination")])[0].first()
        model.state["limit"] = found["IForestScore"][0] if found is not None and found["IForestScore"] is not None else None
        return model, model.flagged(scored)


NODES = "tree int, node int, feature int, cut double, length long"


class IsolationForestModel(FittedModel, HasInputCols):
    """Adds IForestScore (higher: stranger) and IForestAnomaly; rows with a missing or infinite feature keep null in both.

    `nodes` is the table of all nodes: tree, node, feature and cut, or path length."""

    nodes: pd.DataFrame

    def tables(self, spark) -> dict[str, DataFrame]:
        whole = lambda x: None if x is None or x != x else int(x)
        rows = [(int(t), int(h), whole(f), None if c is None or c != c else float(c), whole(n)) for t, h, f, c, n in self.nodes.itertuples(index=False)]
        return {"nodes": spark.createDataFrame(rows, NODES)}

    def read_tables(self, spark, path: str) -> None:
        self.nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # as many rows as were fitted: trees times 2 * SAMPLE at most

    def scored(self, dataset: DataFrame) -> DataFrame:
        """With IForestScore alone."""
        columns, size, trees = self.getInputCols(), self.state["size"], self.state["trees"]
        if not size:
            return dataset.withColumn("IForestScore", F.lit(None).cast("double"))
        shared = dataset.sparkSession.sparkContext.broadcast(Scorer(self.nodes, trees, depth_limit(size)))
        ok = F.lit(True)
        for c in columns:
            ok = ok & number(c).isNotNull()

        @F.pandas_udf("long")
        def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(shared.value.lengths(x.fillna(-np.inf).to_numpy(dtype=np.float64)))

        total = lengths(F.struct(*[feature(c).alias(f"f{i}") for i, c in enumerate(columns)]))
        return dataset.withColumn("IForestScore", F.when(ok, F.pow(F.lit(2.0), -(total / F.lit(float(trees * max(average_path(size), 1)))))))

    def flagged(self, scored: DataFrame) -> DataFrame:
        limit = self.state["limit"]
        verdict = F.col("IForestScore") > F.lit(limit) if limit is not None else F.lit(None).cast("boolean")
        return scored.withColumn("IForestAnomaly", verdict)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.flagged(self.scored(dataset))
