"""K-means with all restarts in one pass a round."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasSeed
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.shared import cut
from assayer.operators.stages import FittedModel, SavedEstimator, number

#: Steps to a unit of a feature: points are whole numbers of them, so that sums are exact in any order of adding.
STEPS = 1_000_000
#: Rounds, at most; they end where no centre moves.
ROUNDS = 20
#: Rows that a task may add up in a round.
TASK_ROWS = 200_000


def _points(df: DataFrame, columns: list[str]) -> tuple[DataFrame, object]:
    """Rows with `__p`, their features in whole steps; and the condition that all features are there."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & number(c).isNotNull()
    return df.withColumn("__p", F.when(ok, F.array(*[F.rint(number(c) * STEPS).cast("long") for c in columns]))), ok


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each of the restarts (first axis of `centres`) the number of the nearest centre, the first of equals."""
    gap = points[None, :, None, :].astype(np.float64) - centres[:, None, :, :]
    return (gap * gap).sum(axis=-1).argmin(axis=-1)


class KMeansRestarts(SavedEstimator, HasInputCols, HasSeed):
    """The cheapest of several runs of Lloyd's method. A run starts at the k rows whose md5 of (seed, run, row id) is least.

    Each round reads the table once for all runs: a task assigns its rows to the centres of every run and sends one row of sums for
    each centre. Rows with a missing or infinite feature take no part. Clusters are numbered by their centres' order."""

    k = Param(Params._dummy(), "k", "number of clusters", typeConverter=TypeConverters.toInt)
    restarts = Param(Params._dummy(), "restarts", "number of runs", typeConverter=TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column that names a row", typeConverter=TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, id_column: str = "row_id", k: int = 3, restarts: int = 10, seed: int = 42) -> None:
        super().__init__()
        self._set(inputCols=columns or [], idCol=id_column, k=k, restarts=restarts, seed=seed)

    def _fit(self, dataset: DataFrame) -> KMeansModel:
        columns, k, runs = self.getInputCols(), self.getOrDefault("k"), self.getOrDefault("restarts")
        placed, ok = _points(dataset, columns)
        rows = cut(placed.filter(ok).select(F.col(self.getOrDefault("idCol")).cast("string").alias("id"), F.col("__p").alias("p")))
        n = rows.count()
        rows = rows.coalesce(max(1, -(-n // TASK_ROWS)))  # a filter may leave little in each of many partitions
        digest = lambda r: F.md5(F.concat_ws(":", F.lit(str(self.getSeed())), F.lit(str(r)), "id").cast("binary"))
        hashed = rows.select("p", F.posexplode(F.array(*[digest(r) for r in range(runs)])).alias("run", "h"))
        place = F.row_number().over(Window.partitionBy("run").orderBy("h", "p"))  # the planner keeps k rows of a run in each task
        drawn = hashed.withColumn("place", place).filter(F.col("place") <= k).orderBy("run", "place").collect()
        starts = [[list(r["p"]) for r in drawn if r["run"] == run] for run in range(runs)]
        if not starts[0]:
            return self._copyValues(KMeansModel({"centres": []}))
        centres = np.array(starts, dtype=np.float64)
        for _ in range(ROUNDS):
            n, total, _ = _sums(rows, centres)
            moved = np.array([[[t / float(n[r][c]) for t in map(float, total[r][c])] if n[r][c] else centres[r, c] for c in range(centres.shape[1])] for r in range(runs)])
            if np.array_equal(moved, centres):
                break
            centres = moved
        n, total, square = _sums(rows, centres)
        cost = [float(sum(Fraction(q * m - s * s, m) for m, ss, qs in zip(n[r], total[r], square[r], strict=True) if m for s, q in zip(ss, qs, strict=True))) for r in range(runs)]
        best = centres[int(np.argmin(cost))]
        return self._copyValues(KMeansModel({"centres": sorted(best.tolist())}))


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[list, list, list]:
    """Number of rows, sums and sums of squares of each run's clusters, as whole numbers."""
    runs, k, dim = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros((runs, k), np.int64), np.zeros((runs, k, dim), object), np.zeros((runs, k, dim), object)
        for batch in batches:
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            at = nearest(p, centres)
            whole = p.astype(object)
            for r in range(runs):
                for c in range(k):
                    own = at[r] == c
                    if own.any():
                        n[r, c] += int(own.sum())
                        s[r, c] += whole[own].sum(axis=0)
                        q[r, c] += (whole[own] ** 2).sum(axis=0)
        found = [(r, c, int(n[r, c]), [str(x) for x in s[r, c]], [str(x) for x in q[r, c]]) for r in range(runs) for c in range(k) if n[r, c]]
        if found:
            columns = list(zip(*found, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["r", "c", "n", "s", "q"])

    parts = rows.mapInArrow(add, "r int, c int, n long, s array<string>, q array<string>")
    sums = [F.sum(F.col(x)[i].cast("decimal(38,0)")).alias(f"{x}{i}") for x in "sq" for i in range(dim)]
    n, s, q = ([[z() for _ in range(k)] for _ in range(runs)] for z in (int, lambda: [0] * dim, lambda: [0] * dim))
    for row in parts.groupBy("r", "c").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each run and cluster
        n[row["r"]][row["c"]] = row["n"]
        s[row["r"]][row["c"]], q[row["r"]][row["c"]] = ([int(row[f"{x}{i}"]) for i in range(dim)] for x in "sq")
    return n, s, q


class KMeansModel(FittedModel, HasInputCols):
    """Adds CLUSTER, the number of the nearest centre; rows with a missing or infinite feature get none."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.state["centres"]:
            return dataset.withColumn("CLUSTER", F.lit(None).cast("int"))
        placed, ok = _points(dataset, self.getInputCols())
        gap = lambda centre: sum(((F.col("__p")[i] - F.lit(x)) * (F.col("__p")[i] - F.lit(x)) for i, x in enumerate(centre)), F.lit(0.0))
        of = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(self.state["centres"])]))
        return placed.withColumn("CLUSTER", F.when(ok, of["c"])).drop("__p")
