"""Centroids of vectors by rounds over their distinct quantised forms.

Components become integers, so that sums, means and distances are exact and any order of adding gives the same centroids. Equal
vectors are counted once, before any round; a round reads each distinct vector once, with its multiplicity as weight, and sends
one row for each centroid and component from a task to the sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SALTS, cut

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Integers at or beyond this size would let squared distances outgrow 64 bits.
BOUND = 1 << 27


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """`vec_id`, `v`: components times `scale` as integers, of the vectors that have exactly `dim` components, none of them null,
    non-finite or beyond BOUND as an integer."""
    e = F.col(embedding)
    scaled = F.transform(e, lambda x: x.cast("double") * scale)
    fit = (F.size(e) == dim) & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < BOUND), F.lit(False)))
    return vectors.filter(fit).select(F.col(vec_id).alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose `seed:vec_id` have the smallest SHA-256, in that order; a null id counts as empty text."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    top = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k)
    return np.array([r["v"] for r in top.collect()], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance to it, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every product and sum is a whole number that a double holds
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        d = ((xf * xf).sum(axis=1)[:, None] - 2 * xf @ cf.T + (cf * cf).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[list[int], int]]:
    """Componentwise sum and number of the vectors nearest to each centroid, multiplicities counted. Every task adds up its own rows
    first, so what moves is one row for each centroid and component; sums are decimals and can't overflow."""
    dim = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 1) for _ in centroids]
        for batch in batches:
            x, w = _matrix(batch, dim), batch.column("n").to_numpy().astype(np.int64)
            if not len(x):
                continue
            x = np.column_stack([x, np.ones(len(x), np.int64)])
            at, _ = nearest(x[:, :dim], centroids)
            small = max(int(np.abs(x).max()), 1) * int(w.sum()) < 1 << 62
            for c in np.unique(at):
                own = at == c
                part = (x[own] * w[own, None]).sum(axis=0) if small else (x[own].astype(object) * w[own, None].astype(object)).sum(axis=0)
                total[c] = [a + int(b) for a, b in zip(total[c], part, strict=True)]
        rows = [(c, i, Decimal(s)) for c, sums in enumerate(total) if sums[dim] for i, s in enumerate(sums)]
        if rows:
            c, i, s = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(s, pa.decimal128(38, 0))], ["c", "i", "s"])

    sums = distinct.mapInArrow(add, "c int, i int, s decimal(38,0)").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()
    out: dict[int, tuple[list[int], int]] = {}
    for c in {r["c"] for r in sums}:
        by = {r["i"]: int(r["s"]) for r in sums if r["c"] == c}
        out[c] = ([by[i] for i in range(dim)], by[dim])
    return out


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Replace every centroid that has vectors by the floor of their mean, `rounds` times; others stay."""
    for _ in range(rounds):
        sums = weighted_sums(distinct, centroids)
        centroids = np.array([[s // sums[c][1] for s in sums[c][0]] if c in sums else row.tolist() for c, row in enumerate(centroids)], dtype=np.int64)
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add `cluster` and `distance` to the distinct vectors."""
    dim = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = nearest(_matrix(batch, dim), centroids)
            yield pa.record_batch([batch.column("v"), batch.column("n"), pa.array(at.astype(np.int32)), pa.array(d)], ["v", "n", "cluster", "distance"])

    return distinct.mapInArrow(place, "v array<int>, n long, cluster int, distance long")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for every vector that `quantised` keeps: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Repeated rows and ids: a row each, and each counts. Null ids: rows like others. Equal vectors: one cluster. Ties: the centroid
    with the smaller number. Fewer vectors than k: as many centroids as vectors. Empty table, or none kept: empty result. Other
    columns of the input are left out, whatever their names.

    A vector that very many rows share is counted in SALTS parts before its parts meet, and its cluster goes back to rows by
    (vector, part)."""
    rows = quantised(vectors, vec_id, embedding, dim, scale).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"))
    distinct = cut(parts.groupBy("v").agg(F.sum("n").alias("n")))
    start = first_centroids(rows, k, seed)
    if not len(start):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    centroids = lloyd(distinct, start, rounds)
    placed = assigned(distinct, centroids)
    of = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    listed = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    to_part = parts.select("v", "part").join(placed.select("v", "cluster", "distance"), "v")
    inertia = [F.lit(of.get(c, 0)).cast("long") for c in range(len(centroids))]
    out = rows.join(to_part, ["v", "part"])
    return out.select("vec_id", "cluster", "distance", F.element_at(F.array(*inertia), F.col("cluster") + 1).alias("cluster_inertia"), F.lit(sum(of.values())).cast("long").alias("inertia"), listed(digests).alias("centroid_sha256"))
