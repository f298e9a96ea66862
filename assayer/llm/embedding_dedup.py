"""Embedding near-dedup: coarse inverted lists with product-quantised residuals, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, hash_share
from assayer.llm.components import connected_components

THRESHOLD = 0.95
#: Bounds of the index fit: vectors of the sample of each length (shared out if there are several lengths); subspaces; code words of each.
FIT_ROWS, SUBSPACES, CODES = 16_384, 16, 64
#: Vectors wanted in a list, centres of the first level, and vectors of a list that a task compares at a time.
LIST_SIZE, CENTRES, BLOCK = 400, 512, 1_024
#: A vector probes every list whose centre is at most PROBE_SPREAD / sqrt(dimension) less similar to it than the nearest one. A
#: neighbour at cosine 0.95 moves similarities to centres by a standard deviation of about 0.32 / sqrt(dimension).
PROBE_SPREAD = 0.8
#: So many rows are broadcast at most.
SMALL = 20_000


@dataclass
class Index:
    """Centres of the first level, centres of what is left of vectors after it (one zero: no second level), code books of what both
    leave, subspaces x codes x width, and how much less similar than the nearest a list is probed. A list is a pair of centres, so
    lists grow with the table though the fit does not."""

    first: np.ndarray
    second: np.ndarray
    books: np.ndarray
    margin: float

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.first[lists // len(self.second)] + self.second[lists % len(self.second)]

    def home(self, x: np.ndarray) -> np.ndarray:
        top = (x @ self.first.T).argmax(axis=1)
        return top * len(self.second) + _nearest(x - self.first[top], self.second)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that rows probe. Squared distances differ twice as much as similarities of unit vectors."""
        similar, margin = x @ self.first.T, self.margin
        row, top = np.nonzero(similar >= similar.max(axis=1, keepdims=True) - margin)
        if len(self.second) == 1:
            return row, top
        far = (self.second**2).sum(axis=1) - 2 * (x[row] - self.first[top]) @ self.second.T
        k, sub = np.nonzero(far <= far.min(axis=1, keepdims=True) + 2 * margin)
        return row[k], top[k] * len(self.second) + sub

    def residual_codes(self, residuals: np.ndarray) -> np.ndarray:
        parts = self.split(residuals)
        return np.stack([_nearest(parts[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width)

    def decode(self, codes: np.ndarray, dim: int) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)[:, :dim]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def build(sample: np.ndarray, n: int, list_size: int = LIST_SIZE, spread: float = PROBE_SPREAD) -> Index:
    """Fit centres and code books on unit vectors; n is how many the index will hold, and with it the number of lists grows."""
    rng = np.random.default_rng(11)
    lists = max(1, n // list_size)
    first = _kmeans(sample, int(min(CENTRES, lists, len(sample))), 10, rng)
    norm = np.linalg.norm(first, axis=1, keepdims=True)
    first = np.where(norm > 0, first / np.where(norm > 0, norm, 1), first)
    left = sample - first[(sample @ first.T).argmax(axis=1)]
    finer = int(min(-(-lists // len(first)), len(sample)))
    second = _kmeans(left, finer, 10, rng) if finer > 1 else np.zeros((1, sample.shape[1]))
    left = left - second[_nearest(left, second)]
    subspaces = min(SUBSPACES, sample.shape[1])
    width = -(-sample.shape[1] // subspaces)
    padded = np.zeros((len(sample), subspaces * width))
    padded[:, : sample.shape[1]] = left
    parts = padded.reshape(len(sample), subspaces, width)
    return Index(first, second, np.stack([_kmeans(parts[:, m], min(CODES, len(sample)), 8, rng) for m in range(subspaces)]), spread / np.sqrt(sample.shape[1]))


def unit(rows: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _compare(index: Index, base: pd.DataFrame, query: pd.DataFrame, dim: int, threshold: float) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """Links between the vectors of a list and those that probe it: what each side gains, and a spanning forest.

    Both (q probes x's list) and (x probes q's list) may find a pair, each in its own task; where both do, each counts
    for the vector that probes, else the only finder counts for both."""
    x, q = [np.frombuffer(b"".join(d["vector"]), dtype="<f8").reshape(-1, dim) for d in (base, query)]
    codes = np.frombuffer(b"".join(base["code"]), dtype=np.uint8).reshape(len(base), -1)
    r = index.split(q - index.centre(base["list"].to_numpy()[:1]))
    tables = (r**2).sum(axis=2)[:, :, None] - 2 * np.einsum("qmw,mkw->qmk", r, index.books) + (index.books**2).sum(axis=2)[None]
    distance = np.zeros((len(q), len(x)))
    for m in range(codes.shape[1]):
        distance += tables[:, m][:, codes[:, m]]
    reach = np.sqrt(2 - 2 * threshold) + base["error"].to_numpy() + 1e-9
    near = np.argwhere(distance <= reach[None] ** 2)  # by the triangle inequality no link lies farther
    ids_q, ids_x = query["id"].to_numpy(), base["id"].to_numpy()
    near = near[ids_q[near[:, 0]] != ids_x[near[:, 1]]]
    i, j = near[:, 0], near[:, 1]
    keep = np.zeros(len(near), dtype=bool)
    for a in range(0, len(near), 1 << 16):
        at = slice(a, a + (1 << 16))
        keep[at] = np.einsum("nd,nd->n", q[i[at]], x[j[at]]) >= threshold
    i, j = i[keep], j[keep]
    # pairs (vector, list that it probes) as numbers, to ask which x probe q's home
    homes, home = np.unique(query["home"].to_numpy(), return_inverse=True)
    probed = np.zeros((len(x), len(homes)), dtype=bool)
    sizes = base["probes"].map(len).to_numpy()
    every = np.concatenate(base["probes"].to_numpy()).astype(np.int64)
    at = np.minimum(np.searchsorted(homes, every), len(homes) - 1)
    hit = homes[at] == every
    probed[np.repeat(np.arange(len(x)), sizes)[hit], at[hit]] = True
    back = probed[j, home[i]]
    weight_q, weight_x = query["n"].to_numpy(), base["n"].to_numpy()
    gained = pd.DataFrame({"id": np.concatenate([ids_q[i], ids_x[j[~back]]]), "links": np.concatenate([weight_x[j], weight_q[i[~back]]])})
    return gained.groupby("id", as_index=False)["links"].sum(), _forest(ids_q[i], ids_x[j])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, one fewer than nodes in each part, and few at each node."""
    top: dict[int, int] = {}

    def find(v: int) -> int:
        while top.setdefault(v, v) != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(u), find(v)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


def valid(vector: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _fit(nodes: DataFrame, list_size: int, spread: float) -> dict[int, Index]:
    """An index for each length of vector, fitted on a hash sample of FIT_ROWS vectors or so (of all lengths together)."""
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, FIT_ROWS // max(1, len(sizes)))
    share = F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, each / n))]), F.size("embedding")) if sizes else F.lit(0.0)
    place = hash_share(F.col("embedding"), F.lit(5))
    drawn: dict[int, list] = {d: [] for d in sizes}
    for r in nodes.filter(place < share).select("rep", "embedding").orderBy("rep", "embedding").limit(2 * FIT_ROWS).toLocalIterator():
        drawn[len(r["embedding"])].append(r["embedding"])
    rare = [d for d in sizes if not drawn[d]]
    if rare:  # lengths of which the sample holds none: one vector of each, a row a length
        for r in nodes.filter(F.size("embedding").isin(rare)).groupBy(F.size("embedding")).agg(F.min("embedding").alias("e")).collect():
            drawn[len(r["e"])].append(r["e"])
    return {d: build(unit(np.array(drawn[d], dtype=np.float64)), n, list_size, spread) for d, n in sizes.items()}


def link_near(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, spread: float = PROBE_SPREAD, list_size: int = LIST_SIZE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links join vectors of cosine >= threshold, components join links.

    Equal vectors are compared once: they link with each other and share all further links. Distances of residual codes
    only rule out pairs that the triangle inequality rules out, every other pair is compared exactly in double precision,
    so links can be missed only where neither vector probes the other's list. Vectors of different lengths do not link;
    each length has an index of its own. Null, zero and non-finite vectors and rows with a null id link with nothing.
    Repeated rows are rows of their own, and so are rows that share an id. Empty table: empty result. Other columns are dropped."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    usable = valid(F.col("embedding")) & F.col("vec_id").isNotNull()
    ok, alone = rows.filter(usable), rows.filter(~F.coalesce(usable, F.lit(False)))
    lonely = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # each different vector is a node of its own, also where ids repeat; the checkpoint fixes the numbers
    distinct = ok.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(distinct.select(F.monotonically_increasing_id().alias("node"), "rep", "copies", "embedding"))
    shared = rows.sparkSession.sparkContext.broadcast(_fit(nodes, list_size, spread))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            length = whole["embedding"].map(len).to_numpy()
            for d in np.unique(length).tolist():
                of_length, index = whole[length == d], shared.value[d]
                for start in range(0, len(of_length), 2_000):
                    b = of_length.iloc[start : start + 2_000]
                    x = unit(np.array(b["embedding"].tolist(), dtype=np.float64))
                    home = index.home(x)
                    residuals = x - index.centre(home)
                    codes = index.residual_codes(residuals)
                    error = np.sqrt(((residuals - index.decode(codes, d)) ** 2).sum(axis=1))
                    row, place = index.probes(x)
                    probes = np.split(place, np.flatnonzero(np.diff(row)) + 1)
                    yield pd.DataFrame({"d": d, "id": b["node"].to_numpy(), "n": b["copies"].to_numpy(), "home": home, "probes": probes, "vector": [v.tobytes() for v in x], "code": [c.tobytes() for c in codes], "error": error})

    placed = cut(nodes.mapInPandas(assign, "d int, id long, n long, home long, probes array<long>, vector binary, code binary, error double"))
    queries = placed.select("d", "id", "n", "home", "vector", F.explode("probes").alias("list"))
    # how many blocks each list has on either side
    homes = placed.groupBy("d", F.col("home").alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    visits = placed.select("d", F.explode("probes").alias("list")).groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq"))
    blocks = cut(homes.join(visits, ["d", "list"]))
    blocks = F.broadcast(blocks) if blocks.limit(SMALL + 1).count() <= SMALL else blocks
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    bases = placed.withColumn("list", F.col("home")).join(blocks, ["d", "list"]).select("d", "list", own(F.col("nb")).alias("b"), every(F.col("nq")).alias("q"), F.lit(True).alias("base"), "id", "n", "home", "probes", "vector", "code", "error")
    asked = queries.join(blocks, ["d", "list"]).select("d", "list", own(F.col("nq")).alias("q"), every(F.col("nb")).alias("b"), F.lit(False).alias("base"), "id", "n", "home", "vector")
    sides = bases.unionByName(asked, allowMissingColumns=True)

    def search(both: pd.DataFrame) -> pd.DataFrame:
        base, query = both[both["base"]], both[~both["base"]]
        if not len(base) or not len(query):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        d = int(both["d"].iloc[0])
        gained, forest = _compare(shared.value[d], base, query, d, threshold)
        links = pd.DataFrame({"a": gained["id"].astype("int64"), "b": pd.array([None] * len(gained), dtype="Int64"), "links": gained["links"].astype("int64")})
        edges = pd.DataFrame({"a": [e[0] for e in forest], "b": pd.array([e[1] for e in forest], dtype="Int64"), "links": 0})
        return pd.concat([links, edges.astype({"a": "int64", "links": "int64"})])

    found = cut(sides.groupBy("d", "list", "b", "q").applyInPandas(search, "a long, b long, links long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    parts = cut(connected_components(found.filter("b is not null")).join(nodes.select(F.col("node").alias("id"), "rep"), "id"))
    named = parts.join(parts.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("id").alias("node"), "component_id").join(links, "node")
    known = nodes.join(named, "node", "left").select("embedding", "rep", "copies", "more", "component_id")
    out = ok.join(known, "embedding").select("vec_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return out.unionByName(lonely).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
