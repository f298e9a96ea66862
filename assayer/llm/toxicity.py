"""Toxicity by non-negative positive-unlabelled learning on the letter n-grams of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, hash_share, held_out

#: Bounds of what is fitted on, all of them rows of the labels: confirmed rows, rows taken without their label, and n-grams.
POSITIVES, UNLABELLED, VOCABULARY, LEAST_DOCS = 4_000, 8_000, 3_000, 5
GRAMS = (4, 5)
LETTERS = re.compile(r"[^\W\d_]+")
#: Tokens whose n-grams a task remembers, and n-grams that it counts before it hands counts on.
KNOWN_WORDS, COUNTED = 60_000, 100_000


def grams(word: str) -> set[str]:
    """Letter n-grams of a word with marked ends."""
    w = f"<{word}>"
    return {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} | {w}


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case tokens of a batch, the token of each occurrence, and where each text's occurrences begin."""
    clean = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "\n", " ")
    parts = pc.split_pattern(clean, " ")
    flat = pc.dictionary_encode(parts.flatten())
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy(zero_copy_only=False) - parts.offsets[0].as_py()


class Features:
    """Which vocabulary n-grams a text holds; what a token holds is remembered for a bounded number of tokens."""

    def __init__(self, vocabulary: list[str]):
        self.index = {g: i for i, g in enumerate(vocabulary)}
        self.known: dict[str, np.ndarray] = {}

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        tokens, index, bounds = split_words(texts)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        for t in tokens:
            if t not in self.known:
                self.known[t] = np.array(sorted({self.index[g] for w in LETTERS.findall(t) for g in grams(w) if g in self.index}), dtype=np.int32)
        held = [self.known[t] for t in tokens]
        some = np.array([len(h) > 0 for h in held], dtype=bool)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = index[a:b]
            own = np.unique(own[some[own]]) if len(own) else own
            out.append(np.unique(np.concatenate([held[i] for i in own])) if len(own) else np.zeros(0, np.int32))
        return out


@dataclass
class Model:
    """A linear score of n-gram presence; `prior` is the class prior it was trained for."""

    vocabulary: list[str]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[r].sum() for r in rows], dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def slopes(z: np.ndarray, p: int, prior: float) -> np.ndarray:
    """Which way the scores of p positive rows and of the unlabelled rows after them go: the gradient of the non-negative risk estimate.

    The logistic risk of the negative class is estimated as that of the unlabelled rows less prior times that of the positive
    ones taken as negative. Where that estimate is below zero, it is undone (its gradient turned round) and nothing else is followed."""
    n = len(z)
    up = 1 / (1 + np.exp(-np.clip(z, -500, 500)))  # derivative of log(1 + e^z), the loss as negative
    negative = np.logaddexp(0, z)
    slope = np.zeros(n)
    slope[p:] = up[p:] / (n - p)
    slope[:p] = -prior * up[:p] / p
    if negative[p:].mean() - prior * negative[:p].mean() < 0:
        return -slope
    slope[:p] += prior * (up[:p] - 1) / p
    return slope


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk estimate with the logistic loss, by Adam's method."""
    if not positive or not unlabelled:
        odds = min(max(prior, 1e-6), 0.49)
        return np.zeros(width), float(np.log(odds / (1 - odds)))
    rows = positive + unlabelled
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        slope = slopes(np.bincount(doc, w[col], len(rows)) + b, len(positive), prior)
        g = np.append(np.bincount(col, slope[doc], width) + decay * w, slope.sum())
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, p, u: how many confirmed and how many unlabelled texts hold it; the empty gram counts all texts."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(found[0].keys() | found[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in found]], names=["gram", "p", "u"])
        for c in found:
            c.clear()
        return batch

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            tokens, index, bounds = split_words(part.column(2))
            held = [{g for w in LETTERS.findall(t) for g in grams(w)} for t in tokens]
            flags = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True)
            for p, u, a, b in flags:
                own = set().union(*[held[i] for i in np.unique(index[a:b])]) | {""}
                for c, on in zip(found, (p, u), strict=True):
                    if on:
                        c.update(own)
            if len(found[0]) + len(found[1]) > COUNTED:
                yield out()
    yield out()


def _drawn(n: int, most: int, seed: int) -> Column:
    """About `most` of n rows, by a hash of their id."""
    return hash_share(F.col("__id"), F.lit(seed)) < min(1.0, most / max(n, 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", may_learn: Column | None = None) -> Model:
    """Train on about POSITIVES confirmed rows and UNLABELLED rows at most (hash samples of the rows with a label that `may_learn` admits).

    Confirmed are labels of 1; the unlabelled rows are taken without their label, which else serves for the class prior alone. Null
    labels and ids are left out; of rows that share an id the greatest label and the least text count. Documents are read once."""
    may = ~held_out(doc_id) if may_learn is None else may_learn
    known = labels.filter(may & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) == 1).alias("__y"))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("__y").alias("p")).first()
    prior = seen["p"] / seen["n"] if seen["n"] else 0.0
    chosen = known.select("__id", (F.col("__y") & _drawn(seen["p"], POSITIVES, 1)).alias("p"), _drawn(seen["n"], UNLABELLED, 2).alias("u")).filter("p OR u").limit(2 * (POSITIVES + UNLABELLED))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    sample = cut(texts.groupBy("__id", "p", "u").agg(F.min("text").alias("text")))
    counts = sample.select("p", "u", "text").mapInArrow(_count, "gram string, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter((F.col("p") >= LEAST_DOCS) | (F.col("gram") == ""))
    counts = cut(counts)
    total = F.broadcast(counts.filter(F.col("gram") == "").select(F.col("p").alias("np"), F.col("u").alias("nu")))
    rate = (F.col("p") + F.col("u")) / (F.col("np") + F.col("nu"))
    gap = F.try_divide(F.col("p"), F.col("np")) - F.try_divide(F.col("u"), F.col("nu"))
    z = F.try_divide(gap, F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), F.col("np")) + F.try_divide(F.lit(1.0), F.col("nu")))))
    best = counts.filter(F.col("gram") != "").crossJoin(total).select("gram", F.abs(z).alias("z")).filter("z > 3").orderBy(F.desc("z"), "gram").limit(VOCABULARY)
    vocabulary = sorted(r["gram"] for r in best.collect())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features.of(batch.column(2)), pa.list_(pa.int32()))], names=["p", "u", "grams"])

    rows = sample.select("p", "u", "text").mapInArrow(encode, "p boolean, u boolean, grams array<int>").toArrow()
    grams = rows["grams"].combine_chunks()
    held = np.split(grams.values.to_numpy(), grams.offsets.to_numpy()[1:-1]) if len(grams) else []
    of = lambda flag: sorted((h for h, on in zip(held, rows[flag].to_pylist(), strict=True) if on), key=lambda h: (len(h), h.tolist()))
    weights, bias = train(of("p"), of("u"), len(vocabulary), prior)
    return Model(vocabulary, weights, bias, prior)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add a score from 0 to 1 of each whole text; null or empty texts get that of a text without any known n-gram.

    Repeated rows: each by itself. Empty table: empty result. A column named like `into` is replaced; others pass through."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(model.vocabulary)
        for texts in batches:
            yield pd.Series(model.score(features.of(pa.array(texts, pa.string(), from_pandas=True))))

    return docs.withColumn(into, of(F.col(text).cast("string")))
