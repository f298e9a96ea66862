"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Observations are binned measures of a line and of its neighbours; marginals of the forward-backward recursion, weighted by
line length, are a document's quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import hash_share, held_out, range_hashes

#: Bound of what is fitted on: rows of each label. Their whole texts are read, and so are those of all rows that are scored.
FIT_ROWS = 2_000
#: Lines of a sequence in the fit: longer texts are several sequences run side by side, with messages from one to the next.
SEGMENT = 64
#: Steps of the fit before and after lines of bad documents are judged anew.
FIRST_STEPS, MORE_STEPS = 100, 80
BINS = 8
#: Characters measured, and padded line slots scored, at a time, to bound memory.
CHUNK_CHARS, CHUNK_SLOTS = 2_000_000, 200_000
MEASURES = ("words", "word_length", "upper", "digit", "symbol", "punctuation", "tied_symbol", "adjacent", "distinct", "repeated_line")

_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _POINT = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(0x10000, dtype=np.uint8)
for _c in range(0x10000):
    _s = chr(_c)
    if _s.isspace():
        _CLASS[_c] = _SPACE
    elif _s.isdigit():
        _CLASS[_c] = _DIGIT
    elif _s.isupper():
        _CLASS[_c] = _UPPER
    elif _s.isalpha():
        _CLASS[_c] = _LOWER
for _s in "#*$%&|<>=~^_\\@{}[]+/":
    _CLASS[ord(_s)] = _SYMBOL
for _s in ".,;:!?()\"'-":
    _CLASS[ord(_s)] = _POINT


def _share_of_repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each item whether its (group, key) occurred before in the order of items."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return again


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines (lines x MEASURES), their lengths in characters, and how many lines each text has (at least one)."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _CLASS[np.minimum(codes, 0xFFFF)]
    breaks = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(codes)]])
    n_lines = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    length = ends - starts

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    solid = kind != _SPACE
    first = solid & np.concatenate([[True], ~solid[:-1]]) if len(codes) else solid
    last = solid & np.concatenate([~solid[1:], [True]]) if len(codes) else solid
    w_start, w_end = np.flatnonzero(first), np.flatnonzero(last) + 1
    line_of = np.searchsorted(starts, w_start, side="right") - 1
    hashes = range_hashes(codes, w_start, w_end)
    by_line = lambda flags: np.bincount(line_of, flags, len(starts))
    words = by_line(np.ones(len(w_start)))
    adjacent = np.zeros(len(w_start), dtype=bool)
    adjacent[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    letters = np.maximum(count((kind == _UPPER) | (kind == _LOWER)), 1)
    chars, tokens = np.maximum(count(solid), 1), np.maximum(words, 1)
    tied = np.isin(kind[w_end - 1], (_SYMBOL,)) | (codes[w_end - 1] == 33)
    repeated = _share_of_repeats(doc, range_hashes(codes, starts, ends)) & (length > 0)
    out = np.stack(
        [words, count(solid) / tokens, count(kind == _UPPER) / letters, count(kind == _DIGIT) / chars, count(kind == _SYMBOL) / chars, count(kind == _POINT) / chars, by_line(tied) / tokens, by_line(adjacent) / tokens, 1 - by_line(_share_of_repeats(line_of, hashes)) / tokens, repeated],
        axis=1,
    )
    return out, length, n_lines


@dataclass
class Model:
    """Edges of the bins of each measure, a weight of each bin of the line before, the line and the line after towards `good`, and
    log potentials of the first state and of pairs of states (0 bad, 1 good)."""

    edges: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    pairs: np.ndarray

    def slots(self, measures: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Indices of the bins that hold for each line: MEASURES of three neighbours; the last bin of each is "no such line"."""
        m = len(MEASURES)
        own = np.stack([np.searchsorted(self.edges[k], measures[:, k], side="left") for k in range(m)], axis=1) if len(measures) else np.zeros((0, m), np.int64)
        first = np.cumsum(n_lines) - n_lines
        before, after = np.full_like(own, BINS), np.full_like(own, BINS)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first], after[first + n_lines - 1] = BINS, BINS
        base = np.arange(m) * (BINS + 1)
        return np.concatenate([base + before, base + own + m * (BINS + 1), base + after + 2 * m * (BINS + 1)], axis=1)

    def unary(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(axis=1)


def forward_backward(unary: np.ndarray, mask: np.ndarray, start: np.ndarray, pairs: np.ndarray, first: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of `good` (documents x lines) and of pairs of neighbouring states (documents x lines - 1 x 2 x 2).

    Unary log potentials are those of good against bad; slots outside `mask` are padding at the ends. `first` is the message that
    reaches the first slots in place of `start`, `after` the one that comes back to the last (each documents x 2)."""
    n, t = unary.shape
    first = np.exp(start) if first is None else first
    after = np.ones((n, 2)) if after is None else after
    obs = np.stack([np.zeros_like(unary), unary], axis=2)
    obs = np.exp(obs - obs.max(axis=2, keepdims=True))
    trans = np.exp(pairs)
    a, b = np.empty((n, t, 2)), np.empty((n, t, 2))
    b[:, -1] = after
    a[:, 0] = first * obs[:, 0]
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, t):
        x = (a[:, k - 1] @ trans) * obs[:, k]
        x /= x.sum(axis=1, keepdims=True)
        a[:, k] = np.where(mask[:, k, None], x, a[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = (b[:, k + 1] * obs[:, k + 1]) @ trans.T
        x /= x.sum(axis=1, keepdims=True)
        b[:, k] = np.where(mask[:, k + 1, None], x, after)
    good = a * b
    good = good[:, :, 1] / good.sum(axis=2)
    both = a[:, :-1, :, None] * trans * (b * obs)[:, 1:, None, :]
    both /= np.maximum(both.sum(axis=(2, 3), keepdims=True), 1e-300)
    return good, both * mask[:, 1:, None, None]


def padded(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots (documents x longest) into the flat lines, and which of them exist."""
    first = np.cumsum(n_lines) - n_lines
    steps = np.arange(int(n_lines.max()))
    mask = steps < n_lines[:, None]
    return np.where(mask, first[:, None] + steps, 0), mask


@dataclass
class Lines:
    """The lines of a fit. Lines with the same bins are of one kind: `kinds` has the bins of each, and in its last row those of "no
    such line"; each line has its kind and those of the lines before and after it in its text."""

    kinds: np.ndarray
    before: np.ndarray
    own: np.ndarray
    after: np.ndarray
    segments: np.ndarray  # lines of each sequence
    heads: np.ndarray  # sequences that begin a text

    def unary(self, weights: np.ndarray) -> np.ndarray:
        w = weights.reshape(3, len(MEASURES), BINS + 1)
        of = [sum(w[k, j][self.kinds[:, j]] for j in range(len(MEASURES))) for k in range(3)]
        return of[0][self.before] + of[1][self.own] + of[2][self.after]

    def pull(self, gap: np.ndarray) -> np.ndarray:
        """How far each weight moves with a gap at each line: what `unary` does, backwards."""
        each = [np.bincount(at, gap, len(self.kinds)) for at in (self.before, self.own, self.after)]
        return np.concatenate([np.bincount(self.kinds[:, j], g, BINS + 1) for g in each for j in range(len(MEASURES))])


def gather(edges: np.ndarray, measures: np.ndarray, n_lines: np.ndarray) -> Lines:
    """Lines of texts in order: bins of their measures, and sequences of SEGMENT lines at most."""
    bins = np.stack([np.searchsorted(edges[k], measures[:, k], side="left") for k in range(len(MEASURES))], axis=1)
    code = bins @ ((BINS + 1) ** np.arange(len(MEASURES)))
    _, first_of, own = np.unique(code, return_index=True, return_inverse=True)
    kinds = np.concatenate([bins[first_of], np.full((1, len(MEASURES)), BINS)])
    none = len(kinds) - 1
    first = np.cumsum(n_lines) - n_lines
    before, after = np.full(len(own), none), np.full(len(own), none)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + n_lines - 1] = none, none
    parts = [np.append(np.full((n - 1) // SEGMENT, SEGMENT), n - (n - 1) // SEGMENT * SEGMENT) for n in n_lines.tolist()]
    heads = np.zeros(sum(map(len, parts)), dtype=bool)
    heads[np.cumsum([0, *map(len, parts[:-1])])] = True
    return Lines(kinds, before, own, after, np.concatenate(parts), heads)


def messages(unary: np.ndarray, mask: np.ndarray, heads: np.ndarray, start: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each sequence (sequences x lines) learns from the one before it in its text and from the one after it: forward and backward
    messages (sequences x 2). A sequence passes them on by the product of its transitions, made for all sequences at once."""
    n, t = unary.shape
    entry, after = np.full((n, 2), 0.5), np.ones((n, 2))
    many = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    if not len(many):
        return entry, after
    obs = np.stack([np.zeros_like(unary[many]), unary[many]], axis=2)
    obs = np.exp(obs - obs.max(axis=2, keepdims=True))[:, :, None, :]
    trans = np.exp(pairs)
    product = np.zeros((n, 2, 2))
    # the message that enters a text sums to 1, so with alike rows the first line starts as `start` says
    x = np.where(heads[many, None, None], np.exp(start), trans) * obs[:, 0]
    for k in range(1, t):
        y = (x @ trans) * obs[:, k]
        x = np.where(mask[many, k, None, None], y / y.sum(axis=(1, 2), keepdims=True), x)
    product[many] = x
    place = np.arange(n) - np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    order = np.argsort(place, kind="stable")
    levels = np.split(order, np.searchsorted(place[order], np.arange(1, place.max() + 1)))[1:]
    for at in levels:
        x = np.einsum("ni,nij->nj", entry[at - 1], product[at - 1])
        entry[at] = x / x.sum(axis=1, keepdims=True)
    for at in levels[::-1]:
        x = np.einsum("nij,nj->ni", product[at], after[at])
        after[at - 1] = x / x.sum(axis=1, keepdims=True)
    return entry, after


def chains(unary: np.ndarray, lines: Lines, start: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of `good` of all lines, and the sum over all neighbours of those of their pair of states (2 x 2), by whole texts."""
    at, mask = padded(lines.segments)
    entry, after = messages(unary[at], mask, lines.heads, start, pairs)
    trans = np.exp(pairs)
    first = np.where(lines.heads[:, None], np.exp(start), entry @ trans)
    p, both = forward_backward(unary[at], mask, start, pairs, first, after)
    inner = ~lines.heads
    own = np.stack([1 - p[inner, 0], p[inner, 0]], axis=1) / first[inner]
    across = np.einsum("ni,ij,nj->ij", entry[inner], trans, own)
    flat = np.empty(len(unary))
    flat[at[mask]] = p[mask]
    return flat, both.sum(axis=(0, 1)) + across


def likelihood_gradient(theta: np.ndarray, lines: Lines, good: np.ndarray, decay: float) -> np.ndarray:
    """Gradient, by weights, start and pair potentials, of the mean log likelihood of line labels a line, less decay / 2 times the
    squares of all but the start."""
    width, rows = len(theta) - 6, len(good)
    w, start, pairs = theta[:width], theta[width : width + 2], theta[width + 2 :].reshape(2, 2)
    p, both = chains(lines.unary(w), lines, start, pairs)
    gap = good - p
    firsts = (np.cumsum(lines.segments) - lines.segments)[lines.heads]
    first = gap[firsts].sum() / rows
    a, b = np.delete(np.append(0.0, good[:-1]), firsts), np.delete(good, firsts)
    seen = np.array([[((a == i) & (b == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    return np.concatenate([lines.pull(gap) / rows - decay * w, [-first, first], ((seen - both) / rows).ravel() - decay * theta[width + 2 :]])


def train(lines: Lines, good: np.ndarray, theta: np.ndarray, steps: int, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights, start and pair potentials of the greatest penalised likelihood of line labels, by Adam's method from `theta`."""
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = likelihood_gradient(theta, lines, good, decay)
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta


def fit_lines(measures: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on whole-document labels and the measures of all their lines: lines start with their document's label; then lines of bad
    documents that look good to the first model count as good (each bad document keeps its worst line), and the fit goes on."""
    width = 3 * len(MEASURES) * (BINS + 1)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        flat = float(np.log(share / (1 - share)))
        return Model(np.zeros((len(MEASURES), BINS - 1)), np.zeros(width), np.array([0.0, flat]), np.array([[0.0, flat], [0.0, flat]]))
    bad_lines = np.repeat(labels == 0, n_lines)
    # as many edges again from what is rare among all lines but common in bad ones
    edges = np.stack([np.sort(np.concatenate([np.quantile(x, np.arange(1, 5) / 5), np.quantile(x[bad_lines], np.arange(1, 4) / 4)])) for x in measures.T])
    lines = gather(edges, measures, n_lines)
    good = np.repeat(labels.astype(float), n_lines)
    theta = train(lines, good, np.zeros(width + 6), FIRST_STEPS)
    flat, _ = chains(lines.unary(theta[:width]), lines, theta[width : width + 2], theta[width + 2 :].reshape(2, 2))
    first = np.cumsum(n_lines) - n_lines
    worst = flat <= np.repeat(np.minimum.reduceat(flat, first), n_lines)
    theta = train(lines, np.where(bad_lines & (flat > 0.5) & ~worst, 1.0, good), theta, MORE_STEPS)
    return Model(edges, theta[:width], theta[width : width + 2], theta[width + 2 :].reshape(2, 2))


def line_marginals(model: Model, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text the probability of `good` and the length of each line."""
    out: list = [None] * len(texts)
    for own in _by_chars(texts):
        measures, length, n_lines = measure([texts[i] for i in own])
        unary = model.unary(model.slots(measures, n_lines))
        first = np.cumsum(n_lines) - n_lines
        order = np.argsort(n_lines, kind="stable")[::-1]
        at = 0
        while at < len(order):
            part = order[at : at + max(1, CHUNK_SLOTS // int(n_lines[order[at]]))]
            steps = np.arange(int(n_lines[part].max()))
            mask = steps < n_lines[part][:, None]
            p, _ = forward_backward(unary[np.where(mask, first[part][:, None] + steps, 0)], mask, model.start, model.pairs)
            for k, d in enumerate(part.tolist()):
                n = int(n_lines[d])
                out[own[d]] = (p[k, :n], length[first[d] : first[d] + n])
            at += len(part)
    return out


def _by_chars(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, some CHUNK_CHARS characters at a time."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, lines and measures of whole texts."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for own in _by_chars(texts):
            measures, _, n_lines = measure([texts[i] for i in own])
            ends = np.cumsum(n_lines)
            cells = [measures[e - n : e].tobytes() for e, n in zip(ends.tolist(), n_lines.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(n_lines), pa.array(cells, pa.binary())], names=["id", "y", "lines", "measures"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", may_learn: Column | None = None) -> Model:
    """Fit on the whole texts of about FIT_ROWS rows of each label at most, chosen by a hash of their id, from rows that `may_learn` admits.

    Rows with null ids, labels or texts teach nothing; of rows that share an id the least text and the least label teach.
    Lines are measured where the texts lie; only their measures reach the driver."""
    may = ~held_out(doc_id) if may_learn is None else may_learn
    known = labels.filter(may & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__y"))
    seen = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = hash_share(F.col("__id"), F.lit(3))
    share = F.coalesce(*[F.when(F.col("__y") == y, min(1.0, FIT_ROWS / n)) for y, n in seen.items()], F.lit(0.0))
    chosen = known.filter(place < share).limit(4 * FIT_ROWS)
    rows = docs.filter(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(F.col("__id").cast("long").alias("__id"), "__y", F.col(text).cast("string").alias("__t"))
    rows = rows.groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    table = rows.mapInArrow(_measured, "id long, y int, lines long, measures binary").toArrow().sort_by("id")
    cells = b"".join(table["measures"].to_pylist())
    return fit_lines(np.frombuffer(cells, dtype=np.float64).reshape(-1, len(MEASURES)), table["lines"].to_numpy(), table["y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality") -> DataFrame:
    """Add the length-weighted mean probability of `good` over all lines of each whole text.

    Lines end at a line feed; each weighs one more than its characters, so null and empty texts count as one empty line.
    Repeated rows: each by itself. Empty table: empty result. A column named like `into` is replaced; others pass through."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            whole = [t if isinstance(t, str) else "" for t in texts]
            yield pd.Series([float((p * (n + 1)).sum() / (n + 1).sum()) for p, n in line_marginals(model, whole)], dtype="float64")

    return docs.withColumn(into, of(F.col(text).cast("string")))


def label_lines(docs: DataFrame, model: Model, text: str = "text", into: str = "good_lines") -> DataFrame:
    """Add the probability of `good` of every line, in order."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([p.tolist() for p, _ in line_marginals(model, [t if isinstance(t, str) else "" for t in texts])])

    return docs.withColumn(into, of(F.col(text).cast("string")))
