"""Ranked lexical search over a bit-sliced index of impacts.

Documents are taken in blocks. For each term a block holds bitmaps, one for each bit of the term's impact (weight times saturated
frequency), over the documents of the block. A query adds the bitmaps of its terms by carry arithmetic, 64 documents at a time,
and finds its best documents by going down the slices of the sum from the most significant one; no score is computed by itself."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import cut

#: Documents of a block, at most. A task keeps the bitmaps of one block.
BLOCK = 1 << 14
#: Terms, with repeats, of the items that are searched for in one pass; the items of a pass are sent to every task.
PASS_TERMS = 1 << 19
_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes(32 if c in _BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: ASCII letters and digits and all other signs beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_FOLD).split() if text else []


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """The bitmaps of some documents: for each term the 64-document words that it touches, and one row of words for each bit."""

    def __init__(self, size: int) -> None:
        self.words = -(-size // 64)
        self.slices: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def put(self, term: int, place: np.ndarray, impact: np.ndarray) -> None:
        """`place` ascends, each document once; impacts are above 0."""
        most = int(impact.max())
        word, first = np.unique(place >> 6, return_index=True)
        bits = np.uint64(1) << (place & 63).astype(np.uint64)
        planes = np.empty((most.bit_length(), len(word)), np.uint64)
        for b in range(len(planes)):
            planes[b] = np.bitwise_or.reduceat(np.where((impact >> b) & 1, bits, np.uint64(0)), first)
        self.slices[term] = (word, planes, most)

    def total(self, query: list[tuple[int, int]]) -> np.ndarray | None:
        """Bit slices of the sum of impact times repeats over the terms of a query; None where no term is here."""
        held = [(self.slices[t], times) for t, times in query if t in self.slices]
        if not held:
            return None
        out = np.zeros((sum(most * times for (_, _, most), times in held).bit_length(), self.words), np.uint64)
        for (word, planes, _), times in held:
            for shift in range(times.bit_length()):
                if times >> shift & 1:
                    _add(out, word if len(word) < self.words else slice(None), planes, shift)
        return out

    def best(self, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the k documents with the greatest sums above 0; of equal sums the first places."""
        sure, maybe = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(total, axis=0)
        for plane in total[::-1]:
            one = maybe & plane
            n = int(np.bitwise_count(sure | one).sum())
            if n > k:
                maybe = one
            else:
                sure, maybe = sure | one, maybe & ~plane
        left = k - int(np.bitwise_count(sure).sum())
        place = np.sort(np.concatenate([_places(sure), _places(maybe)[:left]]))
        bit = (total[:, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        return place, (bit.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def _places(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


def _add(out: np.ndarray, word: np.ndarray | slice, planes: np.ndarray, shift: int) -> None:
    """Add numbers given as bit slices to those of `out`, at the words named, carrying from slice to slice."""
    carry = None
    for b in range(shift, len(out)):
        a = out[b, word]
        if b - shift < len(planes):
            p = planes[b - shift]
            either, onward = a ^ p, a & p
            if carry is not None:
                either, onward = either ^ carry, onward | (carry & either)
        elif carry is None or not carry.any():
            return
        else:
            either, onward = a ^ carry, a & carry
        out[b, word], carry = either, onward  # last, as `a` may be a view of `out`


def count_terms(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n` (terms with repeats), `term` and `tf` (arrays: numbers of the given terms in the document, ascending, and how
    often each occurs) for each document that has a term at all."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                ids, ns, term, tf = [], [], [], []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = terms_of(text)
                    if words:
                        found = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                        ids.append(i)
                        ns.append(len(words))
                        term.append([t for t, _ in found])
                        tf.append([c for _, c in found])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(count, "doc_id long, n long, term array<int>, tf array<int>")


def blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """Ids (ascending, null ones last), which of them are null, and the index of up to `size` documents, again and again."""
    tables, held = [], 0

    def build(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Block]:
        rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
        block = Block(len(rows))
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
        term, tf, n = flat("term"), flat("tf"), rows.column("n").to_numpy()
        each = rows.column("term").combine_chunks().value_lengths().to_numpy()
        place = np.repeat(np.arange(len(rows)), each)
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
        order = np.argsort(term, kind="stable")
        order = order[impact[order] > 0]
        term, place, impact = term[order], place[order], impact[order]
        at = np.flatnonzero(np.diff(term, prepend=-1))
        for a, b in zip(at, [*at[1:], len(term)], strict=True):
            block.put(int(term[a]), place[a:b], impact[a:b])
        ids = rows.column("doc_id")
        return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), block

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - held)
            tables.append(part)
            held += part.num_rows
            at += part.num_rows
            if held == size:
                yield build(pa.Table.from_batches(tables))
                tables, held = [], 0
    if held:
        yield build(pa.Table.from_batches(tables))


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, int | None, dict[bytes, int]]]]:
    """Number, id and counted terms of the items, so many at a time that their terms have a bound (but for a single item)."""
    rows, held = [], 0
    for number, r in enumerate(items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator()):
        words = terms_of(bytes(r["t"]) if r["t"] is not None else None)
        if not words:
            continue
        if rows and held + len(words) > PASS_TERMS:
            yield rows
            rows, held = [], 0
        rows.append((number, r["i"], Counter(words)))
        held += len(words)
    if rows:
        yield rows


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank from 1, doc_id, score; equal scores by ascending doc_id.

    Items are the stated query set: they are read in bounded passes, and in a pass every block of documents meets all items of it.
    The index holds every document and the terms that a pass asks for. Null and empty texts: no terms, so no row. Repeated document
    rows: a document each. Repeated items: each is ranked, so its rows are repeated. Null document ids come after others of equal
    score; null item ids are items. Empty tables: empty result. Other columns are left out, whatever their names."""
    spark = docs.sparkSession
    found = [_search(docs, pass_, k, doc_id, text, block) for pass_ in _passes(items, item_id, item_text)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, pass_: list[tuple[int, int | None, dict[bytes, int]]], k: int, doc_id: str, text: str, block: int) -> DataFrame:
    """The k best of every block for each item of a pass."""
    terms = sorted({t for _, _, counts in pass_ for t in counts})
    number = {t: i for i, t in enumerate(terms)}
    counted = cut(count_terms(docs, terms, doc_id, text))
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["c"] for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}
    weight = np.array([_weight(n_docs, df.get(i, 0)) for i in range(len(terms))], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((weight, [(at, item, [(number[t], c) for t, c in counts.items()]) for at, item, counts in pass_]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = sent.value
        for ids, none, index in blocks(batches, weight, n_docs, n_terms, block):
            out = [[], [], [], []]
            for at, item, query in queries:
                total = index.total(query)
                if total is None:
                    continue
                place, score = index.best(total, k)
                for column, values in zip(out, ([at] * len(place), [item] * len(place), [None if none[p] else int(ids[p]) for p in place], score.tolist()), strict=True):
                    column.extend(values)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["number", "item_id", "doc_id", "score"])

    return counted.mapInArrow(search, "number long, item_id long, doc_id long, score long")
