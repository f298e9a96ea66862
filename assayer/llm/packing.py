"""Best-fit packing of tokenised documents into sequences, after a dominance reduction of the instance.

Lengths are whole numbers up to the capacity, so an instance is the count of pieces of each length: at most `capacity`
numbers, whatever the number of documents. The reduction and the best fit run on these counts and give a plan of fill
patterns; the pieces are then numbered within their length and take their places in the plan, all as Spark jobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import cut

CAPACITY = 2048
END = 0
#: Parts that the pieces of one length are numbered in.
PARTS = 512
#: Words whose ids a task keeps; beyond it the memory of words starts anew.
KNOWN_WORDS = 300_000
#: Texts are tokenised about so many characters at a time, to bound memory.
BATCH_CHARS = 1_000_000
#: Signs that end many words. The vocabulary splits letters from such a run, so both parts are tokenised by themselves.
ENDINGS = ".,;:!?)*$%&#"
#: Strings around this are tokens of their own to the tokenizer, in just this spelling.
SPECIAL = "<|"


class Tokens:
    """Token ids of whole texts. The vocabulary ignores case and drops white space before it splits, so a text's ids are those of
    its words one after the other, and a word is tokenised once for many occurrences."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Keep nothing but the empty word, which has no ids."""
        self.places: dict[str, int] = {"": 0}
        self.pool, self.starts, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])

    def encode(self, words: list[str]) -> None:
        """Learn the ids of new words. Words of letters alone end at the only token that ends a word, so many go in one call."""
        letters, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters):
                self.keep(letters, ids, np.diff(ends, prepend=0))
            else:
                others = words
        if others:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self.keep(others, np.array([i for e in each for i in e], dtype="<u4"), np.array([len(e) for e in each], dtype=np.int64))

    def learn(self, words: list[str]) -> np.ndarray:
        """Places of the two parts of each word, learning those that are new: letters and the signs after them, or all and nothing."""
        if len(self.places) > KNOWN_WORDS:
            self.forget()
        parts = []
        for w in words:
            core = w.rstrip(ENDINGS)
            parts += (w, "") if core is w or not core.isalpha() else (core, w[len(core) :])
        places = self.places
        self.encode(list(dict.fromkeys(x for x in parts if x not in places)))
        return np.fromiter(map(places.__getitem__, parts), dtype=np.int64, count=len(parts)).reshape(-1, 2)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end. Only ASCII space and line feed part words
        here; the tokenizer sees to the rest. Null texts have no ids."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, SPECIAL)
        plain = pc.if_else(special, "", pc.ascii_lower(texts))
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        flat = pc.dictionary_encode(parts.flatten())
        place = self.learn(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)].ravel()
        n = self.sizes[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.starts[place], n)
        ids = self.pool[at]
        bounds = ends[2 * (parts.offsets.to_numpy(zero_copy_only=False) - parts.offsets[0].as_py())]
        if pc.any(special).as_py():
            each = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                each[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype="<u4")
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and a final 0, cut every `capacity` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size) // BATCH_CHARS
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(int(rows[0]), len(rows))
                ids, bounds = tokens.of(part.column(1))
                data, out = memoryview(ids.tobytes()), []
                for d, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    total = b - a + 1
                    for k, start in enumerate(range(0, total, capacity)):
                        last = min(start + capacity, total)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * min(a + last, b)])
                        out.append((d, k, start, last - start, zlib.crc32(end, crc) if last == total else crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Fill:
    """`count` sequences filled alike: (length, how many of it) in the order they were placed."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)


def reduce(counts: np.ndarray, capacity: int) -> list[Fill]:
    """Martello and Toth's reduction on counts by length; takes what it fixes out of `counts`.

    For each length, longest first: where nothing else fits beside it, it stands alone; where one other length fills the
    sequence exactly, or at most one further piece fits at all, the pair with the longest that fits dominates every set
    that holds the piece. Passes repeat until nothing more is fixed."""
    fixed: list[Fill] = []
    changed = True
    while changed:
        changed = False
        for length in np.flatnonzero(counts)[::-1].tolist():
            while counts[length]:
                room = capacity - length
                present = np.flatnonzero(counts[: room + 1])
                if length <= room and counts[length] == 1:
                    present = present[present != length]
                if not len(present):
                    n, items = int(counts[length]), [(length, 1)]
                else:
                    mate = int(present[-1])
                    least = int(present[0])
                    second = least if counts[least] > 1 + (least == length) else int(present[1]) if len(present) > 1 else capacity
                    if mate != room and least + second <= room:
                        break
                    if mate == length:
                        n, items = int(counts[length]) // 2, [(length, 2)]
                    else:
                        n, items = int(min(counts[length], counts[mate])), [(length, 1), (mate, 1)]
                for x, k in items:
                    counts[x] -= n * k
                fixed.append(Fill(n, items))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Fill]:
    """Best fit of the counts, longest first: each piece goes where it leaves the least room; alike sequences move together."""
    open_by_room: list[list[Fill]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        for room in range(length, capacity):
            while n and open_by_room[room]:
                fill = open_by_room[room].pop()
                each = room // length
                whole = min(fill.count, n // each)
                if whole:
                    open_by_room[room - each * length].append(Fill(whole, [*fill.items, (length, each)]))
                    n -= whole * each
                rest = fill.count - whole
                if rest and 0 < n < each:
                    open_by_room[room - n * length].append(Fill(1, [*fill.items, (length, n)]))
                    rest, n = rest - 1, 0
                if rest:
                    open_by_room[room].append(Fill(rest, fill.items))
            if not n:
                break
        each = capacity // length
        if n // each:
            open_by_room[capacity - each * length].append(Fill(n // each, [(length, each)]))
        if n % each:
            open_by_room[capacity - (n % each) * length].append(Fill(1, [(length, n % each)]))
    return [f for fills in open_by_room for f in fills]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Places by length: ranks [first, first + each * count) of a length lie `each` to a sequence from `sequence` on, at `offset`."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in counts.items():
        left[k] = n
    fills = reduce(left, capacity)
    fills += best_fit(left, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for f in fills:
        at = 0
        for length, each in f.items:
            rows.append((length, used[length], each, f.count, sequence, at))
            used[length] += each * f.count
            at += each * length
        sequence += f.count
    return pd.DataFrame(rows, columns=["length", "first", "each", "count", "sequence", "offset"])


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and any more columns).

    The driver sees only the count of pieces by length, `capacity` numbers at most, and the plan made from them. Pieces of
    one length are numbered in PARTS parts by a hash of their document, so no length meets in one task. Repeated rows are
    pieces of their own. No pieces: empty result."""
    # repeated rows (copies made on purpose) get places of their own: ties are numbered in any order
    part = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(PARTS)).cast("int")
    own = Window.partitionBy("length", "__part").orderBy("doc_id", "piece")
    rows = cut(cut_pieces.withColumn("__part", part).withColumn("__row", F.row_number().over(own).cast("long") - 1))
    by_part = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    bases = by_part.select("length", "__part", before)
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = plan(counts, capacity)
    ranked = rows.join(bases, ["length", "__part"]).withColumn("__rank", F.col("__row") + F.col("__before"))
    lookup = {k: g.drop(columns="length").to_numpy() for k, g in table.groupby("length")}
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])
    kept = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    shared = rows.sparkSession.sparkContext.broadcast(lookup)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                t = lookup[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                i = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + i // row[:, 1]
                offset[at] = row[:, 4] + (i % row[:, 1]) * k
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, *schema.names])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*kept).schema.fields)
    return ranked.select(*kept, "__rank").mapInArrow(place, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null or empty text: a piece of the final 0 alone. Null ids and repeated rows: documents of their own. Empty table:
    empty result. Extra columns do not matter."""
    return pack(pieces(docs, tokenizer_path, capacity, doc_id, text), capacity)
