"""Line dedup by content-defined chunks.

A rolling hash runs over the hashes of neighbouring lines, and a chunk begins where it is least: what begins a chunk depends on the
lines there alone, so a passage has the same chunks inside whatever stands before and after it, and however far it is moved. Chunks
that were seen before anywhere are anchors: they grow by the line before and the line after where these agree as well, and what they
cover goes once its bytes have been compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SALTS, cut, first_of_group, let

#: Lines that the rolling hash covers, and so lines of a chunk. A repeated single line is no passage.
SPAN = 2
#: Lines of more words than this are a chunk whatever their hashes: one such line by itself, or SPAN lines together.
LONG = 50
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def rolling(hashes: np.ndarray) -> np.ndarray:
    """The rolling hash at each line: of its hash and those of the next SPAN - 1 lines."""
    roll = np.zeros(max(len(hashes) - SPAN + 1, 0), np.uint64)
    for k in range(SPAN):
        roll = roll * _BASE + hashes[k : k + len(roll)]
    roll *= _MIX
    return roll ^ (roll >> np.uint64(29))


def chunks(lines: list[bytes], hashes: np.ndarray) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of a text, by start.

    A chunk begins at each line where the rolling hash is no greater than at the line before or no greater than at the line after: of
    any two neighbours one begins a chunk, so every passage of three lines or more holds a chunk that depends on the passage alone,
    and chunks of SPAN lines leave no more than its first and its last line uncovered. SPAN lines of more than LONG words together
    are a chunk wherever they stand, and so is one line of more than LONG words."""
    roll = rolling(hashes)
    least = np.ones(len(roll), bool)
    if len(roll) > 1:
        falls = roll[1:] <= roll[:-1]
        rises = roll[:-1] <= roll[1:]
        least = np.r_[False, falls] | np.r_[rises, False]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    for i in np.flatnonzero(~least & (sizes[:-1] + sizes[1:] > 2 * LONG) if len(roll) else least):
        least[i] = sum(len(x.split()) for x in lines[i : i + SPAN]) > LONG
    out = [(int(i), SPAN) for i in np.flatnonzero(least)]
    return out + [(int(i), 1) for i in np.flatnonzero(sizes > 2 * LONG) if len(lines[i].split()) > LONG]


FOUND = "__id long, __text long, start int, lines int, h1 long, h2 long, previous long, next long"


def find_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __text (hash), start, lines, h1 and h2 (128 bits of its bytes) of every chunk, and the hashes of the line before and the
    line after it (null at the ends of a text, and for chunks of a single line, which do not grow)."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in FOUND.split(", "))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            digests = []
            for d, h, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines = (t or "").encode().split(b"\n")
                if len(lines) < SPAN and len(lines[0]) <= 2 * LONG:
                    continue
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
                near = hashes.view(np.int64).tolist()
                for start, n in chunks(lines, hashes):
                    end = start + n
                    out.append((d, h, start, n, near[start - 1] if n == SPAN and start else None, near[end] if n == SPAN and end < len(lines) else None))
                    digests.append(xxhash.xxh3_128_digest(b"\n".join(lines[start:end])))
            if out:
                both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                d, h, start, n, before, after = zip(*out, strict=True)
                columns = (d, h, start, n, both[:, 0], both[:, 1], before, after)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text).alias("__text"), F.col(text).alias("t")).mapInArrow(of, FOUND)


def remove_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove from each text the passages that chunks show to be in an earlier document, or in an earlier place of the same one that
    they do not overlap.

    Every passage of three lines or more, of two lines with more than LONG words, or of one line of more than LONG words is found,
    whatever its neighbours; of shorter ones of two lines those whose chunk falls in step in both places, which is always so where
    the passage is a whole text. Earlier is by doc_id (null first), then place, in the texts as given. Chunks are compared by 128-bit
    hashes; before anything goes, the bytes of all that chunks of one hash cover, grown alike, are compared with each other and with
    the first place, and where they differ nothing of them is removed. What is removed stands line by line in places that stay.

    Adds `removed_chunks`, how many unbroken runs of lines went, and `removed_lines`; lines that stay keep their order and bytes.
    Null text stays null, empty texts and single lines of LONG words at most stay as they are. Rows equal in id and text are one
    document and get one result each. Empty table: empty result. Columns named like the added ones are replaced; other columns
    pass through."""
    return _remove(docs, doc_id, text, find_chunks(docs, doc_id, text))


def _remove(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """docs without what repeated ones of the `found` chunks cover, with removed_chunks (runs of lines) and removed_lines."""
    found = cut(found)
    place = F.struct("__id", "__text", "start", "previous", "next")
    # most chunks are unlike any other, so they only meet as hashes that are counted; the rest goes on
    repeated = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    again = cut(found.join(repeated, ["h1", "h2"], "left_semi"))
    seen = first_of_group(again, ["h1", "h2"], place, "first", "n", repeated_only=True)
    # within one text a chunk may not grow into its first place; one that overlaps it repeats nothing: of equal lines in a row, the first SPAN stay
    same_text = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__text") == F.col("first.__text"))
    room = F.when(same_text, F.col("start") - F.col("first.start") - F.col("lines")).otherwise(2)
    agree = lambda side: F.coalesce((F.col(side) == F.col(f"first.{side}")).cast("int"), F.lit(0))
    grown = seen.withColumn("room", room).filter("room >= 0").withColumn("e1", F.least(agree("previous"), "room")).withColumn("e2", F.least(agree("next"), F.col("room") - F.col("e1")))
    cover = lambda start, first: F.struct((start - F.col("e1")).cast("int").alias("start"), (F.col("lines") + F.col("e1") + F.col("e2")).cast("int").alias("lines"), "h1", "h2", "e1", "e2", F.lit(first).alias("first")).alias("chunk")
    # the chunk and its first place, which is compared too, in one reading; sets of a task hold the first place of many copies once
    both = F.array(F.struct("__id", "__text", cover(F.col("start"), False)), F.struct(F.col("first.__id").alias("__id"), F.col("first.__text").alias("__text"), cover(F.col("first.start"), True)))
    own = grown.select(F.inline(both))
    marks = cut(own.groupBy("__id", "__text").agg(F.collect_set("chunk").alias("__chunks")))
    kept = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    rows = docs.select(*kept).withColumn("__hash", F.xxhash64(text))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
    key = ["h1", "h2", "e1", "e2"]
    bytes_of = lambda lines, c: F.struct(*[c[k].alias(k) for k in key], F.array_join(F.slice(lines, c["start"] + 1, c["lines"]), "\n").alias("bytes"))
    parts = let(F.split(F.col(text), "\n", -1), lambda lines: F.transform("__chunks", lambda c: bytes_of(lines, c)))
    # all columns are read here as below, so that one exchange of the texts serves both joins
    nulls = sum((F.col(c).isNull().cast("int") for c in kept), F.lit(0))
    compared = rows.join(marks, same).select(nulls.alias("nulls"), parts.alias("parts")).select("nulls", F.inline("parts"))
    unequal = compared.groupBy(*key).agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.sum("nulls").alias("nulls")).filter("low <> high AND nulls >= 0").select(*key)
    gone = marks.select("__id", "__text", F.explode(F.filter("__chunks", lambda c: ~c["first"])).alias("c")).select("__id", "__text", "c.start", "c.lines", *[f"c.{k}" for k in key])
    # one hash may be that of a third of all windows, so they meet the few unequal ones in parts
    salted = unequal.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = gone.withColumn("__salt", F.pmod(F.xxhash64("__id", "__text", "start"), F.lit(SALTS)).cast("int"))
    sure = gone.join(salted, [*key, "__salt"], "left_anti").groupBy("__id", "__text").agg(F.collect_list(F.struct("start", "lines")).alias("__gone"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["start"], g["start"] + g["lines"] - 1)))))
    # runs of removed lines: their first lines, and their last
    edges = lambda at: F.struct(F.size(at).alias("n"), F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) < x - 1, F.lit(True))).alias("a"), F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) > x + 1, F.lit(True))).alias("b"))
    runs = sure.select("__id", "__text", let(numbers, edges).alias("__runs"))
    r = F.col("__runs")

    def rest(lines: Column) -> Column:
        """The lines before the first run, between runs and after the last."""
        start = lambda k: F.coalesce(F.get(r["b"], k - 1) + 1, F.lit(0))
        end = lambda k: F.coalesce(F.get(r["a"], k), F.size(lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(r["a"])), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))

    out = rows.join(runs, same, "left").withColumns(
        {
            text: F.when(r.isNull(), F.col(text)).otherwise(F.array_join(let(F.split(F.col(text), "\n", -1), rest), "\n")),
            "removed_chunks": F.when(r.isNull(), 0).otherwise(F.size(r["a"])),
            "removed_lines": F.coalesce(r["n"], F.lit(0)),
        }
    )
    return out.select(*kept, "removed_chunks", "removed_lines")
