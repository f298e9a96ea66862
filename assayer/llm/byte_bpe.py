"""Byte-level BPE by the tiktoken library over local rank files."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a part, and of a run of white space that is cut out: the library's look-ahead keeps a state for each character
#: of a run and fails at a million.
PART, RUN = 1 << 16, 1 << 14

#: A pattern that takes a text as one match.
ONE = r"[\s\S]+"
#: Places where one match of the splitting pattern ends and another begins, whatever stands around: no match goes on from a sign
#: that is no white space into white space, from a letter into a digit, or from a letter or digit into a punctuation mark.
SAFE = regex.compile(r"(?<=\P{White_Space})(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[\p{L}\p{N}])(?=[!-/:-@、。，])")
WHITE = regex.compile(rf"\p{{White_Space}}{{{RUN},}}")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder; once for each process."""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """The bytes of each id."""
    known = ranks(path)
    table = np.full(max(known.values()) + 1, None, dtype=object)
    table[list(known.values())] = list(known)
    return table


def _at_boundaries(text: str, start: int, end: int, part: int) -> Iterator[str]:
    while end - start > part and (m := SAFE.search(text, start + part, end)):
        yield text[start : m.start()]
        start = m.start()
    if end > start:
        yield text[start:end]


def parts(text: str, part: int = PART) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of a text, and whether a part is one match of the pattern; the parts' matches are those of the text.

    Parts end at safe places. A long run of white space is one match but for its last sign, which may belong to what follows."""
    if len(text) <= part:
        yield text, False
        return
    start = 0
    for run in WHITE.finditer(text):
        for piece in _at_boundaries(text, start, run.start(), part):
            yield piece, False
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : start], True
    for piece in _at_boundaries(text, start, len(text), part):
        yield piece, False


def encode_text(text: str | None, path: str, pattern: str, part: int = PART) -> np.ndarray:
    found = [encoder(path, ONE if one else pattern).encode_ordinary(piece) for piece, one in parts(text or "", part)]
    return np.concatenate([np.asarray(x, dtype=np.int32) for x in found])


def ids_of(text: Column, path: str, pattern: str) -> Column:
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [encode_text(t.as_py(), path, pattern) for t in texts]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *found]))

    return encode(text)


def bytes_of(ids: Column, path: str) -> Column:
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_bytes(path)
        for rows in batches:
            yield pa.array([None if x.values is None else b"".join(table[x.values.to_numpy(zero_copy_only=False)]) for x in rows], pa.binary())

    return decode(ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of each whole text, as the library gives them without special tokens.

    Null and empty text: no ids. Very long texts are encoded in parts that end where matches end, so no text is cut inside a match.
    Repeated rows: each by itself. Empty table: empty result. A column named like `into` is replaced; others pass through.
    `path` is the rank file's place on every machine."""
    return docs.withColumn(into, ids_of(F.col(text), path, pattern))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the raw bytes that the ids stand for; they need not be whole characters. Null ids: null; no ids: no bytes; an id that the
    file does not have is an error. A column named like `into` is replaced; others pass through."""
    return tokens.withColumn(into, bytes_of(F.col(ids), path))
