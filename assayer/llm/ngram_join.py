"""N-gram Jaccard join: a forest of sorted MinHash prefixes proposes families of texts, exact shingle sets decide every link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.shared import small_side
from assayer.llm.common import cut, range_hashes
from assayer.llm.components import connected_components
from assayer.llm.embedding_dedup import _forest

WORDS, THRESHOLD = 5, 0.8
#: Trees of the forest, values of a tree's signature (a byte each), and the recall that prefixes are shortened for.
TREES, DEPTH, RECALL = 32, 10, 0.998
#: Links less than this above the threshold are those whose recall is estimated: the hardest to find.
BAND = 0.05
#: Similarity of whole signatures at which a text joins the family of a group's leader, and at which the leader speaks for it.
#: Two texts at 0.8 are both within 0.5 of a leader that speaks for one of them; signatures of 320 values err by 0.03 or so.
NEAR, SAME = 0.5, 0.75
#: Groups of more texts that share a prefix meet their leaders in parts of about so many texts.
GROUP = 1_024
#: A task compares texts of about so many shingles and at most about so many texts on either side: the first number in small
#: families, the second in large ones, whose texts are sent to fewer blocks then.
BLOCK_SHINGLES, BLOCK_TEXTS, LARGE_BLOCK_TEXTS, COLUMNS = 200_000, 256, 2_048, 4_096
BATCH_CHARS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def found_by(similarity: float, length: int, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Where shortening ends at the latest: even texts of just the threshold's similarity meet as often as `recall` asks."""
    length = depth
    while length > 3 and found_by(threshold, length, trees) < recall:
        length -= 1
    return length


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """64-bit hashes of the windows of n words of each text, with repeats; shorter texts have one window of all their words, and
    texts without words none."""
    clean = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = clean.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[clean.offset : clean.offset + len(clean) + 1]
    letters = np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    first = ~_SPACE[letters]
    last = first.copy()
    inside = first[1:] & first[:-1]
    inside[bounds[(bounds > 0) & (bounds < len(letters))] - 1] = False  # a text ends here
    first[1:] &= ~inside
    last[:-1] &= ~inside
    starts = np.flatnonzero(first)
    words = _mix(range_hashes(letters, starts, np.flatnonzero(last) + 1))
    bounds = np.searchsorted(starts, bounds)
    rolled = np.zeros(len(words), np.uint64)
    size = len(words)
    for k in range(n):
        rolled[: size - k] = rolled[: size - k] * _ODD + words[k:] if k else words
    # windows of texts with fewer words start as the others do, but stop where the text does
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(_mix(rolled[a : b - n + 1]))
        elif b > a:
            h = b - a
            for w in words[a:b].tolist():
                h = (h * int(_ODD) + w) & ((1 << 64) - 1)
            out.append(_mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """MinHash signatures: `depth` bytes for each tree, each hashed from the least value of the shingles in an order of its own."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(23)
        self.a = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def sign(self, shingle: np.ndarray) -> bytes:
        x = (shingle >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(x), 128):
            part = x[at : at + 128, None] * self.a
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // BATCH_CHARS
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
        if len(rows):
            yield batch.slice(int(rows[0]), len(rows))


def verify(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of sorted sets whose Jaccard similarity reaches the threshold; i < j within left if right is None.

    Shared elements are counted by products of 0/1 matrices, over the elements that two sets or more hold."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    n = len(left)
    m = len(sets) - n if right is not None else n
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    element, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(element)) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, m), dtype=np.float32)
    total = int(shared.sum())
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, total - start)), dtype=np.float32)
        held[row[a:b], column[a:b] - start] = 1
        common += held[:n] @ (held[n:] if right is not None else held).T
    size_l, size_r = sizes[:n], sizes[n:] if right is not None else sizes
    union = size_l[:, None] + size_r[None] - common
    near = (common >= threshold * union - 1e-9) & (common > 0)
    if right is None:
        near = np.triu(near, 1)
    return np.nonzero(near)


def paths(node: np.ndarray, signatures: np.ndarray, trees: int, depth: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's place in each tree as two numbers that sort like its signature: tree and the first `short` bytes, and the other bytes."""
    sig = signatures.reshape(len(node), trees, depth).astype(np.int64)
    head = np.broadcast_to(np.arange(trees, dtype=np.int64), (len(node), trees))
    tail = np.zeros((len(node), trees), dtype=np.int64)
    for k in range(depth):
        head, tail = (head << 8 | sig[:, :, k], tail) if k < short else (head, tail << 8 | sig[:, :, k])
    return head.ravel(), tail.ravel(), np.repeat(node, trees)


def branches(head: np.ndarray, tail: np.ndarray, n: np.ndarray, depth: int, short: int) -> np.ndarray:
    """For each of the sorted, different paths that n texts have each, bit k - short: its prefix of length k is a branching of the
    trie, or at `depth` a leaf that texts share."""
    shared = np.full(max(len(head) - 1, 0), short)
    x = tail[1:] ^ tail[:-1]
    for j in range(depth - short):
        shared += (x >> (8 * j)) == 0  # that many leading bytes of the tail are equal, too
    before = np.concatenate([[0], np.where(head[1:] == head[:-1], shared, 0)]) if len(head) else np.zeros(0, np.int64)
    mask = (n > 1).astype(np.int32) << (depth - short)
    for k in range(short, depth):
        run = np.cumsum(before < k)
        parts = np.bincount(run, before == k, int(run[-1]) + 1) if len(run) else run
        mask |= (parts[run] > 0).astype(np.int32) << (k - short)
    return mask


def walk(batches: Iterator[pa.RecordBatch], depth: int, short: int) -> Iterator[pa.RecordBatch]:
    """Those of the sorted, different paths (head, tail, node, n) that stand at some branching, with `levels`. Paths of a head come
    one after another and are held until it ends; there are no more of them than tails, 256 ** (depth - short)."""
    held: list[tuple[np.ndarray, ...]] = []
    names = ["head", "tail", "node", "n"]

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            levels = branches(columns[0], columns[1], columns[3], depth, short)
            at = levels > 0
            if at.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (*columns, levels)], names=[*names, "levels"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
        head = columns[0]
        if held and held[0][0][0] != head[0]:
            yield from flush(held)
            held = []
        end = int(np.searchsorted(head, head[-1]))
        if end:
            yield from flush([*held, tuple(c[:end] for c in columns)])
            held = []
        held.append(tuple(c[end:] for c in columns))
    yield from flush(held)


class Leaders:
    """The texts of a group that no earlier one speaks for, with their signatures, and which of them are joined already."""

    def __init__(self):
        self.node: list[int] = []
        self.sig: list[np.ndarray] = []
        self.top: list[int] = []

    def find(self, k: int) -> int:
        while self.top[k] != k:
            self.top[k] = self.top[self.top[k]]
            k = self.top[k]
        return k

    def add(self, node: int, sig: np.ndarray, top: int | None = None) -> None:
        self.top.append(len(self.node) if top is None else top)
        self.node.append(int(node))
        self.sig.append(sig.copy())

    def meet(self, node: np.ndarray, sig: np.ndarray, elect: bool = True) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """Let texts meet all leaders, and lead in turn if they may. Returns edges (leader, node, similarity) that join what none
        joined before, fewer than the group has texts, though every text within NEAR of a leader ends up in one part with it;
        and the places of the texts that no leader speaks for, which are none where texts may lead."""
        edges: list[tuple[int, int, float]] = []
        left, k = np.arange(len(node)), 0
        home = np.full(len(node), -1)
        while len(left):
            if k == len(self.node):
                if not elect:
                    break
                i, left = int(left[0]), left[1:]
                self.add(node[i], sig[i], self.find(home[i]) if home[i] >= 0 else None)
            alike = (sig[left] == self.sig[k]).mean(axis=1)
            near = alike >= NEAR
            new = left[near & (home[left] < 0)]
            edges += [(self.node[k], int(node[i]), float(s)) for i, s in zip(new, alike[near & (home[left] < 0)], strict=True)]
            old = np.flatnonzero(near & (home[left] >= 0))
            for h in np.unique(home[left[old]]).tolist():  # a text near leaders of two parts joins them
                if self.find(h) != self.find(k):
                    j = old[home[left[old]] == h][0]
                    edges.append((self.node[k], int(node[left[j]]), float(alike[j])))
                    self.top[self.find(h)] = self.find(k)
            home[new] = k
            left, k = left[alike < SAME], k + 1
        return edges, left


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, np.ndarray, np.ndarray]]:
    """Sorted rows (keys, node, signature) by runs of equal keys: key, whether it is a new one, nodes, signatures."""
    at: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        *key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 1))
        sig = np.frombuffer(b"".join(batch.column(keys + 1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(node)], strict=True):
            here = tuple(int(c[i]) for c in key)
            yield here, here != at, node[i:j], sig[i:j]
            at = here


def _edge_columns(edges: list[tuple[int, int, float]]) -> list[pa.Array]:
    a, b, s = (np.array(c) for c in zip(*edges, strict=True))
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)]


def follow_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, s: similarity of signatures >= NEAR) of groups that come one after another (head, prefix, node, signature).

    The first text of a group leads; texts that no leader speaks for lead in turn. Every text meets every leader, so of two
    similar texts of a group both end up in one family. Only the leaders' signatures of one group are held."""
    leaders = Leaders()
    for _, new, node, sig in _runs(batches, 2):
        leaders = Leaders() if new else leaders
        edges, _ = leaders.meet(node, sig)
        if edges:
            yield pa.RecordBatch.from_arrays(_edge_columns(edges), names=["a", "b", "s"])


def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaders that groups of rows (head, prefix, node, signature) choose, as rows of the same kind."""
    leaders = Leaders()
    for key, new, node, sig in _runs(batches, 2):
        leaders = Leaders() if new else leaders
        had = len(leaders.node)
        leaders.meet(node, sig)
        chosen = leaders.node[had:]
        if chosen:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(chosen)), pa.array([key[1]] * len(chosen)), pa.array(chosen), pa.array([x.tobytes() for x in leaders.sig[had:]], pa.binary())], names=["head", "prefix", "node", "sig"])


def meet_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, prefix, part, text: 0 for a leader, node, signature), leaders of a part first: edges as in `follow_leaders`, and
    rows (head, prefix, node) of the texts that no leader speaks for."""
    leaders, at = Leaders(), None
    for (head, prefix, part, text), _, node, sig in _runs(batches, 4):
        if at != (head, prefix, part):
            leaders, at = Leaders(), (head, prefix, part)
        if not text:
            for i in range(len(node)):
                leaders.add(node[i], sig[i])
            continue
        edges, rest = leaders.meet(node, sig, elect=False)
        edges = [e for e in edges if e[0] != e[1]]  # leaders meet themselves
        n, m = len(edges), len(rest)
        if n + m:
            ends = _edge_columns(edges) if n else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
            columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in ends]
            columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in (np.full(m, head), np.full(m, prefix), node[rest])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "s", "head", "prefix", "node"])


def group_edges(rows: DataFrame, nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b, s) of the groups that rows (head, prefix, node) make, whatever the size of a group.

    A group of `group` texts or fewer meets in one place. Of a larger one, a part of about that size elects leaders; all its
    parts, each with a copy of them, meet these leaders side by side, and texts that none of them speaks for make a smaller
    group, which goes the same way. So every text meets all leaders up to one that speaks for it, as in one place."""
    keys, signed = ["head", "prefix"], nodes.select("node", "sig")
    found: DataFrame | None = None
    again = 0
    while True:
        big = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select(*keys, F.ceil(F.col("n") / group).cast("int").alias("parts")))
        last = big.isEmpty()
        few = small_side(big)
        whole = rows if last else rows.join(few, keys, "left_anti")
        edges = whole.join(signed, "node").select(*keys, "node", "sig").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(follow_leaders, "a long, b long, s double")
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        part = F.pmod(F.xxhash64("node", F.lit(again)), F.col("parts")).cast("int")
        dealt = rows.join(few, keys).join(signed, "node").select(*keys, part.alias("part"), "node", "sig")
        # should this part be empty, no text is spoken for, and the next round deals by another hash
        pool = dealt.filter("part = 0").select(*keys, "node", "sig")
        leaders = cut(pool.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(elect, "head long, prefix long, node long, sig binary"))
        copies = leaders.join(few, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("text"), "node", "sig")
        both = copies.unionByName(dealt.withColumn("text", F.lit(1))).select(*keys, "part", "text", "node", "sig")
        met = cut(both.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "text", "node").mapInArrow(meet_leaders, "a long, b long, s double, head long, prefix long, node long"))
        found = found.unionByName(met.filter("a is not null").select("a", "b", "s"))
        rows, again = met.filter("a is null").select(*keys, "node"), again + 1


def forest_edges(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, group: int = GROUP) -> DataFrame:
    """Edges (a, b, s) that join leaders and members of the groups that share prefixes of signatures (`node`, `sig` of each text).

    All trees are sorted once, by their different paths: texts of one path are counted where they lie, so a path that many
    share is one row. Groups of texts that share all `depth` values are judged first, then shorter and shorter
    prefixes, only where tries branch, until the estimated recall of links near the threshold reaches `recall`: each
    found link stands for 1 / (its chance of being found) links. Prefixes end at `shortest_prefix`, where that chance is
    enough for any link. Groups of more than `group` texts are split (`group_edges`)."""
    short = shortest_prefix(threshold, trees, depth, recall)
    depth = min(depth, short + 7)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, trees, -1)[:, :, :depth]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in paths(batch.column(0).to_numpy(), sig, trees, depth, short)], names=["head", "tail", "node"])

    laid = nodes.select("node", "sig").mapInArrow(lay, "head long, tail long, node long")
    different = laid.groupBy("head", "tail").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    walked = cut(different.repartition("head").sortWithinPartitions("head", "tail").mapInArrow(lambda batches: walk(batches, depth, short), "head long, tail long, node long, n long, levels int"))
    leaves = walked.filter("n > 1").select("head", "tail", "levels")
    trie = cut(walked.filter("n = 1").select("head", "tail", "node", "levels").unionByName(laid.join(small_side(leaves), ["head", "tail"]).select("head", "tail", "node", "levels")))
    found: DataFrame | None = None
    for length in range(depth, short - 1, -1):
        rows = trie.filter(F.col("levels").bitwiseAND(1 << (length - short)) != 0).select("head", F.shiftright("tail", 8 * (depth - length)).alias("prefix"), "node")
        edges = group_edges(rows, nodes, group)
        found = cut((edges if found is None else found.unionByName(edges)).distinct())
        if length > short:
            s = F.col("s")
            hard = s < threshold + BAND
            weight = 1 / (1 - F.pow(1 - F.pow(s, F.lit(length)), F.lit(trees)))
            n = found.filter(s >= threshold).agg(F.count_if(hard).alias("n"), F.sum(F.when(hard, weight)).alias("w"), F.count(F.lit(1)).alias("all_n"), F.sum(weight).alias("all_w")).first()
            if n["n"] and n["n"] / n["w"] >= recall or not n["n"] and n["all_n"] and n["all_n"] / n["all_w"] >= recall:
                break
    return found


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, n_links, class_id, kept of every row: links join rows whose sets of word windows reach the threshold.

    Equal texts are one class from the start. `forest_edges` proposes which texts may be alike: texts whose signatures agree
    to NEAR with a common leader, directly or through others, form a family, and inside a family every pair is compared
    exactly, in blocks of bounded size. A class is what links join; `class_id` is its least doc_id and `kept` marks the rows
    with it. Texts with fewer than `words` words are one window; texts without words and rows with a null id link with
    nothing. Words are what stands between ASCII white space, as written. Repeated rows link with each other. Empty table:
    empty result. Other columns are dropped."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("fp", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(trees, DEPTH)
        for whole in batches:
            for batch in _batches(whole, 1):
                found = shingles(batch.column(1), words)
                signed = [signer.sign(s) if len(s) else b"" for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", "fp", "size", "sig"])

    known_ids = source.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "fp")
    signed = cut(known_ids.mapInArrow(sign, "doc_id long, fp binary, size long, sig binary"))  # it is read twice
    # partial sums and minima of each task meet, so a text that a third of rows hold is one row of each task
    texts = signed.filter("size > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    # the checkpoint fixes these ids
    nodes = cut(texts.select(F.monotonically_increasing_id().alias("node"), "rep", "fp", "copies", "size", "sig"))
    families = connected_components(forest_edges(nodes, threshold, trees, DEPTH, recall, group))
    members = cut(families.join(nodes.select(F.col("node").alias("id"), "rep", F.col("fp").alias("__fp"), "copies", "size"), "id"))
    weights = members.groupBy("component").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    side = F.greatest(F.lit(BLOCK_TEXTS), F.least(F.lit(LARGE_BLOCK_TEXTS), F.col("n") / 16))
    blocks = weights.select("component", F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("n") / side)).cast("int").alias("blocks"))
    placed = members.join(blocks, "component").select("component", "blocks", F.col("id").alias("node"), "rep", "__fp", "copies")
    held = source.join(placed, (F.col("doc_id") == F.col("rep")) & (F.col("fp") == F.col("__fp")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = held.select("component", "node", "copies", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "copies", "text")

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        both = both.drop_duplicates("node")
        p, q = int(both["p"].iloc[0]), int(both["q"].iloc[0])
        sides = [both] if p == q else [both[both["own"] == p], both[both["own"] == q]]
        sets = [[np.unique(s) for s in shingles(pa.array(d["text"], pa.string()), words)] for d in sides]
        i, j = verify(sets[0], sets[1] if p != q else None, threshold)
        a, b = sides[0]["node"].to_numpy()[i], sides[-1]["node"].to_numpy()[j]
        na, nb = sides[0]["copies"].to_numpy()[i], sides[-1]["copies"].to_numpy()[j]
        gained = pd.DataFrame({"a": np.concatenate([a, b]), "links": np.concatenate([nb, na])}).groupby("a", as_index=False)["links"].sum()
        forest = _forest(a, b)
        return pd.DataFrame({"a": np.concatenate([gained["a"].to_numpy(), np.array([e[0] for e in forest], dtype=np.int64)]), "b": pd.array([None] * len(gained) + [e[1] for e in forest], dtype="Int64"), "links": np.concatenate([gained["links"].to_numpy(), np.zeros(len(forest), dtype=np.int64)])}).astype({"a": "int64", "links": "int64"})

    # a task's work is in comparing, not in reading, so small partitions are not put together
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(dealt.repartition(parts, "component", "p", "q").groupBy("component", "p", "q").applyInPandas(compare, "a long, b long, links long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    parts = cut(connected_components(found.filter("b is not null")).join(members.select("id", "rep"), "id"))
    classes = parts.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = parts.join(classes, "component").select(F.col("id").alias("node"), "class_id").join(links, "node")
    known = nodes.select("node", "fp", "rep", "copies").join(named, "node", "left").drop("node")
    out = signed.select("doc_id", "fp").join(known, "fp", "left").select(
        "doc_id",
        F.lower(F.hex("fp")).alias("text_hash"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "rep", "doc_id").alias("class_id"),
    )
    alone = source.filter(F.col("doc_id").isNull()).select("doc_id", F.lower(F.hex("fp")).alias("text_hash"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
