"""Centroids, ranked search and byte-level BPE against brute force, with edge rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import byte_bpe, centroids, impact_index

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, n_terms long, score string"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# centroids


def plain_lloyd(rows, dim, k, rounds, scale, seed):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x * scale) < centroids.BOUND for x in e):
            kept.append((vec_id, [math.floor(scale * x) for x in e]))
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    at = [v for _, v in start]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for n, vs in groups.items():
            at[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    total = Counter()
    for _, n, d in found:
        total[n] += d
    return sorted(map(repr, ((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, n, d in found)))


@pytest.mark.parametrize("size", [0, 3, 200])
def test_centroids_equal_plain_rounds(spark, size):
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4).round(1)]) for i in rng.integers(0, 150, size)]
    if size:
        rows += [(7, [1.0, 2.0, 3.0, 4.0])] * 40 + [(None, [0.5] * 4), (8, None), (9, []), (10, [1.0, None, 0.0, 0.0]), (11, [float("nan"), 0.0, 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [1e300, 0.0, 0.0, 0.0]), (14, [1.0] * 5), (15, [-1e5, 9e5, 0.0, 1e4]), (16, [-0.0] * 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    got = centroids.cluster(df, dim=4, k=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_lloyd(rows, 4, 6, 3, 64, 1)


def test_distances_beyond_doubles_are_exact():
    x, c = np.array([[2**27 - 1, -(2**27) + 1], [3, 5]], dtype=np.int64), np.array([[-(2**27) + 1, 2**27 - 1], [2**27 - 2, 5]], dtype=np.int64)
    at, d = centroids.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)), n) for n, s in enumerate(c)) for r in x]
    assert list(zip(d.tolist(), at.tolist(), strict=True)) == want


def test_no_task_gathers_equal_vectors(spark):
    rows = centroids.quantised(spark.range(5_000).selectExpr("id AS vec_id", "array_repeat(0.25D, 4) AS embedding"), dim=4)
    assert rows.select("v").distinct().count() == 1
    df = spark.range(5_000).selectExpr("id AS vec_id", "array_repeat(0.25D, 4) AS embedding")
    out = centroids.cluster(df, dim=4, k=3)
    assert out.count() == 5_000 and out.filter("cluster = 0 AND distance = 0 AND inertia = 0").count() == 5_000


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_rank(docs, items, k=10):
    lower = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(t or "")]
    held = [(i, Counter(lower(t))) for i, t in docs if lower(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in lower(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def ranked(spark, docs, items, block):
    d = spark.createDataFrame([(i, t, "en", 1, "s") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(repr(tuple(r)) for r in impact_index.rank(d, q, block=block).collect())


@pytest.mark.parametrize("block", [1, 70, 1 << 14])
def test_search_equals_plain_scores(spark, block):
    rng = random.Random(block)
    words = ["the", "The", "of", "x1", "é", "É", "漢字", "rare", "zebra", "𝒳"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ,\n".join(rng.choice(words[: rng.choice([3, 10, 40])]) for _ in range(n))
    docs = [(rng.randint(0, 250), text(rng.randint(0, 60))) for _ in range(300)] + [(None, "rare zebra"), (None, "rare zebra"), (5, None), (6, ""), (7, " ,. "), (900, "the " * 5000)]
    docs += [(1000 + i, "twin text of some words") for i in range(30)]
    items = [(1, text(5)), (2, text(40)), (2, "twin twin twin text"), (None, "rare"), (3, None), (4, ""), (5, "nowhere"), (6, "RARE zebra É 漢字 the")]
    items += [(2, items[1][1])]
    assert ranked(spark, docs, items, block) == plain_rank(docs, items)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "PASS_TERMS", 3)
    docs = [(i, f"a b{i % 3} c{i % 7}") for i in range(40)]
    items = [(i, f"a b{i} c{i} c{i + 1}") for i in range(5)]
    assert ranked(spark, docs, items, 16) == plain_rank(docs, items)


def test_search_on_empty_tables(spark):
    docs, items = [(1, "some words")], [(1, "words")]
    assert ranked(spark, [], items, 16) == ranked(spark, docs, [], 16) == []
    assert ranked(spark, [(1, None), (2, "..")], items, 16) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 199), st.integers(1, 1 << 40)), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 3), st.integers(1, 12))
def test_bit_slices_add_and_select(terms, times, k):
    block, sums = impact_index.Block(200), np.zeros(200, np.int64)
    for t, postings in enumerate(terms):
        place, first = np.unique([p for p, _ in postings], return_index=True)
        impact = np.array([x for _, x in postings], dtype=np.int64)[first]
        block.put(t, place, impact)
        sums[place] += impact * times
    place, score = block.best(block.total([(t, times) for t in range(len(terms))]), k)
    want = sorted((-s, p) for p, s in enumerate(sums.tolist()) if s > 0)[:k]
    assert sorted((-int(s), int(p)) for p, s in zip(place, score, strict=True)) == want


# tokens

SIGNS = ["a", "B", "z", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", ",", "!", "é", "漢", "字", "，", "𝒳", " ", "　", "\x1c", "\x85", "٣", "-", "\r", "nd"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SIGNS), st.text(max_size=3)), max_size=60).map("".join), st.integers(1, 9))
def test_parts_have_the_matches_of_the_text(library, text, part):
    assert byte_bpe.encode_text(text, RANKS, PATTERN, part).tolist() == library.encode_ordinary(text)
    assert "".join(p for p, _ in byte_bpe.parts(text, part)) == text


@pytest.mark.parametrize("tail", ["", "x", "'s", "　x", "\n"])
@pytest.mark.parametrize("sign", [" ", "\n", "\t \n"])
def test_long_white_space(library, sign, tail):
    text = "abc" + sign * (2 * byte_bpe.RUN) + tail
    assert byte_bpe.encode_text(text, RANKS, PATTERN, 1_000).tolist() == library.encode_ordinary(text)


def test_tokens_of_edge_rows(spark, library):
    texts = [None, "", " ", "some words, and 23 more", "some words, and 23 more", "𝒳 é 漢字 " * 9, "<|endoftext|>", " " * 1_200_000 + "x", "word " * 100_000, "\x00\x01"]
    rows = spark.createDataFrame([(i if i != 3 else None, t, "mine", "mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    out = byte_bpe.decode(byte_bpe.encode(rows, RANKS, PATTERN), RANKS).collect()
    assert len(out) == len(texts)
    for r in out:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        if not (r["text"] or "").startswith(" " * 1_000):
            assert r["ids"] == library.encode_ordinary(r["text"] or "")
    assert byte_bpe.encode(rows.limit(0), RANKS, PATTERN).count() == 0


def test_decoding_gives_raw_bytes(spark, library):
    ids = library.encode_ordinary("漢")
    rows = spark.createDataFrame([(1, ids[:1]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(rows, RANKS).collect()}
    assert bytes(got[1]) == library.decode_single_token_bytes(ids[0]) and bytes(got[2]) == b"" and got[3] is None
