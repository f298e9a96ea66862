"""Classifiers, joins, embeddings and the pipeline: held-out accuracy, brute force, edge rows."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import catalog, components, embedding_dedup, line_quality, ngram_join, toxicity
from assayer.llm.common import hash_share

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# toxicity and quality


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(["ta", "re", "mo", "li", "su", "ne", "ka"], rng.integers(2, 5))) for _ in range(400)]
    bad, texts, toxic, good = ["zgrobix", "vexnarq"], [], [], []
    for i in range(700):
        lines = [" ".join(rng.choice(plain, 12)) for _ in range(rng.integers(2, 7))]
        t, q = int(i % 6 == 0), int(i % 5 != 0)
        if t:
            lines[0] += " " + str(rng.choice(bad))
        if not q:
            lines[1:] = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines[1:]]
        texts.append("\n".join(lines))
        toxic.append(t)
        good.append(q)
    return texts, toxic, good


def test_toxicity_on_held_out_rows(spark, labelled):
    texts, toxic, good = labelled
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, q, t) for i, (t, q) in enumerate(zip(toxic, good, strict=True))], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).withColumn("out", toxicity.held_out()).collect()
    held = [(r["toxicity"] >= 0.5, toxic[r["doc_id"]]) for r in rows if r["out"]]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    edges = toxicity.score(documents(spark, [None, "", "x" * 40_000, "same", "same"]), model).orderBy("doc_id").collect()
    assert all(0 <= r["toxicity"] <= 1 for r in edges) and edges[0]["toxicity"] == edges[1]["toxicity"] < 0.5 and edges[3]["toxicity"] == edges[4]["toxicity"]


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b c"] * 5)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    assert toxicity.score(docs.filter("doc_id < 0"), toxicity.fit(docs.filter("doc_id < 0"), labels)).count() == 0


def test_slopes_equal_differences_of_the_risk():
    """The risk estimate written out loss by loss, differenced at every score; below zero its negative part turned round."""
    rng = np.random.default_rng(1)
    loss = lambda z, y: np.log(1 + np.exp(-y * z))

    def parts(z, p, prior):
        rest = sum(loss(x, -1) for x in z[p:]) / (len(z) - p) - prior * sum(loss(x, -1) for x in z[:p]) / p
        return prior * sum(loss(x, 1) for x in z[:p]) / p, rest

    seen = set()
    for prior, shift in ((0.1, 0.0), (0.3, 0.5), (0.6, 2.0), (0.9, 3.0)):
        z, p = rng.normal(size=20), 6
        z[:p] += shift
        rest = parts(z, p, prior)[1]
        seen.add(rest < 0)
        value = (lambda z: -parts(z, p, prior)[1]) if rest < 0 else (lambda z: sum(parts(z, p, prior)))  # noqa: B023
        for k in range(20):
            step = np.eye(20)[k] * 1e-5
            assert np.isclose(toxicity.slopes(z, p, prior)[k], (value(z + step) - value(z - step)) / 2e-5, atol=1e-8)
    assert seen == {True, False}


def test_counts_of_grams_by_hand(monkeypatch):
    """In pieces of any size the counts of n-grams are those of sets by hand."""
    texts, p, u = ["ab abc", "abc", None, "Abc abd"], [True, False, True, True], [True, True, True, False]
    want = {}
    for t, a, b in zip(texts, p, u, strict=True):
        for g in {""} | {x for w in (t or "").lower().split() for x in toxicity.grams(w)}:
            want[g] = [x + y for x, y in zip(want.get(g, [0, 0]), [int(a), int(b)], strict=True)]
    for most in (1, 1000):
        monkeypatch.setattr(toxicity, "COUNTED", most)
        got = {}
        batches = [pa.RecordBatch.from_arrays([pa.array(p[i : i + 2]), pa.array(u[i : i + 2]), pa.array(texts[i : i + 2], pa.string())], names=["p", "u", "text"]) for i in (0, 2)]
        for b in toxicity._count(iter(batches)):
            for g, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[g] = [got.get(g, [0, 0])[0] + x, got.get(g, [0, 0])[1] + y]
        assert got == want


def test_negative_risk_is_not_followed():
    """With fewer unlabelled negatives than the prior promises, positives still score above the rest."""
    positive, unlabelled = [np.array([0])] * 50, [np.array([0])] * 50 + [np.array([1])] * 50
    w, b = toxicity.train(positive, unlabelled, 2, 0.5)
    assert w[0] + b > 0 > w[1] + b


def test_quality_on_held_out_rows(spark, labelled):
    texts, toxic, good = labelled
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, q, t) for i, (t, q) in enumerate(zip(toxic, good, strict=True))], "doc_id long, quality int, toxic int")
    model = line_quality.fit(docs, labels)
    rows = line_quality.score(docs, model).withColumn("out", line_quality.held_out()).collect()
    held = [((r["quality"] >= 0.3), good[r["doc_id"]]) for r in rows if r["out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    edges = line_quality.score(documents(spark, [None, "", "\n" * 3_000, "x" * 50_000, "😀 é\n" * 4]), model).collect()
    assert all(0 <= r["quality"] <= 1 for r in edges)
    lines = line_quality.label_lines(documents(spark, ["a\nb\n", None]), model).orderBy("doc_id").collect()
    assert [len(r["good_lines"]) for r in lines] == [3, 1]


def test_quality_without_labels(spark):
    docs = documents(spark, ["a b c"] * 3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r["quality"] <= 1 for r in line_quality.score(docs, line_quality.fit(docs, labels)).collect())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    unary, start, pairs = rng.normal(size=4), rng.normal(size=2), rng.normal(size=(2, 2))
    weight = {}
    for y in itertools.product((0, 1), repeat=4):
        weight[y] = np.exp(start[y[0]] + sum(unary[k] * y[k] for k in range(4)) + sum(pairs[y[k], y[k + 1]] for k in range(3)))
    total = sum(weight.values())
    padded, mask = np.array([[*unary, 0.0, 0.0]]), np.array([[True] * 4 + [False] * 2])
    good, both = line_quality.forward_backward(padded, mask, start, pairs)
    for k in range(4):
        assert np.isclose(good[0, k], sum(w for y, w in weight.items() if y[k]) / total)
    assert np.isclose(both[0, 1, 0, 1], sum(w for y, w in weight.items() if y[1] == 0 and y[2] == 1) / total)
    assert both[0, 3:].sum() == 0


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_gradient_equals_differences_of_the_likelihood(monkeypatch, segment):
    """The log likelihood of line labels by enumeration of all labellings, differenced at every parameter, however texts are cut."""
    monkeypatch.setattr(line_quality, "SEGMENT", segment)
    rng = np.random.default_rng(4)
    m, bins = len(line_quality.MEASURES), line_quality.BINS
    n_lines = np.array([3, 1, 4])
    edges = np.sort(rng.normal(size=(m, bins - 1)), axis=1)
    measures = rng.normal(size=(8, m))
    lines = line_quality.gather(edges, measures, n_lines)
    good, theta, decay = rng.integers(0, 2, 8).astype(float), rng.normal(size=3 * m * (bins + 1) + 6) * 0.3, 0.01
    model = line_quality.Model(edges, theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2))
    slots = model.slots(measures, n_lines)

    def value(theta):
        w, start, pairs = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        unary, total, at = w[slots].sum(axis=1), 0.0, 0
        for n in n_lines:
            weigh = lambda y, at=at: start[int(y[0])] + sum(unary[at + k] * y[k] for k in range(len(y))) + sum(pairs[int(y[k]), int(y[k + 1])] for k in range(len(y) - 1))
            total += weigh(good[at : at + n]) - np.log(sum(np.exp(weigh(y)) for y in itertools.product((0, 1), repeat=int(n))))
            at += n
        return total / 8 - decay / 2 * (w @ w + (pairs * pairs).sum())

    assert np.allclose(lines.unary(theta[:-6]), model.unary(slots))
    g = line_quality.likelihood_gradient(theta, lines, good, decay)
    for k in [*rng.choice(len(theta) - 6, 60, replace=False).tolist(), *np.unique(slots)[:20].tolist(), *range(len(theta) - 6, len(theta))]:
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert np.isclose((value(theta + step) - value(theta - step)) / 2e-5, g[k], atol=1e-7)


def test_sequences_with_messages_equal_whole_chains(monkeypatch):
    """Marginals of texts cut into sequences are those of one recursion over each whole text."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(line_quality, "SEGMENT", 5)
    n_lines = np.array([1, 23, 5, 6, 2, 40, 10])
    edges = np.sort(rng.normal(size=(len(line_quality.MEASURES), line_quality.BINS - 1)), axis=1)
    lines = line_quality.gather(edges, rng.normal(size=(n_lines.sum(), len(line_quality.MEASURES))), n_lines)
    unary, start, pairs = rng.normal(size=n_lines.sum()) * 3, rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    flat, both = line_quality.chains(unary, lines, start, pairs)
    at, mask = line_quality.padded(n_lines)
    p, whole = line_quality.forward_backward(unary[at], mask, start, pairs)
    assert np.allclose(flat, p[mask]) and np.allclose(both, whole.sum(axis=(0, 1)))


def test_long_texts_teach_whole(spark):
    """Bad lines that only come after hundreds of clean ones are learned, and one long text is several sequences."""
    clean = "plain words stand here in a row"
    texts = [(clean + "\n") * 300 + ("## $$ !! ## $$ !!\n") * 300 if i % 2 else (clean + "\n") * 30 for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = line_quality.fit(documents(spark, texts), labels)
    low, high = (r["quality"] for r in line_quality.score(documents(spark, [("## $$ !! ## $$ !!\n") * 20, (clean + "\n") * 20]), model).orderBy("doc_id").collect())
    assert low < 0.3 < high
    assert line_quality.gather(model.edges, np.zeros((601, len(line_quality.MEASURES))), np.array([601])).segments.tolist() == [64] * 9 + [25]


def test_repeated_ids_teach_once(spark):
    docs = documents(spark, ["good words here", "## !! ##"] * 6)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, quality int")
    many = docs.unionByName(docs).unionByName(docs)
    one, three = line_quality.fit(docs, labels), line_quality.fit(many, labels)
    assert np.array_equal(one.weights, three.weights)


# components


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, x) for x in range(400, 440)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# embeddings


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1_500, 16)).astype(np.float32)
    x[600:700] = x[0] + rng.normal(size=(100, 16)) * 0.15
    for i in range(700, 1_000):
        x[i] = x[i - 700] + rng.normal(size=16) * 0.2
    x[1_000:1_040] = x[5]
    x[1_040] = x[6] * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2_000, None), (2_001, [0.0] * 16), (2_002, [float("nan")] * 16), (2_003, [None] + [1.0] * 15), (2_004, [float("inf")] * 16), (2_005, []), (2_006, [1.0, 2.0]), (None, rows[0][1])]
    got = {r["vec_id"]: r for r in embedding_dedup.link_near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    near = y @ y.T >= 0.95
    want = near.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(2_000, 2_007))
    assert got[None]["n_links"] == 0 and len(got) == len(rows)
    assert all(got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))


def test_different_vectors_of_one_id_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 8))
    rows = [(1, a), (1, b), (2, a * 1.0001 + 1e-3), (3, b * 0.9999 + 1e-3), (4, c[:3]), (5, c[:3]), (6, c[:3] + 1e-3), (7, c)]
    got = embedding_dedup.link_near(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in got] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 0, 7)]


def test_two_levels_of_lists_find_the_hardest_links():
    """Pairs just above the threshold, over a thousand lists: what no probe finds is under a tenth of them."""
    rng = np.random.default_rng(12)
    x = embedding_dedup.unit(rng.normal(size=(8_000, 64)))
    e = rng.normal(size=x.shape)
    e = embedding_dedup.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * e
    index = embedding_dedup.build(x, 600_000)
    assert len(index.first) * len(index.second) >= 1_000 and len(index.second) > 1
    home = {0: index.home(x), 1: index.home(y)}
    found = np.zeros(len(x), dtype=bool)
    for rows, other in ((x, home[1]), (y, home[0])):
        row, place = index.probes(rows)
        found[row[place == other[row]]] = True
    assert found.mean() >= 0.95


def test_links_over_two_levels_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3_000, 24))
    x[1_500:] = x[:1_500] + rng.normal(size=(1_500, 24)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in embedding_dedup.link_near(df, list_size=4).orderBy("vec_id").collect()])
    y = embedding_dedup.unit(x)
    want = (y @ y.T >= 0.95).sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() > 0


@pytest.mark.parametrize("dim", [256, 768])
def test_probes_stay_few_in_many_dimensions(dim):
    """Pairs just above the threshold among random unit vectors: nearly all are found, and a vector probes few of 250 lists."""
    rng = np.random.default_rng(dim)
    x = embedding_dedup.unit(rng.normal(size=(3_000, dim)))
    e = rng.normal(size=x.shape)
    e = embedding_dedup.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * e
    index = embedding_dedup.build(embedding_dedup.unit(rng.normal(size=(6_000, dim))), 100_000)
    found, probes = np.zeros(len(x), dtype=bool), 0
    for rows, other in ((x, index.home(y)), (y, index.home(x))):
        row, place = index.probes(rows)
        probes += len(row)
        found[row[place == other[row]]] = True
    assert len(index.first) == 250 and found.mean() >= 0.98 and probes / (2 * len(x)) <= 12


def test_links_of_many_dimensions_through_the_query(spark):
    rng = np.random.default_rng(8)
    x = embedding_dedup.unit(rng.normal(size=(1_500, 768)))
    e = rng.normal(size=x.shape)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * embedding_dedup.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = embedding_dedup.link_near(df, list_size=20).filter("n_links = 1").count()
    assert got >= 0.98 * 3_000


def test_small_shares_of_huge_tables_draw_rows(spark):
    """Shares of 10^-9 keep their meaning: about one in that many hashes, not none."""
    share = spark.range(4_000_000).select(hash_share(F.col("id"), F.lit(1)).alias("u"))
    row = share.agg(F.min("u").alias("low"), F.max("u").alias("high"), F.avg("u").alias("mean"), F.count_if(F.col("u") < 1e-6).alias("few"), F.approx_count_distinct("u", 0.01).alias("n")).first()
    assert 0 < row["low"] < 2e-6 and row["high"] < 1 and abs(row["mean"] - 0.5) < 1e-3 and row["few"] <= 20 and row["n"] > 3_800_000
    drawn = toxicity._drawn(10**10, 4_000, 1)
    rows = spark.createDataFrame([(i,) for i in range(10)], "__id long").select(drawn.alias("d")).collect()
    assert not any(r["d"] for r in rows)


def test_no_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.link_near(empty).count() == 0


# n-gram join


def test_similar_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one", "one", "one two", "é " * 9, "long " * 20_000]
    for _ in range(60):
        base = list(rng.choice(vocabulary, rng.integers(30, 200)))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "one", "en", "s", 3), (4, "one", "en", "s", 3)], SCHEMA))
    got = ngram_join.similar(docs).collect()
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = np.zeros(len(texts), int)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[[a, b]] += 1
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    links[[3, 4]] += 1  # the row that repeats document 4
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["n_links"] == 0
        else:
            assert (r["class_id"], r["n_links"]) == (find(r["doc_id"]), links[r["doc_id"]]), r
    assert len(got) == len(texts) + 2


def test_shortest_prefix():
    n = ngram_join.shortest_prefix()
    assert ngram_join.found_by(0.8, n) >= ngram_join.RECALL > ngram_join.found_by(0.8, n + 1)


def test_branches_of_sorted_tries():
    rng = np.random.default_rng(5)
    trees, depth, short = 3, 6, 2
    sig = rng.integers(0, 3, (60, trees, depth)).astype(np.uint8)
    head, tail, node = ngram_join.paths(np.arange(60), sig, trees, depth, short)
    order = np.lexsort((tail, head))
    head, tail, node = head[order], tail[order], node[order]
    first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])  # of the texts of one path
    n = np.diff(np.r_[first, len(head)])
    levels = ngram_join.branches(head[first], tail[first], n, depth, short)
    got = {(int(h) >> 8 * short, int(x)): int(m) for h, x, m in zip(head, node, np.repeat(levels, n), strict=True)}
    for t in range(trees):
        for k in range(short, depth + 1):
            for i in range(60):
                group = [j for j in range(60) if (sig[j, t, :k] == sig[i, t, :k]).all()]
                wide = len(group) > 1 if k == depth else len({int(sig[j, t, k]) for j in group}) > 1
                assert bool(got[t, i] >> (k - short) & 1) == wide
    # in batches of any size the same rows come out
    columns = [c[first] for c in (head, tail, node)] + [n]
    rows = lambda batches: [tuple(r) for b in ngram_join.walk(batches, depth, short) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    whole = rows(iter([_batch(*columns)]))
    assert whole == rows(_batch(*(c[i : i + 7] for c in columns)) for i in range(0, len(first), 7))
    assert whole == [(*(int(c[i]) for c in columns), int(levels[i])) for i in range(len(first)) if levels[i]]


def test_leaders_join_what_is_similar():
    """Joined are leaders and texts within NEAR of them, and any two texts at 0.8, in whatever pieces a group comes."""
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 256, (5, 320)).astype(np.uint8)[rng.integers(0, 5, 200)]
    for i in range(200):
        at = rng.random(320) < rng.uniform(0, 0.45)
        sig[i, at] = rng.integers(0, 256, int(at.sum()))

    def parts(edges):
        top = list(range(200))

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in edges:
            top[find(a)] = find(b)
        return [min(j for j in range(200) if find(j) == find(i)) for i in range(200)]

    leaders, edges = [], []
    for i in range(200):
        alike = [(sig[i] == sig[k]).mean() for k in leaders]
        spoken = next((n + 1 for n, s in enumerate(alike) if s >= ngram_join.SAME), len(alike))  # it meets no leader after that
        edges += [(k, i) for k, s in zip(leaders[:spoken], alike, strict=False) if s >= ngram_join.NEAR]
        if all(s < ngram_join.SAME for s in alike):
            leaders.append(i)
    assert 10 < len(leaders) < 150
    for step in (1, 30, 200):
        group = ngram_join.Leaders()
        found = [e for i in range(0, 200, step) for e in group.meet(np.arange(i, min(200, i + step)), sig[i : i + step])[0]]
        assert len(found) < 200 and all(np.isclose((sig[a] == sig[b]).mean(), s) and s >= ngram_join.NEAR for a, b, s in found)
        assert step > 1 or parts([e[:2] for e in found]) == parts(edges)
        similar = [(i, j) for i, j in itertools.combinations(range(200), 2) if (sig[i] == sig[j]).mean() >= 0.8]
        own = parts([e[:2] for e in found])
        assert similar and all(own[i] == own[j] for i, j in similar)


def test_split_groups_join_what_is_similar(spark):
    """One prefix for 400 texts and another for 5: parts of a group meet its leaders apart, and no two texts at 0.8 stay apart."""
    rng = np.random.default_rng(11)
    sig = rng.integers(0, 256, (6, 320)).astype(np.uint8)[rng.integers(0, 6, 400)]
    for i in range(400):
        at = rng.random(320) < rng.uniform(0, 0.3)
        sig[i, at] = rng.integers(0, 256, int(at.sum()))
    nodes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "node long, sig binary")
    rows = spark.createDataFrame([(1, 2, i) for i in range(400)] + [(1, 3, i) for i in range(5)], "head long, prefix long, node long")
    edges = ngram_join.group_edges(rows, nodes, 60).collect()
    assert all(np.isclose((sig[a] == sig[b]).mean(), s) and s >= ngram_join.NEAR and a < b for a, b, s in edges)
    found = components.connected_components(spark.createDataFrame([(a, b) for a, b, _ in edges], "a long, b long"))
    own = {r["id"]: r["component"] for r in found.collect()}
    similar = [(i, j) for i, j in itertools.combinations(range(400), 2) if (sig[i] == sig[j]).mean() >= 0.8]
    assert len(similar) > 1_000 and all(own[i] == own[j] for i, j in similar)
    assert len(set(own.values())) == 6


def test_large_group_of_near_copies_has_exact_counts(spark):
    """Copies of one text with a word of their own in one place: which pairs reach 0.8 follows from the places alone."""
    rng = np.random.default_rng(13)
    base = [f"w{i}" for i in range(60)]
    places = rng.integers(0, 60, 1_500)
    texts = [" ".join([*base[:p], f"own{i}", *base[p + 1 :]]) for i, p in enumerate(places.tolist())]
    touched = [set(range(max(0, p - 4), min(p, 55) + 1)) for p in range(60)]  # windows that hold a place; 56 in all
    at = np.bincount(places, minlength=60)
    near = np.array([[(56 - len(a | b)) >= 0.8 * (2 * 56 - (56 - len(a | b))) for b in touched] for a in touched])
    want = near @ at - near.diagonal()
    got = ngram_join.similar(documents(spark, texts), group=100).collect()
    assert len({r["class_id"] for r in got}) == 1 and 0 < (~near).sum()
    assert [r["n_links"] for r in sorted(got, key=lambda r: r["doc_id"])] == want[places].tolist()


def _batch(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["head", "tail", "node", "n"])


def test_shingles_are_windows_of_words():
    texts = ["a b  c\td e f", "a b c d e", "", None, "one", "\n x", "x", "é b c d e f", " ".join("w" * 9000 for _ in range(3))]
    got = ngram_join.shingles(pa.array(texts, pa.string())[0:], 5)
    assert [len(s) for s in got] == [2, 1, 0, 0, 1, 1, 1, 2, 1]
    assert got[0][0] == got[1][0] and got[5][0] == got[6][0] and got[0][1] == got[7][1] and got[0][0] != got[7][0] and got[4][0] != got[5][0]
    assert [s.tolist() for s in ngram_join.shingles(pa.array(texts, pa.string())[3:], 5)] == [s.tolist() for s in got[3:]]


def test_verify_in_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)] + [np.zeros(0, np.uint64)] * 2
    want = {(i, j) for i, j in itertools.combinations(range(30), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*map(np.ndarray.tolist, ngram_join.verify(sets, None, 0.5)), strict=True)) == want
    i, j = ngram_join.verify(sets[:10], sets[10:], 0.5)
    assert {(a, b + 10) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if a < 10 <= b}


# pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(found) <= ids
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name != "packing":
            ids = set(found)
    assert set(found) == ids
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "quality")).select("doc_id").collect()}
    assert len(good - kept) <= 0.03 * len(good)


def test_every_operator_is_registered():
    names = list(catalog.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(names)
