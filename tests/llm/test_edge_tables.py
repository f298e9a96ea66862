"""Empty tables, nulls in every column, repeated rows and columns named like those that operators add, through all operators and stages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import embedding_dedup, line_dedup, line_quality, mixing, ngram_join, packing, pii, quality_rules, secrets, toxicity
from assayer.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "\n".join(f"line {i} of a rather long text with words enough" for i in range(3_000))
ROWS = [
    (None, None, None, None, None), (None, "some words without an id", "en", "a", 24), (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t\n", "xx", None, 4),
    (4, "plain words in one line that stand here", "en", "b", 39), (4, "plain words in one line that stand here", "en", "b", 39), (5, LONG, "de", "b", len(LONG)), (6, LONG, "de", "b", len(LONG)), (-7, "𝒳 é 漢字 " * 30, "fr", "c", 270),
]
#: Names that operators add, as other columns of the input.
CLASH = ("secrets", "pii", "toxicity", "quality", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_words", "kept", "char_distance", "removed_chunks", "removed_lines", "copy", "shuffle_key", "text_hash", "n_links", "class_id", "rep", "copies", "fp")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def models():
    width = 3 * len(line_quality.MEASURES) * (line_quality.BINS + 1)
    crf = line_quality.Model(np.zeros((len(line_quality.MEASURES), line_quality.BINS - 1)), np.zeros(width), np.zeros(2), np.zeros((2, 2)))
    return toxicity.Model(["<ab"], np.array([1.0]), -1.0, 0.1), crf


def operators(models):
    return {
        "op2": line_dedup.remove_runs,
        "op3": lambda d: packing.pack_documents(d, tokenizer_path()),
        "op4": secrets.find_secrets,
        "op5": lambda d: toxicity.score(d, models[0]),
        "op6": mixing.mix,
        "op7": quality_rules.quality_rules,
        "op8": lambda d: line_quality.score(d, models[1]),
        "op9": pii.find_pii,
        "op10": ngram_join.similar,
    }


@pytest.mark.parametrize("name", [f"op{k}" for k in range(2, 11)])
def test_clashing_names_and_edge_rows(edge, models, name):
    f = operators(models)[name]
    plain = f(edge)
    more = f(edge.withColumns({c: F.lit("mine") for c in CLASH}))
    assert set(plain.columns) <= set(more.columns) and len(more.columns) == len(set(more.columns))
    key = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
    a, b = key(plain), key(more)
    if name == "op3":  # which sequence a piece lies in is any
        a, b = (sorted(map(repr, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for df in (plain, more))
    assert a == b
    if name not in ("op3", "op6"):
        assert len(a) == len(ROWS)


@pytest.mark.parametrize("name", [f"op{k}" for k in range(2, 11)])
def test_empty_tables(edge, models, name):
    assert operators(models)[name](edge.filter("doc_id > 1000")).count() == 0


def test_empty_fits(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for docs in (edge.filter("doc_id > 1000"), edge):
        for known in (labels, labels.filter("doc_id > 1000")):
            t, q = toxicity.fit(docs, known), line_quality.fit(docs, known)
            assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(edge, t).collect()) and all(0 <= r["quality"] <= 1 for r in line_quality.score(edge, q).collect())


def test_vectors_with_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 7, "x"), (2, [1.0, 0.01], 7, "y"), (None, [1.0, 0.0], 7, "z"), (3, None, None, None)], "vec_id long, embedding array<double>, component_id int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_near(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True), 3: (0, 3, True)}


def test_stages_on_edge_rows_and_empty_tables(spark, edge, tmp_path):
    clashing = edge.withColumns({c: F.lit("mine") for c in ("removed_chunks", "copy", "shuffle_key", "text_hash", "n_links", "kept")})
    for n, docs in enumerate((clashing, edge.filter("doc_id > 1000"))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(path := str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(path)
            if name != "packing":
                assert tuple(docs.columns) == corpus_pipeline.COLUMNS
            assert n == 0 or docs.count() == 0


def test_join_stage_keeps_one_of_each_and_all_without_words(spark, edge):
    rows = corpus_pipeline.ngram_join(spark, edge, SF).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted([(True, 0), (True, 0), (False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, -7)])
