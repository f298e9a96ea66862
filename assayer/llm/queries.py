"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import byte_bpe, impact_index, line_quality, toxicity
from assayer.llm.centroids import cluster
from assayer.llm.common import held_out, read
from assayer.llm.embedding_dedup import link_near
from assayer.llm.line_dedup import remove_runs
from assayer.llm.mixing import mix
from assayer.llm.ngram_join import similar
from assayer.llm.packing import pack_documents
from assayer.llm.pii import KINDS, find_pii, listed, scores
from assayer.llm.quality_rules import quality_rules
from assayer.llm.secrets import BASE, find_secrets


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(read(spark, sf_dir, "embeddings"))


def op2_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_runs(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public vocabulary lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = joined(F.filter("secrets", lambda x: x["kind"].isin(list(BASE))))
    return out.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, into="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


#: Documents below this score count as bad.
QUALITY_LIMIT = 0.3


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit(docs, read(spark, sf_dir, "labels"))
    out = line_quality.score(docs, model, into="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k.name).alias(f"n_{k.name}") for k in KINDS if k.base]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("pii"), base_only=True).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores(F.col("pii")).alias("scores"), (F.size("pii") > 0).alias("has_pii"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents")).drop("text_hash")


def op11_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
