"""The corpus pipeline: judge, strip, deduplicate, mix and pack documents, each stage over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run` writes
each result as Parquet into the shared folder and reads it again as the next stage's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import line_quality
from assayer.llm.common import cut, read, shared_folder
from assayer.llm.line_dedup import remove_runs
from assayer.llm.mixing import mix
from assayer.llm.ngram_join import similar
from assayer.llm.packing import pack_documents
from assayer.llm.queries import QUALITY_LIMIT, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels, does not reject. Null and empty texts are judged like one empty line;
    repeated rows and ids each by themselves; columns other than those of documents go. Empty table: empty result."""
    model = line_quality.fit(docs, read(spark, sf_dir, "labels"))
    return line_quality.score(docs, model, into="__quality").filter(F.col("__quality") >= QUALITY_LIMIT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that earlier ones hold; a document of nothing else goes, as all of it stands elsewhere.

    Exact copies go entirely, but for those of one line of few words, which the n-gram join finds whole."""
    # n_chars is counted anew, so it stays out of the exchange of the texts that both joins share
    out = remove_runs(docs.select(*[c for c in COLUMNS if c != "n_chars"]))
    gone = (F.col("removed_chunks") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Repeated rows of it count once. Documents without
    words and with a null id are no copies of each other and stay. Empty table: empty result."""
    classes = cut(similar(docs).select("doc_id", "text_hash", "n_links", "kept"))
    gone = classes.filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    kept = hashed.join(gone, ["doc_id", "text_hash"], "left_anti")
    repeated = classes.filter(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_links") > 0)).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.filter(F.col("doc_id").isNull()).unionByName(kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text_hash"]))
    return kept.select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources take their target shares, in a global random order. A null source is a source;
    null ids draw as one id, so repeated rows are repeated alike. Empty table: empty result."""
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens at most. Null and empty texts are one closing token; repeated
    rows and null ids are documents of their own. Empty table: empty result."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the trained classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
