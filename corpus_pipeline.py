"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents;
extra columns of the input are dropped, null texts are defined stage by stage in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, mixing, ngram_join, piece_sampling, secret_scan
from gridloom.llm.common import SIDE_ROWS, crc_mod, scratch, sided, tune, written
from gridloom.llm.rows import ROW, with_copies, with_row

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
SECRET = "[SECRET]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without a letter, posterior below one half. Without any labelled language all stay."""
    tune(spark)
    docs = docs.select(*DOCUMENT)
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    if not model.languages:
        return docs
    told = langid.detect(docs, model, list(DOCUMENT))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that with the smallest doc_id (null ids last), of rows with that id the one with the smallest hash."""
    tune(spark)
    docs = docs.select(*DOCUMENT)
    linked = written(ngram_join.join(with_row(docs), ROW).where("n_links > 0").select("class_key", "doc_id", *ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("f")
    stays = linked.groupBy("class_key").agg(first).select(*(F.col(f"f.{c}").alias(c) for c in ROW), F.lit(1).alias("copies"))
    decisions = linked.groupBy(*ROW).agg(F.count("*").alias("n")).join(sided(stays, linked.count() <= SIDE_ROWS), ROW, "left")
    return with_copies(docs, decisions.select(*ROW, "n", F.coalesce("copies", F.lit(0)).alias("copies")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; n_chars follows the text where it changed."""
    tune(spark)
    forest = secret_scan.fit(secret_scan.labelled_findings())
    found = secret_scan.scan(docs.select(*DOCUMENT), forest, list(DOCUMENT), path="source", redact=SECRET)
    changed = F.size("secrets") > 0
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    length = F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents so that the sources' words come near their targets."""
    tune(spark)
    docs = docs.select(*DOCUMENT)
    mixed = written(mixing.mix(with_row(docs), keep=ROW).select(*ROW, "copies"))
    return with_copies(docs, mixed.groupBy(*ROW).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    tune(spark)
    return piece_sampling.encode(docs.select(*DOCUMENT), ["doc_id", "lang", "source"], k=2)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("SentencePiece encoding", pieces),
]
#: Trained models and sampled segmentations have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
