"""A corpus pipeline over `documents`: quality classifier, line dedup, near-dedup, secret scan, packing.

Each stage takes the documents that the one before kept and returns documents of the same columns; the last returns
the packed pieces. Between stages, rows are written as Parquet to the shared folder and read again.

In every stage: a null text is an empty one and stays null, a null id is passed on (rows without an id are kept apart
from each other, as no document), texts of any length are read whole, repeated rows are judged alike, further columns
pass through whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import line_dedup, minhash_dedup, packing, pu_quality, secret_scan
from siftspark.llm._shared import discard, scratch, small_batches, stored, table
from siftspark.llm.queries import held_out_rows, tokenizer_file

#: A document goes if its quality score is below this. Rejecting is final here, so doubtful ones stay: of held-out labelled
#: documents at scale 0.1, 0.999 of the good ones pass and 0.985 of the bad ones go at 0.5; at 0.7 it is 0.994 and 0.985.
REJECT_BELOW = 0.5


def _documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below REJECT_BELOW go. Labels of held-out ids are not learned from; without any label all stay."""
    small_batches(spark)
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"), held_out_rows(), REJECT_BELOW)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in the smallest doc_id that holds them (a null one counts as the largest); every document stays."""
    small_batches(spark)
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("_doc")))  # its new columns can't replace those of docs
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return _documents(kept.select(*[text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8): the smallest doc_id.

    Rows of one id are one document, and stay or go together; rows without an id all stay, as do empty texts.
    """
    small_batches(spark)
    gone = stored(minhash_dedup.near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. Repeated rows of one id and text lose the same places."""
    small_batches(spark)
    found = secret_scan.scan_secrets(docs, tokenizer_file("byte_bpe_50k.json"))
    return _documents(secret_scan.redact_secrets(docs, found), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids; every row is packed on its own, a null or empty text as the end id alone."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
#: A fitted model and a tokenizer aren't SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage stored on its way goes when its result stands
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if before:
            discard(spark, before)
        before = docs._sift_path
    return STAGES[-1][1](spark, docs, sf_dir)
