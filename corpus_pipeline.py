"""A training corpus from documents: toxic texts go, near duplicates go, secrets are masked, sources are mixed to target
weights, and what is left is packed into sequences. Each stage works on all that the one before kept, reread from Parquet.

Defined results, for documents with nulls in any column, empty and very long texts, repeated rows, no rows at all, and
extra columns of any name (all but the last stage return the columns they got, under their names):

- ``toxicity``: null and empty texts get the score of a text without words, repeated rows equal scores; a null doc_id is
  never learnt from; without labelled rows of both kinds every score is the labelled share, so nothing goes where that is below one half.
- ``near_dedup``: texts without a word all stay; of other classes one row stays, the one with the smallest doc_id (null
  last), and of rows equal in doc_id and text one.
- ``secret_scans``: all rows stay; null and empty texts stay as they are; n_chars follows a text that changed, and is
  as before, null included, where the text didn't.
- ``source_mixing``: a null source counts as one with the default weight, a null doc_id as the text 'null'; rows with an
  equal doc_id get equal numbers of copies.
- ``best_fit_packing``: one row a piece; null and empty texts are a piece of the end id alone.

An empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm.bag_minhash import drop_near_duplicates
from lumenvec.llm.common import read, spare_name, written
from lumenvec.llm.mixing import replicate
from lumenvec.llm.packing import pack_documents
from lumenvec.llm.queries import BYTE_BPE, MIX_WEIGHTS
from lumenvec.llm.secret_scans import redact
from lumenvec.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model learns from the labelled ones among them."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars is that of the masked text where the text changed."""
    before = spare_name(docs, "hash_before")
    cleaned = redact(docs.withColumn(before, F.xxhash64("text")), *BYTE_BPE[1:])
    changed = F.xxhash64("text") != F.col(before)
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their weights, in random order."""
    return replicate(docs, MIX_WEIGHTS).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs, BYTE_BPE)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Boosted trees, signatures, tokenizers and packing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
