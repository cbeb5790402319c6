"""The queries of the text operators: thin wrappers with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm.bag_minhash import near_duplicates
from lumenvec.llm.common import read
from lumenvec.llm.fill_in_middle import FIM_SQL, fim_table
from lumenvec.llm.html_extraction import extract
from lumenvec.llm.mixing import replicate, replicate_sql
from lumenvec.llm.nn_descent import nearest
from lumenvec.llm.packing import pack_documents
from lumenvec.llm.periodic_runs import runs_table
from lumenvec.llm.quality_rules import QUALITY_SQL, quality_table
from lumenvec.llm.secret_scans import scan
from lumenvec.llm.substring_dedup import remove_repeats
from lumenvec.llm.token_counts import count_tokens
from lumenvec.llm.toxicity import score as score_toxicity
from lumenvec.llm.warc import PAGES_SQL, pages_round_trip


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(read(spark, sf_dir, "documents"))


#: Weights by source; all others have weight 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 2.0, "src4": 0.5, "src5": 0.25}


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs, MIX_WEIGHTS)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: The byte-level vocabulary as tokenizer and as ranks.
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_round_trip(read(spark, sf_dir, "pages"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op11_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_table(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_table(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_token_counts": op3_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op9_bag_minhash": op9_bag_minhash,
    "op5_secret_scans": op5_secret_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_nn_descent": op2_nn_descent,
    "op11_tree_extraction": op11_tree_extraction,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": QUALITY_SQL,
    "op7_source_mixing": replicate_sql(MIX_WEIGHTS, "doc_id, text, lang, source, n_chars, copy::INT AS copy_no, md5('mix-1:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS order_key"),
    "op1_arc_to_warc": PAGES_SQL,
    "op12_fill_in_middle": FIM_SQL,
}
