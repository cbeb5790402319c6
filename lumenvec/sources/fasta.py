"""FASTA text, plain or gzip-compressed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWYBXZUOJ*-"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, sequence) of all records in order of the file; a record's id is the first word of its header.

    Records are split by the reader itself, so a large plain file is read by many tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "^>", "").alias("v"))
    header, body = F.regexp_extract("v", r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*(\n|$)", ""), r"\s", "")
    return raw.filter(F.trim("v") != "").select("pos", F.regexp_extract(F.trim(header), r"^(\S*)", 1).alias("id"), body.alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence): the first record of each id; records without a sequence are skipped."""
    kept = records(spark, path).filter("sequence <> '' and id <> ''")
    return kept.groupBy("id").agg(F.min_by("sequence", "pos").alias("sequence"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of all headers, without their sequences; UniProt-like headers give their accession."""
    from lumenvec.functions.bio import parse_identifier

    lines = spark.read.text(path).filter(F.startswith("value", F.lit(">"))).select(F.monotonically_increasing_id().alias("pos"), F.regexp_extract("value", r"^>(\S*)", 1).alias("key"))
    return lines.select("pos", parse_identifier(F.col("key")).alias("id"))


@dataclass(frozen=True)
class Limits:
    least: int = 20
    most: int = 1500
    residues: int = 2000
    total: int = 1_500_000


def validate(df: DataFrame, limits: Limits = Limits()) -> list[str]:
    """What is wrong with (id, sequence) rows, from one aggregate; nothing where all is well."""
    n, seq = F.length("sequence"), F.upper("sequence")
    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.countDistinct(F.lower(F.trim("id"))).alias("ids"),
        F.count_if(~seq.rlike(f"^[{ALPHABET}]*$")).alias("odd"), F.count_if((n >= 50) & seq.rlike("^[ACGTUN]*$")).alias("bases"),
    ).first()
    tests = {
        f"fewer than {limits.least} sequences": r["n"] < limits.least, f"more than {limits.most} sequences": r["n"] > limits.most, f"a sequence of more than {limits.residues} residues": r["longest"] > limits.residues,
        f"more than {limits.total} residues": r["total"] > limits.total, "repeated ids": r["ids"] < r["n"], "letters outside the alphabet": r["odd"] > 0, "nucleotides": r["bases"] > 0,
    }
    return [k for k, bad in tests.items() if bad]


def sequence_key(sequence: str = "sequence"):
    """The key by which sequences are looked up: their MD5 in capitals."""
    return F.upper(F.md5(F.upper(sequence)))
