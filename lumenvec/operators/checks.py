"""Checks of rows before they are used, and rules about columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
MAX_COLUMNS, MAX_CELL = 200, 256
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CATEGORIES = ("Biocentral", "InterPro", "TED", "Taxonomy", "UniProt", "Other")
RANKS = ("root", "domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")


def cell_problems(df: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """(col, n_long, n_control): by text column, cells with a part (between semicolons) of more than ``max_cell`` characters, and cells with control characters. Every row is looked at."""
    text = [c for c, t in df.dtypes if t == "string"]
    aggs = [F.count_if(F.exists(F.split(F.col(f"`{c}`"), ";"), lambda p: F.length(p) > max_cell)).alias(f"l{i}") for i, c in enumerate(text)]
    aggs += [F.count_if(F.col(f"`{c}`").rlike(CONTROLS)).alias(f"c{i}") for i, c in enumerate(text)]
    if not text:
        return df.sparkSession.createDataFrame([], "col string, n_long long, n_control long")
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"l{i}").alias("n_long"), F.col(f"c{i}").alias("n_control")) for i, c in enumerate(text)])))


def validate_rows(df: DataFrame, max_columns: int = MAX_COLUMNS, max_cell: int = MAX_CELL) -> None:
    """Raises for a table without rows or columns, with too many columns, or with cells that are too long or hold controls."""
    if not df.columns:
        raise ValueError("no columns")
    if len(df.columns) > max_columns:
        raise ValueError(f"{len(df.columns)} columns are more than {max_columns}")
    if df.isEmpty():
        raise ValueError("no rows")
    for r in cell_problems(df, max_cell).filter("n_long > 0 or n_control > 0").collect():  # at most max_columns rows
        raise ValueError(f"column {re.sub(r'[^ -~]', '?', r['col'])[:80]}: {r['n_long']} cells are too long, {r['n_control']} hold control characters")


def validate_projection(df: DataFrame) -> None:
    """``validate_rows``, and columns projection_name, x and y with finite numbers; names that look like numbers or are blank are errors."""
    validate_rows(df)
    odd = [c for c in df.columns if not c.strip() or re.fullmatch(r"[+-]?\d+(\.\d+)?", c)]
    if odd:
        raise ValueError(f"odd column names: {odd[:5]}")
    if not {"projection_name", "x", "y"} <= set(df.columns):
        raise ValueError("a projection has the columns projection_name, x and y")
    x, y = (F.col(c).cast("double") for c in "xy")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if not df.filter(bad(x) | bad(y)).isEmpty():
        raise ValueError("coordinates are not finite")


def group_columns(columns: Sequence[str], category_of: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """Columns by category in fixed order, "Other" for unknown ones; by name inside, but taxonomy from the root down."""
    depth = {r: i for i, r in enumerate(RANKS)}
    out = []
    for category in CATEGORIES:
        mine = [c for c in columns if (category_of.get(c) if category_of.get(c) in CATEGORIES else "Other") == category]
        if mine:
            out.append((category, sorted(mine, key=(lambda c: (depth.get(c, len(depth)), c)) if category == "Taxonomy" else (lambda c: (c.lower(), c)))))
    return out


def resolve_styles(wanted: DataFrame, values: DataFrame, missing: Sequence[str] = ("", "<NA>", "NaN", "__NA__", "None")) -> DataFrame:
    """(value, found): a styles file's ``wanted`` (value) in the data's ``values`` (value): the equal one, else for a missing-value word the data's own word, else the one equal as a number; null where there is none."""
    have = values.select("value").distinct()
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in missing]), F.col("value")), F.lit(0))
    word = have.select("value", rank.alias("p")).filter("p > 0").agg(F.min_by("value", "p").alias("word"))
    number = have.select(F.col("value").try_cast("double").alias("x"), "value").filter("x is not null").groupBy("x").agg(F.min("value").alias("numeric"))
    exact = have.select(F.col("value").alias("exact"))
    out = wanted.join(exact, F.col("value") == F.col("exact"), "left").join(number, F.col("value").try_cast("double") == F.col("x"), "left").crossJoin(F.broadcast(word))
    return out.select("value", F.coalesce("exact", F.when(F.col("value").isin(*missing), F.col("word")), "numeric").alias("found"))


def read_annotations(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of annotations as text, tab- or comma-separated: the first column, whatever its name, is the identifier."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.withColumnRenamed(df.columns[0], "identifier")


def write_annotations(df: DataFrame, path: str, kind: str = "parquet", sep: str = ",") -> None:
    """Annotations as Parquet or as separated text with a header, by Spark's own writers."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    else:
        raise ValueError(f"kind is parquet or csv, not {kind}")
