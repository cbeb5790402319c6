"""Label transfer over tables: which rows ask, which answer, and what the answers become."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.functions.missing import transfer_missing
from lumenvec.operators.knn import transfer


@dataclass(frozen=True)
class Rule:
    """A row matches if its id starts with any prefix or any named column contains its text, in either case. A rule without clauses is open."""

    prefixes: tuple[str, ...] = ()
    where: tuple[tuple[str, str], ...] = field(default=())

    @property
    def is_open(self) -> bool:
        return not self.prefixes and not self.where

    def matches(self, id_col: str = "id") -> Column:
        if self.is_open:
            return F.lit(True)
        test = F.lit(False)
        for p in self.prefixes:
            test = test | F.col(id_col).cast("string").startswith(p)
        for c, text in self.where:
            test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
        return test


def classify(df: DataFrame, query: Rule = Rule(), reference: Rule = Rule(), id_col: str = "id", check: bool = False) -> DataFrame:
    """``df`` with is_query and is_reference. Of two explicit rules the query's wins; an open one matches all and takes none away.

    ``check`` raises where an explicit rule, or an empty table, leaves a side without rows.
    """
    q, r = query.matches(id_col), reference.matches(id_col)
    if not query.is_open and not reference.is_open:
        r = r & ~q
    out = df.withColumns({"is_query": q, "is_reference": r})
    if check:
        n = out.agg(F.count_if("is_query"), F.count_if("is_reference")).first()
        if not n[0]:
            raise ValueError("no query rows")
        if not n[1] and not reference.is_open:
            raise ValueError("no reference rows")
    return out


def run_transfer(df: DataFrame, columns: list[str], query: Rule = Rule(), reference: Rule = Rule(), k: int = 1, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``df`` (id, vector, annotation columns) with three prediction columns for each of ``columns``.

    References are classified rows with a vector and a value, queries classified rows with a vector and without one. A
    column without either side gets no prediction columns' values.
    """
    marked = classify(df.filter(F.col(vec_col).isNotNull()), query, reference, id_col)
    out = df
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)
        missing = transfer_missing(F.col(c).cast("string"))
        side = marked.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), F.col(c).cast("string").alias("label"), "is_query", "is_reference", missing.alias("missing"))
        predicted = transfer(side.filter("is_query and missing"), side.filter("is_reference and not missing"), k, metric)
        out = add_overlay(out, c, predicted, id_col)
    return out


def add_overlay(df: DataFrame, column: str, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns COLUMN__pred_value, __pred_confidence (single precision) and __pred_source; older ones are replaced, the column itself stays."""
    names = [f"{column}__pred_{x}" for x in ("value", "confidence", "source")]
    p = predicted.select(F.col("query_id").alias("_id"), F.col("label").alias(names[0]), F.col("reliability").cast("float").alias(names[1]), F.col("source_id").cast("string").alias(names[2]))
    return df.drop(*names).join(p, F.col(id_col) == F.col("_id"), "left").drop("_id")


def companions(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``predicted``: struct(value, confidence, source) where the curated value is missing and the prediction is whole with a confidence from 0 to 1; else null."""
    v, c, s = (F.col(f"{column}__pred_{x}") for x in ("value", "confidence", "source"))
    # NaN sorts above all numbers, so the upper bound excludes it.
    valid = transfer_missing(F.col(column).cast("string")) & ~transfer_missing(v) & c.between(0, 1) & ~transfer_missing(s)
    return df.withColumn("predicted", F.when(valid, F.struct(v.alias("value"), c.cast("double").alias("confidence"), s.alias("source"))))


def overlay(df: DataFrame, column: str, enabled: bool = True) -> DataFrame:
    """``shown``: the curated value, or else the predicted one if the overlay is on."""
    curated = F.when(~transfer_missing(F.col(column).cast("string")), F.col(column).cast("string"))
    return df.withColumn("shown", F.coalesce(curated, F.col("predicted.value")) if enabled else curated)


def provenance(cells: DataFrame, view: DataFrame, clicked: DataFrame, cap: int = 200) -> DataFrame:
    """Links around clicked rows: (clicked, other, direction, n_out_of_view).

    ``cells`` (id, source): predicted rows. A predicted row links to its source, a source to its targets. At most
    ``cap`` links of a clicked row that end in ``view`` (id) are returned, smallest id first; those outside are counted.
    """
    links = cells.select(F.col("id").alias("clicked"), F.col("source").alias("other"), F.lit("source").alias("direction")).unionByName(
        cells.select(F.col("source").alias("clicked"), F.col("id").alias("other"), F.lit("target").alias("direction"))
    )
    mine = links.join(clicked.select(F.col("id").alias("clicked")), "clicked", "left_semi")
    seen = mine.join(view.select(F.col("id").alias("other"), F.lit(True).alias("in_view")), "other", "left")
    out = F.count_if(F.col("in_view").isNull()).over(Window.partitionBy("clicked")).alias("n_out_of_view")
    ranked = seen.select("clicked", "other", "direction", "in_view", out)
    r = F.row_number().over(Window.partitionBy("clicked").orderBy("other", "direction"))
    return ranked.filter("in_view").withColumn("r", r).filter(F.col("r") <= cap).select("clicked", "other", "direction", "n_out_of_view")
