"""Legends: label frequencies, sort modes, the largest labels with the rest under "Other", dictionaries and encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.functions.missing import NA
from lumenvec.operators import ranks

OTHER = "Other"
SHAPES = 6
MODES = ("size-desc", "size-asc", "alpha-asc", "alpha-desc", "manual", "manual-reverse")


def natural_key(c: Column) -> Column:
    """A key whose plain order is the case-insensitive, number-aware order: each run of digits stands behind its length, zeros at its start taken off."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.format_string("0%09d", F.length(bare(x))), bare(x))).otherwise(x)), "")


def frequencies(rows: DataFrame, labels: str, known: DataFrame | None = None) -> DataFrame:
    """(value, n): label occurrences, repeated labels of a row counted each; a row without labels counts under NA.

    ``known`` (value) adds values that don't occur, with 0.
    """
    each = F.when(F.size(F.coalesce(F.col(labels), F.array())) == 0, F.array(F.lit(NA))).otherwise(F.transform(labels, lambda x: F.coalesce(x, F.lit(NA))))
    counts = rows.select(F.explode(each).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts if known is None else counts.join(known.select("value").distinct(), "value", "full").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def order_of(mode: str, numeric_source: bool = False) -> list[Column]:
    """Sort columns over (value, n, and for the manual modes z; for numeric labels also place); ends with the value, so that ties are
    settled. All but those of alpha-desc are plain ascending keys, as ``ranks`` takes them."""
    if mode not in MODES:
        raise ValueError(mode)
    head = [(F.col("value") == NA).cast("int")] if numeric_source else []
    if mode.startswith("manual"):
        z = F.coalesce(F.col("z"), F.lit((1 << 53) - 1))
        return [*head, z if mode == "manual" else -z, F.col("value")]
    if mode.startswith("alpha"):
        key = natural_key(F.col("value"))
        return [*head, key if mode == "alpha-asc" else key.desc(), -F.col("n"), F.col("value")]
    return [*head, F.col("n") if mode == "size-asc" else -F.col("n"), F.col("value")]


def top_k(
    counts: DataFrame, k: int = 10, mode: str = "size-desc", visible: Sequence[str] = (), extract: str | None = None, merge: str | None = None, isolated: bool = False, numeric_source: bool = False, z_orders: Mapping[str, int] | None = None
) -> DataFrame:
    """(value, n, rank, is_other): the first ``k`` values in order, and one row for all others with their summed count.

    Named visible values come first (one to extract is added, one to merge taken out and not brought back); others fill
    up what is left of ``k``, unless rows are isolated. is_other tells the bucket from a label of the same name.
    """
    shown = (set(visible) | ({extract} if extract is not None else set())) - ({merge} if merge is not None else set())
    z = F.lit(None).cast("long")
    for v, o in (z_orders or {}).items():
        z = F.when(F.col("value") == v, F.lit(o)).otherwise(z)
    named = counts.withColumn("z", z)
    first = F.col("value").isin(*shown) if shown else F.lit(True)
    barred = F.lit(False) if merge is None or not shown else F.col("value") == merge
    barred = barred | (~first if isolated and shown else F.lit(False))
    order = [F.col("first").desc(), *order_of(mode, numeric_source)]
    # Each task keeps its first k; only k rows are numbered, and all others are a sum less theirs.
    top = named.withColumn("first", first).filter(~barred).orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    top = top.select("value", "rank", F.lit(False).alias("is_other"), "n")
    every = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.count(F.lit(1)).alias("d"))))
    rest = every.filter("c > d").select(F.lit(OTHER).alias("value"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("is_other"), (F.col("n") - F.col("m")).alias("n"))
    return top.unionByName(rest)


def silhouette_order(descending: bool = True) -> list[Column]:
    """Over (value, is_other, score, z), as ascending keys: Other last, then unscored ones, ties by z-order."""
    return [F.col("is_other").cast("int"), F.col("score").isNull().cast("int"), -F.col("score") if descending else F.col("score"), F.col("z")]


def dictionary(rows: DataFrame, labels: str, position: str, by_frequency: bool = True) -> DataFrame:
    """(value, n, idx): distinct labels by falling number of occurrences, first seen on ties (or by first appearance alone); NA goes last if any row has no label."""
    at = rows.select(F.col(position).alias("p"), F.posexplode(labels).alias("j", "value"))
    each = at.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "j")).alias("seen"))
    empty = rows.filter(F.size(F.coalesce(F.col(labels), F.array())) == 0).groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(NA).alias("value"), "n", F.struct(F.lit(None).cast("long").alias("p"), F.lit(None).cast("int").alias("j")).alias("seen"))
    both = each.withColumn("last", F.lit(0)).unionByName(empty.withColumn("last", F.lit(1)))
    order = [F.col("last"), -F.col("n"), F.col("seen")] if by_frequency else [F.col("last"), F.col("seen")]
    return ranks.numbered(both, order, "idx", 0).select("value", "n", F.col("idx").cast("int").alias("idx"))


def colors_and_shapes(idx: Column, palette: int, shapes: int = SHAPES) -> tuple[Column, Column]:
    """Numbers of colour and shape by place in the dictionary: colours go round first; places repeat after all pairs."""
    i = F.pmod(idx, F.lit(palette * shapes))
    return (i % palette).cast("int"), (F.floor(i / palette) % shapes).cast("int")


def row_colors(labels: Column, color: Mapping[str, str], hidden: Sequence[str], other: Sequence[str], neutral: str = "#888888") -> Column:
    """Distinct colours of a row's labels that aren't hidden; Other's are neutral, and rows of Other alone are just that."""
    known = F.create_map(*[F.lit(x) for kv in color.items() for x in kv])
    of = lambda v: F.when(v.isin(*other), F.lit(neutral)).otherwise(F.coalesce(F.try_element_at(known, v), F.lit(neutral)))
    drawn = F.array_distinct(F.transform(F.filter(labels, lambda v: ~v.isin(*hidden)), of))
    alone = (F.size(F.coalesce(labels, F.array())) < 1) | F.forall(labels, lambda v: v.isin(*other))
    return F.when(alone, F.array(F.lit(neutral))).otherwise(drawn)


def row_shape(labels: Column, shape: Mapping[str, str], other: Sequence[str], numeric: bool = False) -> Column:
    """The label's shape; a circle for rows of several labels or none, for Other and for numbers."""
    known = F.create_map(*[F.lit(x) for kv in shape.items() for x in kv])
    v = F.get(labels, F.lit(0))
    return F.when(F.lit(numeric) | (F.size(F.coalesce(labels, F.array())) != 1) | v.isin(*other), "circle").otherwise(F.coalesce(F.try_element_at(known, v), F.lit("circle")))
