"""Places in a total order without a window over all rows.

A sample gives cut points in the order (at most ``MAX_BUCKETS`` rows reach the driver); they are literals from then on, so a row's
bucket depends on nothing but the row, whichever task or retry computes it. Sums by bucket give each bucket's offset, and
windows run inside buckets. The order should end with a key, so that a value that many rows share is cut as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_ROWS, MAX_BUCKETS, SAMPLED = 500_000, 20_000, 20


def _bucketed(df: DataFrame, order: Sequence[Column], bucket_rows: int) -> tuple[DataFrame, int]:
    keyed = df.select("*", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_key"))
    n = df.count()
    wanted = min(MAX_BUCKETS, -(-n // bucket_rows))
    if wanted <= 1:
        return keyed.withColumn("_bucket", F.lit(0)), 1
    share = min(1.0, wanted * SAMPLED / n)
    # The sample is sorted and thinned by Spark: every SAMPLED-th of it is a cut.
    drawn = keyed.select("_key").sample(share, seed=11).orderBy("_key").limit(2 * wanted * SAMPLED).collect()
    cuts = [r["_key"] for r in drawn[SAMPLED::SAMPLED]]
    schema = keyed.schema["_key"].dataType
    table = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cuts)], f"_i int, _cut {schema.simpleString()}")
    literal = table.agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    # Binary search over the cuts, held as one broadcast row.
    low = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(cuts)).bit_length())), F.struct(F.lit(0).alias("lo"), F.size("_cuts").alias("hi")), _halve)["lo"]
    return keyed.crossJoin(F.broadcast(literal)).withColumn("_bucket", low).drop("_cuts"), len(cuts) + 1


def _halve(a: Column, _: Column) -> Column:
    mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    over, open_ = F.get(F.col("_cuts"), mid) <= F.col("_key"), a["lo"] < a["hi"]
    return F.struct(F.when(open_ & over, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~over, mid).otherwise(a["hi"]).alias("hi"))


def before(df: DataFrame, order: Sequence[Column], weight: Column | None = None, name: str = "before", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the sum of ``weight`` (1 if absent) over all rows before in ``order``; rows equal in it are in no set order."""
    keyed, n = _bucketed(df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight), order, bucket_rows)
    inside = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn(name, F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    if n > 1:
        sums = keyed.groupBy("_bucket").agg(F.sum("_weight").alias("_sum"))  # one row a bucket, here and in the window
        offset = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_offset")
        local = local.join(F.broadcast(offset), "_bucket").withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")
    return local.drop("_key", "_bucket", "_weight")


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with each row's place in ``order``."""
    return before(df, order, None, name, bucket_rows).withColumn(name, F.col(name) + start)


def midrank_table(df: DataFrame, c: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(``c``, ``name``): the mean rank of each value of ``c``; values are counted first, so a frequent one is one row of the sort."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    return before(counts, [F.col(c)], F.col("_n"), "_before", bucket_rows).select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def midranks(df: DataFrame, c: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the mean rank of each value of ``c``."""
    return df.join(midrank_table(df, c, name, bucket_rows), c)


def quantiles(df: DataFrame, c: str, shares: Sequence[float], bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """Exact quantiles with linear interpolation; nulls don't count. Only the values next to the places asked for reach the driver."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    n = counts.agg(F.sum("_n")).first()[0]
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(x) for x in at} | {min(n - 1, int(x) + 1) for x in at})
    ranked = before(counts, [F.col(c)], F.col("_n"), "_before", bucket_rows)
    places = F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w >= F.col("_before")) & (w < F.col("_before") + F.col("_n")))
    value = {r["w"]: r["v"] for r in ranked.select(F.explode(places).alias("w"), F.col(c).alias("v")).collect()}
    return [value[int(x)] + (value[min(n - 1, int(x) + 1)] - value[int(x)]) * (x - int(x)) for x in at]
