"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight ``w`` is to make up ``w / sum of weights`` of ``target_rows`` rows; over its ``n`` rows that is a
mean repetition rate of ``target_rows * w / (sum * n)``. Each row's count is the inverse of a Poisson distribution with
that mean at a uniform number taken from a hash of seed and row key, so it depends on nothing but the row: any
partitioning, retry or rerun gives the same counts. Rows are exploded by their counts and dealt out over the whole
cluster in the order of another hash (a range shuffle), which mixes all sources globally.

A rate above ``MAX_STEP`` is drawn as a sum of equal parts with a hash each, which keeps exp(-rate) and the length of
the distribution's table bounded. Sources without a weight get ``default_weight``; a null source counts as one source.

Defined results: a null key counts as the text 'null'; rows with an equal key get equal counts (and their copies equal
order keys); null, empty and long texts are carried along; an empty table gives an empty result; extra columns are
kept, with copy number and order key under names that are free.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import spare_name

MAX_STEP = 32.0
#: Entries of a part's table: beyond 32 + 96 the rest of the distribution is under 1e-30, less than a double can tell.
TABLE = 128
#: Sources up to which their rates are broadcast; beyond, a shuffled join takes over.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... TABLE - 1 for a rate of at most MAX_STEP."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("t"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["t"], F.array(a["c"] + p)).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), zero, step, lambda a: a["t"])


def source_rates(docs: DataFrame, weights: Mapping[str, float], target_rows: int | None = None, default_weight: float = 1.0, source: str = "source") -> DataFrame:
    """src (never null), n, parts and table of each source: one row a source."""
    w = F.lit(float(default_weight))
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    for k, v in weights.items():
        w = F.when(F.col("src") == k, F.lit(float(v))).otherwise(w)
    counts = docs.groupBy(name.alias("src")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", w)
    total = counts.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))  # one row
    rate = (F.lit(float(target_rows)) if target_rows is not None else F.col("n_all").cast("double")) * F.col("w") / (F.col("w_all") * F.col("n"))
    rates = counts.join(F.broadcast(total)).select("src", "n", rate.alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_STEP)).cast("int")
    return rates.withColumn("parts", parts).withColumn("table", poisson_table(F.col("rate") / F.col("parts")))


def replicate(docs: DataFrame, weights: Mapping[str, float], target_rows: int | None = None, default_weight: float = 1.0, seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture: ``docs`` with copy_no (from 0) and order_key, in the order of the latter, partition after partition."""
    spark = docs.sparkSession
    rates = source_rates(docs, weights, target_rows, default_weight, source)
    src, copies, order, parts, table = (spare_name(docs, x) for x in ("src", "copy_no", "order_key", "parts", "table"))
    rates = rates.select(F.col("src").alias(src), F.col("parts").alias(parts), F.col("table").alias(table))
    named = docs.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit("")))
    if rates.select(src).limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    keyed = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    # A part's number is hashed once and bound before the table is read, so that a row costs one MD5 a part.
    below = lambda i: F.aggregate(F.array(uniform(F.lit(seed), keyed, i.cast("string"))), F.lit(0), lambda a, u: a + F.size(F.filter(F.col(table), lambda c: c <= u)))
    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, i: a + below(i))
    drawn = named.join(rates, src).withColumn(copies, count).filter(F.col(copies) > 0).drop(src, parts, table)
    each = drawn.withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    each = each.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), keyed, F.col(copies).cast("string"))))
    # MD5 is uniform, so its first 32 bits over 2**32 name ranges of equal size: no pass over the rows to sample bounds.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    return each.repartitionById(n, place).sortWithinPartitions(order)


def replicate_sql(weights: Mapping[str, float], columns: str, table: str = "documents", seed: str = SEED) -> str:
    """DuckDB's SQL of ``replicate`` with target_rows and default_weight left alone."""
    case = "".join(f" WHEN src = '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items())
    return f"""
WITH d AS (SELECT *, coalesce(source, '') AS src FROM {table}),
c AS (SELECT src, count(*) AS n, CASE{case} ELSE 1.0::DOUBLE END AS w FROM d GROUP BY src),
r AS (SELECT src, (SELECT sum(n) FROM c)::DOUBLE * w / ((SELECT sum(w) FROM c) * n) AS rate FROM c),
s AS (SELECT src, greatest(1, ceil(rate / 32.0::DOUBLE))::INT AS parts, rate / greatest(1, ceil(rate / 32.0::DOUBLE))::INT AS rate FROM r),
p AS (SELECT src, parts, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM s, range(128) t(k)),
q AS (SELECT src, parts, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM p),
t AS (SELECT src, any_value(parts) AS parts, list(cdf ORDER BY k) AS tab FROM q GROUP BY src),
u AS (SELECT d.*, t.tab, unnest(range(1, t.parts + 1)) AS i, row_number() OVER () AS rid FROM d JOIN t ON d.src = t.src),
v AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS uni FROM u),
n AS (SELECT doc_id, any_value(COLUMNS(* EXCLUDE (doc_id, rid, i, uni, tab))), sum(len(list_filter(tab, lambda x: x <= uni)))::BIGINT AS k FROM v GROUP BY doc_id),
e AS (SELECT *, unnest(range(k)) AS copy FROM n)
SELECT {columns} FROM e"""
