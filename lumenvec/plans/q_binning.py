"""Binning of order totals, part sizes and customer balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import binning as b
from lumenvec.plans.registry import query


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))


def edge_rows(spark: SparkSession, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, round(e, 6)) for i, e in enumerate(edges)], "i int, edge double")


@query("agg5", "SELECT count(v) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi, count(DISTINCT v) AS d, coalesce(bool_and(v = floor(v)), true) AS ints, coalesce(bool_and(v > 0), false) AS pos FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = balances(spark, sf_dir).agg(*b.summary_columns(F.col("v")))
    return s.select(F.col("count").alias("n"), F.round("min", 4).alias("lo"), F.round("max", 4).alias("hi"), F.col("distinct").alias("d"), F.col("all_integers").alias("ints"), F.col("all_positive").alias("pos"))


@query("bin1", "SELECT i::INT AS i, round(CASE WHEN i = 8 THEN hi ELSE lo + (hi - lo) / 8 * i END, 6) AS edge FROM range(9) t(i), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def bin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.summarize(orders(spark, sf_dir), "v")
    return edge_rows(spark, b.linear_edges(s.min, s.max, 8))


@query("bin2", "SELECT i::INT AS i, round(q, 6) AS edge FROM (SELECT unnest(range(6)) AS i, unnest(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS q FROM orders)")
def bin2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_rows(spark, b.quantile_edges(orders(spark, sf_dir), "v", 5))


@query("bin3", "SELECT i::INT AS i, round(CASE WHEN i = 6 THEN hi WHEN i = 0 THEN lo ELSE pow(10, log10(lo) + (log10(hi) - log10(lo)) / 6 * i) END, 4) AS edge FROM range(7) t(i), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def bin3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.summarize(orders(spark, sf_dir), "v")
    return spark.createDataFrame([(i, round(e, 4)) for i, e in enumerate(b.log_edges(s.min, s.max, 6))], "i int, edge double")


@query("bin4", "SELECT 'linear' AS sparse, 'quantile' AS fallback, 'quantile' AS dense, (SELECT count(DISTINCT c_nationkey) FROM customer)::INT AS distinct_n")
def bin4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct values: lines; logarithms of values of both signs: quantiles; else as asked."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation, balance = b.summarize(c, "c_nationkey"), b.summarize(c, "c_acctbal")
    row = (b.effective_strategy("quantile", nation, 30), b.effective_strategy("logarithmic", balance, 5), b.effective_strategy("quantile", balance, 5), nation.distinct)
    return spark.createDataFrame([row], "sparse string, fallback string, dense string, distinct_n int")


@query(
    "bin5",
    """WITH v AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer),
e AS (SELECT list(lo + (hi - lo) / 4 * i ORDER BY i) AS e FROM range(4) t(i), (SELECT min(v) AS lo, max(v) AS hi FROM v))
SELECT id, CASE WHEN v IS NULL THEN 4 WHEN v < e[2] THEN 0 WHEN v < e[3] THEN 1 WHEN v < e[4] THEN 2 ELSE 3 END::INT AS bin_idx FROM v, e""",
)
def bin5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bins asked for; missing balances take one of them."""
    return b.materialize(balances(spark, sf_dir), "v", b.Settings("linear", 5))[0].select("id", "bin_idx")


@query("bin5_outside", "SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 1000 AND o_totalprice < 20000 THEN 0 ELSE 1 END::INT AS b FROM orders")
def bin5_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside all edges go to the last bin."""
    return orders(spark, sf_dir).select("id", b.assign(F.col("v"), [1000.0, 20000.0, 50000.0]).alias("b"))


@query(
    "bin6",
    """WITH e AS (SELECT quantile_cont(o_totalprice, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]) AS e FROM orders),
b AS (SELECT o_totalprice AS v, CASE WHEN v < e[2] THEN 0 WHEN v < e[3] THEN 1 WHEN v < e[4] THEN 2 WHEN v < e[5] THEN 3 WHEN v < e[6] THEN 4 ELSE 5 END AS b FROM orders, e),
r AS (SELECT b, count(*) AS n, regexp_replace(format('{:,.2f}', min(v)), '0$', '') AS lo, regexp_replace(format('{:,.2f}', max(v)), '0$', '') AS hi FROM b GROUP BY b)
SELECT lo || ' - ' || hi AS label, n FROM r""",
)
def bin6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = b.materialize(orders(spark, sf_dir), "v", b.Settings("quantile", 6))[1]
    return spark.createDataFrame([(x.label, x.count) for x in bins], "label string, n long")


_TEXT = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE format('{{:#.17g}}', {0}) END"


@query(
    "bin7",
    f"""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT i, lo + (hi - lo) / 4 * i AS a, CASE WHEN i = 3 THEN hi ELSE lo + (hi - lo) / 4 * (i + 1) END AS z FROM range(4) t(i), m)
SELECT 'num:linear:' || {_TEXT.format("a")} || ':' || {_TEXT.format("z")} AS id FROM b""",
)
def bin7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all bins that hold rows (here every one)."""
    bins = b.materialize(orders(spark, sf_dir), "v", b.Settings("linear", 4))[1]
    return spark.createDataFrame([(x.id,) for x in bins], "id string")


@query(
    "bin8",
    """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size), w AS (SELECT p_size, n, sum(n) OVER (ORDER BY p_size) AS upto, sum(n) OVER () AS total, row_number() OVER (ORDER BY p_size) AS r, count(*) OVER () AS k FROM c)
SELECT p_size::INT AS p_size, round(CASE WHEN r = 1 THEN 0 WHEN r = k THEN 1 ELSE (upto - n / 2) / total END, 6)::DOUBLE AS position FROM w""",
)
def bin8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return b.cumulative_positions(c, "p_size").select("p_size", F.round("position", 6).alias("position"))


@query("bin10", "SELECT c_custkey AS id, 0::INT AS bin_idx FROM customer")
def bin10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit(None).cast("double").alias("v"))
    return b.materialize(c, "v")[0].select("id", "bin_idx")


@query("bin11", "SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END::INT AS c_nationkey__bin FROM customer")
def bin11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two numeric columns only the selected one is binned."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    out = b.materialize_selected(c, ["c_nationkey", "c_acctbal"], "c_nationkey", settings={"c_nationkey": b.Settings("linear", 2)})
    return out.select(F.col("c_custkey").alias("id"), *[x for x in out.columns if x.endswith("__bin")])


@query(
    "top5",
    f"""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT i, lo + (hi - lo) / 4 * i AS a, CASE WHEN i = 3 THEN hi ELSE lo + (hi - lo) / 4 * (i + 1) END AS z FROM range(4) t(i), m)
SELECT CASE i WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::INT AS place, 'num:linear:' || {_TEXT.format("a")} || ':' || {_TEXT.format("z")} AS id FROM b UNION ALL SELECT 4, '__NA__'""",
)
def top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's bins by lower bound, the third one put first by hand; an id that is gone counts for nothing."""
    bins = b.materialize(orders(spark, sf_dir), "v", b.Settings("linear", 4))[1]
    ids = b.ordered_ids(bins[::-1], "manual", ["gone", bins[2].id], True)
    return spark.createDataFrame(list(enumerate(ids)), "place int, id string")
