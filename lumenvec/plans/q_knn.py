"""Nearest neighbours and label transfer on the embeddings: rows with vec_id divisible by 5 ask, the others answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import knn, transfer
from lumenvec.plans.registry import query

QR = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id AS ref_id, embedding::DOUBLE[] AS r, label FROM embeddings WHERE vec_id % 5 <> 0)"
COS = "greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 - list_dot_product(q, r) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)))))"
EUC = "list_distance(q, r)"


def near_sql(k: int, d: str) -> str:
    return f"""{QR}, d AS (SELECT query_id, ref_id, label, {d} AS distance FROM q, r),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), ref_id) AS rank FROM d) WHERE rank <= {k})"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))
    return e.filter("id % 5 = 0"), e.filter("id % 5 <> 0")


@query("knn1", f"WITH {near_sql(5, COS)} SELECT query_id, ref_id, round(distance, 6) AS distance, rank::INT AS rank FROM n")
def knn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return knn.nearest(q, r, 5).select("query_id", "ref_id", F.round("distance", 6).alias("distance"), "rank")


@query("knn1_euclidean", f"WITH {near_sql(3, EUC)} SELECT query_id, ref_id, round(distance, 6) AS distance, rank::INT AS rank FROM n")
def knn1_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return knn.nearest(q, r, 3, "euclidean").select("query_id", "ref_id", F.round("distance", 6).alias("distance"), "rank")


@query("jn8", f"WITH {near_sql(1, COS)} SELECT query_id, ref_id, round(distance, 6) AS distance FROM n")
def jn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return knn.nearest(q, r, 1).select("query_id", "ref_id", F.round("distance", 6).alias("distance"))


@query("top6", f"WITH {near_sql(2, EUC)} SELECT query_id, ref_id, rank::INT AS rank FROM n")
def top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return knn.nearest(q, r, 2, "euclidean").select("query_id", "ref_id", "rank")


@query("knn2", f"WITH {QR} SELECT query_id, ref_id, round(CASE WHEN query_id % 10 = 0 THEN 1.0::DOUBLE ELSE {COS} END, 6) AS distance FROM q, r")
def knn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance with zero vectors among the queries: their distance to everything is 1."""
    q, r = sides(spark, sf_dir)
    q = q.withColumn("embedding", F.when(F.col("id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return knn.all_pairs(q, r).select("query_id", "ref_id", knn.rounded(F.col("distance"), 6).alias("distance"))


@query("knn3", "SELECT event_id, CASE WHEN value < 1 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - value / 100)), 6) END AS cosine, CASE WHEN value < 1 THEN 0.0 ELSE round(0.5::DOUBLE / (0.5::DOUBLE + greatest(0.0::DOUBLE, value / 100)), 6) END AS euclidean FROM events")
def knn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = F.when(F.col("value") < 1, F.lit(float("inf"))).otherwise(F.col("value") / 100)
    return e.select("event_id", F.round(knn.reliability(d, "cosine"), 6).alias("cosine"), F.round(knn.reliability(d, "euclidean"), 6).alias("euclidean"))


VOTE = """v AS (SELECT query_id, label, count(*) AS m, sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - distance))) AS s, min(struct_pack(d := round(distance, 9), i := ref_id)) AS b FROM n GROUP BY query_id, label),
w AS (SELECT *, s / sum(m) OVER (PARTITION BY query_id) AS ri FROM v),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ri, 9) DESC, b.d, label) AS place FROM w)"""


@query("knn4", f"WITH {near_sql(3, COS)}, {VOTE} SELECT query_id, label::VARCHAR AS label, b.i AS source_id, round(b.d, 6) AS distance, round(ri, 6) AS reliability FROM t WHERE place = 1")
def knn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    out = knn.transfer(q, r, 3)
    return out.select("query_id", "label", "source_id", F.round("distance", 6).alias("distance"), F.round("reliability", 6).alias("reliability"))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a label missing on a fifth, in several spellings, and a group column."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 10 == 0, F.lit(" NA ")).when(F.col("vec_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("L"), "label"))
    return e.select(F.col("vec_id").alias("id"), "embedding", label.cast("string").alias("family"), F.concat(F.lit("G"), F.col("label") % 3).alias("grp"))


VOTE1 = f"WITH {near_sql(1, COS)}"


@query("knn5", f"{VOTE1} SELECT query_id AS id, 'L' || label AS value, round(greatest(0.0::DOUBLE, 1 - distance), 4) AS confidence, ref_id::VARCHAR AS source FROM n")
def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transfer.run_transfer(table(spark, sf_dir), ["family"])
    return out.filter("family__pred_value is not null").select("id", F.col("family__pred_value").alias("value"), F.round(F.col("family__pred_confidence").cast("double"), 4).alias("confidence"), F.col("family__pred_source").alias("source"))


@query("knn6", f"{VOTE1} SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN ' NA ' WHEN vec_id % 5 = 0 THEN NULL ELSE 'L' || e.label END AS family, 'L' || n.label AS family__pred_value, ref_id::VARCHAR AS family__pred_source FROM embeddings e LEFT JOIN n ON e.vec_id = n.query_id")
def knn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = table(spark, sf_dir).withColumn("family__pred_value", F.lit("stale"))
    return transfer.run_transfer(stale, ["family"]).select("id", "family", "family__pred_value", "family__pred_source")


def companion_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id")
    return e.select(
        i.alias("id"), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("L"), "label")).alias("family"), F.when(i % 7 != 0, F.concat(F.lit("P"), i % 4)).alias("family__pred_value"),
        ((i % 13).cast("double") / 10).alias("family__pred_confidence"), F.when(i % 11 != 0, (i + 1).cast("string")).otherwise("NaN").alias("family__pred_source"),
    )


COMPANION = "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 AND vec_id % 7 <> 0 AND vec_id % 13 <= 10 AND vec_id % 11 <> 0 THEN 'P' || (vec_id % 4) END AS value, CASE WHEN vec_id % 3 <> 0 THEN 'L' || label END AS curated FROM embeddings"


@query("knn7", f"SELECT id, value, CASE WHEN value IS NOT NULL THEN round((id % 13)::DOUBLE / 10, 6) END AS confidence FROM ({COMPANION})")
def knn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.companions(companion_input(spark, sf_dir), "family").select("id", "predicted.value", F.round("predicted.confidence", 6).alias("confidence"))


@query("knn8", f"SELECT id, coalesce(curated, value) AS shown FROM ({COMPANION})")
def knn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.overlay(transfer.companions(companion_input(spark, sf_dir), "family"), "family").select("id", "shown")


@query("flt18", "SELECT c_custkey AS id, contains(lower(c_mktsegment), 'build') AS is_query, (starts_with(c_custkey::VARCHAR, '1') OR contains(lower(c_name), '9')) AND NOT contains(lower(c_mktsegment), 'build') AS is_reference FROM customer")
def flt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "id")
    return transfer.classify(c, transfer.Rule(where=(("c_mktsegment", "BUILD"),)), transfer.Rule(prefixes=("1",), where=(("c_name", "9"),))).select("id", "is_query", "is_reference")


@query(
    "jn16",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS source FROM orders WHERE o_orderkey % 3 = 0), l AS (
  SELECT id AS clicked, source AS other, 'source' AS direction FROM c UNION ALL SELECT source, id, 'target' FROM c),
m AS (SELECT *, other % 4 <> 0 AS seen FROM l),
n AS (SELECT *, count(*) FILTER (NOT seen) OVER (PARTITION BY clicked) AS n_out_of_view FROM m)
SELECT clicked, other, direction, n_out_of_view FROM (SELECT *, row_number() OVER (PARTITION BY clicked ORDER BY other, direction) AS r FROM n WHERE seen) WHERE r <= 200""",
)
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cells = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"))
    ids = o.select(F.col("o_orderkey").alias("id")).unionByName(o.select(F.col("o_custkey").alias("id"))).distinct()
    return transfer.provenance(cells, ids.filter("id % 4 <> 0"), ids)
