"""Layouts of the embeddings, and the tables of pairs that they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import manifold
from lumenvec.plans.registry import query

#: Rows numbered by id, and each one's 60 nearest others by Euclidean distance.
ROWS = "r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no, embedding::DOUBLE[] AS v FROM embeddings)"
NEAR = f"""{ROWS}, d AS (SELECT a.no AS i, b.no AS j, list_distance(a.v, b.v) AS d FROM r a, r b WHERE a.no <> b.no),
near AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS place FROM d) WHERE place <= %d)"""
DRAW = "('0x' || substr(md5('42:%s:' || i || ':' || %s), 1, 15))::BIGINT %% (SELECT count(*) FROM r)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


@query("dr3")
def dr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.umap(vectors(spark, sf_dir))


@query("dr3_graph", f"""WITH RECURSIVE {NEAR % 14},
l AS (SELECT i, list(d ORDER BY d, j) AS ds, list(j ORDER BY d, j) AS js, coalesce(min(d) FILTER (d > 0), 0) AS rho, avg(d) AS mean FROM near GROUP BY i),
b AS (SELECT i, 0 AS t, 0.0::DOUBLE AS low, 'Infinity'::DOUBLE AS high, 1.0::DOUBLE AS mid FROM l UNION ALL
  SELECT i, t + 1, CASE WHEN more THEN low ELSE mid END, CASE WHEN more THEN mid ELSE high END, CASE WHEN more THEN (low + mid) / 2 WHEN isinf(high) THEN mid * 2 ELSE (mid + high) / 2 END
  FROM (SELECT b.*, list_sum(list_transform(ds, lambda x: exp(-greatest(0.0, x - rho) / mid))) > log2(15) AS more FROM b JOIN l USING (i)) WHERE t < 64),
w AS (SELECT l.i, unnest(js) AS j, exp(-greatest(0.0, unnest(ds) - rho) / greatest(mid, mean / 1000)) AS w FROM l JOIN b ON l.i = b.i AND t = 64),
u AS (SELECT least(i, j) AS a, greatest(i, j) AS b, sum(w) AS s, max(w) AS m FROM w GROUP BY 1, 2)
SELECT a AS i, b AS j, round(s - m * (s - m), 6) AS w FROM u UNION ALL SELECT b, a, round(s - m * (s - m), 6) FROM u""")
def dr3_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = manifold.near_lists(manifold.numbered_vectors(vectors(spark, sf_dir)), 14)
    return manifold.fuzzy_graph(near, 15).select("i", "j", F.round("w", 6).alias("w"))


@query("dr4")
def dr4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.pacmap(vectors(spark, sf_dir))


NEAR_PAIRS = f"""{NEAR % 60}, s AS (SELECT i, greatest(coalesce(avg(d) FILTER (place BETWEEN 4 AND 6), avg(d)), 1e-10) AS scale FROM near GROUP BY i),
p AS (SELECT near.i, near.j, row_number() OVER (PARTITION BY near.i ORDER BY round(d * d / (a.scale * b.scale), 9), near.j) AS p FROM near JOIN s a ON a.i = near.i JOIN s b ON b.i = near.j)"""


@query("dr4_near", f"WITH {NEAR_PAIRS} SELECT i, j FROM p WHERE p <= 10")
def dr4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.pacmap_near(manifold.near_lists(manifold.numbered_vectors(vectors(spark, sf_dir)), 60), 10)


@query("dr4_mid", f"""WITH {ROWS}, k AS (SELECT no AS i, v AS u, slot, t FROM r, range(5) s(slot), range(6) x(t)),
m AS (SELECT i, u, slot, {DRAW % ("mid", "slot || ':' || t")} AS j FROM k),
d AS (SELECT DISTINCT i, slot, j, round(list_sum(list_transform(list_zip(u, v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS d FROM m JOIN r ON r.no = m.j WHERE i <> j)
SELECT i, slot, coalesce(list(j ORDER BY d, j)[2], list(j ORDER BY d, j)[1]) AS j FROM d GROUP BY i, slot""")
def dr4_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifold.numbered_vectors(vectors(spark, sf_dir))
    return manifold.pacmap_mid(rows, rows.count(), 5).select("i", F.col("slot").cast("long").alias("slot"), "j")


@query("dr4_far", f"""WITH {NEAR_PAIRS}, k AS (SELECT no AS i, slot FROM r, range(20) s(slot)),
m AS (SELECT DISTINCT i, {DRAW % ("far", "slot")} AS j FROM k)
SELECT i, j FROM m WHERE i <> j AND NOT EXISTS (SELECT 1 FROM p WHERE p.i = m.i AND p.j = m.j AND p <= 10)""")
def dr4_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifold.numbered_vectors(vectors(spark, sf_dir))
    return manifold.pacmap_far(rows, dr4_near(spark, sf_dir), rows.count(), 20)


@query("dr5")
def dr5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.localmap(vectors(spark, sf_dir))
