"""Statistics of the embeddings under their labels and of a plane made of their first two components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import distance_ranks, ranks, stats
from lumenvec.plans.registry import query

P = "p AS (SELECT vec_id AS id, CASE WHEN vec_id = 3 THEN 'alone' ELSE label::VARCHAR END AS c, embedding::DOUBLE[] AS v, embedding[1:2]::DOUBLE[] AS xy FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, one of them a category by itself, with their first two components as a layout."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") == 3, "alone").otherwise(F.col("label").cast("string")).alias("c"), v.alias("v"), F.slice(v, 1, 2).alias("xy"))


SIL = """d AS (SELECT a.id, a.c AS own, b.c AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM p a, p b GROUP BY ALL),
ab AS (SELECT id, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b, max(CASE WHEN own = other THEN n END) AS m FROM d GROUP BY ALL),
s AS (SELECT id, own AS c, CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("sta4", f"WITH {P}, {SIL} SELECT NULL AS category, round(avg(s), 6) AS value FROM s UNION ALL SELECT c, round(avg(s), 6) FROM s GROUP BY c HAVING count(*) > 1")
def sta4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.silhouette(points(spark, sf_dir)).select("category", F.round("value", 6).alias("value"))


CENT = """q AS (SELECT * FROM p WHERE c <> 'alone'), u AS (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS j FROM q), cj AS (SELECT c, j, avg(x) AS x FROM u GROUP BY ALL),
m AS (SELECT c, list(x ORDER BY j) AS m FROM cj GROUP BY c), sp AS (SELECT c, avg(list_distance(v, m)) AS s FROM q JOIN m USING (c) GROUP BY c)"""


@query("sta5", f"WITH {P}, {CENT}, k AS (SELECT m.c, m.m, sp.s FROM m JOIN sp USING (c)), r AS (SELECT a.c, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM k a JOIN k b ON a.c <> b.c GROUP BY a.c) SELECT c AS category, round(r, 5) AS value FROM r UNION ALL SELECT NULL, round(avg(r), 5) FROM r")
def sta5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.davies_bouldin(points(spark, sf_dir)).select("category", F.round("value", 5).alias("value"))


@query("sta6", f"WITH {P}, {CENT}, g AS (SELECT list(x ORDER BY j) AS g FROM (SELECT j, avg(x) AS x FROM u GROUP BY j)), b AS (SELECT sum(n * pow(list_distance(m, g), 2)) AS b, count(*) AS k, sum(n) AS n FROM m JOIN (SELECT c, count(*) AS n FROM q GROUP BY c) USING (c), g), w AS (SELECT sum(pow(list_distance(v, m), 2)) AS w FROM q JOIN m USING (c)) SELECT round(b * (n - k) / (w * (k - 1)), 5) AS value FROM b, w")
def sta6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.calinski_harabasz(points(spark, sf_dir)).select(F.round("value", 5).alias("value"))


@query(
    "sta7",
    """WITH f AS (SELECT CASE WHEN n_chars > 1500 THEN 'long' WHEN n_chars > 500 THEN 'mid' ELSE 'short' END AS a, quality AS b FROM documents JOIN labels USING (doc_id)),
t AS (SELECT a, b, count(*)::DOUBLE AS n FROM f GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM t GROUP BY a), c AS (SELECT b, sum(n) AS c FROM t GROUP BY b), g AS (SELECT sum(n) AS t FROM t),
x AS (SELECT sum(n * (n - 1) / 2) AS nij, sum(n / t * ln(n * t / (r * c))) AS mi FROM t JOIN r USING (a) JOIN c USING (b), g),
rr AS (SELECT sum(r * (r - 1) / 2) AS r2, -sum(r / t * ln(r / t)) AS rh FROM r, g), cc AS (SELECT sum(c * (c - 1) / 2) AS c2, -sum(c / t * ln(c / t)) AS ch FROM c, g)
SELECT round((nij - r2 * c2 / (t * (t - 1) / 2)) / ((r2 + c2) / 2 - r2 * c2 / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((rh + ch) / 2), 6) AS nmi FROM x, rr, cc, g""",
)
def sta7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    n = F.col("n_chars")
    f = d.join(lab, "doc_id").select(F.when(n > 1500, "long").when(n > 500, "mid").otherwise("short").alias("a"), "quality")
    return stats.agreement(f, "a", "quality").select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


RANKS = f"""{P}, d AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 9) AS h, round(list_distance(a.xy, b.xy), 9) AS l FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY h, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY l, j) AS rl FROM d), n AS (SELECT count(*)::DOUBLE AS n FROM p)"""


@query("sta8", f"WITH {RANKS} SELECT round(count(*) FILTER (rh <= 10 AND rl <= 10) / (max(n) * 10), 6) AS knn_overlap FROM r, n")
def sta8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.knn_overlap(points(spark, sf_dir), 10, "euclidean").select(F.round("knn_overlap", 6).alias("knn_overlap"))


@query("sta9", f"WITH {RANKS} SELECT round(1 - sum(CASE WHEN rl <= 10 AND rh > 10 THEN rh - 10 ELSE 0 END) * 2 / (max(n) * 10 * (2 * max(n) - 31)), 6)::DOUBLE AS trustworthiness, round(1 - sum(CASE WHEN rh <= 10 AND rl > 10 THEN rl - 10 ELSE 0 END) * 2 / (max(n) * 10 * (2 * max(n) - 31)), 6)::DOUBLE AS continuity FROM r, n")
def sta9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.faithfulness(points(spark, sf_dir), 10, "euclidean").select(F.round("trustworthiness", 6).alias("trustworthiness"), F.round("continuity", 6).alias("continuity"))


def _cos(a: str, b: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))), 9)"


@query(
    "sta10",
    f"""WITH {P}, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM p), n AS (SELECT count(*) AS n FROM p),
t AS (SELECT pos, v, xy, unnest(range(1, 6)) AS t FROM o),
j AS (SELECT *, ('0x' || substr(md5(pos || ':' || t || ':j'), 1, 8))::BIGINT % (n - 1) + 1 AS oj, ('0x' || substr(md5(pos || ':' || t || ':m'), 1, 8))::BIGINT % (n - 2) + 1 AS m0 FROM t, n),
m AS (SELECT *, m0 + (m0 >= oj)::INT AS om FROM j)
SELECT round(avg((({_cos("m.v", "a.v")} < {_cos("m.v", "b.v")}) = (round(list_distance(m.xy, a.xy), 9) < round(list_distance(m.xy, b.xy), 9)))::INT), 6) AS value
FROM m JOIN o a ON a.pos = (m.pos + oj) % n JOIN o b ON b.pos = (m.pos + om) % n""",
)
def sta10(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ranks.numbered(points(spark, sf_dir), [F.col("id")], "pos", 0)
    return stats.triplet_accuracy(at).select(F.round("value", 6).alias("value"))


@query("sta11", f"WITH {P}, d AS (SELECT round(list_distance(a.v, b.v), 9) AS h, round(list_distance(a.xy, b.xy), 9) AS l FROM p a JOIN p b ON a.id < b.id), r AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2 AS rh, rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2 AS rl FROM d) SELECT round(corr(rh, rl), 6) AS value FROM r")
def sta11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance_ranks.spearman(points(spark, sf_dir), "euclidean").select(F.round("value", 6).alias("value"))


@query("sta12", "SELECT 0::BIGINT AS rows, 1::INT AS k_small, 10::INT AS k_large")
def sta12(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = stats.faithfulness(points(spark, sf_dir).filter("id < 2"), 10).agg(F.count(F.lit(1)).alias("rows"))
    return none.select("rows", F.lit(stats.clamp_k(10, 3)).alias("k_small"), F.lit(stats.clamp_k(10, 100)).alias("k_large"))


@query("sta2", """WITH v AS (SELECT sum(c_acctbal) AS y FROM customer GROUP BY c_nationkey), r AS (SELECT y, row_number() OVER (ORDER BY y DESC) - 1 AS i FROM v),
d AS (SELECT i, (1 - i / (SELECT max(i) FROM r)::DOUBLE) - (y - (SELECT min(y) FROM r)) / ((SELECT max(y) FROM r) - (SELECT min(y) FROM r)) AS d FROM r),
b AS (SELECT i, d FROM d ORDER BY d DESC, i LIMIT 1) SELECT (2 + i)::INT AS k, d >= 0.05 AND (SELECT count(*) FROM r) >= 4 AS trusted, 2::INT AS short_k, false AS short_trusted FROM b""")
def sta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elbow of a falling curve from a table (nations by their customers' balance), and of a curve of two points, which has none to trust."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("y")).orderBy(F.desc("y"))
    y = [float(r["y"]) for r in c.collect()]  # a row a nation
    k, trusted = stats.elbow(list(range(2, 2 + len(y))), y)
    s, t = stats.elbow([2, 3], y[:2])
    return spark.createDataFrame([(k, trusted, s, t)], "k int, trusted boolean, short_k int, short_trusted boolean")


@query("sta16", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '—' WHEN event_id % 50 = 1 THEN '0.00' WHEN abs(value) >= 100 THEN printf('%.0f', floor(value + 0.5)) ELSE printf('%.2f', value) END AS text FROM events")
def sta16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 50
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(-0.001)).otherwise(F.col("value"))
    return e.select("event_id", stats.format_value(v).alias("text"))


@query("flt21", "SELECT 'c_mktsegment' AS col")
def flt21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("cluster_x", F.col("c_mktsegment")).withColumn("one", F.lit("same"))
    return spark.createDataFrame([(x,) for x in stats.suitable_columns(c, "c_custkey")], "col string")


@query("flt22", "SELECT 'c_mktsegment' AS annotation, c_custkey AS id, c_mktsegment AS label FROM customer WHERE c_custkey % 4 <> 0")
def flt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    seg = F.when(F.col("c_custkey") % 4 == 0, "<NA>").otherwise(F.concat("c_mktsegment", F.lit("|EXP")))
    return stats.labels_for(c.select("c_custkey", seg.alias("c_mktsegment"), F.lit("x").alias("one")), "c_mktsegment, one", "c_custkey")


# A statistics table out of line items: one row for each (annotation, space, metric).
STAT = """(SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'embedding' ELSE 'projection' END AS space_kind, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_linenumber = 3 OR l_returnflag <> 'A' THEN 'E1' ELSE 'E2' END ELSE 'P' || l_linenumber END AS space_name,
  'ann' || l_returnflag AS annotation, CASE WHEN l_linestatus = 'F' THEN 'annotation_validity' ELSE 'cluster_agreement' END AS stat_family, 'elbow' AS label_kind,
  CASE WHEN l_linestatus = 'F' THEN 'silhouette' ELSE 'adjusted_rand' END AS metric, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus)"""


def stat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, n = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_linenumber")
    g = li.groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("value"))
    inner, valid = n % 3 == 0, F.col("l_linestatus") == "F"
    return g.select(
        F.when(inner, "embedding").otherwise("projection").alias("space_kind"), F.when(inner, F.when((n == 3) | (F.col("l_returnflag") != "A"), "E1").otherwise("E2")).otherwise(F.concat(F.lit("P"), n)).alias("space_name"),
        F.concat(F.lit("ann"), "l_returnflag").alias("annotation"), F.when(valid, "annotation_validity").otherwise("cluster_agreement").alias("stat_family"), F.lit("elbow").alias("label_kind"),
        F.when(valid, "silhouette").otherwise("adjusted_rand").alias("metric"), F.lit("validity").alias("metric_kind"), "value", F.lit(None).cast("string").alias("category"), F.lit("{}").alias("extra_json"),
    )


@query("agg13", f"WITH t AS (SELECT * FROM {STAT}), e AS (SELECT metric, CASE WHEN count(DISTINCT space_name) = 1 THEN max(value) END AS embedding FROM t WHERE annotation = 'annA' AND space_kind = 'embedding' AND stat_family = 'annotation_validity' GROUP BY metric) SELECT t.metric, t.value, e.embedding FROM t LEFT JOIN e USING (metric) WHERE annotation = 'annA' AND space_name = 'P1' AND stat_family = 'annotation_validity'")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stat_summary(stat_table(spark, sf_dir), "annA", "P1")


@query("agg14", f"SELECT annotation, value AS adjusted_rand, row_number() OVER (ORDER BY value DESC, annotation)::INT AS place FROM {STAT} WHERE stat_family = 'cluster_agreement' AND space_name = 'P2'")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster_agreement(stat_table(spark, sf_dir), "elbow", "P2").select("annotation", "adjusted_rand", "place")


@query("agg15", f"SELECT annotation AS category, value AS silhouette, NULL::DOUBLE AS davies_bouldin, NULL::DOUBLE AS embedding FROM {STAT} WHERE stat_family = 'annotation_validity' AND space_name = 'P4'")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stat_table(spark, sf_dir)
    return stats.category_scores(t.withColumn("category", F.col("annotation")).withColumn("annotation", F.lit("x")), "x", "P4")


@query("agg18", f"SELECT stat_family, count(*) AS n FROM {STAT} GROUP BY stat_family")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by destination, all in one pass."""
    return stat_table(spark, sf_dir).filter(F.col("stat_family").isin("annotation_validity", "cluster_agreement")).groupBy("stat_family").agg(F.count(F.lit(1)).alias("n"))
