"""Legends and views over parts (labels: the words of a part's name), events, line items and embeddings (first components as a plane)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import legend, ranks, spatial, views
from lumenvec.plans.registry import query
from lumenvec.sources.shared import fresh_path

PARTS = """p AS (SELECT p_partkey AS id, p_partkey % 9 = 0 AS m, string_split(p_name, ' ') AS w, p_type, p_brand, p_size FROM part),
l AS (SELECT id, unnest(CASE WHEN m THEN ['__NA__'] ELSE w END) AS value, unnest(range(CASE WHEN m THEN 1 ELSE len(w) END)) AS j FROM p),
f AS (SELECT value, count(*) AS n FROM l GROUP BY value)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 != 0, F.split("p_name", " ")).alias("labels"), "p_type", "p_brand", "p_size")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.frequencies(parts(spark, sf_dir), "labels")


@query("agg1", f"WITH {PARTS} SELECT value, n FROM f UNION ALL SELECT 'unused', 0")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("unused",), ("small",)], "value string")
    return legend.frequencies(parts(spark, sf_dir), "labels", known)


def top_sql(order: str, k: int, first: str = "true", barred: str = "false") -> str:
    return f"""WITH {PARTS}, r AS (SELECT value, n, {barred} AS barred, row_number() OVER (ORDER BY {barred}, ({first}) DESC, {order}) AS rank FROM f),
s AS (SELECT *, rank <= {k} AND NOT barred AS kept FROM r)
SELECT CASE WHEN kept THEN value ELSE 'Other' END AS value, CASE WHEN kept THEN rank END::INT AS rank, NOT kept AS is_other, sum(n)::BIGINT AS n FROM s GROUP BY ALL"""


@query("top1", top_sql("n DESC, value", 5))
def top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 5)


@query("top1_visible", top_sql("n DESC, value", 4, "value IN ('ring', 'small', 'bolt')", "value = 'large'"))
def top1_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 4, visible=("ring", "small"), extract="bolt", merge="large")


@query("top1_isolated", top_sql("n DESC, value", 4, "value IN ('ring', 'small')", "value NOT IN ('ring', 'small')"))
def top1_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 4, visible=("ring", "small"), isolated=True)


@query("top2", top_sql("value = '__NA__', value, n DESC", 6))
def top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 6, "alpha-asc", numeric_source=True)


@query("top2_size_asc", top_sql("n, value", 3))
def top2_size_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 3, "size-asc")


@query("top2_manual", top_sql("CASE value WHEN 'ring' THEN 0 WHEN 'small' THEN 1 ELSE 9007199254740991 END, value", 3))
def top2_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.top_k(counts(spark, sf_dir), 3, "manual", z_orders={"ring": 0, "small": 1})


@query("top3", f"WITH {PARTS}, s AS (SELECT value, n, value = 'ring' AS is_other, CASE WHEN n % 3 > 0 THEN (n % 7)::DOUBLE END AS score FROM f) SELECT value, row_number() OVER (ORDER BY is_other, score DESC NULLS LAST, value) AS place FROM s")
def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counts(spark, sf_dir).select("value", (F.col("value") == "ring").alias("is_other"), F.when(F.col("n") % 3 > 0, (F.col("n") % 7).cast("double")).alias("score"), F.col("value").alias("z"))
    return ranks.numbered(c, legend.silhouette_order(), "place").select("value", F.col("place").cast("long").alias("place"))


@query("top4", f"WITH {PARTS} SELECT value, row_number() OVER (ORDER BY value = '__NA__', n DESC, value) - 1 AS z FROM f")
def top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ranks.numbered(counts(spark, sf_dir), legend.order_of("size-desc", numeric_source=True), "z", 0)
    return placed.select("value", F.col("z").cast("long").alias("z"))


@query("top7", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS draw FROM events")
def top7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return views.depth_order(e, "value", "event_id").select("event_id", F.col("draw").cast("long").alias("draw"))


@query("top8", "SELECT p_brand AS name, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("name")).distinct()
    return ranks.numbered(b, [legend.natural_key(F.col("name"))], "place").select("name", F.col("place").cast("long").alias("place"))


@query("prj16", f"WITH {PARTS}, s AS (SELECT value, count(*) AS n, min(struct_pack(p := id, j := j)) AS seen FROM l GROUP BY value) SELECT value, n, (row_number() OVER (ORDER BY value = '__NA__', n DESC, seen) - 1)::INT AS idx FROM s")
def prj16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.dictionary(parts(spark, sf_dir), "labels", "id")


@query("prj17", f"WITH {PARTS}, s AS (SELECT value, count(*) AS n, min(struct_pack(p := id, j := j)) AS seen FROM l GROUP BY value) SELECT value, n, (row_number() OVER (ORDER BY value = '__NA__', seen) - 1)::INT AS idx FROM s")
def prj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend.dictionary(parts(spark, sf_dir), "labels", "id", by_frequency=False)


@query("enc1", f"WITH {PARTS}, s AS (SELECT value, count(*) AS n, min(struct_pack(p := id, j := j)) AS seen FROM l GROUP BY value), i AS (SELECT value, (row_number() OVER (ORDER BY value = '__NA__', n DESC, seen) - 1) % 12 AS i FROM s) SELECT value, (i % 2)::INT AS color, (i // 2)::INT AS shape FROM i")
def enc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = legend.colors_and_shapes(F.col("idx"), 2)
    return legend.dictionary(parts(spark, sf_dir), "labels", "id").select("value", c.alias("color"), s.cast("int").alias("shape"))


@query("enc3", f"WITH {PARTS} SELECT id, CASE WHEN m OR len(list_filter(w, lambda v: v NOT IN ('ring', 'bolt'))) = 0 THEN '#888888' ELSE array_to_string(list_distinct(list_transform(list_filter(w, lambda v: v <> 'small'), lambda v: CASE WHEN v = 'large' THEN '#FF0000' ELSE '#888888' END)), ',') END AS colors FROM p WHERE m OR len(list_filter(w, lambda v: v <> 'small')) < 2")
def enc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).filter(F.col("labels").isNull() | (F.size(F.filter("labels", lambda v: v != "small")) < 2))
    return p.select("id", F.array_join(legend.row_colors(F.col("labels"), {"large": "#FF0000"}, ("small",), ("ring", "bolt")), ",").alias("colors"))


@query("enc4", "SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN 'square' ELSE 'circle' END AS shape FROM part")
def enc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", legend.row_shape(F.array("p_type"), {"ECONOMY": "square", "STANDARD": "cross"}, ("STANDARD",)).alias("shape"))


@query("agg10", f"WITH {PARTS} SELECT 'p_type' AS col, p_type AS value, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'p_brand', p_brand, count(*) FROM p GROUP BY ALL")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = parts(spark, sf_dir).select("id", F.concat("p_type", F.lit("|0.5")).alias("p_type"), "p_brand").unpivot("id", ["p_type", "p_brand"], "col", "cell")
    from lumenvec.functions.cells import display_value

    return long.select("col", F.explode(F.split(display_value(F.col("cell")), ";")).alias("value")).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


@query("agg11", "SELECT DISTINCT p_type AS value FROM part")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(F.col("p_type").alias("value")).distinct()


@query("agg12", "WITH c AS (SELECT p_size, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_size::INT AS p_size, arg_min(p_type, struct_pack(a := -n, b := first)) AS mode FROM c GROUP BY p_size")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parts(spark, sf_dir).groupBy("p_size", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return c.groupBy("p_size").agg(F.min_by("p_type", F.struct(-F.col("n"), F.col("first"))).alias("mode"))


@query("flt14", "SELECT p_partkey AS id FROM part WHERE p_size < 30 AND p_type = 'ECONOMY'")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return views.isolate(p, [p.filter("p_size < 30"), p.filter("p_type = 'ECONOMY'")]).select("id")


@query("flt15", "SELECT p_partkey AS id FROM part WHERE p_size < 30 AND p_brand = 'Brand#2'")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return views.isolate(views.isolate(p, [p.filter("p_size < 30")]), [p.filter("p_brand = 'Brand#2'")]).select("id")


@query("jn14", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY user_id")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey = 3")
    return views.isolate(e, [c.select(F.col("c_custkey").alias("user_id"))], "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj26", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 8)")
def prj26(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return views.isolate(e, [spark.createDataFrame([(3,), (5,), (8,), (5,)], "vec_id long")], "vec_id").select("vec_id", "label")


HIDDEN = f"WITH {PARTS} SELECT id, (m OR len(list_filter(w, lambda v: v NOT IN ('small', 'ring'))) = 0) AS hidden"


@query("flt16", HIDDEN + " FROM p")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", views.hidden(F.col("labels"), ("small", "ring")).alias("hidden"))


@query("flt17", f"SELECT id, CASE WHEN hidden THEN 0.0 WHEN id % 5 = 0 OR id % 7 = 0 THEN 1.0 ELSE 0.2 END::DOUBLE AS opacity FROM ({HIDDEN} FROM p)")
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.hidden(F.col("labels"), ("small", "ring"))
    return parts(spark, sf_dir).select("id", views.opacity(h, F.col("id") % 5 == 0, F.col("id") % 7 == 0, True).alias("opacity"))


@query("flt19", "WITH h AS (SELECT c_name AS id, c_custkey % 4 = 0 AS is_selected, row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY c_custkey) AS r FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')) SELECT id, is_selected FROM h WHERE r <= CASE WHEN is_selected THEN 3 ELSE 50 END")
def flt19(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return views.search_ids(c, " CUSTOMER#00000001", F.col("c_custkey") % 4 == 0, "c_name", "c_custkey", selected_limit=3)


@query("flt20", "WITH k AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS id, p_partkey AS pos FROM part), a AS (SELECT DISTINCT p_name AS asked FROM part), f AS (SELECT lower(id) AS low, arg_max(id, pos) AS folded FROM k GROUP BY 1) SELECT asked, coalesce(e.id, folded) AS id FROM a LEFT JOIN (SELECT DISTINCT id FROM k) e ON asked = e.id LEFT JOIN f ON lower(asked) = low")
def flt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("id"), F.col("p_partkey").alias("pos"))
    return views.canonical_ids(p.select(F.col("p_name").alias("asked")).distinct(), known, last=True)


PLANE = "e AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


@query("agg6", f"WITH {PLANE} SELECT round(min(x) - 0.05 * abs(max(x) - min(x)), 6) AS x_min, round(max(x) + 0.05 * abs(max(x) - min(x)), 6) AS x_max, round(min(y) - 0.05 * abs(max(y) - min(y)), 6) AS y_min, round(max(y) + 0.05 * abs(max(y) - min(y)), 6) AS y_max FROM e")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.padded_extent(points(spark, sf_dir))
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


@query("agg7", "SELECT l_quantity AS x, l_discount AS y, count(*) AS n, sum(l_orderkey * 10 + l_linenumber)::BIGINT AS ids FROM lineitem WHERE l_quantity <= 40 GROUP BY ALL HAVING count(*) > 1")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = li.select(F.when(F.col("l_quantity") > 40, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"), F.col("l_discount").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return views.duplicate_stacks(at, also=[F.sum("id").alias("ids")])


@query("agg7_members", "WITH s AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT l_orderkey AS id, l_linenumber AS line, n FROM lineitem JOIN s ON l_quantity = x AND l_discount = y")
def agg7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = li.select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    return views.stack_members(at, views.duplicate_stacks(at)).select("id", "line", "n")


@query("top10", "WITH s AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT x, y, n FROM s WHERE x BETWEEN 5 AND 20 ORDER BY n DESC, x, y LIMIT 20")
def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = views.duplicate_stacks(li.select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")))
    return views.badges(s, (5, 0, 20, 1), 20).select("x", "y", "n")


@query("geo1", f"WITH {PLANE} SELECT id FROM e WHERE x BETWEEN -0.1 AND 0.05 AND y BETWEEN 0 AND 0.2")
def geo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(views.in_box(F.col("x"), F.col("y"), 0.05, 0.2, -0.1, 0)).select("id")


LASSO = ((-0.2, -0.1), (0.1, -0.15), (0.2, 0.1), (0.0, 0.02), (-0.1, 0.2))
_EDGES = " + ".join(
    f"(CASE WHEN ({yi} > y) <> ({yj} > y) AND x < ({xj - xi})::DOUBLE * (y - ({yi})::DOUBLE) / ({yj - yi})::DOUBLE + ({xi})::DOUBLE THEN 1 ELSE 0 END)" for (xi, yi), (xj, yj) in zip(LASSO, (LASSO[-1], *LASSO[:-1]), strict=True)
)


@query("geo2", f"WITH {PLANE} SELECT id FROM e WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.15 AND 0.2 AND ({_EDGES}) % 2 = 1")
def geo2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(views.in_polygon(F.col("x"), F.col("y"), LASSO)).select("id")


@query("geo3", f"WITH {PLANE} SELECT id, round((x - 0.01) * (x - 0.01) + (y - 0.02) * (y - 0.02), 9) AS d2 FROM e WHERE (x - 0.01) * (x - 0.01) + (y - 0.02) * (y - 0.02) <= 0.04 ORDER BY d2, id LIMIT 1")
def geo3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.nearest_point(points(spark, sf_dir), 0.01, 0.02, 0.2).select("id", F.round("d2", 9).alias("d2"))


@query("geo4", f"WITH {PLANE} SELECT id FROM e WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND id % 3 <> 0")
def geo4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("id") % 3 != 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    return points(spark, sf_dir).filter(views.in_box(F.col("x"), F.col("y"), -0.1, -0.1, 0.1, 0.1) & ~views.hidden(shown, ("b",))).select("id")


@query("geo5", f"WITH {PLANE} SELECT id, round(10 + (x + 1) / 2 * 780, 4) AS px FROM e")
def geo5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.round(views.scale(F.col("x"), (-1, 1), (10, 790)), 4).alias("px"))


@query("geo6", f"WITH {PLANE} SELECT id FROM e WHERE 10 + (x + 1) / 2 * 780 BETWEEN 150 AND 450 AND 10 + (y + 1) / 2 * 580 BETWEEN 100 AND 350")
def geo6(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = views.viewport(2.0, -300.0, -200.0, 600, 500, (10, 10, 10, 10), 10)
    return points(spark, sf_dir).filter(views.in_box(views.scale(F.col("x"), (-1, 1), (10, 790)), views.scale(F.col("y"), (-1, 1), (10, 590)), *window)).select("id")


@query("prj22", f"WITH {PLANE} SELECT id, y AS px, z AS py FROM e")
def prj22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.plane(points(spark, sf_dir), "yz").select("id", "px", "py")


@query("snk6", f"WITH {PARTS} SELECT id FROM p WHERE NOT (m OR len(list_filter(w, lambda v: v NOT IN ('small', 'ring'))) = 0)")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of rows with a label that is not hidden, as an export writes them."""
    return parts(spark, sf_dir).filter(~views.hidden(F.col("labels"), ("small", "ring"))).select("id")




# The same windows by the spatial index: each query writes the table clustered by place, and reads the files and stretches it needs.


def indexed(spark: SparkSession, sf_dir: str) -> spatial.SpatialTable:
    return spatial.write_index(points(spark, sf_dir), fresh_path(spark, "plane"), files=8)


@query("geo1_index", f"WITH {PLANE} SELECT id FROM e WHERE x BETWEEN -0.1 AND 0.05 AND y BETWEEN 0 AND 0.2")
def geo1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).box(0.05, 0.2, -0.1, 0).select("id")


@query("geo2_index", f"WITH {PLANE} SELECT id FROM e WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.15 AND 0.2 AND ({_EDGES}) % 2 = 1")
def geo2_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).polygon(LASSO).select("id")


@query("geo3_index", f"WITH {PLANE} SELECT id, round((x - 0.01) * (x - 0.01) + (y - 0.02) * (y - 0.02), 9) AS d2 FROM e WHERE (x - 0.01) * (x - 0.01) + (y - 0.02) * (y - 0.02) <= 0.04 ORDER BY d2, id LIMIT 1")
def geo3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).nearest(0.01, 0.02, 0.2).select("id", F.round("d2", 9).alias("d2"))


@query("geo6_index", f"WITH {PLANE} SELECT id FROM e WHERE 10 + (x + 1) / 2 * 780 BETWEEN 150 AND 450 AND 10 + (y + 1) / 2 * 580 BETWEEN 100 AND 350")
def geo6_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible part, from pixels back to the plane."""
    x0, y0, x1, y1 = views.viewport(2.0, -300.0, -200.0, 600, 500, (10, 10, 10, 10), 10)
    back = lambda v, size: (v - 10) / size * 2 - 1
    return indexed(spark, sf_dir).box(back(x0, 780), back(y0, 580), back(x1, 780), back(y1, 580)).select("id")
