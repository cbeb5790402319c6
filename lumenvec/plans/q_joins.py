"""Joins, set operations, types and layouts over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import joins, layout
from lumenvec.plans.registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAST = "(SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS pr, arg_max(o_totalprice, o_orderkey) AS c_acctbal FROM orders GROUP BY o_custkey)"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("c_acctbal"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    return joins.attach_annotations(c, o, "id", "o_orderkey")


@query("jn1", f"SELECT c_custkey::VARCHAR AS id, c_name, pr, o.c_acctbal FROM customer LEFT JOIN {LAST} o ON c_custkey = o_custkey")
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotations of customers: the last order wins and its column replaces the customer's of the same name."""
    return _attached(spark, sf_dir)


@query("jn2", f"SELECT pr, count(*) AS n FROM customer LEFT JOIN {LAST} o ON c_custkey = o_custkey GROUP BY pr")
def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).groupBy("pr").agg(F.count(F.lit(1)).alias("n"))


@query("jn3", "SELECT s_suppkey, coalesce(n_name, 'old') AS n_name, r_name FROM (SELECT *, s_nationkey AS n_nationkey FROM supplier) LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0) n USING (n_nationkey) LEFT JOIN region ON n_regionkey = r_regionkey")
def jn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").withColumn("n_nationkey", F.col("s_nationkey")).withColumn("n_name", F.lit("old"))
    n = t(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.enrich(s, [(n, "n_nationkey", ["n_name", "r_regionkey"]), (t(spark, sf_dir, "region"), "r_regionkey", ["r_name"])]).select("s_suppkey", "n_name", "r_name")


@query("jn4", "SELECT c_custkey AS id, c_name, f.pr FROM customer LEFT JOIN (SELECT o_custkey, arg_min(struct_pack(p := CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END), o_orderkey).p AS pr FROM orders GROUP BY o_custkey) f ON c_custkey = o_custkey")
def jn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order wins, and its priority replaces the customer's even where it is null."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.lit("own").alias("pr"))
    u = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("pr"))
    return joins.overlay_table(c, u, "id", "o_orderkey")


@query("jn5", "SELECT p_partkey AS id, f.q FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey) f ON p_partkey = l_partkey")
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("q"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("pos"))
    return joins.align_headers(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), m, "id", "pos")


@query("jn6", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 'new' WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN '' END ELSE c_mktsegment END AS seg FROM customer")
def jn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells come from the cache where it has the id; the cache lacks every fourth."""
    k = F.col("c_custkey") % 3
    c = t(spark, sf_dir, "customer")
    api = c.select(F.col("c_custkey").alias("id"), F.when(k == 0, "").when(k == 2, "new").alias("seg"))
    return joins.refill_blanks(api, c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg")), "id", ["seg"])


@query("jn7", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT user_id FROM events)")
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), t(spark, sf_dir, "events").select(F.col("user_id").alias("id"))]
    return joins.intersect_sets(ids)[0]


@query("jn9", "SELECT vec_id AS id, e.label, d.lang FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def jn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "documents")
    return e.select(F.col("vec_id").alias("id"), "label").join(d.select(F.col("doc_id").alias("id"), "lang"), "id")


@query("jn10", "WITH s AS (SELECT source AS set_name, doc_id FROM documents UNION ALL SELECT 'all', doc_id FROM documents), w AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), k AS (SELECT set_name, count(DISTINCT doc_id) AS k FROM s JOIN w USING (doc_id) GROUP BY set_name) SELECT set_name FROM k WHERE k = (SELECT count(*) FROM w)")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    c = d.select(F.col("source").alias("set_name"), F.col("doc_id").alias("id")).unionByName(d.select(F.lit("all").alias("set_name"), F.col("doc_id").alias("id")))
    return spark.createDataFrame([(joins.best_source(c, d.filter("lang = 'en'").select(F.col("doc_id").alias("id"))),)], "set_name string")


@query("jn11", "SELECT label, quality, count(*) AS n FROM embeddings JOIN labels ON vec_id = doc_id GROUP BY ALL")
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, lab = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), t(spark, sf_dir, "labels")
    return e.join(lab, "doc_id").groupBy("label", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("jn12", "SELECT vec_id AS id, label, 'cluster ' || (doc_id % 3) AS cluster_a FROM embeddings LEFT JOIN labels ON vec_id = doc_id")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two membership columns the one that meets no id is left out."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    m = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("cluster "), F.col("doc_id") % 3).alias("cluster_a"), F.lit(None).cast("string").alias("cluster_b"))
    return joins.merge_columns(e, m)


@query("jn13", """WITH q AS (SELECT p_type AS m, round(avg(p_size), 3) AS v FROM part GROUP BY p_type), t AS (SELECT '{' || string_agg('"' || m || '":' || v, ',' ORDER BY m) || '}' AS j FROM q)
SELECT 'PCA 2' AS projection_name, '{"n":"2","quality":"' || replace(j, '"', chr(92) || '"') || '"}' AS info_json FROM t UNION ALL SELECT 'MDS 2', NULL""")
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([("PCA 2", '{"n": "2", "quality": "old"}'), ("MDS 2", None)], "projection_name string, info_json string")
    q = t(spark, sf_dir, "part").groupBy(F.lit("PCA 2").alias("space_name"), F.col("p_type").alias("metric")).agg(F.round(F.avg("p_size"), 3).alias("value"))
    return joins.fold_quality(meta, q)


@query("jn15", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.uncovered(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("src22", "SELECT 0::BIGINT AS n_missing")
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    skipped = joins.uncovered(c, o)
    joins.assert_complete(c, o, skipped)
    return joins.uncovered(joins.uncovered(c, o), skipped).agg(F.count(F.lit(1)).alias("n_missing"))


NAMES = "SELECT n_nationkey::VARCHAR AS code, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0"
CODED = "SELECT c_custkey AS id, unnest([c_nationkey::VARCHAR, (c_custkey % 25)::VARCHAR]) AS code, unnest(['|EXP', '']) AS ev, unnest([0, 1]) AS pos FROM customer"


@query("jn17", f"SELECT id, string_agg(CASE WHEN name IS NULL THEN c.code ELSE c.code || ' (' || name || ')' END || ev, ';' ORDER BY pos) AS cell FROM ({CODED}) c LEFT JOIN ({NAMES}) n ON c.code = n.code GROUP BY id")
def jn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_nationkey", F.lit("|EXP; ;"), F.col("c_custkey") % 25).alias("cell"))
    n = t(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return joins.resolve_names(c, "id", "cell", n)


query("fn8", f"SELECT id, string_agg(CASE WHEN name IS NULL THEN c.code ELSE c.code || ' (' || name || ')' END || ev, ';' ORDER BY pos) AS cell FROM ({CODED}) c LEFT JOIN ({NAMES}) n ON c.code = n.code GROUP BY id")(jn17)


@query("fn11", "WITH p AS (SELECT c_custkey AS id, unnest(['PF' || c_nationkey, 'PF' || (c_custkey % 25)]) AS acc FROM customer), m AS (SELECT 'PF' || n_nationkey AS acc, 'CL' || n_regionkey AS clan FROM nation WHERE n_nationkey % 5 <> 0) SELECT id, string_agg(DISTINCT clan, ';' ORDER BY clan) AS clans FROM p JOIN m USING (acc) GROUP BY id")
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenvec.functions.bio import pfam_accessions

    cell = F.concat(F.lit("PF"), "c_nationkey", F.lit(" (a)|1;PF"), F.col("c_custkey") % 25)
    acc = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(pfam_accessions(cell)).alias("acc"))
    m = t(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("PF"), "n_nationkey").alias("acc"), F.concat(F.lit("CL"), "n_regionkey").alias("clan"))
    return acc.join(joins.checked_broadcast(m), "acc").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("clan")), ";").alias("clans"))


@query("set1", "SELECT c_custkey AS id FROM customer WHERE (c_nationkey < 5 OR c_acctbal > 5000) AND NOT (c_nationkey < 5 AND c_acctbal > 5000)")
def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union without intersection, by set operations."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")
    a, b = c.filter("c_nationkey < 5").select("id"), c.filter("c_acctbal > 5000").select("id")
    return a.union(b).distinct().exceptAll(a.intersect(b))


@query("set2", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS s FROM embeddings")
def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    shifted = e.filter("id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x + 5e-7))
    return joins.union_sets([e, shifted]).select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("set3", "SELECT n_nationkey::VARCHAR AS id, n_name AS a, '' AS b FROM nation UNION ALL SELECT r_regionkey::VARCHAR, '', r_name FROM region")
def set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    return joins.union_columns([n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("a")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("b"))])


@query("set4", "SELECT 'interpro' AS source, true AS needed UNION ALL SELECT 'taxonomy', false UNION ALL SELECT 'uniprot', true")
def set4(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = joins.missing_sources(["length", "genus"], ["length", "pfam", "genus"], {"length": "uniprot", "pfam": "interpro", "genus": "taxonomy"}, {"interpro": ["uniprot"], "taxonomy": ["uniprot"]})
    return spark.createDataFrame(list(todo.items()), "source string, needed boolean")


@query("agg8", "SELECT TRY_CAST(x AS BIGINT) AS taxon, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'n.d.' ELSE c_nationkey::VARCHAR END AS x FROM customer) WHERE TRY_CAST(x AS BIGINT) IS NOT NULL GROUP BY 1")
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(joins.count_ids(F.when(F.col("c_custkey") % 6 == 0, "n.d.").otherwise(F.col("c_nationkey").cast("string"))).alias("taxon"))
    return c.filter("taxon is not null").groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg9",
    """WITH h AS (SELECT l_orderkey AS id, l_returnflag AS db, 'ACC' || (l_partkey % 3) AS acc, CASE WHEN l_linenumber % 2 = 0 THEN 'name' || l_linenumber END AS name, CASE WHEN l_quantity > 10 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS score, l_linenumber * 100000 + l_partkey AS pos FROM lineitem),
e AS (SELECT id, db, acc, arg_min(name, pos) FILTER (name IS NOT NULL) AS name, string_agg(score, ',' ORDER BY pos, score) AS scores FROM h GROUP BY ALL)
SELECT id, db, string_agg(acc || CASE WHEN name IS NULL THEN '' ELSE ' (' || name || ')' END || CASE WHEN scores IS NULL THEN '' ELSE '|' || scores END, ';' ORDER BY acc) AS cell FROM e GROUP BY ALL""",
)
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, n = t(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    return joins.domain_hits(
        li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("db"), F.concat(F.lit("ACC"), F.col("l_partkey") % 3).alias("accession"), F.when(n % 2 == 0, F.concat(F.lit("name"), n)).alias("name"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int").cast("string")).alias("score"), (n * 100000 + F.col("l_partkey")).alias("pos"))
    )


@query("prj5", "SELECT 'c_custkey' AS col, 'int' AS type UNION ALL SELECT 'c_acctbal', 'float' UNION ALL SELECT 'c_name', 'string' UNION ALL SELECT 'gap', 'int' UNION ALL SELECT 'none', 'string'")
def prj5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").withColumn("gap", F.when(F.col("c_custkey") % 2 == 0, " NA ").otherwise(" 7 ")).withColumn("none", F.lit(""))
    types = layout.infer_types(c, ["c_custkey", "c_acctbal", "c_name", "gap", "none"])
    return spark.createDataFrame(list(types.items()), "col string, type string")


@query("prj7", "SELECT 'whole' AS col, 'float' AS type UNION ALL SELECT 'void', 'int' UNION ALL SELECT 'c_name', 'string'")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select("c_name", F.floor("c_acctbal").cast("double").alias("whole"), F.lit(None).cast("int").alias("void"))
    types = layout.restore_types(c, layout.infer_types(c, ["whole", "void", "c_name"]))
    return spark.createDataFrame(list(types.items()), "col string, type string")


GRID = "(SELECT vec_id AS id, p FROM embeddings, (VALUES ('A'), ('B')) t(p))"


@query("prj18", f"SELECT id, p AS projection_name, CASE WHEN id % 4 > 0 AND (p = 'A' OR id % 3 = 0) THEN id * 1.0::DOUBLE ELSE 0 END AS x, CASE WHEN p = 'B' AND id % 4 > 0 AND id % 3 = 0 AND id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS z, CASE p WHEN 'A' THEN 2 ELSE 3 END::INT AS dimension FROM {GRID}")
def prj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    at = e.filter("id % 4 > 0").withColumns({"x": F.col("id").cast("double"), "y": F.lit(0.0)})
    coords = at.withColumns({"z": F.lit(None).cast("double"), "projection_name": F.lit("A")}).unionByName(at.filter("id % 3 = 0").withColumns({"z": F.when(F.col("id") % 2 == 0, 1.0), "projection_name": F.lit("B")}))
    names = spark.createDataFrame([("A",), ("B",)], "projection_name string")
    return layout.coordinates(e, names, coords).select("id", "projection_name", "x", "z", "dimension")


@query("prj19", "SELECT vec_id::VARCHAR AS id, unnest(['umap', 'PC']) AS projection_name, unnest([embedding[1], embedding[3]])::DOUBLE AS x, unnest([embedding[2], embedding[4]])::DOUBLE AS y FROM embeddings")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return layout.wide_to_long(e.select("vec_id", at(0).alias("umap_x"), at(1).alias("umap_y"), at(2).alias("PC1"), at(3).alias("PC2")), "vec_id").select("id", "projection_name", "x", "y")


@query("prj20", "SELECT c_custkey AS protein_id, c_name FROM customer")
def prj20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identifier"), "c_name", F.lit(1).alias("organism_id"))
    return c.withColumnRenamed("identifier", "protein_id").drop("organism_id")


@query("prj23", "SELECT r_name AS projection_name, unnest(['k', 'source']) AS key, unnest(['15', 'row']) AS value FROM region")
def prj23(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "region").select(F.col("r_name").alias("projection_name"), F.lit('{"dimension": 3, "k": 15, "source": "json"}').alias("info_json"), F.lit("row").alias("source"))
    return layout.metadata_map(m)


@query("prj27", "SELECT c_custkey, c_name AS title, coalesce(CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END, 'guess') AS seg FROM customer WHERE c_custkey = 42")
def prj27(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").withColumn("seg", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment"))).withColumn("seg__pred_value", F.lit("guess")).withColumn("blank", F.lit(" NA "))
    return layout.detail(c, "c_custkey", 42, {"title": ("blank", "c_name")}, ["seg"])


@query("src5", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").filter("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src6", "SELECT vec_id AS id, len(embedding)::INT AS d FROM embeddings WHERE vec_id % 6 <> 0 AND vec_id % 10 <> 9")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with NaN or another length are dropped, of equal ids the first stays."""
    from lumenvec.sources.vectors import clean_vectors

    e, i = t(spark, sf_dir, "embeddings"), F.col("vec_id")
    v = F.when(i % 6 == 0, F.transform("embedding", lambda x: x * float("nan"))).when(i % 10 == 9, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    rows = e.select(i.alias("id"), v.alias("embedding"), (i * 2).alias("pos"))
    again = rows.filter("id % 4 = 1 and id % 10 <> 9").withColumns({"pos": F.col("pos") + 1, "embedding": F.transform("embedding", lambda x: x + 1)})
    return clean_vectors(rows.unionByName(again), "id", "embedding", "pos", 64).select("id", F.size("embedding").alias("d"))
