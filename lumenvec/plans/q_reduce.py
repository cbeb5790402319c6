"""Projections, clusterings, bundles, FASTA and saved responses: results that SQL can't express, checked by tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import knn, reduce
from lumenvec.plans import prepare
from lumenvec.plans.q_knn import COS, VOTE, near_sql
from lumenvec.plans.registry import query
from lumenvec.sources import bundle, entries, fasta
from lumenvec.sources.shared import Tables, file_system, fresh_path, spread


def folder(spark: SparkSession) -> str:
    """A new folder among those that driver and executors share, on whichever file system they are."""
    path = fresh_path(spark, "q")
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    return path


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("dr1")
def dr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.pca(vectors(spark, sf_dir), 2)[0].select("id", F.transform("coords", lambda x: F.round(x, 5)).alias("coords"))


@query("dr2")
def dr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_sample(vectors(spark, sf_dir), "tsne", 2, sample=200)


@query("dr6", "SELECT i, j, round(sqrt(greatest(0, 1 - sim)), 6) AS d FROM (SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0::DOUBLE ELSE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS sim FROM embeddings a, embeddings b)")
def dr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    d = knn.all_pairs(v, v).select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"), F.when(F.col("query_id") == F.col("ref_id"), 1.0).otherwise(knn.rounded(1 - F.col("distance"), 6)).alias("sim"))
    return reduce.distances_from_similarity(d, v.select("id").distinct().count()).select("i", "j", knn.rounded(F.col("d"), 6).alias("d"))


@query("dr6_mds")
def dr6_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_sample(vectors(spark, sf_dir), "mds", 2, sample=200)


@query("dr8")
def dr8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets by two methods, and a precomputed similarity, which gets MDS alone; a second call over the store fits nothing."""
    v = vectors(spark, sf_dir).select("id", "embedding")
    sets = {"A": v, "B": v.withColumn("embedding", F.transform("embedding", lambda x: -x))}
    edges = knn.nearest(v, v, 10).select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"), F.round(1 - F.col("distance"), 6).alias("sim"))
    edges = Tables(spark).written(edges, "edges")  # read a dozen times below
    store = reduce.ProjectionStore(spark, f"{folder(spark)}/projections")
    reduce.reductions(sets, reduce.parse_methods("pca2,pca3"), {"C": edges}, store)
    return reduce.reductions(sets, reduce.parse_methods("pca2,pca3"), {"C": edges}, store)


@query("snk8", "SELECT vec_id AS id, true AS reused FROM embeddings")
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection read back from the store, beside the one it was made from: equal on every row."""
    v = vectors(spark, sf_dir).select("id", "embedding")
    store, spec = reduce.ProjectionStore(spark, f"{folder(spark)}/projections"), reduce.parse_method("pca2")
    first = store.made(v, "A", spec, {}, lambda: reduce.project(v, spec))
    again = store.made(v.repartition(3), "A", spec, {}, lambda: v.limit(0).select("id", F.array(F.lit(0.0)).alias("coords")))
    return first.join(again.withColumnRenamed("coords", "c"), "id").select("id", (F.col("coords") == F.col("c")).alias("reused"))


@query("sta1")
def sta1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.kmeans_sweep(vectors(spark, sf_dir))[0]


@query("sta3")
def sta3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.kmeans_sweep(vectors(spark, sf_dir), by="silhouette")[0]


@query("knn9", f"WITH {near_sql(2, COS)}, {VOTE} SELECT query_id, label::VARCHAR AS label, b.i AS source_id, round(b.d, 6) AS distance, round(ri, 6) AS reliability FROM t WHERE place = 1")
def knn9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from a saved reference set, which brings its metric with it."""
    path = f"{folder(spark)}/lookup"
    v = vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    knn.save_lookup(v.filter("id % 5 <> 0"), path, "cosine")
    out = knn.query_lookup(v.filter("id % 5 = 0"), path, 2)
    return out.select("query_id", "label", "source_id", F.round("distance", 6).alias("distance"), F.round("reliability", 6).alias("reliability"))


def _bundle(spark: SparkSession, sf_dir: str) -> str:
    v = vectors(spark, sf_dir)
    notes = v.select(F.col("id").cast("string").alias("identifier"), F.concat(F.lit("L"), "label").alias("family"))
    meta = spark.createDataFrame([("P", 2, "{}", "test")], "projection_name string, dimensions long, info_json string, source string")
    at = v.select(F.lit("P").alias("projection_name"), F.col("id").cast("string").alias("identifier"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"), F.lit(None).cast("double").alias("z"))
    path = f"{folder(spark)}/test.bundle"
    bundle.write_bundle(path, notes, meta, at, {"family": {"maxVisibleValues": 10}})
    return path


@query("src1", "SELECT vec_id::VARCHAR AS identifier, 'L' || label AS family FROM embeddings")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a bundle and read back by ranges, a partition a row group."""
    return bundle.read_part(spark, _bundle(spark, sf_dir))


@query("src2", """SELECT 'annotations' AS part, count(*) AS rows, 2 AS columns, 2 AS version FROM embeddings UNION ALL SELECT 'metadata', 1, 4, 1
UNION ALL SELECT 'projections', count(*), 5, 1 FROM embeddings UNION ALL SELECT 'settings', 1, 1, 1""")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all parts are read, and each part's format version from its footer."""
    path = _bundle(spark, sf_dir)
    stream = bundle.Stream(spark, path)
    out = None
    for name, (_, end) in bundle.locate(stream.read, stream.size).items():
        version = bundle.format_version(bundle.footer(stream.read, end)[0].schema.to_arrow_schema())
        part = bundle.read_part(spark, path, name)
        one = part.agg(F.lit(name).alias("part"), F.count(F.struct("*")).alias("rows"), F.lit(len(part.columns)).alias("columns"), F.lit(version).alias("version"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src2_columns", "SELECT vec_id::VARCHAR AS identifier, embedding[1]::DOUBLE AS x FROM embeddings WHERE embedding[1] > 0")
def src2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of five, filtered: row groups without such rows make no partition."""
    return bundle.read_part(spark, _bundle(spark, sf_dir), "projections", ["identifier", "x"]).filter("x > 0").select("identifier", F.col("x").cast("double").alias("x"))


@query("snk2", "SELECT vec_id::VARCHAR AS identifier, 'L' || label AS family, 25::BIGINT AS visible FROM embeddings")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings replaced in place, and every annotation still there, byte for byte."""
    path = _bundle(spark, sf_dir)
    bundle.replace_in(spark, path, f"{path}.new", "settings", bundle.settings_table({"family": {"maxVisibleValues": 25}}))
    settings = bundle.read_part(spark, f"{path}.new", "settings").select(F.get_json_object("settings_json", "$.family.maxVisibleValues").cast("long").alias("visible"))
    return bundle.read_part(spark, f"{path}.new").crossJoin(F.broadcast(settings))  # one row


@query("src3", "SELECT 'annotations' AS part, count(*) AS n FROM embeddings UNION ALL SELECT 'metadata', 1 UNION ALL SELECT 'projections', count(*) FROM embeddings UNION ALL SELECT 'settings', 1")
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _bundle(spark, sf_dir)
    files = bundle.extract(spark, path, f"{os.path.dirname(path)}/parts")
    rows = [(os.path.basename(p).removesuffix(".parquet"), spark.read.parquet(p).count()) for p in files]
    return spark.createDataFrame(rows, "part string, n long")


@query("snk3", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ';x' END AS cell, c_nationkey AS n FROM customer")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    df = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.array("c_mktsegment", F.lit("x"))).alias("cell"), F.col("c_nationkey").cast("double").alias("n"))
    return bundle.serialize(df, ["cell"], ["n"])


@query("agg17", "SELECT count(*) AS n, (sum(('0x' || substr(md5(c_custkey || '|' || c_name || '|' || c_mktsegment), 1, 15))::HUGEINT) % 18446744073709551616)::VARCHAR AS fingerprint FROM customer")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint that no order of rows changes and in which equal rows add up: 60-bit hashes summed modulo 2**64, beside the count."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment")), 1, 15), 16, 10).cast("decimal(20,0)")
    return c.agg(F.count(F.lit(1)).alias("n"), (F.sum(h) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("fingerprint"))


@query("src8", "SELECT c_name AS id, 'MKVL' || c_mktsegment AS sequence FROM customer WHERE c_custkey % 7 > 0")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of FASTA text over several lines: some without a sequence, some repeated, of which the first counts."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    body = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("MK\nVL"), "c_mktsegment"))
    again = F.when((k % 7 > 0) & (k % 11 == 0), F.concat(F.lit("\n>"), "c_name", F.lit(" again\nAAA"))).otherwise("")
    path = f"{folder(spark)}/customers.fasta"
    c.select(F.concat(F.lit(">"), "c_name", F.lit(" a customer\n"), body, again).alias("value")).write.text(path)
    return fasta.read_fasta(spark, path)


#: An entry as the remote service gives it, with a customer's key, name and nation in it.
ENTRY = (
    '{"primaryAccession":"P%1$05d","uniProtkbId":"N%1$d_HUMAN","entryType":"UniProtKB reviewed (Swiss-Prot)","genes":[{"geneName":{"value":"%2$s"}}],"organism":{"scientificName":"O","taxonId":%3$d,"lineage":["a","b%3$d"]},'
    '"organismHosts":[{"scientificName":"h"},{}],"sequence":{"value":"MK","length":2,"molWeight":%1$d},"entryAudit":{"firstPublicDate":"2001-02-03","entryVersion":%3$d},'
    '"proteinDescription":{"recommendedName":{"ecNumbers":[{"value":"1.1.1.%3$d"}]},"alternativeNames":[{"ecNumbers":[{"value":"2.2.2.2"}]},{}]},"keywords":[{"id":"KW-%3$d","name":"k"}],'
    '"features":[{"type":"Signal","location":{"start":{"value":1},"end":{"value":%3$d}}},{"type":"Glycosylation","description":"N-linked","location":{"start":{"value":%3$d},"end":{"value":%3$d}}},{"type":"Disulfide bond","location":{"start":{"value":3},"end":{"value":9}}}],'
    '"uniProtKBCrossReferences":[{"database":"GO","id":"GO:%3$d","properties":[{"key":"GoTerm","value":"P:growth"},{"key":"GoEvidenceType","value":"IDA:X"}]},{"database":"GO","id":"GO:0","properties":[{"key":"GoTerm","value":"F:binding"}]},{"database":"Proteomes","id":"UP%3$d"}]}'
)
FIELDS = ("entry", "entry_name", "gene_primary", "organism_name", "xref_proteomes", "lineage", "virus_hosts", "mass", "keyword_id", "go", "go_bp", "go_mf", "go_cc", "go_id", "date_created", "date_modified", "version", "ec", "ft_disulfid", "ft_glycosylation", "ft_signal", "ft_non_ter")


@query("src13", """SELECT c_custkey AS id, printf('P%05d', c_custkey) AS entry, 'N' || c_custkey || '_HUMAN' AS entry_name, c_name AS gene_primary, 'O' AS organism_name, 'UP' || n AS xref_proteomes, 'a;b' || n AS lineage, 'h' AS virus_hosts,
  c_custkey::VARCHAR AS mass, 'KW-' || n AS keyword_id, 'P:growth|IDA;F:binding' AS go, 'P:growth|IDA' AS go_bp, 'F:binding' AS go_mf, '' AS go_cc, 'GO:' || n || ';GO:0' AS go_id, '2001-02-03' AS date_created, '' AS date_modified, n::VARCHAR AS version,
  '1.1.1.' || n || ';2.2.2.2' AS ec, '3-9' AS ft_disulfid, n || ' (N-linked)' AS ft_glycosylation, '1-' || n AS ft_signal, '' AS ft_non_ter FROM (SELECT *, c_nationkey AS n FROM customer)""")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of as many proteins as there are customers, field by field."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"))
    body = F.format_string(ENTRY, F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"))
    return entries.parse_entries(c.select(F.col("c_custkey").alias("id"), body.alias("body")), "id", "body").select("id", *FIELDS)


@query("src15", "SELECT n_nationkey AS taxon, '' AS root, 'R' AS domain, '' AS kingdom, '' AS phylum, '' AS class, '' AS \"order\", '' AS family, n_name AS genus, '' AS species FROM nation")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lineage = F.array(F.struct(F.lit("realm").alias("rank"), F.lit("R").alias("name")), F.struct(F.lit("Genus").alias("rank"), F.col("n_name").alias("name")))
    return entries.lineages(n.select(F.col("n_nationkey").alias("taxon"), lineage.alias("lineage")))


@query("src17", "SELECT c_custkey AS id, 'answer ' || c_mktsegment AS body FROM customer")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys are asked for once and answered everywhere."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seq"))
    answers = entries.fetch_batches(c, "seq", lambda keys: [f"answer {k}" for k in keys])
    return entries.fan_out(c, "seq", answers).select("id", "body")


@query("src20", "WITH e AS (SELECT o_custkey AS a, o_orderkey % 50 AS b, o_totalprice AS s, o_orderkey AS p FROM orders), u AS (SELECT a AS i, b AS j, s, p FROM e UNION ALL SELECT b, a, s, p FROM e) SELECT i, j, arg_max(s, p) AS sim FROM u GROUP BY i, j")
def src20(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return entries.similarity_edges(o.select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 50).alias("target"), F.col("o_totalprice").alias("fident"), F.col("o_orderkey").alias("pos")))


@query("src21", "SELECT c_custkey AS id, length(c_name)::DOUBLE AS first FROM customer WHERE c_custkey % 2 = 1")
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("sequence"))
    out = entries.embed(c, lambda s: [[float(len(x)), 1.0] for x in s], c.filter("id % 2 = 0"))
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("prepare", f"""SELECT p.projection_name, e.vec_id::VARCHAR AS identifier, CASE WHEN e.vec_id % 5 > 0 THEN 'L' || e.label ELSE '' END AS family, CASE WHEN e.vec_id % 5 = 0 THEN 'L' || n.label ELSE '' END AS filled, p.dims AS dimensions, 'red' AS color
FROM embeddings e CROSS JOIN (VALUES ('A — PCA 2', 2), ('A — PCA 3', 3)) p(projection_name, dims) LEFT JOIN (WITH {near_sql(1, COS)} SELECT query_id, label FROM n) n ON n.query_id = e.vec_id""")
def prepare_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call from vectors to a bundle with filled labels, one more for its styles, and everything read back."""
    v = vectors(spark, sf_dir)
    notes = v.select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("L"), "label")).alias("family"))
    path = prepare.prepare(spark, {"A": v.select("id", "embedding")}, f"{folder(spark)}/a.bundle", "pca2,pca3", notes, fill=["family"])
    prepare.style_bundle(spark, path, f"{path}.styled", {"family": {"colors": {"L1": "red"}}})
    path = f"{path}.styled"
    at, meta = bundle.read_part(spark, path, "projections").filter("x is not null and y is not null"), bundle.read_part(spark, path, "metadata").select("projection_name", "dimensions")
    color = bundle.read_part(spark, path, "settings").select(F.get_json_object("settings_json", "$.legendSettings.family.categories.L1.color").alias("color"))
    both = at.join(bundle.read_part(spark, path), "identifier").join(meta, "projection_name").crossJoin(F.broadcast(color))  # one row
    return both.select("projection_name", "identifier", "family", F.col("family__pred_value").alias("filled"), "dimensions", "color")
