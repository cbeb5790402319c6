"""Queries over cells and scalar functions: customers carry cells of every shape, derived alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions import bio, cells, missing
from lumenvec.plans.registry import query

CELL = """CASE CAST(c_custkey % 19 AS INT) WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'NA' WHEN 3 THEN ' n/a ' WHEN 4 THEN 'None' WHEN 5 THEN '__NA__'
 WHEN 6 THEN 'A' WHEN 7 THEN 'A;B' WHEN 8 THEN 'A;;B' WHEN 9 THEN 'A|0.9' WHEN 10 THEN 'A|1.5e-10,2' WHEN 11 THEN 'A|ECO:0000269' WHEN 12 THEN 'A|toolong'
 WHEN 13 THEN 'A|' WHEN 14 THEN 'x|y|0.5' WHEN 15 THEN NULL WHEN 16 THEN 'a%3Bb' || ';' || c_mktsegment || '|EXP' WHEN 17 THEN ' ' || c_mktsegment || ' ; NaN' ELSE c_mktsegment || ';' || c_name || '|' || CAST(c_nationkey AS VARCHAR(9)) END"""
BASE = f"SELECT c_custkey AS id, {CELL} AS cell FROM customer"
T = "regexp_replace(cell, '^\\s+|\\s+$', '', 'g')"
WEB = f"(cell IS NULL OR {T} = '' OR lower({T}) IN ('na', 'n/a', 'nan', 'null', 'none', '__na__'))"
TX = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.expr(CELL.replace("VARCHAR(9)", "STRING")).alias("cell"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")


@query("prj1", f"SELECT id, CASE WHEN {WEB} THEN NULL ELSE cell END AS value FROM ({BASE})")
def prj1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", missing.normalize_missing(F.col("cell")).alias("value"))


@query("prj2", f"SELECT id, (cell IS NULL OR cell IN ('', 'nan', 'none', 'null', 'NA', 'NaN')) AS missing FROM ({BASE})")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", missing.core_missing(F.col("cell")).alias("missing"))


@query("prj3", f"SELECT id, (cell IS NULL OR cell IN ('', 'nan', 'none', 'null', 'NA', 'NaN', '<N/A>', '<NA>', '<NaN>', 'NaT', 'None')) AS missing FROM ({BASE})")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", missing.stats_missing(F.col("cell")).alias("missing"))


@query("prj4", f"SELECT id, (cell IS NULL OR {T} IN ('', 'nan', 'none', 'null', 'NA', 'NaN')) AS missing FROM ({BASE})")
def prj4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", missing.transfer_missing(F.col("cell")).alias("missing"))


NUMERIC = "CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN ' 12 ' WHEN 1 THEN '1e3' WHEN 2 THEN '1d' WHEN 3 THEN 'Infinity' WHEN 4 THEN '.5' WHEN 5 THEN '1;2' ELSE CAST(c_nationkey AS VARCHAR(9)) || '.25' END"


@query(
    "prj6",
    rf"""SELECT id, CASE WHEN regexp_matches({T}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({T} AS DOUBLE) END AS value
FROM (SELECT c_custkey AS id, {NUMERIC} AS cell FROM customer)""",
)
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("cell", F.expr(NUMERIC.replace("VARCHAR(9)", "STRING")))
    return df.select("id", cells.parse_number(F.col("cell")).alias("value"))


SPLIT = f"list_filter(list_transform(string_split(cell, ';'), lambda x: {TX}), lambda x: x <> '' AND lower(x) NOT IN ('na', 'n/a', 'nan', 'null', 'none', '__na__'))"


@query("prj8", f"SELECT id, unnest({SPLIT}) AS label FROM ({BASE})")
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", F.explode(cells.split_labels(F.col("cell"))).alias("label"))


@query("prj9", f"WITH b AS (SELECT c_custkey AS id, {CELL} AS cell, c_mktsegment AS seg FROM customer), p AS (SELECT id, CASE WHEN id % 5 = 0 THEN string_split('f(' || seg || ';y);' || cell || '(', ';') ELSE list_concat(['f(' || seg || ';y)'], string_split(cell, ';')) END AS w FROM b WHERE cell IS NOT NULL) SELECT id, unnest(range(len(w)))::INT AS pos, unnest(w) AS part FROM p")
def prj9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).withColumn("cell", F.concat(F.lit("f("), "c_mktsegment", F.lit(";y);"), "cell", F.when(F.col("id") % 5 == 0, "(").otherwise("")))
    return df.select("id", F.posexplode(cells.split_top_level(F.col("cell"))).alias("pos", "part"))


PIPED = r"regexp_matches(p, '^.*\|[^|]+$')"
TAIL = r"regexp_replace(regexp_extract(p, '^.*\|([^|]+)$', 1), '^\s+|\s+$', '', 'g')"
NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


@query(
    "prj10",
    rf"""WITH parts AS (SELECT id, unnest(string_split(cell, ';')) AS raw FROM ({BASE})),
t AS (SELECT id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM parts),
u AS (SELECT id, p, {PIPED} AND regexp_matches({TAIL}, '^([A-Z]{{2,5}}|ECO:\d+)$') AS ev,
  {PIPED} AND len(list_filter(string_split({TAIL}, ','), lambda x: NOT ({TX} = '' OR regexp_matches({TX}, {NUM})))) = 0 AS num FROM t)
SELECT id, CASE WHEN ev OR num THEN regexp_replace(regexp_extract(p, '^(.*)\|[^|]+$', 1), '^\s+|\s+$', '', 'g') ELSE p END AS label,
  CASE WHEN num AND NOT ev THEN list_aggregate(list_transform(string_split({TAIL}, ','), lambda x: coalesce(TRY_CAST({TX} AS DOUBLE), 0)), 'sum') END AS score_sum,
  CASE WHEN ev THEN {TAIL} END AS evidence FROM u""",
)
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir).select("id", F.explode(F.split("cell", ";")).alias("part")).select("id", cells.parse_label(F.col("part")).alias("p"))
    return p.select("id", "p.label", F.when(F.size("p.scores") > 0, F.aggregate("p.scores", F.lit(0.0), lambda a, x: a + x)).alias("score_sum"), "p.evidence")


@query("prj11", f"SELECT id, replace(replace(replace(replace(cell, '%', '%25'), ';', '%3B'), '|', '%7C'), chr(9), '%09') AS value FROM (SELECT id, cell || chr(9) AS cell FROM ({BASE}))")
def prj11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", cells.encode_field(F.concat("cell", F.char(F.lit(9)))).alias("value"))


@query("prj12", "SELECT page_id, replace(replace(replace(replace(u, '%3B', ';'), '%7C', '|'), '%3b', ';'), '%25', '%') AS value FROM (SELECT page_id, replace(replace(url, '%', '%25'), '/', '%3B') || '%7C+%zz%2' AS u FROM pages)")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.concat(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%3B")), F.lit("%7C+%zz%2"))
    return p.select("page_id", cells.decode_field(u).alias("value"))


@query("prj13", f"SELECT id, 'f(a%3Bb);' || array_to_string(list_transform(string_split(cell, ';'), lambda x: replace(split_part(x, '|', 1), '%', '%25') || CASE WHEN contains(x, '|') THEN '|' || replace(replace(substr(x, strpos(x, '|') + 1), '%', '%25'), '|', '%7C') ELSE '' END), ';') AS value FROM ({BASE})")
def prj13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", cells.migrate_cell(F.concat(F.lit("f(a;b);"), "cell")).alias("value"))


@query("prj14", f"SELECT id, array_to_string(list_transform(string_split(cell, ';'), lambda x: replace(split_part(x, '|', 1), '%3B', ';')), ';') AS value FROM ({BASE})")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", cells.display_value(F.col("cell")).alias("value"))


@query("prj15", f"SELECT id, array_to_string(list_transform(string_split(cell, ';'), lambda x: split_part(x, '|', 1)), ';') AS value FROM ({BASE})")
def prj15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", cells.strip_scores(F.col("cell")).alias("value"))


@query("prj25", f"SELECT id, ({SPLIT})[1] AS label FROM ({BASE})")
def prj25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", cells.primary_label(cells.split_labels(F.col("cell"))).alias("label"))


# Scalar functions: each over a text that part rows of the customers' columns make up.
def _fn(name: str, text: str, sql: str, f) -> None:  # noqa: ANN001
    """Registers ``f(text)`` as ``out`` by customer."""

    @query(name, f"SELECT id, {sql} AS out FROM (SELECT c_custkey AS id, {text} AS x FROM customer)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = spark.read.parquet(f"{sf_dir}/customer.parquet")
        return c.select(F.col("c_custkey").alias("id"), F.expr(text.replace("VARCHAR(9)", "STRING")).alias("x")).select("id", f(F.col("x")).alias("out"))


_KEY = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'sp|P' || CAST(10000 + c_custkey % 80000 AS VARCHAR(9)) || '|NAME' WHEN 1 THEN 'db|' || c_name WHEN 2 THEN c_name ELSE 'tr|Q1ABC2|' END"
_fn("fn1", _KEY, r"CASE WHEN regexp_matches(x, '^(sp|tr)\|[^|]+\|') THEN regexp_extract(x, '^(?:sp|tr)\|([^|]+)\|', 1) WHEN contains(x, '|') THEN split_part(x, '|', 2) ELSE x END", bio.parse_identifier)
_fn("fn2", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'P' || CAST(10000 + c_custkey % 80000 AS VARCHAR(9)) WHEN 1 THEN 'A0A024RBG1' ELSE c_name END", "regexp_matches(x, '^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$')", bio.is_accession)
_fn("fn3", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN CAST(c_nationkey AS VARCHAR(9)) || '.7' WHEN 1 THEN 'n.d.' ELSE '' END", "coalesce(CAST(CAST(trunc(TRY_CAST(x AS DOUBLE)) AS BIGINT) AS VARCHAR), x)", bio.annotation_score)
_FAM = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN c_mktsegment || ' family, sub ' || c_name || '|ISS' WHEN 1 THEN c_mktsegment || '; ' || c_name WHEN 2 THEN c_name ELSE '' END"
_MAIN = r"CASE WHEN contains(x, '|') THEN regexp_extract(x, '^(.*)\|([^|]*)$', 1) ELSE x END"
_fn("fn4", _FAM, rf"CASE WHEN contains({_MAIN}, ',') THEN trim(split_part({_MAIN}, ',', 1)) WHEN contains({_MAIN}, ';') THEN trim(split_part({_MAIN}, ';', 1)) ELSE {_MAIN} END || CASE WHEN regexp_extract(x, '\|([^|]+)$', 1) <> '' THEN '|' || regexp_extract(x, '\|([^|]+)$', 1) ELSE '' END", bio.first_family)
_fn("fn5", "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'True' WHEN 2 THEN 'False' WHEN 3 THEN NULL ELSE '1ABC;2XYZ' END", "CASE WHEN x IN ('True', 'False') THEN x WHEN coalesce(trim(x), '') = '' THEN 'False' ELSE 'True' END", lambda c: bio.has_structure(c, F.lit("P1")))
_fn("fn6", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN ' Fragment' WHEN 1 THEN c_mktsegment ELSE '' END", "CASE WHEN lower(trim(x)) = 'fragment' THEN 'yes' ELSE x END", bio.fragment)
_fn("fn7", "'F:' || c_mktsegment || '; P:' || c_name || ';plain'", "array_to_string(list_transform(string_split(x, ';'), lambda t: CASE WHEN length(trim(t)) > 2 AND trim(t)[2] = ':' THEN substr(trim(t), 3) ELSE trim(t) END), ';')", bio.go_terms)
_fn("fn9", "'G3DSA:' || CAST(c_custkey % 9 AS VARCHAR(9)) || '.10; G3DSA:' || CAST(c_custkey % 7 AS VARCHAR(9)) || '.40;'", "array_to_string(list_sort(list_transform(list_filter(string_split(x, ';'), lambda v: trim(v) <> ''), lambda v: trim(replace(v, 'G3DSA:', '')))), ';')", bio.cath)
_fn("fn10", "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'SIGNAL_PEPTIDE(1-20)' WHEN 1 THEN 'True' WHEN 2 THEN '' ELSE c_name END", "CASE WHEN x IN ('True', 'False') THEN x WHEN contains(x, 'SIGNAL_PEPTIDE') THEN 'True' ELSE 'False' END", bio.signal_peptide)
_fn("fn13", "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'SSSiiHHH' WHEN 1 THEN 'iibbB' WHEN 2 THEN 'HHbb' WHEN 3 THEN 'iioo' ELSE 'Soo' END", "CASE WHEN contains(x, 'S') THEN 'True' ELSE 'False' END || '/' || CASE WHEN regexp_matches(x, '[Hh]') AND regexp_matches(x, '[Bb]') THEN 'alpha-helical;beta-barrel' WHEN regexp_matches(x, '[Hh]') THEN 'alpha-helical' WHEN regexp_matches(x, '[Bb]') THEN 'beta-barrel' ELSE 'none' END", lambda c: F.concat(bio.topology_signal(c), F.lit("/"), bio.topology_membrane(c)))
_fn("fn14", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Belongs to the ' || c_mktsegment || ' family. More' WHEN 1 THEN c_name ELSE 'UniProtKB unreviewed (TrEMBL)' END", "split_part(regexp_replace(x, '^Belongs to the ', ''), '.', 1) || '/' || CASE WHEN contains(lower(x), 'reviewed') AND NOT contains(lower(x), 'unreviewed') THEN 'Swiss-Prot' ELSE 'TrEMBL' END", lambda c: F.concat(bio.family_sentence(c), F.lit("/"), bio.reviewed(c)))
_fn("fn15", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'unclassified|9.1;2.60|8;unclassified|7' WHEN 1 THEN 'x (unclassified)|3' ELSE 'unclassified' END", r"regexp_replace(x, '(^|;)unclassified\|', '\1-|', 'g')", bio.relabel_ted)
_fn("fn16", "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'my_long--name' WHEN 1 THEN '__' ELSE c_name END", "CASE WHEN trim(regexp_replace(x, '[_-]+', ' ', 'g')) = '' THEN x ELSE upper(trim(regexp_replace(x, '[_-]+', ' ', 'g'))[1]) || substr(trim(regexp_replace(x, '[_-]+', ' ', 'g')), 2) END", bio.pretty_name)
_fn("fn17", "'#' || CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'FF8000' WHEN 1 THEN '00a0ff' ELSE '0A0B0C' END", "'rgba(' || CAST(('0x' || x[2:3])::INT AS VARCHAR) || ', ' || CAST(('0x' || x[4:5])::INT AS VARCHAR) || ', ' || CAST(('0x' || x[6:7])::INT AS VARCHAR) || ', 0.8)'", bio.hex_to_rgba)
_fn("agg16", "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'ECO:0000256,ECO:0000269' WHEN 1 THEN 'XYZ' WHEN 2 THEN 'IEA,IDA' ELSE 'ECO:0000305,ECO:0007744' END", "CASE x WHEN 'ECO:0000256,ECO:0000269' THEN 'EXP' WHEN 'XYZ' THEN 'XYZ' WHEN 'IEA,IDA' THEN 'IDA' ELSE 'HDA' END", lambda c: bio.best_evidence(F.split(c, ",")))


@query("fn12", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '-' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || c_name || ')' END || '|' || printf('%.1f', c_nationkey + 0.25::DOUBLE) AS out FROM customer")
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey") % 3
    return c.select(F.col("c_custkey").alias("id"), bio.ted_domain(F.when(k > 0, F.col("c_mktsegment")), F.when(k == 2, F.col("c_name")), F.col("c_nationkey") + F.lit(0.25)).alias("out"))


PALETTE = ("#0D0887", "#7E03A8", "#CC4778", "#F89540", "#fd0")


@query("fn17_palette", """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 0.25 ELSE (value - 20) / 100 END AS t FROM events),
p AS (SELECT event_id, CASE WHEN t IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, t)) * 4 END AS u FROM e),
r AS (SELECT [[13, 8, 135], [126, 3, 168], [204, 71, 120], [248, 149, 64], [255, 221, 0]] AS rgb, ['#0D0887', '#7E03A8', '#CC4778', '#F89540', '#fd0'] AS stops),
m AS (SELECT event_id, u, stops, least(floor(u), 3)::INT AS low, rgb FROM p, r)
SELECT event_id, CASE WHEN u = floor(u) THEN stops[u::INT + 1] WHEN u IS NOT NULL THEN '#' || list_aggregate(list_transform([1, 2, 3], lambda k: printf('%02X', floor(rgb[low + 1][k] * (1 - (u - low)) + rgb[low + 2][k] * (u - low) + 0.5 + 1e-9)::INT)), 'string_agg', '') END AS color FROM m""")
def fn17_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a numeric column; no value and NaN have none, and values beyond the ends take the ends'."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 50
    t = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(0.25)).otherwise((F.col("value") - 20) / 100)
    return e.select("event_id", bio.sample_palette(t, PALETTE).alias("color"))
