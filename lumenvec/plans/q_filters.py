"""Filter queries over customers: a label array (with missing and mixed rows) and a balance with gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.missing import NA
from lumenvec.operators import filters as flt
from lumenvec.operators.filters import ANY, Categorical, Columns, Group, Numeric
from lumenvec.plans.registry import query

COLS = Columns(frozenset({"seg"}), frozenset({"bal", "nat"}))
# m: row without labels; x: row with a real and a missing label.
SQL = """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, c_custkey % 7 = 0 AS m, c_custkey % 7 = 1 AS x, c_custkey % 7 = 2 AS two,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, c_nationkey AS nat FROM customer) SELECT id FROM c WHERE """


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey") % 7
    seg = F.when(k == 0, F.lit(None)).when(k == 1, F.array("c_mktsegment", F.lit(None))).when(k == 2, F.array("c_mktsegment", F.lit("EXTRA"))).otherwise(F.array("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), seg.alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").alias("nat"))


def _q(name: str, sql: str, *items: flt.Item) -> None:
    @query(name, SQL + sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir).filter(flt.compile_query(items, COLS)).select("id")


B = Categorical("seg", ("BUILDING",))
_q("flt1", "NOT m AND (s IN ('BUILDING', 'MACHINERY') OR two)", Categorical("seg", ("BUILDING", "MACHINERY", "EXTRA")))
_q("flt1_na", "m OR x OR s = 'BUILDING'", Categorical("seg", ("BUILDING", NA)))
_q("flt2", "NOT m", Categorical("seg", (ANY,)))
_q("flt2_na", "m OR x", Categorical("seg", (NA,)))
_q("flt3", "bal BETWEEN 100 AND 5000", Numeric("bal", "between", 100, 5000))
_q("flt3_gt", "bal > 5000", Numeric("bal", "gt", min=5000))
_q("flt4", "bal >= 8000 OR bal IS NULL", Numeric("bal", "gte", min=8000, presence=(NA,)))
_q("flt4_any", "bal IS NOT NULL", Numeric("bal", "lt", max=0, presence=(ANY,)))
_q("flt6", "bal < 100", Numeric("bal", "between", 5, None), Categorical("seg"), Group(), Numeric("bal", "lt", max=100))
_q("flt6_absent", "bal < 100", Numeric("bal", "lt", max=100), Categorical("nowhere", ("a",), op="OR"), Categorical("nat", ("1",), op="OR"))
_q("flt7", "((NOT m AND s = 'BUILDING') OR bal > 5000) AND nat < 10", Categorical("seg", ("BUILDING",), op="OR"), Numeric("bal", "gt", min=5000, op="OR"), Numeric("nat", "lt", max=10))
_q("flt8", "nat < 20 AND NOT m AND s <> 'BUILDING'", Numeric("nat", "lt", max=20), Categorical("seg", ("BUILDING",), op="NOT"))
_q("flt8_mixed", "NOT m AND NOT x", Categorical("seg", (NA,), op="NOT"))
_q("flt8_number", "bal <= 5000", Numeric("bal", "gt", min=5000, op="NOT"))
_q("flt9", "(NOT m OR bal IS NOT NULL) AND NOT (NOT m AND s = 'BUILDING' AND coalesce(bal > 1000, false))", Group((B, Numeric("bal", "gt", min=1000)), op="NOT"))
_q("flt10", "nat < 10 AND bal IS NULL", *flt.excluding((Numeric("nat", "lt", max=10), Group((Categorical("seg", ("BUILDING",), id="drop"),), op="AND"), Numeric("bal", "gte", presence=(NA,))), "drop"))
_q("flt13", "bal BETWEEN 0.2 AND 0.9 OR bal IS NULL", *flt.reliability_conditions("bal", 0.2, 0.9))
_q("flt12", "bal >= 9000 AND nat < 5", *flt.replace_conditions((Numeric("bal", "lt", max=1, op="NOT"), Group((Numeric("bal", "gt", min=3),)), Numeric("nat", "lt", max=5, op="AND")), "bal", Numeric("bal", "gte", min=9000)))


@query("flt11", SQL.replace("SELECT id", "SELECT count(*) AS n") + "NOT m AND s = 'BUILDING'")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate lets the middle query through and clears those that match everything or nothing."""
    df = rows(spark, sf_dir)
    if flt.apply_gate(df, (Categorical("seg"),), COLS) is not None or flt.apply_gate(df, (Categorical("seg", ("nothing",)),), COLS) is not None:
        raise AssertionError("the gate is open")
    return flt.apply_gate(df, (B,), COLS).agg(F.count(F.lit(1)).alias("n"))


LABELS = """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, c_custkey % 7 AS k, c_nationkey < 12 AS inside FROM customer),
l AS (SELECT id, k, inside, s AS value FROM c WHERE k <> 0 UNION ALL SELECT id, k, inside, '__NA__' FROM c WHERE k IN (0, 1) UNION ALL SELECT id, k, inside, 'EXTRA' FROM c WHERE k = 2)"""


@query("agg2", LABELS + " SELECT value, count(DISTINCT id) AS n FROM l GROUP BY value")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.value_counts(rows(spark, sf_dir), "seg")


def _picker(name: str, op: str, sql: str) -> None:
    @query(name, LABELS + f", g AS (SELECT value, count(*) AS f, count(*) FILTER (inside) AS i FROM l GROUP BY value), t AS (SELECT count(*) FILTER (inside) AS sc, count(*) FILTER (inside AND k <> 0) AS an, count(*) FILTER (inside AND k = 1) AS mx FROM c) SELECT value, {sql} AS n FROM g, t")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flt.picker_counts(rows(spark, sf_dir), "seg", F.col("nat") < 12, op)


_picker("agg3", "AND", "i")
_picker("agg3_or", "OR", "sc + f - i")
_picker("agg3_not", "NOT", "an - CASE WHEN value = '__NA__' THEN mx ELSE i END")


@query("agg4", "SELECT count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 500 OR c_acctbal < 0) AS n, 0::BIGINT AS unconfigured, 0::BIGINT AS absent FROM customer")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    one = flt.numeric_matches(df, Numeric("bal", "lt", max=500, presence=(NA,)), COLS)
    return df.agg(one.alias("n"), F.max(flt.numeric_matches(df, Numeric("bal"), COLS)).alias("unconfigured"), F.max(flt.numeric_matches(df, Numeric("zz", "lt", max=1), COLS)).alias("absent"))
