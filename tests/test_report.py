"""Ranks over many buckets, the statistics table, row checks and number texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import binning, checks, joins, knn, ranks, report, stats


def test_ranks_over_many_buckets(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 500, 3000))]  # one value holds two fifths
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(5)
    order = sorted(range(3000), key=lambda i: (-values[i], i))
    want = {i: place for place, i in enumerate(order)}
    assert {r["id"]: r["at"] for r in ranks.numbered(df, [-F.col("v"), F.col("id")], "at", 0, bucket_rows=200).collect()} == want
    assert ranks._bucketed(df, [-F.col("v"), F.col("id")], 200)[0].groupBy("_bucket").count().agg(F.max("count")).first()[0] < 700
    mid = {r["id"]: r["m"] for r in ranks.midranks(df, "v", "m", bucket_rows=50).collect()}
    rank = np.array([np.mean([1 + sum(x < v for x in values), sum(x <= v for x in values)]) for v in values[:50]])
    assert [mid[i] for i in range(50)] == rank.tolist()
    shares = [0, 0.1, 0.33, 0.5, 0.999, 1]
    assert np.allclose(ranks.quantiles(df, "v", shares, bucket_rows=50), np.quantile(values, shares))
    assert ranks.numbered(df.limit(0), [F.col("id")], "at").count() == 0 and ranks.quantiles(df.limit(0), "v", [0.5]) == []


def test_statistics_table(spark):
    rng = np.random.default_rng(2)
    at = 20 * np.eye(6)[np.arange(120) % 6] + 0.1 * rng.standard_normal((120, 6))
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(at)], "id long, v array<double>")
    flat = spark.createDataFrame([(i, [float(i % 6 % 3 * 9 + r[0] / 50), float(i % 6 // 3 * 9 + r[1] / 50)]) for i, r in enumerate(at)], "id long, xy array<double>")
    notes = e.select("id", (F.col("id") % 6).cast("string").alias("kind"))
    got = report.compute({"E": e}, [("P", "E", flat), ("broken", "E", flat.withColumn("xy", F.array(F.lit("x"))))], notes, ["kind"], clusters=("elbow",), k_max=9)
    rows = {(r["space_name"], r["stat_family"], r["annotation"], r["metric"], r["category"]): r["value"] for r in got.table(spark).collect()}
    assert rows["P", "annotation_validity", "kind", "silhouette", None] > 0.9 and rows["E", "annotation_validity", "kind", "silhouette", None] > 0.9
    assert rows["P", "cluster_validity", "", "n_clusters", None] == 6 and rows["P", "cluster_agreement", "kind", "adjusted_rand", None] == 1
    assert rows["P", "annotation_validity", "cluster_elbow_P", "silhouette", None] > 0.9 and 0.5 < rows["P", "faithfulness", "", "trustworthiness", None] <= 1
    assert {s for s, _, _ in got.failed} == {"broken"} and got.failed and not any(k[0] == "broken" for k in rows)
    assert list(got.memberships) == ["cluster_elbow_P"] and got.memberships["cluster_elbow_P"].count() == 120
    legend = report.cluster_legend(got.memberships["cluster_elbow_P"], "cluster_elbow_P").orderBy("z_order").collect()
    assert [r["label"] for r in legend] == [f"cluster {i}" for i in range(6)] and legend[5]["color"] == report.CONTRAST[5]


def test_faithfulness_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v, k = rng.standard_normal((60, 5)).round(1), 4
    v[10:20] = v[10]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in r], [float(x) for x in r[:2]]) for i, r in enumerate(v)], "id long, v array<double>, xy array<double>").repartition(3)
    gap = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    place = lambda d: np.array([np.argsort(np.lexsort((np.arange(60), np.where(np.arange(60) == i, np.inf, d[i])))) + 1 for i in range(60)])
    h, lo = place(gap(v)), place(gap(v[:, :2]))
    norm = 2 / (60 * k * (120 - 3 * k - 1))
    want = [(((h <= k) & (lo <= k)).sum() / (60 * k)), 1 - np.where(lo <= k, np.maximum(h - k, 0), 0).sum() * norm, 1 - np.where(h <= k, np.maximum(lo - k, 0), 0).sum() * norm]
    assert np.allclose(stats.faithfulness(df, k, "euclidean").first(), want)
    assert stats.faithfulness(df, k, max_rows=59).first() == (None, None, None) and stats.faithfulness(df.limit(2)).count() == 0


def test_row_checks(spark):
    rows = spark.createDataFrame([("a;b", 1.0), ("x" * 300, 2.0), ("tab\there", 3.0), ("bell\x07", 4.0), (None, 5.0)], "t string, x double")
    assert tuple(checks.cell_problems(rows).first()) == ("t", 1, 1)
    for bad in (rows, rows.limit(0), rows.select("x").withColumnRenamed("x", "12"), spark.createDataFrame([("P", 1.0, float("nan"))], "projection_name string, x double, y double")):
        with pytest.raises(ValueError):
            checks.validate_projection(bad)
    checks.validate_projection(spark.createDataFrame([("P", 1.0, 2.0)], "projection_name string, x double, y double"))


def test_number_texts():
    f = binning.format_number
    assert [f(1234567.5, False), f(2.0, False), f(0.1234567, False), f(0.00012345678, False), f(1e-7, False), f(-12.9, True)] == ["1,234,567.5", "2.0", "0.123457", "0.000123457", "1e-7", "-12"]
    assert [binning.serialize_number(x) for x in (3.0, 0.1, 1234567.1, 1e-8 / 3)] == ["3", "0.10000000000000001", "1234567.1000000001", "3.3333333333333334e-9"]
    assert binning.bin_id("linear", 1234567.1, 2.0) != binning.bin_id("linear", 1234567.4, 2.0)
    assert binning.observed_labels([(1.0, 1.0), (1.00000001, 1.00000001)], False) == ["1.0", "1.00000001"]
    assert binning._hash32("a") == f"{(5381 * 33) ^ 97:08x}"
    one = [binning.Bin("b", "b", 0.0, 1.5, 3, 0.25)]
    assert binning.signature(binning.Settings(), one) != binning.signature(binning.Settings(reverse=True), one) and len(binning.topology("linear", one)) == 8


def test_side_tables_are_made_unique(spark):
    base = spark.createDataFrame([(1, "a"), (2, "")], "id long, x string")
    side = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q"), (None, "r")], "id long, x string")
    assert joins.refill_blanks(base, side, "id", ["x"]).count() == 2
    assert joins.enrich(base, [(side.withColumnRenamed("x", "y"), "id", ["y"])]).count() == 2


def test_distances_of_near_copies():
    x = np.full((3, 4), 1e3) + np.arange(3)[:, None] * 1e-9
    assert np.allclose(knn.distances(x, x, "euclidean")[0], [0, 2e-9, 4e-9], rtol=1e-3, atol=1e-15)
