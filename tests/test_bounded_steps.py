"""Steps that ran in one task, or again and again, and whose cost grew faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import manifold, reduce, settings, stats
from lumenvec.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["settings_normalized", "src13"])
def test_rows_of_one_file_are_spread(spark, name):
    assert "RoundRobinPartitioning" in plan(registry.queries()[name](spark, SF))


def test_settings_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(settings.normalized(F.col("t")).alias("n"))
    assert plan(df).count("parseJson(") == 1


def test_skipped_statistics_are_not_computed(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(stats, "silhouette", lambda points: asked.append(points))
    assert registry.queries()["sta12_skip"](spark, SF).first()["metric"] == "skipped" and not asked


def test_similarities_are_searched_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reduce, "reductions", lambda sets, specs, precomputed, store: seen.append(precomputed["C"]))
    registry.queries()["dr8"](spark, SF)
    assert len(seen) == 2 and all("CartesianProduct" not in plan(edges) and "Scan parquet" in plan(edges) for edges in seen)


def test_vectors_are_numbered_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(manifold, "NUMBERED_ROWS", 100)
    held = []
    before = manifold.ranks.before
    monkeypatch.setattr(manifold.ranks, "before", lambda df, order, weight, name, bucket_rows: held.append(bucket_rows) or before(df, order, weight, name, bucket_rows))
    df = spark.createDataFrame([(i * 7 % 1000, [float(i), 1.0]) for i in range(1000)], "id long, embedding array<double>")
    got = manifold.numbered_vectors(df).select("id", "no").collect()
    assert held == [100] and sorted((r["no"], r["id"]) for r in got) == [(i, i) for i in range(1000)]


def test_clusterings_scan_more_than_one_file(spark, monkeypatch):
    from lumenvec.operators import kmeans

    seen = []
    sweep = kmeans.sweep
    monkeypatch.setattr(kmeans, "sweep", lambda rows, *a: seen.append(len(rows.inputFiles())) or sweep(rows, *a))
    v = np.random.default_rng(2).normal(size=(200, 2))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").coalesce(1)
    assert reduce.kmeans_sweep(df, k_max=4)[0].count() == 200 and seen[0] > 1
