"""Layouts on planted clusters, their tables of pairs against plain loops, and the store of projections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import manifold, reduce


def planted(clusters=6, rows=50, width=16, seed=0):
    rng = np.random.default_rng(seed)
    v = np.vstack([c + rng.normal(size=(rows, width)) * np.linspace(0.2, 1.5, width) for c in rng.normal(size=(clusters, width)) * 4])
    return v, np.repeat(np.arange(clusters), rows)


def frame(spark, v, parts=3):
    return spark.createDataFrame([(i, x.tolist(), "x", 1) for i, x in enumerate(v)], "id long, embedding array<double>, y string, no int").repartition(parts)


def trustworthiness(v, y, k=10):
    n = len(v)
    far = lambda x: np.where(np.eye(n, dtype=bool), np.inf, ((x[:, None] - x[None]) ** 2).sum(2))
    rank, near = np.argsort(np.argsort(far(v), 1), 1), np.argsort(far(y), 1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] + 1 - k) for i in range(n) for j in near[i])


METHODS = {
    "umap": lambda df, **o: manifold.umap(df, total=100, **o),
    "pacmap": lambda df, **o: manifold.pacmap(df, phases=(40, 40, 80), epochs=20, **o),
    "localmap": lambda df, **o: manifold.localmap(df, phases=(40, 40, 80), epochs=20, **o),
}


@pytest.mark.parametrize("method", sorted(METHODS))
def test_layouts_keep_neighbours(spark, method):
    v, label = planted()
    for options in ({"blocks": 4}, {"blocks": 11, "dims": 3}):
        got = {r["id"]: r["coords"] for r in METHODS[method](frame(spark, v, options["blocks"]), **options).collect()}
        y = np.array([got[i] for i in range(len(v))])
        assert y.shape == (len(v), options.get("dims", 2)) and np.isfinite(y).all()
        assert trustworthiness(v, y) > 0.9
        near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2) + np.diag([np.inf] * len(y)), 1)[:, :10]
        assert (label[near] == label[:, None]).mean() > 0.97


def test_layouts_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (None, [3.0, 4.0]), (5, [1.0, 2.0]), (6, [0.0, 0.0]), (7, [9.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for method in (METHODS["umap"], METHODS["localmap"]):
        got = method(df).collect()
        assert sorted(r["id"] or 0 for r in got) == [0, 1, 1, 5, 6, 7] and all(np.isfinite(r["coords"]).all() for r in got)
        assert method(df.limit(0)).count() == 0
        assert [r["coords"] for r in method(df.filter("id = 1").limit(1)).collect()] == [[0.0, 0.0]]


def test_a_hub_keeps_its_expected_force(spark):
    """One row that all others are tied to: a round takes a draw of its pairs, of the weight that all have."""
    seen = []

    def step(block, first):
        for h in np.unique(block.head):
            seen.append((int((block.head == h).sum()), float(block.weight[block.head == h].sum())))
        block.y[:, 0] = 0
        np.add.at(block.y[:, 0], block.head, block.weight)
        block.y[:, 1] = np.bincount(block.head, minlength=len(block.y))

    n = 3000
    start = spark.range(n).select(F.col("id").alias("no"), F.array(F.lit(1.0), F.lit(2.0)).alias("y"))
    pairs = spark.range(1, n).select(F.lit(0).cast("long").alias("head"), F.col("id").alias("tail"), F.lit(3).cast("long").alias("kind"), F.lit(1.0).alias("weight"))
    hub = manifold.layout(start, pairs, step, 1, 1, 0).filter("no = 0").first()["y"]
    assert 0.5 * manifold.DRAWN < hub[1] < 2 * manifold.DRAWN and abs(hub[0] - (n - 1)) < 0.6 * n


def test_bandwidths(spark):
    v, _ = planted(3, 20)
    near = manifold.near_lists(manifold.numbered_vectors(frame(spark, v)), 9)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) + np.diag([np.inf] * len(v))
    for r in manifold.bandwidths(near, 10).collect():
        want = np.sort(d[r["i"]])[:9]
        np.testing.assert_allclose(r["ds"], want, atol=1e-9)
        assert abs(r["rho"] - want[0]) < 1e-9 and abs(np.exp(-np.maximum(0, want - r["rho"]) / r["sigma"]).sum() - math.log2(10)) < 1e-6


@pytest.mark.parametrize("min_dist,want", [(0.1, (1.577, 0.895)), (0.5, (0.583, 1.334)), (0.001, (1.929, 0.792))])
def test_curve(min_dist, want):
    """The published values of the curve's parameters."""
    assert np.allclose(manifold.curve(min_dist), want, atol=0.01)


def test_phases():
    assert manifold.pacmap_weights(0, (100, 100, 250)) == (2.0, 1000.0, 1.0) and manifold.pacmap_weights(150, (100, 100, 250)) == (3.0, 3.0, 1.0) and manifold.pacmap_weights(200, (100, 100, 250)) == (1.0, 0.0, 1.0)


# The store


def test_store_reuses_and_refits(spark, tmp_path):
    v, _ = planted(3, 20)
    df = frame(spark, v).select("id", "embedding")
    folder = f"file://{tmp_path}/store"
    specs = reduce.parse_methods("pca2,tsne2:perplexity=5")
    edges = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (0, 1, 0.9), (1, 2, 0.1)], "i long, j long, sim double")
    run = lambda d, **o: (s := reduce.ProjectionStore(spark, folder, **o), reduce.reductions({"A": d}, specs, {"E": edges}, s, seed=1).collect())
    first, rows = run(df)
    again, rows2 = run(df.repartition(7))
    key = lambda rs: sorted((r["projection_name"], r["source"], r["id"], tuple(r["coords"])) for r in rs)
    assert len(first.misses) == 3 and not first.hits and len(again.hits) == 3 and not again.misses and key(rows) == key(rows2)
    assert {(r["projection_name"], r["source"]) for r in rows} == {("A — PCA 2", "A"), ("A — TSNE 2", "A"), ("E — MDS 2", "E")} and sum(r["source"] == "E" for r in rows) == 3
    assert first.info(first.misses[1]) == {"source": "A", "method": "tsne", "dimensions": 2, "params": {"perplexity": 5, "seed": 1}}
    changed = df.withColumn("embedding", F.when(F.col("id") == 7, F.transform("embedding", lambda x: x + 1e-9)).otherwise(F.col("embedding")))
    other, _ = run(changed)
    assert len(other.misses) == 2 and len(other.hits) == 1  # the edges are as they were
    forced, _ = run(df, refetch=True)
    assert len(forced.misses) == 3


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a long, b string")
    f = reduce.fingerprint(a)
    assert f == reduce.fingerprint(a.repartition(3).select("b", "a")) and f != reduce.fingerprint(a.distinct()) and f != reduce.fingerprint(a.fillna("x")) and reduce.fingerprint(a.limit(0)) == "0:0:0"


def test_precomputed_distances(spark):
    """Points of a plane from their distances alone, more of them than landmarks."""
    rng = np.random.default_rng(3)
    p = rng.normal(size=(80, 2))
    d = spark.createDataFrame([(i, j, float(np.linalg.norm(p[i] - p[j]))) for i in range(80) for j in range(i)], "i long, j long, d double")
    got = {r["id"]: r["coords"] for r in reduce.mds_precomputed(d, landmarks=40).collect()}
    y = np.array([got[i] for i in range(80)])
    a, b = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(80, 1)] for x in (p, y))
    assert np.corrcoef(a, b)[0, 1] > 0.98
    assert reduce.mds_precomputed(d.limit(0)).count() == 0
