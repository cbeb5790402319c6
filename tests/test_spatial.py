"""Windows of an indexed plane against scans, and how much of the table they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import spatial, views


@pytest.fixture(scope="module")
def plane(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 40_000
    xy = np.vstack([rng.normal(size=(n // 2, 2)), np.full((n // 4, 2), 0.25), rng.random((n // 4, 2)) * 8 - 4])  # a quarter in one place
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(n, None, 0.0), (n + 1, float("nan"), 0.0), (n + 2, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(4).cache()
    return df, spatial.write_index(df, str(tmp_path_factory.mktemp("plane") / "index"), files=64, row_group_bytes=16 << 10)


def rows_read(df):
    """Rows that the scan of a plan handed on, after files and row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


BOXES = [(-0.5, -0.5, 0.5, 0.5), (3.0, 3.0, 3.5, 3.6), (0.25, 0.25, 0.25, 0.25), (-9, -9, 9, 9), (5, 5, 6, 6), (-0.1, 2, 0.1, -2), (-4, -4, -3.999, 4)]


@pytest.mark.parametrize("box", BOXES)
def test_boxes(plane, box):
    df, index = plane
    want = df.filter(views.in_box(F.col("x"), F.col("y"), *box))
    got = index.box(*box)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_a_small_window_reads_little(plane):
    """A hundredth of the plane: files that the manifest leaves, and rows of the row groups that statistics leave."""
    df, index = plane
    box = (2.0, 2.0, 2.8, 2.8)
    found = index._cells(*box)
    assert len(found) <= spatial.STRETCHES and len(index.files(found)) <= 6
    inside = index.box(*box).count()
    assert 0 < inside and rows_read(index.near_box(*box)) < df.count() / 10


def test_polygons_and_nearest(plane):
    df, index = plane
    for corners in (((-1, -1), (1.5, -0.5), (0.2, 0.1), (0, 2)), ((3, 3), (3.5, 3), (3, 3.5)), ((0, 0), (1, 1))):
        want = df.filter(views.in_polygon(F.col("x"), F.col("y"), corners))
        assert sorted(r["id"] for r in index.polygon(corners).collect()) == sorted(r["id"] for r in want.collect())
    for px, py, radius in ((0.25, 0.25, 1.0), (3.9, -3.9, 0.5), (40, 40, 1.0), (3.2, 3.1, 5.0)):
        assert index.nearest(px, py, radius).collect() == views.nearest_point(df, px, py, radius).collect()


def test_stretches_cover_the_window():
    rng = np.random.default_rng(3)
    for _ in range(40):
        (x0, x1), (y0, y1) = (sorted(rng.integers(0, 64, 2).tolist()) for _ in range(2))
        for most in (4, 64):
            found = spatial.stretches((x0, y0), (x1, y1), 6, most)
            codes = {spatial._interleaved(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
            covered = {c for a, b in found for c in range(a, b + 1)}
            assert len(found) <= most and codes <= covered and (most == 4 or len(found) == most or len(covered) < 2 * len(codes) + 16)


def test_codes(spark):
    rows = [(x, y) for x in (0, 1, 2, 7, 1000, 4095) for y in (0, 3, 5, 4095)]
    side = float(1 << spatial.BITS)
    got = spark.createDataFrame([(float(x), float(y)) for x, y in rows], "x double, y double").select("x", "y", spatial.code(F.col("x"), F.col("y"), (0.0, 0.0, side, side)).alias("c")).collect()
    assert all(r["c"] == spatial._interleaved(int(r["x"]), int(r["y"])) for r in got)


def test_empty_and_degenerate(spark, tmp_path):
    none = spark.createDataFrame([], "id long, x double, y double")
    index = spatial.write_index(none, str(tmp_path / "none"))
    assert index.box(0, 0, 1, 1).count() == 0 and index.polygon([(0, 0), (1, 0), (1, 1)]).count() == 0
    one = spark.createDataFrame([(i, 2.0, 3.0) for i in range(5)], "id long, x double, y double")
    index = spatial.write_index(one, str(tmp_path / "one"), files=3)
    assert index.box(2, 3, 2, 3).count() == 5 and index.box(2.1, 3, 4, 4).count() == 0 and index.nearest(2.5, 3, 1).first()["id"] == 0
