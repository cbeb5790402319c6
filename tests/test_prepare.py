"""From vectors to a bundle in one call, and styles for it in another."""

import json

import numpy as np
import pytest

from lumenvec.plans import prepare
from lumenvec.sources import bundle


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(0)
    v = np.repeat(np.eye(3) * 5, 20, axis=0) + rng.normal(size=(60, 3)) * 0.2
    sets = {"A": spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>"), "B": spark.createDataFrame([(i, x[::-1].tolist()) for i, x in enumerate(v) if i != 7], "id long, embedding array<double>")}
    notes = spark.createDataFrame([(i, None if i % 10 == 0 else f"F{i // 20}", f"x%3B{i % 2};y|0.5") for i in range(65)], "id long, family string, tags string")
    return sets, notes


def test_bundle_of_several_sets(spark, inputs, tmp_path):
    sets, notes = inputs
    edges = spark.createDataFrame([(i, j, 1.0 if i == j else 0.5) for i in range(6) for j in range(6)], "i long, j long, sim double")
    path = prepare.prepare(spark, sets, str(tmp_path / "a.bundle"), "pca2", notes, {"S": edges}, ["family"], cache=str(tmp_path / "cache"))
    rows = {r["identifier"]: r for r in bundle.read_part(spark, path).collect()}
    assert len(rows) == 59 and "7" not in rows and "64" not in rows  # ids of both sets alone
    assert rows["10"]["family"] == "" and rows["10"]["family__pred_value"] == "F0" and rows["11"]["family__pred_value"] == ""
    meta = {(r["projection_name"], r["dimensions"], r["source"]) for r in bundle.read_part(spark, path, "metadata").collect()}
    assert meta == {("A — PCA 2", 2, "A"), ("B — PCA 2", 2, "B"), ("S — MDS 2", 2, "S")}
    data = bundle.read_part(spark, path, "projections")
    assert {(r["projection_name"], r["count"]) for r in data.groupBy("projection_name").count().collect()} == {(n, 59 if s != "S" else 6) for n, _, s in meta}
    assert data.filter("z is null").count() == 59 * 2 + 6 and len(list((tmp_path / "cache").iterdir())) == 3


def test_bundle_with_statistics(spark, inputs, tmp_path):
    sets, notes = inputs
    path = prepare.prepare(spark, {"A": sets["A"]}, str(tmp_path / "a.bundle"), "pca2", notes, stats=True, stats_annotation="family")
    rows = {r["identifier"]: r.asDict() for r in bundle.read_part(spark, path).collect()}
    assert len(rows) == 60 and rows["1"]["cluster_elbow_A — PCA 2"].startswith("cluster ")
    scored = {(r["space_name"], r["annotation"]) for r in bundle.read_part(spark, path, "statistics").filter("metric = 'silhouette'").collect()}
    assert ("A — PCA 2", "family") in scored and ("A", "family") in scored


def test_plain_parquet(spark, inputs, tmp_path):
    sets, notes = inputs
    out = prepare.prepare(spark, {"A": sets["A"]}, str(tmp_path / "out"), annotations=notes, bundled=False, settings={"family": {}})
    assert spark.read.parquet(f"{out}/annotations").count() == 60 and spark.read.parquet(f"{out}/projections").count() == 60
    assert spark.read.parquet(f"{out}/settings").first()[0] == '{"family": {}}'
    with pytest.raises(ValueError):
        prepare.prepare(spark, {}, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        prepare.prepare(spark, sets, str(tmp_path / "none"), stats_annotation="family")


def test_styles(spark, inputs, tmp_path):
    sets, notes = inputs
    path = prepare.prepare(spark, {"A": sets["A"]}, str(tmp_path / "a.bundle"), annotations=notes)
    template = {(r["annotation"], r["value"]): (r["n"], r["color"]) for r in prepare.style_template(bundle.read_part(spark, path)).collect()}
    assert template[("family", "<NA>")] == (6, "#C0C0C0") and template[("family", "F1")] == (18, "") and template[("tags", "x;1")] == (30, "") and template[("tags", "y")] == (60, "")
    one, two = str(tmp_path / "b.bundle"), str(tmp_path / "c.bundle")
    prepare.style_bundle(spark, path, one, {"family": {"colors": {"F1": "#111", "NaN": "#222"}, "maxVisibleValues": 3}})
    got = prepare.style_bundle(spark, one, two, {"tags": {"shapes": {"x;1": "star"}}, "family": {"shapes": {"F1": "square"}}})
    family = got["legendSettings"]["family"]
    assert family["maxVisibleValues"] == 3 and family["sortMode"] == "size-desc" and family["categories"]["F1"] == {"zOrder": 0, "color": "#111", "shape": "square"} and family["categories"]["<NA>"]["color"] == "#222"
    assert got["legendSettings"]["tags"]["categories"]["x;1"]["shape"] == "star"
    assert json.loads(bundle.read_part(spark, two, "settings").first()[0]) == got
    a, b = (bundle.split_bundle(open(p, "rb").read()) for p in (path, two))
    assert all(a[n] == b[n] for n in a)
    with pytest.raises(ValueError, match="no value"):
        prepare.style_bundle(spark, path, one, {"family": {"colors": {"F9": "#111"}}})
    with pytest.raises(ValueError, match="no annotation"):
        prepare.style_bundle(spark, path, one, {"famly": {}})
