"""Literal cases: cells, filters, neighbours, bins, bundles and sources."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenvec.functions import bio, cells, missing
from lumenvec.operators import binning, filters, joins, knn, layout, legend, reduce, stats, transfer, views
from lumenvec.operators.filters import ANY, Categorical, Columns, Group, Numeric
from lumenvec.sources import bundle, entries, fasta, vectors


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("", None), ("  ", None), ("NA", None), ("n/a", None), ("None", None), ("__NA__", None), (" A ", " A "), (None, None)])
def test_normalize_missing(spark, raw, want):
    assert one(spark, raw, missing.normalize_missing) == want


@pytest.mark.parametrize(
    "raw,want",
    [("A|0.9", ("A", [0.9], None)), ("A|1.5e-10,2", ("A", [1.5e-10, 2.0], None)), ("A|EXP", ("A", [], "EXP")), ("A|ECO:0000269", ("A", [], "ECO:0000269")), ("A|toolong", ("A|toolong", [], None)), ("A|", ("A|", [], None)), ("x|y|0.5", ("x|y", [0.5], None)), ("A|1,,2", ("A", [1.0, 0.0, 2.0], None))],
)
def test_parse_label(spark, raw, want):
    assert tuple(one(spark, raw, cells.parse_label)) == want


@pytest.mark.parametrize("raw,want", [(" 12 ", 12.0), ("1d", None), ("0x10", 16.0), ("Infinity", None), ("1;2", None), (".5", 0.5)])
def test_parse_number(spark, raw, want):
    assert one(spark, raw, cells.parse_number) == want


@pytest.mark.parametrize("raw,want", [("f(x;y);z", ["f(x;y)", "z"]), ("f(x;y", ["f(x", "y"]), ("a);b", ["a)", "b"]), ("A;;B", ["A", "", "B"])])
def test_split_top_level(spark, raw, want):
    assert one(spark, raw, cells.split_top_level) == want


def test_encode_decode_and_migrate(spark):
    text = "50% a;b|c\x01\x7f"
    assert one(spark, text, cells.encode_field) == "50%25 a%3Bb%7Cc%01%7F"
    assert one(spark, text, lambda c: cells.decode_field(cells.encode_field(c))) == text
    assert one(spark, "%253B+%zz", cells.decode_field) == "%3B+%zz"
    assert one(spark, "f(x;y)|0.5;p|q|r", cells.migrate_cell) == "f(x%3By)|0.5;p|q%7Cr"


def test_bio(spark):
    assert one(spark, "sp|P12345|X", bio.parse_identifier) == "P12345"
    assert one(spark, "Insulin family, Sub 1|ISS", bio.first_family) == "Insulin family|ISS"
    assert one(spark, "F:binding;P:x", bio.go_terms) == "binding;x"


PROTEINS = Columns(frozenset({"organism", "reviewed", "pfam"}), frozenset({"length"}))


@pytest.fixture(scope="module")
def proteins(spark):
    rows = [("P1", "Human", "true", "PF00069", 100.0), ("P2", "Mouse", "false", "PF00076", 250.0), ("P3", "Human", "true", None, 400.0), ("P4", "Zebrafish", "true", "PF00069", 550.0), ("P5", "Mouse", "false", "PF00076", None)]
    df = spark.createDataFrame(rows, "id string, organism string, reviewed string, pfam string, length double")
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.array(c)) for c in ("organism", "reviewed", "pfam")})


@pytest.mark.parametrize(
    "items,want",
    [
        ((), "12345"), ((Categorical("organism", ("Human",)),), "13"), ((Categorical("pfam", (missing.NA,)),), "3"), ((Categorical("pfam", (ANY,)),), "1245"),
        ((Categorical("pfam", ("PF00069",), op="NOT"),), "25"), ((Numeric("length", "gt", min=200, op="NOT"),), "1"), ((Numeric("length", "lte", max=250, presence=(missing.NA,)),), "125"),
        ((Categorical("organism", ("Human",)), Categorical("organism", ("Mouse",), op="OR"), Numeric("length", "lt", max=300, op="AND")), "12"),
        ((Group((Categorical("pfam", ("PF00069",)), Numeric("length", "gt", min=500)), op="NOT"),), "1235"), ((Categorical("gone", ("x",)),), ""), ((Categorical("gone", ("x",), op="NOT"),), ""), ((Group(),), "12345"),
    ],
)
def test_filters(proteins, items, want):
    got = proteins.filter(filters.compile_query(items, PROTEINS)).select("id").collect()
    assert sorted(r["id"][1] for r in got) == sorted(want)


def test_reliability_round_trip():
    for low, high in ((0.2, 0.9), (0.3, 1.0), (0.0, 0.7), (0.0, 1.0)):
        assert filters.reliability_range(filters.reliability_conditions("r", low, high)) == (low, high)


def refs(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<double>, label string")


def test_transfer_votes(spark):
    r = refs(spark, [("R0", [0.0, 0.0], "toxin"), ("R1", [10.0, 0.0], "enzyme"), ("R2", [20.0, 0.0], "toxin")])
    q = spark.createDataFrame([("Q0", [0.0, 0.0]), ("Q1", [19.7, 0.0])], "id string, embedding array<double>")
    got = {x["query_id"]: x for x in knn.transfer(q, r, 1, "euclidean").collect()}
    assert got["Q0"]["source_id"] == "R0" and got["Q0"]["reliability"] == 1.0
    assert got["Q1"]["source_id"] == "R2" and abs(got["Q1"]["reliability"] - 0.5 / 0.8) < 1e-9
    r = refs(spark, [(f"R{i}", [float(i)], c) for i, c in enumerate(["toxin", "enzyme", "toxin", "toxin"])])
    assert knn.transfer(spark.createDataFrame([("Q", [1.4])], "id string, embedding array<double>"), r, 3, "euclidean").first()["label"] == "toxin"
    r = refs(spark, [("a", [1.0, 0.0], "a"), ("b", [0.0, 1.0], "b")])
    assert knn.transfer(spark.createDataFrame([("Q", [1.0, 0.05])], "id string, embedding array<double>"), r).first()["label"] == "a"
    with pytest.raises(ValueError):
        knn.nearest(r, r, 0)
    with pytest.raises(ValueError):
        knn.nearest(r, r, 1, "manhattan")


def test_blocks_and_sql_agree(spark):
    import random

    random.seed(4)
    df = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(150)], "id long, embedding array<double>").repartition(3)
    key = lambda d: sorted((r["query_id"], r["rank"], r["ref_id"]) for r in d.collect())
    for metric in knn.METRICS:
        assert key(knn.nearest(df, df, 4, metric, block=17)) == key(knn.nearest_sql(df, df, 4, metric))


def test_classify(spark):
    df = spark.createDataFrame([("a1", "toxin"), ("b1", None)], "id string, col string")
    got = transfer.classify(df, transfer.Rule(), transfer.Rule()).collect()
    assert all(r["is_query"] and r["is_reference"] for r in got)
    with pytest.raises(ValueError):
        transfer.classify(df, transfer.Rule(prefixes=("zz",)), transfer.Rule(), check=True)


def test_binning(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    out, bins, strategy = binning.materialize(df, "v", binning.Settings("quantile", 10))
    assert strategy == "linear" and [r["bin_idx"] for r in out.collect()] == [0, 1, 2, 3] and sum(b.count for b in bins) == 3
    assert binning.resolve_settings({"strategy": "odd"}) == binning.Settings()
    assert binning.color_positions("quantile", [(0, 1, 2), (1, 2, 4), (2, 3, 2)], 0, 3) == [0.0, 0.5, 1.0]
    assert binning.observed_labels([(1.001, 1.001), (1.002, 1.002)], False) == ["1.001", "1.002"]


def test_views(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, -0.0, 1.0), (3, float("nan"), 1.0), (4, 5.0, 5.0)], "id long, x double, y double")
    stacks = views.duplicate_stacks(rows, also=[F.sum("id").alias("ids")])
    assert [(r["x"], r["n"], r["ids"]) for r in stacks.collect()] == [(0.0, 2, 3)]
    assert sorted((r["id"], r["n"]) for r in views.stack_members(rows, stacks).collect()) == [(1, 2), (2, 2)]
    assert rows.filter(views.in_polygon(F.col("x"), F.col("y"), ((0, 0), (1, 1)))).count() == 0
    assert one(spark, "b10", legend.natural_key) > one(spark, "B9", legend.natural_key)


def test_layout(spark):
    df = spark.createDataFrame([("1", "1.5", "a", None), ("NA", "2", "1", None)], "a string, b string, c string, d string")
    assert layout.infer_types(df, list("abcd")) == {"a": "int", "b": "float", "c": "string", "d": "string"}
    assert layout.projection_pairs(["id", "UMAP_x", "umap_y", "PC1", "PC2", "z1"]) == {"UMAP": ("UMAP_x", "umap_y"), "PC": ("PC1", "PC2")}
    assert layout.find_id_column(["name", "Protein_ID"]) == "Protein_ID"
    with pytest.raises(ValueError):
        layout.expand_requested(["lenght"], {}, ["length"])
    assert layout.expand_requested(["grp", "b"], {"grp": ("a", "b")}, ["a", "b", "length"]) == ["length", "a", "b"]


def test_union_sets(spark):
    a = spark.createDataFrame([("x", [1.0, 2.0])], "id string, embedding array<double>")
    assert joins.union_sets([a, spark.createDataFrame([("x", [1.0, 2.0 + 1e-7])], a.schema)]).count() == 1
    for bad in ([1.0, 2.5], [1.0]):
        with pytest.raises(ValueError):
            joins.union_sets([a, spark.createDataFrame([("x", bad)], a.schema)])


def test_statistics(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 50], "ab"[i % 2]) for i in range(10)] + [(10, [100.0], "alone")], "id long, v array<double>, c string")
    got = {r["category"]: r["value"] for r in stats.silhouette(df).collect()}
    assert set(got) == {None, "a", "b"} and got["a"] > 0.9
    assert stats.elbow([2, 3, 4, 5], [10.0, 1.0, 0.9, 0.8]) == (3, True)
    again = stats.davies_bouldin(df.repartition(7)).filter("category is null").first()["value"]
    assert abs(again - stats.davies_bouldin(df.repartition(1)).filter("category is null").first()["value"]) < 1e-9


def test_methods():
    assert reduce.parse_method("umap2:n_neighbors=50;min_dist=0.1") == reduce.MethodSpec("umap", 2, {"n_neighbors": 50, "min_dist": 0.1})
    specs = reduce.parse_methods("umap2:n_neighbors=50,umap2,pca2")
    assert [reduce.projection_name("T", s, specs) for s in specs] == ["T — UMAP 2 (n=50)", "T — UMAP 2", "T — PCA 2"]
    for bad in ("pca4", "pca2:odd=1", "umap2:min_dist=7"):
        with pytest.raises(ValueError):
            reduce.parse_method(bad)


def test_pca_centres(spark):
    df = spark.createDataFrame([(i, [100.0 + i, 5.0 + 2 * i, 1.0]) for i in range(9)], "id long, embedding array<double>")
    coords, share = reduce.pca(df, 2)
    assert abs(sum(r["coords"][0] for r in coords.collect())) < 1e-6 and share[0] > 0.999


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "x.bundle")
    notes = spark.createDataFrame([("1", "a"), ("2", None)], "identifier string, family string")
    meta = spark.createDataFrame([("P", 2)], "projection_name string, dimensions long")
    at = spark.createDataFrame([("P", "1", 0.5)], "projection_name string, identifier string, x double")
    bundle.write_bundle(path, notes, meta, at, None, meta)
    data = open(path, "rb").read()
    assert list(bundle.split_bundle(data)) == ["annotations", "metadata", "projections", "statistics"] and bundle.is_bundle(data)
    bundle.register(spark)
    assert {tuple(r) for r in spark.read.format("bundle").load(path).collect()} == {("1", "a"), ("2", "")}
    changed = bundle.replace_part(data, "settings", bundle.settings_table({"a": 1}))
    assert bundle.split_bundle(changed)["annotations"] == bundle.split_bundle(data)["annotations"]
    assert json.loads(pa.parquet.read_table(pa.BufferReader(bundle.split_bundle(changed)["settings"]))["settings_json"][0].as_py()) == {"a": 1}
    with pytest.raises(ValueError):
        bundle.split_bundle(b"nothing")


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">sp|P12345|A one\nMKV\nLL\n>b\n\n>c x\nACD\n>c y\nAAA\n")
    assert {tuple(r) for r in fasta.read_fasta(spark, str(p)).collect()} == {("sp|P12345|A", "MKVLL"), ("c", "ACD")}
    assert [r["id"] for r in fasta.read_ids(spark, str(p)).orderBy("pos").collect()] == ["P12345", "b", "c", "c"]
    found = fasta.validate(fasta.records(spark, str(p)))
    assert "fewer than 20 sequences" in found and "repeated ids" in found
    assert vectors.split_spec("a/b.h5:prot") == ("a/b.h5", "prot") and vectors.split_spec("C:\\x.h5") == ("C:\\x.h5", None)


def test_entries(spark, tmp_path):
    entry = {
        "primaryAccession": "P1", "entryType": "UniProtKB reviewed (Swiss-Prot)", "annotationScore": 5.0, "sequence": {"length": 7, "value": "MKV"},
        "comments": [{"commentType": "SIMILARITY", "texts": [{"value": "Belongs to the X; family. More", "evidences": [{"evidenceCode": "ECO:0000250"}]}]}],
        "uniProtKBCrossReferences": [{"database": "GO", "id": "GO:1", "properties": [{"key": "GoTerm", "value": "F:binding"}]}, {"database": "PDB", "id": "1ABC"}],
    }
    df = spark.createDataFrame([("P1", json.dumps(entry)), ("odd", None)], "id string, body string")
    got = {r["id"]: r for r in entries.parse_entries(df, "id", "body").collect()}
    assert got["P1"]["protein_families"] == "X%3B family|ISS" and got["P1"]["go_f"] == "F:binding" and got["P1"]["xref_pdb"] == "1ABC" and got["P1"]["reviewed"] == "Swiss-Prot" and got["P1"]["annotation_score"] == "5"
    assert got["odd"]["entry"] == ""
    assert list(entries.pages("u1", {"u1": ("a", '<u2>; rel="next"'), "u2": ("b", None)}.get)) == ["a", "b"]
    p = tmp_path / "cath"
    p.write_text("# head\n1.10 1abcA00 :Orthogonal Bundle\n")
    assert [tuple(r) for r in entries.read_names(spark, str(p), "cath").collect()] == [("1.10", "Orthogonal Bundle")]
    p.write_text("ID   1.1.1.1\nDE   Alcohol dehydrogenase.\n//\nID   1.1.1.2\nDE   Two\nDE   lines.\n//\n")
    assert {tuple(r) for r in entries.read_names(spark, str(p), "enzyme").collect()} == {("1.1.1.1", "Alcohol dehydrogenase"), ("1.1.1.2", "Two lines")}


@pytest.mark.parametrize("name", ["sta1", "sta3"])
def test_registered_sweeps_find_a_dozen_clusters(spark, tmp_path, name):
    from lumenvec.plans import registry

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in 20 * np.eye(12)[i % 12] + 0.1 * rng.standard_normal(12)], i % 12) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    groups = {}
    for r in registry.queries()[name](spark, str(tmp_path)).collect():
        groups.setdefault(r["id"] % 12, set()).add(r["cluster"])
    assert len(groups) == 12 and len(set.union(*groups.values())) == 12


@pytest.mark.parametrize("method", ["mds", "tsne"])
def test_rows_outside_the_landmarks_are_placed(spark, method):
    rng = np.random.default_rng(6)
    plane = rng.standard_normal((120, 2)) * 0.2 + 5 * np.eye(2)[np.arange(120) % 2]
    v = plane @ np.linalg.qr(rng.standard_normal((8, 2)))[0].T
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>").repartition(3)
    got = {r["id"]: r["coords"] for r in reduce.reduce_sample(df, method, 2, sample=40).collect()}
    assert sorted(got) == list(range(120))
    y = np.array([got[i] for i in range(120)])
    gap = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if method == "mds":
        assert np.corrcoef(gap(y).ravel(), gap(v).ravel())[0, 1] > 0.98
    else:
        far = gap(y) + 1e9 * np.eye(120)
        assert (far.argmin(1) % 2 == np.arange(120) % 2).mean() > 0.95
