"""Bundles read by ranges: parts found from footers, partitions bounded by row groups, any file system."""

import io
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenvec.sources import bundle


def parquet(table, **options):
    out = io.BytesIO()
    pq.write_table(table, out, **options)
    return out.getvalue()


def some_table(rows, seed=0):
    rng = random.Random(seed)
    return pa.table({"identifier": [f"p{i}" for i in range(rows)], "x": pa.array([rng.random() for _ in range(rows)], pa.float64()), "text": ["".join(rng.choices("abcdefgh ", k=rng.randrange(60))) for _ in range(rows)]})


def reads(data):
    """A counting reader of bytes."""
    taken = []

    def read(start, n):
        taken.append(n)
        return data[start : start + n]

    return read, taken


OPTIONS = [{}, {"write_page_index": True}, {"row_group_size": 100}, {"write_page_index": True, "row_group_size": 50, "compression": "zstd"}, {"use_dictionary": False, "write_statistics": False}]


@pytest.mark.parametrize("present", [(), ("settings",), ("settings", "statistics"), ("statistics",)])
@pytest.mark.parametrize("options", range(len(OPTIONS)))
def test_parts_are_found(present, options):
    parts = {n: parquet(some_table(k * 700, k), **OPTIONS[options]) for k, n in enumerate(bundle.PARTS) if n in bundle.PARTS[:3] or n in present}
    data = bundle.join_bundle(parts)
    read, taken = reads(data)
    found = bundle.locate(read, len(data))
    assert {n: data[a:b] for n, (a, b) in found.items()} == parts == bundle.split_bundle(data)
    assert sum(taken) < sum(bundle.footer(read, b)[1] for _, b in found.values()) * 2 + len(parts) * (bundle.STEP + 200)


def test_a_large_bundle_takes_few_bytes():
    noise = pa.table({"b": [random.Random(k).randbytes(1 << 20) for k in range(12)]})
    data = bundle.join_bundle({n: parquet(noise, compression="none", use_dictionary=False, write_statistics=False) for n in bundle.PARTS[:3]})
    read, taken = reads(data)
    assert len(bundle.locate(read, len(data))) == 3 and sum(taken) < 20_000 < len(data) / 1000


def test_broken_bundles():
    part = parquet(some_table(30))
    good = [part] * 3
    for bad in (b"nothing", b"", part, bundle.DELIMITER.join(good[:2]), bundle.DELIMITER.join(good * 2), bundle.DELIMITER.join([*good, b""]), bundle.DELIMITER.join([part, b"", part, part]), bundle.DELIMITER.join([b"junk", *good[:2]]), bundle.DELIMITER.join(good)[:-5]):
        with pytest.raises(ValueError):
            bundle.locate(reads(bad)[0], len(bad))


@pytest.fixture
def path(spark, tmp_path):
    n = 4000
    rng = np.random.default_rng(1)
    rows = pa.table({"identifier": [f"p{i}" for i in range(n)], "x": np.arange(n) * 1.0, "y": rng.random(n), "wide": [rng.bytes(300).hex() for _ in range(n)]})
    small = parquet(some_table(5))
    (tmp_path / "a.bundle").write_bytes(bundle.join_bundle({"annotations": small, "metadata": small, "projections": parquet(rows, row_group_size=500)}))
    return str(tmp_path / "a.bundle")


def test_a_partition_reads_its_own_columns(spark, path):
    """Bytes that a partition reads are bounded by its row group's columns and the footer."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import DoubleType, StructField, StructType

    reader = bundle.BundleReader({"path": path, "part": "projections"}, StructType([StructField("x", DoubleType())]))
    assert len(reader.partitions()) == 8
    start, end, meta = bundle._part(path, "projections")
    with bundle._opened(path) as file:
        window = bundle.Window(file, start, end)
        (batch,) = pq.ParquetFile(pa.PythonFile(window), pre_buffer=False).iter_batches(row_groups=[3], columns=["x"])
    group = meta.row_group(3)
    chunk = next(c.total_compressed_size for c in map(group.column, range(4)) if c.path_in_schema == "x")
    assert batch["x"][0].as_py() == 1500 and window.taken <= chunk + (1 << 16) + 8 < group.total_byte_size
    for filters, left in (([GreaterThan(("x",), 3000.0)], 2), ([EqualTo(("x",), 700.0)], 1), ([In(("x",), (1.0, 3999.0))], 2), ([GreaterThan(("x",), 1e9)], 0), ([EqualTo(("identifier",), "p0")], None), ([GreaterThan(("x",), "a")], 8)):
        assert list(reader.pushFilters(filters)) == filters
        assert left is None or len(reader.partitions()) == left


def test_read_part(spark, path):
    df = bundle.read_part(spark, path, "projections", ["y", "identifier"])
    assert df.columns == ["y", "identifier"] and df.count() == 4000 and df.rdd.getNumPartitions() == 8
    some = bundle.read_part(spark, path, "projections").filter("x > 3499 and identifier <> 'p3700'")
    assert some.count() == 499 and some.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="has no part"):
        bundle.read_part(spark, path, "statistics").collect()


def test_a_file_system_that_only_spark_opens(spark, path, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bundles.link./in", f"file://{tmp_path}")
    far = "viewfs://bundles/in/a.bundle"
    assert not bundle.ranged(far) and bundle.ranged(path) and bundle.ranged(f"file://{path}")
    df = bundle.read_part(spark, far, "projections", ["x"])
    assert df.columns == ["x"] and df.agg({"x": "sum"}).first()[0] == sum(range(4000))
    assert [p.rsplit("/", 1)[1] for p in bundle.extract(spark, far, "viewfs://bundles/in/parts")] == ["annotations.parquet", "metadata.parquet", "projections.parquet"]
    assert spark.read.parquet("viewfs://bundles/in/parts/projections.parquet").count() == 4000
    assert {p.name.removesuffix(".parquet"): p.read_bytes() for p in (tmp_path / "parts").glob("*.parquet")} == bundle.split_bundle((tmp_path / "a.bundle").read_bytes())
    settings = bundle.settings_table({"a": 1})
    bundle.replace_in(spark, far, "viewfs://bundles/in/b.bundle", "settings", settings)
    bundle.replace_in(spark, "viewfs://bundles/in/b.bundle", "viewfs://bundles/in/c.bundle", "settings", None)
    old, new = (tmp_path / "a.bundle").read_bytes(), (tmp_path / "b.bundle").read_bytes()
    assert (tmp_path / "c.bundle").read_bytes() == old and new.startswith(old) and pq.read_table(pa.BufferReader(bundle.split_bundle(new)["settings"])).equals(settings)
    with pytest.raises(ValueError):
        bundle.replace_in(spark, far, far, "metadata", None)
