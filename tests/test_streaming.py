"""Streams against batch jobs, and a stream that breaks in the middle and starts again."""

from pyspark.sql import functions as F

from lumenvec.operators import transfer
from lumenvec.streaming import online


def vectors(spark, n=120):
    rows = [(i, [float(i % 7), float(i % 11), 1.0], None if i % 4 == 0 else f"L{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, family string")


def test_a_restart_repeats_nothing(spark, tmp_path):
    df = vectors(spark)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = online.files(spark, str(tmp_path / "in"), df.schema)
    out, kept = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    made, calls = online.transferred(df, "family"), []

    def breaks(batch):
        calls.append(batch.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return made(batch)

    try:
        online.run(stream, out, kept, breaks).awaitTermination()
        raise AssertionError("the stream should have broken")
    except Exception as e:
        assert "lost" in str(e)
    done = {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "out").iterdir()}
    assert sorted(done) == ["batch=0", "batch=1"]
    online.run(stream, out, kept, breaks).awaitTermination()
    assert len(calls) == 3 + 3  # the broken batch and the two after it
    for name, names in done.items():
        assert sorted(x.name for x in (tmp_path / "out" / name).iterdir()) == names
    schema = spark.createDataFrame([], "id long, value string, confidence float, source string").schema
    got = online.written(spark, out, schema)
    want = transfer.run_transfer(df, ["family"]).filter("family__pred_value is not null").select("id", F.col("family__pred_value"), F.col("family__pred_confidence"), F.col("family__pred_source"))
    key = lambda d: sorted(tuple(r)[:4] for r in d.collect())
    assert key(got) == key(want) and got.count() == 30 and got.select("batch").distinct().count() == 5
    # nothing new, nothing done; then a file arrives
    online.run(stream, out, kept, breaks).awaitTermination()
    assert len(calls) == 6
    df.filter("id = 0").withColumn("id", F.lit(500).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    online.run(stream, out, kept, breaks).awaitTermination()
    assert len(calls) == 7 and online.written(spark, out, schema).filter("id = 500").count() == 1


def test_late_rows_and_updates(spark, tmp_path):
    """Windows are updated while they are open; a row for one that is closed is left out."""
    schema = spark.createDataFrame([], "ts timestamp, kind string").schema
    put = lambda name, rows: spark.createDataFrame([(t, k) for t, k in rows], "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: online.run(online.window_counts(online.files(spark, str(tmp_path / "in"), schema), "ts", "kind", "1 hour", "2 hours"), str(tmp_path / "out"), str(tmp_path / "kept"), mode="update").awaitTermination()
    put("a", [("2024-01-01 10:05:00", "x"), ("2024-01-01 10:15:00", "x"), ("2024-01-01 11:00:00", "y")])
    go()
    put("b", [("2024-01-01 10:59:00", "x"), ("2024-01-01 15:00:00", "x")])
    go()
    put("c", [("2024-01-01 10:01:00", "x"), ("2024-01-01 14:00:00", "y")])
    go()
    out = spark.createDataFrame([], "start timestamp, label string, n long").schema
    got = online.newest(online.written(spark, str(tmp_path / "out"), out), ["start", "label"])
    assert sorted((r["start"].hour, r["label"], r["n"]) for r in got.collect()) == [(10, "x", 3), (11, "y", 1), (14, "y", 1), (15, "x", 1)]


def test_nothing_yet(spark, tmp_path):
    schema = spark.createDataFrame([], "id long").schema
    assert online.written(spark, str(tmp_path / "none"), schema).columns == ["id", "batch"] and online.written(spark, str(tmp_path / "none"), schema).count() == 0
