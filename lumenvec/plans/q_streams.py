"""Streams over tables that Spark has dealt into files: their union equals the batch query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.filters import Columns, Numeric
from lumenvec.plans.q_knn import VOTE1, table
from lumenvec.plans.registry import query
from lumenvec.sources.shared import fresh_path
from lumenvec.streaming import online


def dealt(spark: SparkSession, df: DataFrame, into: int = 3) -> DataFrame:
    """A stream of a table's rows, a file a micro-batch."""
    path = fresh_path(spark, "stream")
    df.repartition(into).write.parquet(path)
    return online.files(spark, path, df.schema)


def finished(spark: SparkSession, stream: DataFrame, schema, make=lambda df: df, mode: str = "append") -> DataFrame:
    out = fresh_path(spark, "stream-out")
    online.run(stream, out, fresh_path(spark, "stream-checkpoint"), make, mode).awaitTermination()
    return online.written(spark, out, schema)


@query("stream_filter", "SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 60 AND NOT (event_id % 4 = 1)")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", (F.col("event_id") % 4).alias("part"))
    items = (Numeric("value", "between", 20, 60), Numeric("part", "between", 1, 1, op="NOT"))
    stream = online.matching(dealt(spark, e), items, Columns(frozenset(), frozenset({"value", "part"})))
    return finished(spark, stream, e.schema).select("event_id", "value")


@query("stream_transfer", f"{VOTE1} SELECT query_id AS id, 'L' || label AS value, round(greatest(0.0::DOUBLE, 1 - distance), 4) AS confidence, ref_id::VARCHAR AS source FROM n")
def stream_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a label arrive in micro-batches, and take one from the nearest row of the table that has one."""
    rows = table(spark, sf_dir).select("id", "embedding", "family")
    schema = spark.createDataFrame([], "id long, value string, confidence float, source string").schema
    found = finished(spark, dealt(spark, rows.filter("id % 5 = 0")), schema, online.transferred(rows, "family"))
    return found.select("id", "value", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "source")


@query("stream_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type; no row is so late that its window is gone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = online.window_counts(dealt(spark, e), "ts", "event_type", "1 hour", "3650 days")
    schema = spark.createDataFrame([], "start timestamp, label string, n long").schema
    return online.newest(finished(spark, stream, schema, mode="update"), ["start", "label"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "label", "n")
