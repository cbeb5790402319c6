"""Filters, label transfer and window counts over streams: what a batch job gives, batch by batch and once each.

A stream's results go to ``out/batch=N``, N the micro-batch's number. A retried or repeated micro-batch has the number it had and
replaces its own folder, and the checkpoint tells which numbers are done, so a restart repeats nothing and loses nothing. Folders are on
any file system that Spark knows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lumenvec.functions.missing import transfer_missing
from lumenvec.operators import knn
from lumenvec.operators.filters import Columns, Item, compile_query
from lumenvec.sources.shared import exists

BATCH = "batch"


def files(spark: SparkSession, path: str, schema: StructType, a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, at most ``a_batch`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append", forever: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Starts a query that writes what ``make`` makes of each micro-batch. Unless ``forever``, it takes what is there now and ends."""

    def put(df: DataFrame, number: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if forever else writer.trigger(availableNow=True)).start()


def written(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All results so far, with the number of their micro-batch; no rows before the first one."""
    whole = StructType([*schema.fields, StructField(BATCH, LongType())])
    return spark.read.schema(whole).parquet(out) if exists(spark, out) else spark.createDataFrame([], whole)


def matching(stream: DataFrame, items: Sequence[Item], columns: Columns) -> DataFrame:
    """Rows of a stream that a filter query lets through; a filter has no state."""
    return stream.filter(compile_query(items, columns))


def transferred(references: DataFrame, column: str, k: int = 1, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """For ``run``: of a micro-batch's rows those without a value of ``column`` get one from the nearest ``references`` that have one.

    (id, value, confidence, source). References are a table that doesn't stream: a batch reads them as they are when it runs.
    """
    value = F.col(column).cast("string")
    side = lambda df, test: df.filter(F.col(vec_col).isNotNull() & test).select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), value.alias("label"))

    def make(batch: DataFrame) -> DataFrame:
        found = knn.transfer(side(batch, transfer_missing(value)), side(references, ~transfer_missing(value)), k, metric)
        return found.select(F.col("query_id").alias("id"), F.col("label").alias("value"), F.col("reliability").cast("float").alias("confidence"), F.col("source_id").cast("string").alias("source"))

    return make


def window_counts(stream: DataFrame, time: str, label: str, length: str, late: str) -> DataFrame:
    """(start, label, n) by windows of a time column; state of windows that ended ``late`` before the newest row is dropped, and rows that
    come after that with it. Run it in update mode, and read it by ``newest``."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "label", "n")


def newest(results: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Of results in update mode the last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    return results.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", BATCH)
