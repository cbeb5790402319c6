"""What several operators share: the shared folder, written tables, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine gets a temporary folder of its own; on a cluster, where
    executors wouldn't see such a folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenvec-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from these files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sketch of keys (16 MB, whatever the input), and of one of its bitmaps, as Spark's aggregate makes them.
SKETCH_BITS, BITMAP_BITS = 1 << 27, 1 << 15


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` (never null) isn't in ``keys``; it loses none that is.

    Spares a join the shuffle of rows that find no partner. The sketch has a fixed size; with many more keys than bits it
    lets all rows pass, so the join itself has to follow.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(SKETCH_BITS))
    places = [F.floor(bit / BITMAP_BITS).alias("_bitmap"), (bit % BITMAP_BITS).alias("_bit")]
    sketch = keys.select(*places).groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = "(cast(conv(hex(substring(_bits, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int) & shiftleft(1, cast(_bit % 8 as int))) <> 0"
    return rows.select("*", *places).join(F.broadcast(sketch), "_bitmap").filter(found).select(*rows.columns)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, whichever file system that is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it brings."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
