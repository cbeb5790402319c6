"""The folder that the driver and all executors share, on whichever file system it lies, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a session on one machine gets a temporary folder, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenvec-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a finished folder to its name in one step; false, and the folder goes, if that name is taken by now."""
    fs, p = file_system(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(p, target):
        fs.delete(p, True)
        return False
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, p.getName())
    if fs.exists(inside):  # another run was first: the move went into its folder
        fs.delete(inside, True)
        return False
    return True


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cluster before work that costs much a row: a file of one row group is read by one task, whatever its size."""
    return df.repartition(max(8, 3 * df.sparkSession.sparkContext.defaultParallelism))


class Tables:
    """Written tables of one job; ``close`` removes those that aren't kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back; a table of the same name before it is left until ``drop``."""
        path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, but_last: int = 0) -> None:
        """Removes the tables of a name, but for the last few."""
        held = self.paths.get(name, [])
        for path in held[: len(held) - but_last]:
            remove(self.spark, path)
        self.paths[name] = held[len(held) - but_last :] if but_last else []

    def close(self, *but: str) -> None:
        for name in [n for n in self.paths if n not in but]:
            self.drop(name)
