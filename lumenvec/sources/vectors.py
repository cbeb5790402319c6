"""Cleaning of vector sets on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_spec(spec: str) -> tuple[str, str | None]:
    """``file.ext:name`` at its last colon; a drive letter or a path behind the colon is no name."""
    path, mark, name = spec.rpartition(":")
    if mark and name and len(path) > 1 and not name.startswith(("/", "\\")) and "." in path.replace("\\", "/").rsplit("/", 1)[-1]:
        return path, name
    return spec, None


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, position: str, dim: int | None = None) -> DataFrame:
    """Single-precision vectors of one length (``dim``, or that of the first row), the first of each id, none with a NaN."""
    if dim is None:
        first = df.orderBy(position).select(F.size(vec_col)).first()
        dim = first[0] if first else 0
    good = df.withColumn(vec_col, F.col(vec_col).cast("array<float>")).filter(F.size(vec_col) == dim)
    one = good.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(position))).filter("_r = 1").drop("_r")
    return one.filter(~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x)))
