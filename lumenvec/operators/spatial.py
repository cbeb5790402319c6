"""A table of points clustered along a Z-order curve, so that a window of the plane reads few files and row groups.

Every finite point has a code: its two coordinates, scaled to the table's extent and cut to ``BITS`` bits, bit by bit in turn.
Rows are range-partitioned and sorted by it (and by a hash beside it, so a place that a third of all rows share is spread over files),
and a manifest holds each file's first and last code. A window falls into some quadrants of the plane, each a stretch of codes:
the manifest chooses the files, Parquet's statistics the row groups, and the exact test follows on what is left.

Defined results: points with a null, NaN or infinite coordinate are kept in the table under no code and are in no window; windows
have inclusive bounds; a polygon of fewer than three corners holds nothing; an empty table gives empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import views

#: Bits of a coordinate; rows of a file; stretches of codes that a window falls into at most.
BITS, FILE_ROWS, STRETCHES = 20, 2_000_000, 64
CODE = "_zcode"
#: Masks that spread the bits of a number to every other place, from the widest step to the narrowest.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(c: Column) -> Column:
    for step, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
    return c


def _cell(c: Column, low: float, high: float) -> Column:
    """A coordinate as one of 2**BITS places between the extent's ends."""
    side = 1 << BITS
    return F.least(F.greatest(F.floor((c - low) / ((high - low) or 1.0) * side), F.lit(0)), F.lit(side - 1)).cast("long")


def code(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """The place on the curve of a point; null for one that isn't finite."""
    x0, y0, x1, y1 = extent
    finite = F.coalesce((F.abs(x) < math.inf) & (F.abs(y) < math.inf) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
    return F.when(finite, _spread(_cell(x, x0, x1)).bitwiseOR(F.shiftleft(_spread(_cell(y, y0, y1)), 1)))


def stretches(low: tuple[int, int], high: tuple[int, int], bits: int = BITS, most: int = STRETCHES) -> list[tuple[int, int]]:
    """Stretches of codes (first, last) that hold all cells of a window (inclusive corners), and few others.

    Quadrants that the window cuts are split, the largest first, while the stretches stay at most ``most``; neighbours are joined.
    """
    (x0, y0), (x1, y1) = low, high
    inside, cut = [], [(0, 0, bits)]  # corner and log of the side
    while cut:
        parts, whole = [], []
        for x, y, k in cut:
            half = 1 << (k - 1) if k else 0
            for cx, cy in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)) if k else ():
                if cx <= x1 and cx + half - 1 >= x0 and cy <= y1 and cy + half - 1 >= y0:
                    covered = x0 <= cx and cx + half - 1 <= x1 and y0 <= cy and cy + half - 1 <= y1
                    (whole if covered or k == 1 else parts).append((cx, cy, k - 1))
        if len(_joined(inside + whole + parts)) > most:
            break
        inside, cut = inside + whole, parts
    return _joined(inside + cut)


def _joined(quadrants: Sequence[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted((z := _interleaved(x, y), z + (1 << (2 * k)) - 1) for x, y, k in quadrants):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _interleaved(x: int, y: int) -> int:
    return sum((x >> k & 1) << (2 * k) | (y >> k & 1) << (2 * k + 1) for k in range(BITS))


def write_index(df: DataFrame, path: str, x: str = "x", y: str = "y", files: int | None = None, row_group_bytes: int = 8 << 20) -> SpatialTable:
    """``df`` clustered by place, under ``path``; its own columns stay as they are."""
    finite = df.filter((F.abs(x) < math.inf) & (F.abs(y) < math.inf) & ~F.isnan(x) & ~F.isnan(y))
    r = finite.agg(F.min(x).cast("double").alias("x0"), F.min(y).cast("double").alias("y0"), F.max(x).cast("double").alias("x1"), F.max(y).cast("double").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    extent = tuple(r[c] if r["n"] else 0.0 for c in ("x0", "y0", "x1", "y1"))
    files = files or max(1, -(-r["n"] // FILE_ROWS))
    coded = df.withColumn(CODE, code(F.col(x).cast("double"), F.col(y).cast("double"), extent))
    spread = F.xxhash64(*df.columns)
    coded.repartitionByRange(files, CODE, spread).sortWithinPartitions(CODE, spread).write.option("parquet.block.size", row_group_bytes).parquet(f"{path}/points")
    spark = df.sparkSession
    held = spark.read.parquet(f"{path}/points").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(CODE).alias("first"), F.max(CODE).alias("last"), F.count(F.lit(1)).alias("rows"))
    held.coalesce(1).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(*extent, x, y)], "x0 double, y0 double, x1 double, y1 double, x string, y string").coalesce(1).write.parquet(f"{path}/extent")
    return SpatialTable(spark, path)


class SpatialTable:
    """A written table of points, and what lies in windows of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        r = spark.read.parquet(f"{path}/extent").first()
        self.extent, self.x, self.y = (r["x0"], r["y0"], r["x1"], r["y1"]), r["x"], r["y"]

    def _cells(self, x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]]:
        a, b, c, d = self.extent
        if not (x0 <= x1 and y0 <= y1) or x1 < a or x0 > c or y1 < b or y0 > d:
            return []
        side = 1 << BITS
        at = lambda v, low, high: int(min(max(math.floor((min(max(v, low), high) - low) / ((high - low) or 1.0) * side), 0), side - 1))
        return stretches((at(x0, a, c), at(y0, b, d)), (at(x1, a, c), at(y1, b, d)))

    def files(self, found: Sequence[tuple[int, int]]) -> list[str]:
        """The files that hold a code of some stretches: only their names reach the driver."""
        near = self._any("first", "last", found)
        return [r["file"] for r in self.spark.read.parquet(f"{self.path}/manifest").filter(near).select("file").collect()]

    @staticmethod
    def _any(first: str, last: str, found: Sequence[tuple[int, int]]) -> Column:
        test = F.lit(False)
        for a, b in found:
            test = test | ((F.col(last) >= a) & (F.col(first) <= b))
        return test

    def near_box(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        """Rows of the files and stretches that a window touches, a few outside it among them."""
        found = self._cells(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))
        files = self.files(found) if found else []
        schema = self.spark.read.parquet(f"{self.path}/points").schema
        if not files:
            return self.spark.createDataFrame([], schema).drop(CODE)
        return self.spark.read.schema(schema).parquet(*files).filter(self._any(CODE, CODE, found)).drop(CODE)

    def box(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        return self.near_box(x0, y0, x1, y1).filter(views.in_box(F.col(self.x), F.col(self.y), x0, y0, x1, y1))

    def polygon(self, corners: Sequence[tuple[float, float]]) -> DataFrame:
        if len(corners) < 3:
            return self.near_box(1, 1, 0, 0).limit(0)
        xs, ys = zip(*corners, strict=True)
        return self.near_box(min(xs), min(ys), max(xs), max(ys)).filter(views.in_polygon(F.col(self.x), F.col(self.y), corners))

    def nearest(self, px: float, py: float, radius: float, id_col: str = "id") -> DataFrame:
        """The nearest point within a radius. Windows of a growing size are asked, so a point close by costs a small one."""
        size = radius / 64
        while size < radius:
            found = views.nearest_point(self.near_box(px - size, py - size, px + size, py + size), px, py, size, self.x, self.y, id_col)
            if not found.isEmpty():
                return found
            size *= 4
        return views.nearest_point(self.near_box(px - radius, py - radius, px + radius, py + radius), px, py, radius, self.x, self.y, id_col)
