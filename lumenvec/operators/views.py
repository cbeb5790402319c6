"""Views of rows: isolation, visibility, opacity, id search, duplicate stacks, extents and selections in the plane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.operators import ranks

PADDING = 0.05


def isolate(df: DataFrame, layers: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Rows whose id is in every layer."""
    for layer in layers:
        df = df.join(layer.select(id_col).distinct(), id_col, "left_semi")
    return df


def hidden(labels: Column, values: Sequence[str]) -> Column:
    """Whether every label of a row is hidden; a row without labels is."""
    return F.coalesce(F.forall(labels, lambda v: v.isin(*values)), F.lit(True))


def opacity(is_hidden: Column, selected: Column, highlighted: Column, any_selected: bool, levels: tuple[float, float, float] = (1.0, 0.2, 0.8)) -> Column:
    """0 where hidden, else that of selected or highlighted rows, faded ones while a selection exists, or base."""
    strong, faded, plain = levels
    return F.when(is_hidden, 0.0).when(selected | highlighted, strong).otherwise(faded if any_selected else plain)


def search_ids(df: DataFrame, text: str, selected: Column, id_col: str = "id", position: str = "pos", limit: int = 50, selected_limit: int = 10, focused: bool = True) -> DataFrame:
    """(id, is_selected): ids that start with ``text`` in either case, the first in order; selected ones have a limit of their own."""
    q = text.strip().lower()
    hits = df.filter(F.startswith(F.lower(F.col(id_col)), F.lit(q)) if q else F.lit(focused)).select(F.col(id_col).alias("id"), F.col(position).alias("pos"), selected.alias("is_selected"))
    r = F.row_number().over(Window.partitionBy("is_selected").orderBy("pos"))
    return hits.withColumn("r", r).filter(F.when(F.col("is_selected"), F.col("r") <= selected_limit).otherwise(F.col("r") <= limit)).select("id", "is_selected")


def canonical_ids(asked: DataFrame, known: DataFrame, last: bool = False) -> DataFrame:
    """(asked, id): the known id that is equal, or else equal but for case: the first in order (``last``: the last); null where there is none.

    ``asked`` (asked), ``known`` (id, pos).
    """
    folded = known.groupBy(F.lower("id").alias("low")).agg((F.max_by if last else F.min_by)("id", "pos").alias("folded"))
    exact = known.select(F.col("id").alias("exact")).distinct()
    both = asked.join(exact, F.col("asked") == F.col("exact"), "left").join(folded, F.lower("asked") == F.col("low"), "left")
    return both.select("asked", F.coalesce("exact", "folded").alias("id"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _on_plane(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with both coordinates finite, -0 as 0."""
    return df.filter(_finite(F.col(x)) & _finite(F.col(y))).withColumns({x: F.col(x) + F.lit(0.0), y: F.col(y) + F.lit(0.0)})


def duplicate_stacks(df: DataFrame, x: str = "x", y: str = "y", also: Sequence[Column] = ()) -> DataFrame:
    """(x, y, n, ...): places that two rows or more share exactly, with further aggregates; rows off the plane don't count, and 0 is -0. One partial aggregate; members stay rows."""
    return _on_plane(df, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"), *also).filter("n > 1")


def stack_members(df: DataFrame, stacks: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``df`` in ``stacks``, each with its stack's n; a place that very many rows share stays that many rows."""
    return _on_plane(df, x, y).join(stacks.select(x, y, "n"), [x, y])


def padded_extent(df: DataFrame, x: str = "x", y: str = "y", padding: float = PADDING) -> DataFrame:
    e = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    px, py = F.abs(F.col("x1") - F.col("x0")) * padding, F.abs(F.col("y1") - F.col("y0")) * padding
    return e.select((F.col("x0") - px).alias("x_min"), (F.col("x1") + px).alias("x_max"), (F.col("y0") - py).alias("y_min"), (F.col("y1") + py).alias("y_max"))


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule within the polygon's box; under three vertices hold nothing."""
    if len(vertices) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi != yj:
            edge = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
            crossings = crossings + edge.cast("int")
    xs, ys = zip(*vertices, strict=True)
    return in_box(x, y, min(xs), min(ys), max(xs), max(ys)) & (crossings % 2 == 1)


def nearest_point(df: DataFrame, px: float, py: float, radius: float, x: str = "x", y: str = "y", id_col: str = "id") -> DataFrame:
    """(id, d2): the row nearest to a place within a radius, the smaller id on ties."""
    d2 = (F.col(x) - px) * (F.col(x) - px) + (F.col(y) - py) * (F.col(y) - py)
    near = df.filter(in_box(F.col(x), F.col(y), px - radius, py - radius, px + radius, py + radius)).select(F.col(id_col).alias("id"), d2.alias("d2"))
    return near.filter(F.col("d2") <= radius * radius).orderBy("d2", "id").limit(1)


def scale(c: Column, domain: tuple[float, float], extent: tuple[float, float]) -> Column:
    return extent[0] + (c - domain[0]) / (domain[1] - domain[0]) * (extent[1] - extent[0])


def viewport(k: float, tx: float, ty: float, width: float, height: float, margin: tuple[float, float, float, float], padding: float = 0.0) -> tuple[float, float, float, float]:
    """x0, y0, x1, y1 of the visible part in base pixels under a zoom by ``k`` and a shift; margins are top, right, bottom, left."""
    top, right, bottom, left = margin
    xs = sorted(((left - padding - tx) / k, (width - right + padding - tx) / k))
    ys = sorted(((top - padding - ty) / k, (height - bottom + padding - ty) / k))
    return xs[0], ys[0], xs[1], ys[1]


def plane(df: DataFrame, which: str = "xy") -> DataFrame:
    """Three coordinates seen along an axis: xz shows z upwards, yz shows y and z."""
    x, y = {"xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}[which]
    return df.withColumns({"px": F.col(x), "py": F.coalesce(F.col(y), F.lit(0.0))})


def badges(stacks: DataFrame, window: tuple[float, float, float, float], cap: int = 800) -> DataFrame:
    """The fullest stacks in a window, at most ``cap``; ties by place."""
    return stacks.filter(in_box(F.col("x"), F.col("y"), *window)).orderBy(F.desc("n"), "x", "y").limit(cap)


def depth_order(df: DataFrame, depth: str, idx: str, bucket_rows: int = ranks.BUCKET_ROWS) -> DataFrame:
    """``df`` with the order in which to draw: farthest first, then by index."""
    return ranks.numbered(df, [-F.col(depth), F.col(idx)], "draw", bucket_rows=bucket_rows)
