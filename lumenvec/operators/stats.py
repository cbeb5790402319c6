"""How well categories separate, how clusterings agree and how faithful a projection is.

Inputs are tables (id, v array<double>, ...). Metrics over all pairs work on blocks of points: each block is held
against each other block by matrix algebra, only sums, or the nearest of each row, leave a pair of blocks, and Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.functions.missing import stats_missing
from lumenvec.operators.knn import ASIDE, CELLS, PAIRS, REF_PARTS, distance, distances, held, matrix, measured, met, nearest

BLOCK = 1024
#: Pairs whose distances are held at once where they are gone over several times: 1 MB.
STEP = 1 << 17
SCHEMA = "space_kind string, space_name string, annotation string, stat_family string, label_kind string, metric string, metric_kind string, value double, category string, extra_json string"


def blocks(df: DataFrame, columns: list[str], prefix: str, size: int, parts: int) -> DataFrame:
    """Rows packed into blocks of at most ``size``, by partition and place, dealt into ``parts`` partitions."""
    k = F.monotonically_increasing_id()
    block = F.concat_ws(":", F.shiftright(k, 33), (k.bitwiseAND((1 << 33) - 1) / size).cast("long"))
    dealt = df.select(*columns, block.alias(f"{prefix}_block")).repartition(parts, f"{prefix}_block")
    return dealt.groupBy(f"{prefix}_block").agg(*[F.collect_list(c).alias(f"{prefix}_{c}") for c in columns])


def met_blocks(df: DataFrame, columns: list[str], others: DataFrame, other_columns: list[str]) -> DataFrame:
    """Blocks of points (a), each with every block of other points (b), one after the other in a task."""
    parts = max(8, ASIDE * df.sparkSession.sparkContext.defaultParallelism)
    return met(blocks(df, columns, "a", BLOCK, parts), blocks(others, other_columns, "b", 4 * BLOCK, REF_PARTS))


def _over_blocks(start: Callable, meet: Callable, out: Callable):
    """For ``met_blocks``: what ``start`` makes of a block of points meets all the other blocks of a task before ``out`` gives its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = None, None
        for b in batches:
            for row in range(b.num_rows):
                if (block := b.column("a_block")[row].as_py()) != name:
                    if name is not None:
                        yield out(at)
                    name, at = block, start(b, row)
                meet(at, b, row)
        if name is not None:
            yield out(at)

    return run


def _sums_start(b: pa.RecordBatch, row: int) -> dict:
    return {"id": pa.array(held(b, row, "a_id")), "own": pa.array(held(b, row, "a_c")), "v": matrix(b, row, "a_v"), "to": {}}


def _sums_meet(at: dict, b: pa.RecordBatch, row: int) -> None:
    """For each point of a block: the sum of Euclidean distances to each category of the other block."""
    v, ids, other, named = at["v"], np.asarray(at["id"]), np.asarray(held(b, row, "b_id")), held(b, row, "b_c").dictionary_encode()
    names, code, r = named.dictionary.to_pylist(), np.asarray(named.indices), matrix(b, row, "b_v")
    order, n_each = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(names))
    r, other = r[order], other[order]  # a category's points stand together
    first, itself = np.cumsum(n_each) - n_each, np.isin(ids, other)
    sums, step = np.empty((len(v), len(names))), max(1, CELLS // len(r))
    for lo in range(0, len(v), step):
        d = distances(v[lo : lo + step], r, "euclidean")
        for i in np.flatnonzero(itself[lo : lo + step]):
            d[i, other == ids[lo + i]] = 0
        sums[lo : lo + step] = np.add.reduceat(d, first, axis=1)
    for name, s, n in zip(names, sums.T, n_each, strict=True):
        held_sums = at["to"].setdefault(name, [np.zeros(len(v)), 0])
        held_sums[0] += s
        held_sums[1] += int(n)


def _sums_out(at: dict) -> pa.RecordBatch:
    schema = pa.schema([("id", pa.int64()), ("own", pa.string()), ("other", pa.string()), ("s", pa.float64()), ("n", pa.int64())])
    n, names = len(at["id"]), list(at["to"])
    each = pa.array(np.tile(np.arange(n), len(names)))
    other = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), n)))
    return pa.RecordBatch.from_arrays([at["id"].take(each), at["own"].take(each), other, pa.array(np.concatenate([s for s, _ in at["to"].values()])), pa.array(np.repeat([k for _, k in at["to"].values()], n), pa.int64())], schema=schema)


def silhouette_samples(df: DataFrame) -> DataFrame:
    """(id, c, s) for points (id long, v, c): (b - a) / max(a, b) with a the mean distance within the category and b that to the nearest other one; 0 in a category of one."""
    pairs = met_blocks(df, ["id", "v", "c"], df, ["id", "v", "c"])
    sums = pairs.mapInArrow(_over_blocks(_sums_start, _sums_meet, _sums_out), "id long, own string, other string, s double, n long").groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    per = sums.groupBy("id", "own").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.max(F.when(same, F.col("n"))).alias("own_n"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    s = F.when(F.col("own_n") == 1, 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("id", F.col("own").alias("c"), s.alias("s"))


def silhouette(df: DataFrame) -> DataFrame:
    """(category, value): the mean over all points (category null), and by category of two members or more."""
    s = silhouette_samples(df)
    parts = s.groupBy("c").agg(F.avg("s").alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return s.agg(F.avg("s").alias("value")).select(F.lit(None).cast("string").alias("category"), "value").unionByName(parts.select(F.col("c").alias("category"), "value"))


def scorable(df: DataFrame) -> DataFrame:
    """Points of categories with two members or more."""
    big = df.groupBy("c").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("c")
    return df.join(big, "c", "left_semi")


def _centroids(df: DataFrame) -> DataFrame:
    """(c, n, m): size and centroid by category."""
    each = df.select("c", F.posexplode("v").alias("j", "x")).groupBy("c", "j").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("m"))


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """(category, value): each category's worst (s_i + s_j) / distance of centroids, and their mean (category null).

    All zero where all spreads or all gaps vanish; a pair with one centroid doesn't count.
    """
    df = scorable(df)
    m = _centroids(df)
    spread = df.join(m, "c").groupBy("c").agg(F.avg(_gap(F.col("v"), F.col("m"))).alias("s"))
    cats = m.join(spread, "c")
    other = cats.select(F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    pairs = cats.join(other, F.col("c") != F.col("c2")).withColumn("gap", _gap(F.col("m"), F.col("m2")))  # categories by categories
    flat = pairs.agg((F.max("s") <= 1e-8).alias("no_spread"), (F.max("gap") <= 1e-8).alias("no_gap"))
    ratio = F.when(F.col("no_spread") | F.col("no_gap") | (F.col("gap") == 0), 0.0).otherwise((F.col("s") + F.col("s2")) / F.col("gap"))
    parts = pairs.crossJoin(F.broadcast(flat)).groupBy("c").agg(F.max(ratio).alias("value"))
    return parts.agg(F.avg("value").alias("value")).select(F.lit(None).cast("string").alias("category"), "value").unionByName(parts.select(F.col("c").alias("category"), "value"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """(value): between over within sum of squares, by their degrees of freedom; 1 where nothing varies within."""
    df = scorable(df)
    m = _centroids(df)
    whole = _centroids(df.select(F.lit("all").alias("c"), "v")).select(F.col("m").alias("mm"), F.col("n").alias("nn"))
    between = m.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(_gap(F.col("m"), F.col("mm")), 2)).alias("b"), F.count(F.lit(1)).alias("k"), F.max("nn").alias("n"))
    within = df.join(m, "c").agg(F.sum(F.pow(_gap(F.col("v"), F.col("m")), 2)).alias("w"))
    value = F.when(F.col("w") == 0, 1.0).otherwise(F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1)))
    return between.crossJoin(F.broadcast(within)).select(value.alias("value"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, nmi) of two labellings, by their contingency table; nothing under three pairs or two categories of ``b``."""
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("r")), t.groupBy("b").agg(F.sum("n").alias("c"))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    total = t.agg(F.sum("n").alias("t"))
    joined = t.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    cell = joined.agg(F.sum(two("n")).alias("nij"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).alias("mi"), F.max("t").alias("t"))
    part = lambda df, x, name: df.crossJoin(F.broadcast(total)).agg(F.sum(two(x)).alias(f"{name}2"), (-F.sum(F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t")))).alias(f"{name}h"), F.count(F.lit(1)).alias(f"{name}k"))
    one = cell.crossJoin(F.broadcast(part(rows, "r", "r"))).crossJoin(F.broadcast(part(cols, "c", "c"))).filter((F.col("t") >= 3) & (F.col("ck") >= 2))
    expected = F.col("r2") * F.col("c2") / two("t")
    most = (F.col("r2") + F.col("c2")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("nij") - expected) / (most - expected))
    mean_h = (F.col("rh") + F.col("ch")) / 2
    nmi = F.when((F.col("rk") == 1) & (F.col("ck") == 1), 1.0).when(mean_h == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / mean_h)
    return one.select(ari.alias("ari"), nmi.alias("nmi"))


def other_neighbours(df: DataFrame, v: str, k: int, metric: str) -> DataFrame:
    """(i, j): the ``k`` nearest other points of each point, the smaller id on ties."""
    found = nearest(df, df, k + 1, metric, "id", v).filter("query_id <> ref_id")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("r") <= k).select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"))


def _nearness(far: np.ndarray, half: float, square: np.ndarray, most: float, metric: str, unit: float) -> np.ndarray:
    """How near (in the product that tells) a pair has to be to come before a distance surely, and how near to come before it at all, less what rounding to ``unit`` can take."""
    if metric == "cosine":
        sure, maybe, slack = 1 - far + half, 1 - far - half, max(unit, 1e-12)
    else:
        sure, maybe, slack = np.where(far > half, (square - (far - half) ** 2) / 2, np.inf), (square - (far + half) ** 2) / 2, max(unit, 1e-12) * (square + most)
    return np.column_stack([sure + slack, maybe - slack])


def _nearer(v: str, metric: str, digits: int):
    """For each target of a block's points: how many of the other blocks' points come before it.

    One product of matrices says how near each pair is. A row is sorted once, in single precision, and each target's place found in it twice: with what rounding can
    take and without. Only pairs between the two, as those that are as far away as the target, are measured, rounded and put in order by their ids.
    """
    half = 0.5 * 10.0**-digits

    def start(b: pa.RecordBatch, row: int) -> dict:
        lists = held(b, row, "a_to")
        at, (to, far) = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten().flatten()
        # Copies: a view would hold the batch with which the block came.
        x = {"id": held(b, row, "a_id").take(pa.array(np.arange(len(lists)))), "v": np.array(matrix(b, row, f"a_{v}")), "at": np.array(at), "to": np.array(to), "far": np.array(far), "n": np.zeros(len(to), np.int64)}
        x["square"] = (x["v"] ** 2).sum(1)
        x["left"] = x["v"] / np.where(x["square"] > 0, np.sqrt(x["square"]), 1)[:, None] if metric == "cosine" else np.column_stack([x["v"], np.ones(len(lists))])
        return x

    def meet(x: dict, b: pa.RecordBatch, row: int) -> None:
        ids, other, r = np.asarray(x["id"]), np.asarray(held(b, row, "b_id")), matrix(b, row, f"b_{v}")
        square, most = (r * r).sum(1), float((r * r).sum(1).max())
        right = r / np.where(square > 0, np.sqrt(square), 1)[:, None] if metric == "cosine" else np.column_stack([r, -square / 2])
        at, step, itself = x["at"], max(1, STEP // len(r)), np.isin(ids, other)
        plain = metric == "cosine" or 1e-30 < most and most + float(x["square"].max(initial=0)) < 1e37
        kind, unit = (np.float32, 2.0**-22) if plain else (np.float64, 0.0)
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            near = x["left"][lo:hi] @ right.T
            for i in np.flatnonzero(itself[lo:hi]):
                near[i, other == ids[lo + i]] = -np.inf
            rough, t = near.astype(kind), slice(at[lo], at[hi])
            row = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
            bounds = _nearness(x["far"][t], half, x["square"][row], most, metric, unit).astype(kind)
            places = np.empty(bounds.shape, np.int64)
            for i, ordered in enumerate(np.sort(rough, axis=1), lo):
                mine = slice(at[i] - at[lo], at[i + 1] - at[lo])
                places[mine] = np.searchsorted(ordered, bounds[mine].ravel(), side="right").reshape(-1, 2)
            x["n"][t] += len(r) - places[:, 0]
            for k in np.flatnonzero(places[:, 1] < places[:, 0]):
                i, edge, name = row[k], x["far"][at[lo] + k], x["to"][at[lo] + k]
                j = np.flatnonzero((rough[i - lo] > bounds[k, 1]) & ~(rough[i - lo] > bounds[k, 0]))
                d = np.concatenate([measured(np.broadcast_to(x["v"][i], (len(p), r.shape[1])), r[p], metric) for p in np.array_split(j, -(-len(j) // PAIRS))]).round(digits)
                x["n"][at[lo] + k] += ((d < edge) | (d == edge) & (other[j] < name)).sum()

    def out(x: dict) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(x["id"])), np.diff(x["at"]))
        return pa.RecordBatch.from_arrays([x["id"].take(pa.array(who)), pa.array(x["to"]), pa.array(x["n"])], ["i", "j", "n"])

    return _over_blocks(start, meet, out)


def ranks_of(df: DataFrame, pairs: DataFrame, v: str, metric: str, digits: int = 9) -> DataFrame:
    """(i, j, rank) of ``pairs`` (i, j): j's place among all other points around i. Only counts leave a pair of blocks."""
    side = lambda x: df.select(F.col("id").alias(x), F.col(v).alias(f"_{x}"))
    far = F.round(distance(F.col("_i").cast("array<double>"), F.col("_j").cast("array<double>"), metric), digits)
    to = pairs.join(side("i"), "i").join(side("j"), "j").groupBy("i").agg(F.collect_list(F.struct("j", far.alias("d"))).alias("to"))
    points = df.select("id", v).join(to, F.col("id") == F.col("i"))
    counts = met_blocks(points, ["id", v, "to"], df, ["id", v]).mapInArrow(_nearer(v, metric, digits), "i long, j long, n long")
    return counts.groupBy("i", "j").agg((F.sum("n") + 1).alias("rank"))


def clamp_k(k: int, n: int) -> int:
    return max(1, min(k, (n - 1) // 2))


def knn_overlap(df: DataFrame, k: int = 10, metric: str = "cosine", high: str = "v", low: str = "xy") -> DataFrame:
    """(knn_overlap): the share of each point's ``k`` neighbours in one space that are so in the other; no row under three points. Needs no ranks."""
    n = df.count()
    if n < 3:
        return df.sparkSession.createDataFrame([], "knn_overlap double")
    k = clamp_k(k, n)
    both = other_neighbours(df, low, k, "euclidean").join(other_neighbours(df, high, k, metric), ["i", "j"])
    return both.agg((F.count(F.lit(1)) / (n * k)).alias("knn_overlap"))


def faithfulness(df: DataFrame, k: int = 10, metric: str = "cosine", high: str = "v", low: str = "xy", max_rows: int | None = None) -> DataFrame:
    """(knn_overlap, trustworthiness, continuity) of a layout (``low``) of vectors (``high``); no row under three points.

    Each point's ``k`` neighbours in one space get their ranks in the other; no pair but these leaves a block. With
    ``max_rows`` a larger table is skipped: the one row is null then.
    """
    n, schema = df.count(), "knn_overlap double, trustworthiness double, continuity double"
    if n < 3 or max_rows is not None and n > max_rows:
        return df.sparkSession.createDataFrame([(None, None, None)] if n > 2 else [], schema)
    k = clamp_k(k, n)
    in_high = ranks_of(df, other_neighbours(df, low, k, "euclidean"), high, metric)
    in_low = ranks_of(df, other_neighbours(df, high, k, metric), low, "euclidean")
    norm = 2.0 / (n * k * (2.0 * n - 3.0 * k - 1.0))
    over = 1 - F.sum(F.greatest(F.col("rank") - k, F.lit(0))) * norm
    one = in_high.agg((F.count_if(F.col("rank") <= k) / (n * k)).alias("knn_overlap"), over.alias("trustworthiness"))
    return one.crossJoin(F.broadcast(in_low.agg(over.alias("continuity"))))  # one row each


def triplet_accuracy(df: DataFrame, per_point: int = 5, metric: str = "cosine", high: str = "v", low: str = "xy") -> DataFrame:
    """(value): how often two other points, drawn by hash, are in the same order of distance in both spaces.

    ``df`` carries ``pos`` from 0 to n - 1 in the order of ids, so the draw hangs on nothing but the set of ids; nothing under three points.
    """
    n = df.count()
    if n < 3:
        return df.sparkSession.createDataFrame([], "value double")
    draw = lambda salt, m: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("t").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long"), F.lit(m)) + 1
    t = df.select("pos", F.col(high).alias("h"), F.col(low).alias("l"), F.explode(F.sequence(F.lit(1), F.lit(per_point))).alias("t")).withColumn("oj", draw("j", n - 1)).withColumn("om", draw("m", n - 2))
    t = t.withColumn("om", F.col("om") + (F.col("om") >= F.col("oj")).cast("int"))
    t = t.withColumns({"pj": (F.col("pos") + F.col("oj")) % n, "pm": (F.col("pos") + F.col("om")) % n})
    side = lambda x: df.select(F.col("pos").alias(f"p{x}"), F.col(high).alias(f"h{x}"), F.col(low).alias(f"l{x}"))
    t = t.join(side("j"), "pj").join(side("m"), "pm")
    closer = lambda a, j, m, how: F.round(distance(F.col(a), F.col(j), how), 9) < F.round(distance(F.col(a), F.col(m), how), 9)
    return t.agg(F.avg((closer("h", "hj", "hm", metric) == closer("l", "lj", "lm", "euclidean")).cast("double")).alias("value"))


def suitable_columns(df: DataFrame, id_col: str, max_card: int = 50) -> list[str]:
    """Columns to score: 2 to min(max_card, n / 2) categories, not one for each row, not numbers, no cluster columns."""
    from lumenvec.functions.cells import strip_scores

    columns = [c for c in df.columns if c != id_col and not c.startswith("cluster_")]
    value = lambda c: F.when(~stats_missing(F.col(c).cast("string")), strip_scores(F.col(c).cast("string")))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        v = value(c)
        aggs += [F.count(v).alias(f"n{i}"), F.countDistinct(v).alias(f"d{i}"), F.bool_and(v.try_cast("double").isNotNull()).alias(f"x{i}")]
    r = df.agg(*aggs).first()
    cap = min(max_card, max(2, r["_n"] // 2))
    return [c for i, c in enumerate(columns) if 2 <= r[f"d{i}"] <= cap and r[f"d{i}"] != r[f"n{i}"] and not r[f"x{i}"]]


def labels_for(df: DataFrame, selection: str, id_col: str) -> DataFrame:
    """(annotation, id, label) of the columns of ``selection`` ("auto" or a comma list) that have two categories or more."""
    from lumenvec.functions.cells import strip_scores

    columns = suitable_columns(df, id_col) if selection == "auto" else [c.strip() for c in selection.split(",") if c.strip()]
    long = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("id", columns, "annotation", "label")
    long = long.filter(~stats_missing(F.col("label"))).withColumn("label", strip_scores(F.col("label")))
    return long.join(long.groupBy("annotation").agg(F.countDistinct("label").alias("k")).filter("k > 1").select("annotation"), "annotation", "left_semi")


def chord_deviation(y: list[float]) -> list[float]:
    """How far each point of a falling curve, scaled to the unit square, lies under the chord of its ends."""
    if len(y) < 2 or y[0] == y[-1]:
        return [0.0] * len(y)
    n = len(y) - 1
    return [(1 - i / n) - (v - y[-1]) / (y[0] - y[-1]) for i, v in enumerate(y)]


def elbow(ks: list[int], inertia: list[float], least: float = 0.05) -> tuple[int, bool]:
    """The K that deviates most, and whether to trust it: four Ks or more and a deviation of at least ``least``."""
    if len(ks) < 3:
        return ks[0], False
    d = chord_deviation(inertia)
    best = max(range(len(d)), key=lambda i: (d[i], -i))
    return ks[best], len(ks) >= 4 and d[best] >= least


def stat_summary(stats: DataFrame, annotation: str, projection: str) -> DataFrame:
    """(metric, value, embedding): an annotation's aggregate scores in a projection, with the embedding's own where only one embedding has it."""
    rows = stats.filter((F.col("annotation") == annotation) & (F.col("metric_kind") != "meta") & F.col("category").isNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("stat_family") == "annotation_validity"))
    top = rows.filter("space_kind = 'embedding'").groupBy("metric").agg(F.when(F.countDistinct("space_name") == 1, F.first("value")).alias("embedding"))
    mine = rows.filter((F.col("space_kind") == "projection") & (F.col("space_name") == projection))
    return mine.join(top, "metric", "left").select("metric", "value", "embedding")


def cluster_agreement(stats: DataFrame, label_kind: str, space: str) -> DataFrame:
    """(annotation, adjusted_rand, nmi, place): agreement with a clustering, best recovered first, then by name."""
    rows = stats.filter((F.col("stat_family") == "cluster_agreement") & (F.col("label_kind") == label_kind) & (F.col("space_name") == space) & ~F.isnan("value"))
    wide = rows.groupBy("annotation").pivot("metric", ["adjusted_rand", "nmi"]).agg(F.first("value"))
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.col("adjusted_rand").desc_nulls_last(), "annotation")))


def category_scores(stats: DataFrame, annotation: str, projection: str) -> DataFrame:
    """(category, silhouette, davies_bouldin, embedding): scores by category in a projection; those without a silhouette are left out."""
    rows = stats.filter((F.col("annotation") == annotation) & (F.col("stat_family") == "annotation_validity") & (F.length("category") > 0) & F.col("value").isNotNull() & ~F.isnan("value"))
    here = (F.col("space_kind") == "projection") & (F.col("space_name") == projection)
    pick = lambda test, metric: F.max(F.when(test & (F.col("metric") == metric), F.col("value")))
    spaces = rows.filter("space_kind = 'embedding' and metric = 'silhouette'").agg(F.countDistinct("space_name").alias("k"))
    wide = rows.groupBy("category").agg(pick(here, "silhouette").alias("silhouette"), pick(here, "davies_bouldin").alias("davies_bouldin"), pick(F.col("space_kind") == "embedding", "silhouette").alias("e"))
    return wide.filter("silhouette is not null").crossJoin(F.broadcast(spaces)).select("category", "silhouette", "davies_bouldin", F.when(F.col("k") == 1, F.col("e")).alias("embedding"))


def format_value(c: Column) -> Column:
    """Two decimals; whole numbers from 100 on; no sign on zero; a dash for what is not finite."""
    text = F.when(F.abs(F.round(c, 2)) >= 100, F.format_string("%.0f", c)).otherwise(F.format_string("%.2f", c))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "—").otherwise(F.when(F.round(c, 2) == 0, F.replace(text, F.lit("-"), F.lit(""))).otherwise(text))
