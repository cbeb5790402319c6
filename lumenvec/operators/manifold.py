"""Layouts of large vector tables: UMAP, PaCMAP and LocalMAP as bulk-synchronous rounds over written tables.

What ties rows together are tables of pairs: the fuzzy graph of nearest neighbours (UMAP), or near, mid-near and further
pairs (PaCMAP, LocalMAP). Rows are dealt into blocks of bounded size. In a round each block gets its rows' places, its pairs
with the places of their other ends as they were when the round began, and a bounded sample of all places to be repelled by; it
then takes a few steps of its own, and the new places are written. No group grows with the table: a row with very many
pairs takes part in a round with a hashed draw of about ``DRAWN`` of them, weighted so that the expected force is the same.

Defined results: rows without a vector (null, or with a null or non-finite component) take no part; equal ids and equal
vectors each keep a row of their own; fewer than three rows lie at the origin; an empty table gives an empty result; extra columns
are ignored. Equal inputs give equal layouts up to the order in which a shuffle delivers rows, as every draw is a hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.operators import knn, ranks
from lumenvec.sources.shared import Tables

#: Rows of a block, pairs of a row in a round, and rows of the sample that repels.
BLOCK_ROWS, DRAWN, SAMPLE = 4096, 64, 1024
#: Rows that one task numbers, and then works on: a vector is large, and each row draws pairs.
NUMBERED_ROWS = 8192
NEAR, MID, FAR, EDGE = 0, 1, 2, 3


def numbered_vectors(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, no, v): rows with a whole vector, numbered from 0 in the order of their ids."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)))
    return ranks.numbered(rows, [F.col("id")], "no", start=0, bucket_rows=NUMBERED_ROWS).select("id", F.col("no").cast("long").alias("no"), "v")


def near_lists(rows: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(i, j, place, d): the ``k`` nearest others of each row (all, if fewer)."""
    found = knn.nearest(rows, rows, k + 1, metric, "no", "v").filter("query_id <> ref_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"), "place", F.col("distance").alias("d"))


# UMAP: the fuzzy graph


def bandwidths(near: DataFrame, n_neighbors: int) -> DataFrame:
    """(i, ds, rho, sigma): of each row's list the distance to the nearest that isn't equal, and the bandwidth with which the
    memberships exp(-(d - rho) / sigma) add up to log2 of the number of neighbours, by 64 halvings."""
    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("list"))
    lists = lists.withColumn("ds", F.transform("list", lambda x: x["d"])).withColumn("rho", F.coalesce(F.get(F.filter("ds", lambda x: x > 0), F.lit(0)), F.lit(0.0)))
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / F.size("ds")
    top = F.lit(math.inf)

    def halve(s: Column, _: Column) -> Column:
        total = F.aggregate("ds", F.lit(0.0), lambda a, x: a + F.exp(-F.greatest(F.lit(0.0), x - F.col("rho")) / s["at"]))
        over = total > math.log2(n_neighbors)
        low, high = F.when(over, s["low"]).otherwise(s["at"]), F.when(over, s["at"]).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"), F.when(high == top, s["at"] * 2).otherwise((low + high) / 2).alias("at"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(0.0).alias("low"), top.alias("high"), F.lit(1.0).alias("at")), halve)
    return lists.withColumn("sigma", F.greatest(found["at"], 1e-3 * mean, F.lit(1e-12)))


def fuzzy_graph(near: DataFrame, n_neighbors: int) -> DataFrame:
    """(i, j, w) in both directions: the union of both rows' memberships, a + b - ab."""
    lists = bandwidths(near, n_neighbors)
    one = lists.select("i", "rho", "sigma", F.explode("list").alias("x")).select("i", F.col("x.j").alias("j"), F.exp(-F.greatest(F.lit(0.0), F.col("x.d") - F.col("rho")) / F.col("sigma")).alias("w"))
    both = one.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    union = both.select("a", "b", (F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).alias("w"))
    return union.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(union.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d**(2b)) is closest to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, damp = 1.0, 1.0, 1e-3
    loss = lambda a, b: float(((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum())
    for _ in range(200):  # damped Gauss-Newton
        p = x ** (2 * b)
        f = 1 / (1 + a * p)
        jac = np.column_stack([-p * f**2, -2 * a * p * np.log(x) * f**2])
        da, db = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ (y - f))
        if a + da > 0 and b + db > 0 and loss(a + da, b + db) < loss(a, b):
            a, b, damp = a + da, b + db, damp / 3
        else:
            damp *= 4
    return a, b


# PaCMAP: three kinds of pairs


def draw(*parts: Column | str) -> Column:
    """A number below 2**60 from the digest of its parts, as any SQL can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def pacmap_near(near: DataFrame, n_neighbors: int) -> DataFrame:
    """(i, j): of each row's candidates those nearest by squared distance over both rows' scales, the mean distances to their
    fourth to sixth neighbours."""
    scale = near.groupBy("i").agg(F.avg(F.when(F.col("place").between(4, 6), F.col("d"))).alias("some"), F.avg("d").alias("all")).select("i", F.greatest(F.coalesce("some", "all"), F.lit(1e-10)).alias("scale"))
    scaled = near.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("scale").alias("other")), "j")
    key = F.round(F.col("d") * F.col("d") / (F.col("scale") * F.col("other")), 9)
    w = Window.partitionBy("i").orderBy(key, "j")
    return scaled.withColumn("p", F.row_number().over(w)).filter(F.col("p") <= n_neighbors).select("i", "j")


def pacmap_mid(rows: DataFrame, n: int, count: int, seed: int = 42, draws: int = 6) -> DataFrame:
    """(i, slot, j): for each of ``count`` slots the second nearest of ``draws`` hash-drawn others."""
    slots = rows.select(F.col("no").alias("i"), F.col("v").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot")).select("i", "u", "slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("t"))
    drawn = slots.withColumn("j", draw(F.lit(f"{seed}:mid"), "i", "slot", "t") % n).filter("j <> i")
    met = drawn.join(rows.select(F.col("no").alias("j"), "v"), "j")
    d = F.round(F.aggregate(F.zip_with("u", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x), 9)
    order = met.groupBy("i", "slot").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct(d.alias("d"), "j")))).alias("near"))
    return order.filter(F.size("near") > 0).select("i", "slot", F.element_at("near", F.least(F.size("near"), F.lit(2)))["j"].alias("j"))


def pacmap_far(rows: DataFrame, near: DataFrame, n: int, count: int, seed: int = 42) -> DataFrame:
    """(i, j): ``count`` hash-drawn others, without near pairs and repeats."""
    drawn = rows.select(F.col("no").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot")).select("i", (draw(F.lit(f"{seed}:far"), "i", "slot") % n).alias("j")).filter("j <> i")
    return drawn.distinct().join(near.select("i", "j"), ["i", "j"], "left_anti")


# The rounds


@dataclass
class Block:
    """What a block holds in a round: places, optimiser state, and pairs (``here`` is the other end's place among the block's
    rows, or -1, and ``there`` where it was)."""

    y: np.ndarray
    extra: np.ndarray
    head: np.ndarray
    here: np.ndarray
    there: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    sample: np.ndarray
    seed: int

    def ends(self, at: np.ndarray) -> np.ndarray:
        """The other ends of some pairs as they are now, as far as the block knows."""
        here = self.here[at]
        return np.where(here[:, None] >= 0, self.y[here], self.there[at])


Step = Callable[[Block, int], None]


def umap_step(a: float, b: float, epochs: int, total: int, parts: int = 12, negatives: int = 5) -> Step:
    """Edges are sampled by their weights; each draws its row near, and a few random places push it away."""

    def step(x: Block, first: int) -> None:
        rng = np.random.default_rng(x.seed)
        for epoch in range(first, first + epochs):
            rate = 1 - epoch / total
            due = np.repeat(np.arange(len(x.head)), rng.poisson(x.weight))
            rng.shuffle(due)
            for at in np.array_split(due, parts):
                if not len(at):
                    continue
                head = x.head[at]
                way = x.y[head] - x.ends(at)
                s = (way**2).sum(1)
                pull = -2 * a * b * np.power(np.maximum(s, 1e-12), b - 1) / (1 + a * s**b)
                move = 2 * np.clip(pull[:, None] * way, -4, 4)  # the pair's other direction moves its row as well
                for _ in range(negatives):
                    way = x.y[head] - x.sample[rng.integers(0, len(x.sample), len(at))]
                    s = (way**2).sum(1)
                    push = np.where(s > 0, 2 * b / ((0.001 + s) * (1 + a * s**b)), 0)
                    move += np.clip(push[:, None] * way, -4, 4)
                np.add.at(x.y, head, rate * move)

    return step


def pacmap_weights(t: int, phases: tuple[int, int, int]) -> tuple[float, float, float]:
    """Of near, mid-near and further pairs in iteration ``t``: mid-near ones fade over the first phase, and are out in the third."""
    if t < phases[0]:
        return 2.0, 1000 + (3 - 1000) * t / phases[0], 1.0
    return (3.0, 3.0, 1.0) if t < phases[0] + phases[1] else (1.0, 0.0, 1.0)


def pacmap_step(phases: tuple[int, int, int], epochs: int, local: float | None = None, rate: float = 1.0) -> Step:
    """Adam on the sum of the three kinds' losses: d / (10 + d), d / (10000 + d) and 1 / (1 + d), d the squared distance and 1.

    With ``local`` (LocalMAP), from the third phase on near pairs pull in inverse proportion to their distance, and further ones
    push only if they are nearer than ``local``, joined by draws from the sample that are.
    """

    def step(x: Block, first: int) -> None:
        rng, dims = np.random.default_rng(x.seed), x.y.shape[1]
        m, v = x.extra[:, :dims], x.extra[:, dims:]
        for t in range(first, first + epochs):
            w, last = pacmap_weights(t, phases), local is not None and t >= phases[0] + phases[1]
            way = x.y[x.head] - x.ends(np.arange(len(x.head)))
            d = (way**2).sum(1) + 1
            force = np.select([x.kind == NEAR, x.kind == MID], [w[0] * 20 / (10 + d) ** 2, w[1] * 20000 / (10000 + d) ** 2], -w[2] * 2 / (1 + d) ** 2)
            if last:
                force = np.where(x.kind == NEAR, force * local / (2 * np.sqrt(d)), np.where((x.kind == FAR) & (d > local**2), 0, force))
            slope = np.zeros_like(x.y)
            np.add.at(slope, x.head, (force * x.weight)[:, None] * way)
            if last:
                far = x.y - x.sample[rng.integers(0, len(x.sample), len(x.y))]
                d = (far**2).sum(1) + 1
                slope += np.where((d > 1) & (d < local**2), -w[2] * 2 / (1 + d) ** 2, 0)[:, None] * far
            m[:] = 0.9 * m + 0.1 * slope
            v[:] = 0.999 * v + 0.001 * slope**2
            fair = rate * math.sqrt(1 - 0.999 ** (t + 1)) / (1 - 0.9 ** (t + 1))
            x.y -= fair * m / (np.sqrt(v) + 1e-7)

    return step


_STATE = pa.schema([("no", pa.int64()), ("block", pa.int64()), ("y", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64()))])
_STATE_SQL = "no long, block long, y array<double>, extra array<double>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return np.array(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1)


def _moved(step: Step, first: int, sample: np.ndarray, seed: int):
    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _STATE.empty_table()
        rows = rows.sort_by("no")
        pairs = pairs.sort_by([("head", "ascending"), ("tail", "ascending"), ("kind", "ascending")])
        no, y, extra = rows["no"].to_numpy(), _matrix(rows["y"]), _matrix(rows["extra"])
        tail = pairs["tail"].to_numpy()
        here = np.minimum(np.searchsorted(no, tail), len(no) - 1)
        here = np.where(no[here] == tail, here, -1)
        there = _matrix(pairs["there"]) if pairs.num_rows else np.zeros((0, y.shape[1]))
        block = int(rows["block"][0].as_py())
        x = Block(y, extra, np.searchsorted(no, pairs["head"].to_numpy()), here, there, pairs["kind"].to_numpy(), pairs["weight"].to_numpy(), sample, hash((seed, first, block)) & 0x7FFFFFFF)
        step(x, first)
        lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        return pa.Table.from_arrays([rows["no"], rows["block"], lists(x.y), lists(x.extra)], schema=_STATE)

    return run


def layout(start: DataFrame, pairs: DataFrame, step: Step, total: int, epochs: int, state_width: int, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """(no, y) after ``total`` iterations, ``epochs`` of them a round.

    ``start`` is (no, y); ``pairs`` (head, tail, kind, weight) has a row for each direction in which a pair pulls.
    """
    spark = start.sparkSession
    tables = Tables(spark)
    n = start.count()
    blocks = blocks or max(4, -(-n // BLOCK_ROWS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * BLOCK_ROWS)))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks))
    many = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("degree"))
    pairs = tables.written(pairs.join(many, "head").withColumn("block", block("head")), "layout-pairs")
    state = tables.written(start.select("no", block("no").alias("block"), "y", F.array_repeat(F.lit(0.0), state_width).alias("extra")), "layout-state")
    numbers = np.random.default_rng(seed)
    for turn, first in enumerate(range(0, total, epochs)):
        some = [int(x) for x in np.unique(numbers.integers(0, n, SAMPLE))] if n > SAMPLE else list(range(n))
        sample = np.array([r["y"] for r in state.filter(F.col("no").isin(some)).select("no", "y").orderBy("no").collect()])  # at most SAMPLE places
        share = F.least(F.lit(1.0), DRAWN / F.col("degree"))
        chance = F.pmod(F.xxhash64("head", "tail", "kind", F.lit(seed * 1000 + turn)), F.lit(1 << 30)) / float(1 << 30)
        drawn = pairs.filter(chance < share).select("head", "tail", "kind", (F.col("weight") / share).alias("weight"), "block")
        met = drawn.join(state.select(F.col("no").alias("tail"), F.col("y").alias("there")), "tail")
        moved = state.repartition(parts, "block").groupBy("block").cogroup(met.repartition(parts, "block").groupBy("block")).applyInArrow(_moved(step, first, sample, seed), _STATE_SQL)
        state = tables.written(moved, "layout-state")
        tables.drop("layout-state", but_last=1)
    tables.close("layout-state")
    return state.select("no", "y")


def _start(rows: DataFrame, dims: int, size: float | None, factor: float = 1.0) -> DataFrame:
    """(no, y) on the principal axes, scaled to a largest absolute value of ``size``, or by ``factor``; a hash sets equal rows apart."""
    from lumenvec.operators.reduce import pca

    at = pca(rows.select("no", "v"), dims, "v", "no")[0]
    if size is not None:
        most = at.agg(F.max(F.array_max(F.transform("coords", lambda x: F.abs(x))))).first()[0] or 0.0
        factor = size / most if most > 0 else 1.0
    jitter = lambda i: (F.pmod(F.xxhash64("no", i), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    return at.select("no", F.transform("coords", lambda x, i: x * factor + jitter(i)).alias("y"))


def _prepared(df: DataFrame, dims: int, id_col: str, vec_col: str, tables: Tables) -> tuple[DataFrame, int, DataFrame | None]:
    rows = tables.written(numbered_vectors(df, id_col, vec_col), "layout-rows")
    n = rows.count()
    small = rows.select(F.col("id").alias(id_col), F.array_repeat(F.lit(0.0), dims).alias("coords")) if n < 3 else None
    return rows, n, small


def umap(df: DataFrame, dims: int = 2, vec_col: str = "embedding", id_col: str = "id", n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", seed: int = 42, total: int = 200, epochs: int = 10, blocks: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """(id, coords) by UMAP. ``near`` (i, j, place, d over ``numbered_vectors``) may come from an approximate search; else it is exact."""
    tables = Tables(df.sparkSession)
    rows, n, small = _prepared(df, dims, id_col, vec_col, tables)
    if small is not None:
        return small
    k = min(n_neighbors, n)
    near = tables.written(near if near is not None else near_lists(rows, max(1, k - 1), metric), "layout-near")
    graph = tables.written(fuzzy_graph(near, k), "layout-graph")
    top = graph.agg(F.max("w")).first()[0]
    pairs = graph.filter(F.col("w") >= top / total).select(F.col("i").alias("head"), F.col("j").alias("tail"), F.lit(EDGE).cast("long").alias("kind"), (F.col("w") / top).alias("weight"))
    a, b = curve(min_dist)
    placed = layout(_start(rows, dims, 10.0), pairs, umap_step(a, b, epochs, total), total, epochs, 0, seed, blocks)
    out = tables.written(rows.select("no", F.col("id").alias(id_col)).join(placed.select("no", F.col("y").alias("coords")), "no").drop("no"), "layout-coords")
    tables.close("layout-coords")
    return out


def pacmap(df: DataFrame, dims: int = 2, vec_col: str = "embedding", id_col: str = "id", n_neighbors: int = 10, mn_ratio: float = 0.5, fp_ratio: float = 2.0, seed: int = 42, phases: tuple[int, int, int] = (100, 100, 250), epochs: int = 15, blocks: int | None = None, local: float | None = None) -> DataFrame:
    """(id, coords) by PaCMAP, or by LocalMAP with a ``local`` distance."""
    tables = Tables(df.sparkSession)
    rows, n, small = _prepared(df, dims, id_col, vec_col, tables)
    if small is not None:
        return small
    k = min(n_neighbors, n - 1)
    near = tables.written(pacmap_near(near_lists(rows, min(n - 1, k + 50)), k), "layout-near")
    mid = pacmap_mid(rows, n, max(1, round(mn_ratio * k)), seed).select("i", "j")
    far = pacmap_far(rows, near, n, max(1, round(fp_ratio * k)), seed)
    pairs = None
    for kind, table in ((NEAR, near), (MID, mid), (FAR, far)):
        for head, tail in (("i", "j"), ("j", "i")):
            one = table.select(F.col(head).alias("head"), F.col(tail).alias("tail"), F.lit(kind).cast("long").alias("kind"), F.lit(1.0).alias("weight"))
            pairs = one if pairs is None else pairs.unionByName(one)
    placed = layout(_start(rows, dims, None, 0.01), pairs, pacmap_step(phases, epochs, local), sum(phases), epochs, 2 * dims, seed, blocks)
    out = tables.written(rows.select("no", F.col("id").alias(id_col)).join(placed.select("no", F.col("y").alias("coords")), "no").drop("no"), "layout-coords")
    tables.close("layout-coords")
    return out


def localmap(df: DataFrame, dims: int = 2, local: float = 10.0, **options) -> DataFrame:
    """(id, coords) by LocalMAP: PaCMAP whose last phase adjusts the graph to the distances in the layout."""
    return pacmap(df, dims, local=local, **options)
