"""Exact nearest neighbours and label transfer.

``nearest`` packs references and queries into blocks of bounded size and holds every query block against every reference
block (a query set against all rows, in blocks). A task keeps its queries' ``k`` nearest over all the blocks that it meets: what a
matrix product shows to be near enough is measured again in double precision, and Spark merges the lists of the few
partitions of references. Nothing grows with the number of references but the number of block pairs; no side is broadcast or
gathered whole. ``all_pairs`` gives every distance, straight from the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("cosine", "euclidean")
#: Vectors in a block: with 1,000 components of 8 bytes, 32 MB.
BLOCK = 4096
#: Pairs of vectors whose differences are held at once, and bytes of a block's vectors.
PAIRS, BLOCK_BYTES = 8192, 32 << 20
#: Vectors in a block of queries, pairs whose nearness is held at once, and the longest lists that are held over blocks.
QUERY_BLOCK, CELLS, MOST = 1024, 1 << 20, 4096
#: Partitions of queries for each core, and of references: each gives a query one list.
ASIDE, REF_PARTS = 3, 2


def block_rows(components: int) -> int:
    """Vectors in a block of bounded bytes; a block's distances to another one are bounded by ``BLOCK`` on either side."""
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, components))))


def held(b: pa.RecordBatch, row: int, name: str) -> pa.Array:
    """The list that a row of a batch holds, as an array."""
    return b.column(b.schema.get_field_index(name))[row].values


def matrix(b: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    """A row's list of lists of equal length as a matrix."""
    lists = held(b, row, name)
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of distances in double precision. A zero vector has norm 1, so its cosine distance is 1."""
    if metric == "cosine":
        qn, rn = np.linalg.norm(q, axis=1), np.linalg.norm(r, axis=1)
        qn[qn == 0], rn[rn == 0] = 1, 1
        return np.clip(1 - (q / qn[:, None]) @ (r / rn[:, None]).T, 0, 2)
    mine, other = (q * q).sum(1), (r * r).sum(1)
    # One product gives the squares: the lengths are two components more.
    square = np.column_stack([q, mine, np.ones(len(q))]) @ np.column_stack([-2 * r, np.ones(len(r)), other]).T
    np.maximum(square, 0, out=square)
    # Where nearly all digits cancel, the difference is taken pair by pair.
    close = square < ((mine + other.max(initial=0)) * 1e-6)[:, None]
    i, j = np.divmod(np.flatnonzero(close), max(1, len(r))) if close.any() else (np.zeros(0, np.int64),) * 2
    near = square[i, j] < (mine[i] + other[j]) * 1e-6
    i, j = i[near], j[near]
    for lo in range(0, len(i), PAIRS):
        at, to = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        square[at, to] = ((q[at] - r[to]) ** 2).sum(1)
    return np.sqrt(square, out=square)


def _blocks(df: DataFrame, id_col: str, vec_col: str, prefix: str, size: int, parts: int) -> DataFrame:
    """Rows packed into blocks of at most ``size``, by partition and place, dealt into ``parts`` partitions."""
    rows = df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"), F.spark_partition_id().alias(f"{prefix}_part")).withColumn("k", F.monotonically_increasing_id())
    block = F.concat_ws(":", F.col(f"{prefix}_part"), (F.col("k").bitwiseAND((1 << 33) - 1) / size).cast("long"))
    dealt = rows.select(block.alias(f"{prefix}_block"), "i", "v").repartition(parts, f"{prefix}_block")
    return dealt.groupBy(f"{prefix}_block").agg(F.collect_list("i").alias(f"{prefix}_ids"), F.collect_list("v").alias(f"{prefix}_vecs"))


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b``; a row of ``a`` meets those of a partition of ``b`` one after the other."""
    return a.hint("shuffle_replicate_nl").crossJoin(b.hint("shuffle_replicate_nl"))


def _met_blocks(queries: DataFrame, refs: DataFrame, id_col: str, vec_col: str, block: int | None) -> DataFrame:
    if block is None:
        some = refs.select(F.size(vec_col)).first()
        block = block_rows(some[0] if some else 1)
    parts = max(8, ASIDE * refs.sparkSession.sparkContext.defaultParallelism)
    q, r = _blocks(queries, id_col, vec_col, "q", min(block, QUERY_BLOCK), parts), _blocks(refs, id_col, vec_col, "r", block, REF_PARTS)
    return met(q, r).select("q_block", "q_ids", "q_vecs", "r_ids", "r_vecs")


def measured(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``q`` to the row of ``r`` beside it, without cancellation."""
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1) * np.linalg.norm(r, axis=1)
        return np.clip(1 - np.divide((q * r).sum(1), norm, out=np.zeros(norm.shape), where=norm > 0), 0, 2)
    return np.sqrt(((r - q) ** 2).sum(1))


class Nearest:
    """The ``k`` nearest of all references that a block of queries has met so far, by rounded distance, then id.

    One product of matrices, in single precision, says how near each pair is, less what its rounding can take; only pairs that can still be among a
    query's nearest, all ties included, are measured, in double precision, and kept, and lists are merged when as many new pairs have come as they hold.
    Where single precision leaves too many pairs, as around a far centre, the product is taken in double precision.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str, digits: int):
        self.q, self.k, self.metric, self.digits = q, k, metric, digits
        self.square = (q * q).sum(1)
        if metric == "cosine":
            self.left = q / np.where(self.square > 0, np.sqrt(self.square), 1)[:, None]
        else:
            self.left = np.column_stack([q, np.ones(len(q))])
        self.single = self.left.astype(np.float32)
        self.bound, self.rough = np.full(len(q), np.inf), True
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def meet(self, r: np.ndarray, ids: np.ndarray) -> None:
        square = (r * r).sum(1)
        if self.metric == "cosine":
            right = r / np.where(square > 0, np.sqrt(square), 1)[:, None]
        else:
            right = np.column_stack([r, -square / 2])
        most, step = float(square.max()), max(1, CELLS // len(r))
        scale = 1.0 if self.metric == "cosine" else most + float(self.square.max(initial=0))
        single = right.astype(np.float32) if self.rough and 1e-30 < scale < 1e37 else None
        for lo in range(0, len(self.q), step):
            s = slice(lo, lo + step)
            far = self._far(self.single[s] @ single.T, s, len(r), most, scale * (right.shape[1] + 4) * 2.0**-24) if single is not None else None
            if far is None or far.size - np.count_nonzero(far) > max(far.size // 32, 4 * self.k * len(far)):
                double = self._far(self.left[s] @ right.T, s, len(r), most, 0.0)
                if far is not None and 2 * np.count_nonzero(~double) < np.count_nonzero(~far):
                    single, self.rough = None, False
                far = double
            some = np.flatnonzero(~far.all(1))
            row, j = np.nonzero(~far[some])
            i = lo + some[row]
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                self.found.append((a, ids[b], measured(self.q[a], r[b], self.metric)))
            self.fresh += len(i)
            if self.fresh > max(len(self.q) * self.k, CELLS):
                self.merge()
        if self.fresh > len(self.q) * self.k // 2:
            self.merge()

    def _far(self, near: np.ndarray, s: slice, n: int, most: float, slack: float) -> np.ndarray:
        """Which pairs can't be among a query's nearest: ``near`` is off by ``slack`` at most."""
        bound = self.bound[s]
        if np.isinf(bound).any() and n > self.k:
            kth = np.partition(near, n - self.k, axis=1)[:, n - self.k].astype(np.float64)
            bound = np.minimum(bound, self._distance(kth - slack, s))
        least = self._least(bound + 10.0**-self.digits, s, most) - slack
        return near < np.nextafter(least.astype(near.dtype), -np.inf, dtype=near.dtype)[:, None]

    def _distance(self, near: np.ndarray, s: slice) -> np.ndarray:
        return 1 - near if self.metric == "cosine" else np.sqrt(np.maximum(self.square[s] - 2 * near, 0))

    def _least(self, bound: np.ndarray, s: slice, most: float) -> np.ndarray:
        """How near a pair must be, less what rounding can take."""
        if self.metric == "cosine":
            return np.where(bound >= 2, -np.inf, 1 - bound - 1e-12)
        return (self.square[s] - bound**2) / 2 - 1e-12 * (self.square[s] + most)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, reference, distance), the nearest of each query first."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, ids, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        key = np.round(d, self.digits)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, key, i))
        i, ids, d, key = i[order], ids[order], d[order], key[order]
        n = np.bincount(i, minlength=len(self.q))
        keep = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < self.k
        full = n >= self.k
        self.bound[full] = key[(np.cumsum(n) - n)[full] + self.k - 1]
        self.found, self.fresh = [(i[keep], ids[keep], d[keep])], 0
        return self.found[0]


def _pairs(k: int, metric: str, digits: int):
    """Of each query of a block, the nearest of all blocks of references that it meets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, asked, best = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                i, ids, d = best.merge()
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), pa.array(ids, kind), pa.array(d)], ["query_id", "ref_id", "distance"])

        for b in batches:
            kind = b.schema.field("r_ids").type.value_type
            for row in range(b.num_rows):
                block = b.column("q_block")[row].as_py()
                if block != name or k > MOST:  # lists without bound aren't held: each pair of blocks gives its own
                    yield from out()
                    # Copies: a view would hold the whole batch that the block of queries came with, as long as the block lasts.
                    ids, q = held(b, row, "q_ids"), np.array(matrix(b, row, "q_vecs"))
                    name, asked, best = block, ids.take(pa.array(np.arange(len(ids)))), Nearest(q, k, metric, digits)
                    del ids
                best.meet(matrix(b, row, "r_vecs"), held(b, row, "r_ids").to_numpy(zero_copy_only=False))
        yield from out()

    return run


def nearest(queries: DataFrame, refs: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", digits: int = 9, block: int | None = None) -> DataFrame:
    """query_id, ref_id, distance, rank: the ``k`` nearest references of each query (all, if fewer).

    Ties within ``digits`` decimals go to the smaller reference id, so ranks don't hang on the last bits of a sum.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    kinds = dict(queries.dtypes)[id_col], dict(refs.dtypes)[id_col]
    found = _met_blocks(queries, refs, id_col, vec_col, block).mapInArrow(_pairs(k, metric, digits), f"query_id {kinds[0]}, ref_id {kinds[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", digits), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _every(metric: str):
    """The distances of all pairs of two blocks, the nearest first: equal ones then stand together, which halves what a written result takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q, r, q_ids, r_ids = matrix(b, row, "q_vecs"), matrix(b, row, "r_vecs"), held(b, row, "q_ids"), held(b, row, "r_ids")
                d, step = np.empty((len(q), len(r))), max(1, CELLS // len(r))
                for lo in range(0, len(q), step):
                    d[lo : lo + step] = distances(q[lo : lo + step], r, metric)
                d = d.ravel()
                order = np.argsort(d, kind="stable")
                for lo in range(0, len(d), CELLS // 8):
                    some = order[lo : lo + CELLS // 8]
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(some // len(r))), r_ids.take(pa.array(some % len(r))), pa.array(d[some])], ["query_id", "ref_id", "distance"])

    return run


def all_pairs(queries: DataFrame, refs: DataFrame, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, ref_id, distance of every query and every reference: no order, so no pair is shuffled, sorted or held."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    kinds = dict(queries.dtypes)[id_col], dict(refs.dtypes)[id_col]
    return _met_blocks(queries, refs, id_col, vec_col, block).mapInArrow(_every(metric), f"query_id {kinds[0]}, ref_id {kinds[1]}, distance double")


def rounded(c: Column, digits: int) -> Column:
    """To some decimals in double precision, halves up: a tenth of the time that ``F.round`` takes by way of decimal numbers."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def nearest_sql(queries: DataFrame, refs: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", digits: int = 9) -> DataFrame:
    """The same in column functions alone: every pair is measured by its own expression. For small tables."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    r = refs.select(F.col(id_col).alias("ref_id"), F.col(vec_col).cast("array<double>").alias("r"))
    d = q.crossJoin(r).withColumn("distance", distance(F.col("q"), F.col("r"), metric))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", digits), "ref_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "ref_id", "distance", "rank")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    norm = lambda v: F.sqrt(dot(v, v))
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / (one(norm(a)) * one(norm(b)))))


def reliability(d: Column, metric: str) -> Column:
    """From 0 to 1: 1 - d for cosine, 0.5 / (0.5 + d) for Euclidean; 0 where the distance is not finite."""
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)) if metric == "cosine" else 0.5 / (0.5 + F.greatest(F.lit(0.0), d))
    return F.when(finite, value).otherwise(0.0)


def vote(found: DataFrame, labels: DataFrame, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """query_id, label, source_id, distance, reliability, k, metric from ``found`` (query_id, ref_id, distance) and
    ``labels`` (ref_id, label).

    A label's index is the sum of its neighbours' reliabilities over their number; the largest wins, then the nearest
    source, then the smaller label; the source is the nearest neighbour with the label, the smaller id on ties.
    """
    near = found.join(labels, "ref_id")
    k = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    each = near.withColumn("k", k).groupBy("query_id", "label", "k").agg(
        (F.sum(reliability(F.col("distance"), metric)) / F.col("k")).alias("reliability"), F.min(F.struct(F.round("distance", digits).alias("d"), "ref_id", "distance")).alias("best")
    )
    w = Window.partitionBy("query_id").orderBy(F.round("reliability", digits).desc(), "best.d", "label")
    top = each.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return top.select("query_id", "label", F.col("best.ref_id").alias("source_id"), F.col("best.distance").alias("distance"), "reliability", F.col("k").cast("int").alias("k"), F.lit(metric).alias("metric"))


def transfer(queries: DataFrame, refs: DataFrame, k: int = 1, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Labels for ``queries`` from their nearest ``refs``."""
    found = nearest(queries, refs, k, metric, id_col, vec_col)
    return vote(found, refs.select(F.col(id_col).alias("ref_id"), F.col(label_col).alias("label")), metric)


def save_lookup(refs: DataFrame, path: str, metric: str, model: str = "", id_col: str = "id", vec_col: str = "embedding", label_col: str = "label") -> None:
    """A reference set (ids, vectors, labels) as Parquet, its metric and model beside each row."""
    refs.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"), F.lit(metric).alias("metric"), F.lit(model).alias("model")).write.mode("overwrite").parquet(path)


def query_lookup(queries: DataFrame, path: str, k: int = 1, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``transfer`` from a saved reference set."""
    refs = queries.sparkSession.read.parquet(path)
    first = refs.select("metric").first()
    if first is None:
        raise ValueError("the lookup has no references")
    return transfer(queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")), refs, k, first["metric"])
