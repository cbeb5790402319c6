"""Nearest lists that are kept over blocks, and all pairs without an order."""

import weakref

import numpy as np
import pyarrow as pa
import pytest

from lumenvec.operators import knn
from lumenvec.plans import registry

SF = "/root/testdata/sf0.001"


def frame(spark, v, ids=None, parts=3):
    rows = [(i, list(map(float, x))) for i, x in zip(range(len(v)) if ids is None else ids, v, strict=True)]
    return spark.createDataFrame(rows, f"id {'string' if ids and isinstance(ids[0], str) else 'long'}, embedding array<double>").repartition(parts)


def plain(q, r, k, metric):
    d = knn.distances(q, r, metric).round(9)
    return np.array([np.lexsort((np.arange(len(r)), x))[:k] for x in d]), d


@pytest.mark.parametrize("metric", knn.METRICS)
def test_lists_over_blocks_hold_all_ties(metric):
    rng = np.random.default_rng(4)
    r = np.vstack([rng.normal(size=(400, 6)), np.repeat(rng.normal(size=(3, 6)), 60, 0), np.zeros((20, 6))])
    r = np.ascontiguousarray(r[rng.permutation(len(r))])
    q = np.vstack([r[:90], rng.normal(size=(10, 6)), np.zeros((1, 6))])
    for k in (1, 7, 25):
        best = knn.Nearest(q, k, metric, 9)
        for ids in np.array_split(rng.permutation(len(r)), 9):
            best.meet(r[ids], ids)
        i, ids, d = best.merge()
        want, every = plain(q, r, k, metric)
        assert np.array_equal(ids.reshape(len(q), k), want) and np.array_equal(i, np.repeat(np.arange(len(q)), k))
        np.testing.assert_allclose(d.round(9), np.take_along_axis(every, want, 1).ravel(), atol=2e-9)


def test_more_copies_than_a_pool(spark):
    """Forty equal references in one block: the smallest ids, as in SQL, not any of them."""
    ids = [f"r{(7 * i) % 40:02d}" for i in range(40)]
    got = knn.nearest(frame(spark, [[1.0, 0.5]], ["q"]), frame(spark, [[1.0, 0.5]] * 40, ids, 1), 2).collect()
    assert sorted((r["rank"], r["ref_id"]) for r in got) == [(1, "r00"), (2, "r01")]


def test_a_block_of_queries_leaves_k_rows_a_query(spark):
    v = np.random.default_rng(5).normal(size=(300, 4))
    met = knn._met_blocks(frame(spark, v), frame(spark, v), "id", "embedding", 10)
    rows = met.mapInArrow(knn._pairs(3, "cosine", 9), "query_id long, ref_id long, distance double").groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert rows <= 3 * knn.REF_PARTS


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_a_task_lets_go_of_batches_it_has_passed(kind):
    """A block of queries meets references in many Arrow batches: only the newest is held, not the one in which the block began."""
    rng = np.random.default_rng(6)
    q, r, held, most = rng.normal(size=(5, 4)), rng.normal(size=(6, 7, 4)), [], []

    def batches():
        for n, block in enumerate(r):
            columns = [["a"], [list(range(5))], [q.tolist()], [list(range(7 * n, 7 * n + 7))], [block.tolist()]]
            types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(kind)), pa.list_(pa.int64()), pa.list_(pa.list_(kind))]
            b = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["q_block", "q_ids", "q_vecs", "r_ids", "r_vecs"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            whole = np.frombuffer(sink.getvalue(), np.uint8).copy()  # all columns of a batch lie in one buffer, as those that Spark sends
            held.append(weakref.ref(whole))
            b = pa.ipc.open_stream(pa.BufferReader(pa.py_buffer(whole))).read_next_batch()
            del whole
            yield b
            del b
            most.append(sum(x() is not None for x in held))

    got = [row for b in knn._pairs(2, "cosine", 9)(batches()) for row in b.to_pylist()]
    want, _ = plain(q.astype(kind.to_pandas_dtype()), r.reshape(-1, 4).astype(kind.to_pandas_dtype()), 2, "cosine")
    assert [x["ref_id"] for x in got] == want.ravel().tolist() and [x["query_id"] for x in got] == np.repeat(np.arange(5), 2).tolist()
    assert max(most) == 1


def test_few_references(spark):
    got = knn.nearest(frame(spark, np.eye(3)), frame(spark, np.eye(3)[:2]), 5, "euclidean")
    assert got.count() == 6 and knn.nearest(frame(spark, np.eye(3)), frame(spark, np.eye(3)).filter("id < 0"), 5).count() == 0


@pytest.mark.parametrize("name", ["dr6", "knn2"])
def test_all_pairs_need_no_order(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" in plan
