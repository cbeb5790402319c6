"""Neighbours kept and ranks of neighbours: what they cost, ties, and vectors that single precision can't tell apart."""

import numpy as np
import pytest

from lumenvec.operators import knn, stats
from lumenvec.plans import registry
from tests.test_distance_ranks import frame

SF = "/root/testdata/sf0.001"


def plain(v, xy, k):
    at = [np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9) for x in (v, xy)]
    n, ranks = len(v), []
    for d in at:
        np.fill_diagonal(d, np.inf)
        order = np.lexsort((np.broadcast_to(np.arange(n), d.shape), d), axis=1)
        ranks.append(np.argsort(order, axis=1) + 1)
    h, low = ranks
    over = lambda a, b: 1 - np.maximum(a - k, 0)[b <= k].sum() * 2 / (n * k * (2 * n - 3 * k - 1))
    return ((h <= k) & (low <= k)).sum() / (n * k), over(h, low), over(low, h)


@pytest.mark.parametrize("kind", ["random", "ties", "far"])
def test_faithfulness_and_overlap_against_all_pairs(spark, kind):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 3, (150, 4)).astype(float) if kind == "ties" else rng.normal(size=(150, 4))
    xy = v[:, :2] + rng.normal(size=(150, 2)) * (kind != "ties")
    if kind == "far":  # differences lie under the digits of single precision
        v, xy = v * 1e-4 + 100, xy * 1e-4 + 100
    df, want = frame(spark, v, xy), plain(v, xy, 5)
    assert np.allclose(stats.faithfulness(df, 5, "euclidean").first(), want)
    assert np.isclose(stats.knn_overlap(df, 5, "euclidean").first()[0], want[0])
    assert stats.knn_overlap(df.limit(2)).count() == 0


def test_overlap_needs_no_ranks(spark):
    """Two searches for neighbours; ranks would be two more passes over all pairs."""
    plan = registry.queries()["sta8"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("CartesianProduct") == 2


def test_nearest_in_single_precision_is_exact():
    rng = np.random.default_rng(9)
    for r in (rng.normal(size=(5000, 8)), rng.normal(size=(5000, 8)) * 1e-4 + 100, rng.normal(size=(5000, 8)) * 1e30):
        q, best = r[:50] * 1.0001, None
        best = knn.Nearest(q, 5, "euclidean", 9)
        for ids in np.array_split(np.arange(5000), 3):
            best.meet(r[ids], ids)
        d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2)).round(9)
        assert np.array_equal(best.merge()[1].reshape(50, 5), np.array([np.lexsort((np.arange(5000), x))[:5] for x in d]))
    best = knn.Nearest(rng.normal(size=(50, 8)), 5, "euclidean", 9)
    assert best.single.dtype == np.float32


def test_a_category_is_summed_once(monkeypatch):
    """Distances stand by category and are added up there: no matrix of points by categories is multiplied with them."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    v, r = rng.normal(size=(7, 3)), rng.normal(size=(9, 3))
    c = [str(i % 4) for i in range(9)]
    whole = lambda x, t: pa.array([x], pa.list_(t))
    b = pa.record_batch([whole(list(range(9)), pa.int64()), whole(c, pa.string()), whole(r.tolist(), pa.list_(pa.float64()))], ["b_id", "b_c", "b_v"])
    at = {"id": pa.array(range(5, 12)), "v": v, "to": {}}
    stats._sums_meet(at, b, 0)
    d = knn.distances(v, r, "euclidean")
    d[np.arange(5, 12)[:, None] == np.arange(9)] = 0
    for name in "0123":
        some = [x == name for x in c]
        np.testing.assert_allclose(at["to"][name][0], d[:, some].sum(1))
        assert at["to"][name][1] == sum(some)


def test_all_pairs_leave_in_order_of_distance():
    """Equal distances stand together, so that a written result of all pairs takes half; each pair is there once."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    q, r = rng.integers(0, 3, (30, 4)).astype(float), rng.integers(0, 3, (40, 4)).astype(float)
    whole = lambda x, t: pa.array([x], t)
    ids, vecs = pa.list_(pa.int64()), pa.list_(pa.list_(pa.float64()))
    b = pa.record_batch([whole(list(range(30)), ids), whole(q.tolist(), vecs), whole(list(range(100, 140)), ids), whole(r.tolist(), vecs)], ["q_ids", "q_vecs", "r_ids", "r_vecs"])
    out = pa.Table.from_batches(knn._every("euclidean")(iter([b])))
    i, j, d = (out[c].to_numpy() for c in ("query_id", "ref_id", "distance"))
    assert (np.diff(d) >= 0).all() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(d) == 1200
    np.testing.assert_allclose(d, np.sqrt(((q[i] - r[j - 100]) ** 2).sum(1)), atol=1e-12)
