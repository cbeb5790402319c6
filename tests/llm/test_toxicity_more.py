"""Toxicity: the bound of the fit, odd tables, and how good the scores are on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import toxicity
from lumenvec.llm.common import read

SF = "/root/testdata/sf0.1"


def test_held_out_scores(spark):
    """The area under the curve, and the gap between scores and rates of toxic rows."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    order = s[y == 1][:, None] - s[y == 0][None, :]
    assert y.sum() > 50 and ((order > 0) + 0.5 * (order == 0)).mean() > 0.93
    bins = np.clip((s * 10).astype(int), 0, 9)
    error = sum((bins == b).mean() * abs(s[bins == b].mean() - y[bins == b].mean()) for b in np.unique(bins))
    assert error < 0.03


def test_an_id_that_many_rows_share_is_one_row_of_the_fit(spark, monkeypatch):
    seen = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda rows, *n: seen.append(rows.count()) or learn(rows, *n))
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "you stupid fool" if i % 2 else "a fine day by the sea") for i in ids] + [(ids[0], f"again {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=200)
    assert seen == [200] and model.lexicon is not None


@pytest.mark.parametrize("rows", [[], [(1, "x"), (1, "x"), (1, "y"), (None, None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 1}
    assert len(same) <= 2
