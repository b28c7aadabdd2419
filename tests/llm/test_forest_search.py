import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anontext.llm import forest_search
from anontext.llm.forest_search import Forest, nearest, recall

KIND = "vec_id long, embedding array<float>, label int"


def vectors(spark, n, seed=1, dim=16):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((12, dim))
    x = centre[r.integers(0, 12, n)] + 0.5 * r.standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], KIND).repartition(4)


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(forest_search, "LEAF", 30)
    monkeypatch.setattr(forest_search, "PART", 40)  # leaves in several parts
    df = vectors(spark, 1500)
    found = nearest(df, F.col("vec_id") % 20 == 0, k=10, sample_rows=400, share=1.2).cache()
    assert recall(found, df, 10) >= 0.9
    x = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in df.collect()}
    rows = sorted(found.collect(), key=lambda r: (r.query_id, r.rank))
    assert len(rows) == 75 * 10
    for i, r in enumerate(rows):
        assert r["rank"] == i % 10 + 1 and r.vec_id != r.query_id
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
        if r["rank"] > 1:
            before = rows[i - 1]
            assert (before.score, -before.vec_id) >= (r.score, -r.vec_id)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1),
            (6, [nan, 1.0], 1), (40, [inf, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 2.0, 3.0], 1), (60, [], 1),
            (0, [0.5, 0.0], 1)]
    df = spark.createDataFrame(rows, KIND).withColumn("_id", F.lit("x")).withColumn("score", F.lit(1))
    got = nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {0, 20}
    assert [r.vec_id for r in sorted(by[20], key=lambda r: r["rank"])] == [0, 3, 7, None, 0]
    assert len(by[0]) == 10  # two rows with this id ask
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df.where("vec_id = 4"), F.lit(True)).count() == 0


def test_every_length_is_searched(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.standard_normal(3 if i % 3 else 5)], 0) for i in range(90)]
    found = nearest(spark.createDataFrame(rows, KIND).repartition(3), F.col("vec_id") % 10 == 0, k=4).collect()
    assert sorted({f.query_id for f in found}) == list(range(0, 90, 10)) and len(found) == 36
    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for f in found:
        assert len(x[f.query_id]) == len(x[f.vec_id]) and f.score == pytest.approx(float(x[f.query_id] @ x[f.vec_id]), abs=1e-12)


def test_walk_reaches_every_leaf_and_starts_at_home():
    x = np.random.default_rng(3).standard_normal((200, 5))
    forest = Forest(x, 0.0, 3, trees=2)
    for q, seen in zip(range(20), forest.walk(x[:20], 16), strict=True):
        assert len(set(seen)) == 16 and all(7 <= leaf < 15 for _, leaf in seen)
    random.seed(1)


def test_doubles_are_scored_as_doubles(spark):
    r = np.random.default_rng(8)
    x = 1 + 1e-10 * r.standard_normal((60, 8))  # one vector to floats
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in forest_search.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
        assert row.score == pytest.approx(float(x[row.query_id] @ x[row.vec_id]), rel=1e-15)
    for q in (0, 20, 40):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        assert got[q] == [int(i) for i in np.lexsort((np.arange(60), -score))[:5]]
