import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anontext.llm import hard_negatives
from anontext.llm.hard_negatives import LAST_ID, Lane, Tree, annuli, distances, mine

KIND = "vec_id long, embedding array<float>, label int"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def brute(rows, every=20, positives=5, negatives=10):
    """The contract over Python integers: sorted output rows."""
    fine = []
    for i, v, y in rows:
        if v is None or y is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        fine.append((LAST_ID if i is None else i, [math.floor(256 * float(np.float32(c))) for c in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    out = []
    for a, (i, v, y) in enumerate(fine):
        if i == LAST_ID or i % every:
            continue
        met = [(-sum(p * q for p, q in zip(v, w)), j, z == y) for b, (j, w, z) in enumerate(fine) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(m for m in met if m[2])[:positives]:
            near = sorted(m for m in met if not m[2] and 30 * -s <= 100 * -m[0] <= 90 * -s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(near)]
    return sorted(out)


def result(df):
    got = mine(df, F.col("vec_id") % 20 == 0, F.expr(LABEL)).collect()
    return sorted(tuple(LAST_ID if c is None else c for c in r) for r in got)


def clustered(n, seed, dim=8, spread=0.2, labels=4):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((10, dim))
    x = centre[r.integers(0, 10, n)] + spread * r.standard_normal((n, dim))
    return [(i, [float(np.float32(c)) for c in v], int(r.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("leaf", "block", "lanes"), [(512, 2048, 64), (10, 7, 3), (40, 16, 1)])
def test_equals_brute_force(spark, monkeypatch, leaf, block, lanes):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "LANES", lanes)
    rows = clustered(900, leaf)
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(60)]  # one vector many times
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for name in ("_id", "_row", "_leaf", "_block", "rank", "window"):
        df = df.withColumn(name, F.lit("x"))
    want = brute(rows)
    assert result(df) == want and len(want) > 500


def test_odd_vectors_repeated_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [1.0, 0.5], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (5, [1.0, 1.0], 2),
            (4, [1.0, 1.0], 2), (4, [1.0, 1.0], 2), (6, [0.5, 0.0], 3), (None, [0.5, 0.1], 3), (None, [2.0, 2.0], 1), (7, [1.0, 0.0], 0),
            (8, [0.0, 0.0], 4), (40, [0.0, 0.0], 4), (9, [0.0, 0.0], 4), (60, [-1.0, 0.0], 5), (11, [1.0, 0.0], 5),
            (80, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0, 1.0], 1), (13, [0.5, 0.0, 1.0], 2), (100, [], 1), (14, [], 1), (15, [], 2)]
    bad = [(1, None, 1), (2, [nan, 1.0], 1), (16, [inf, 1.0], 1), (17, [None, 1.0], 1), (18, [1.0, 0.0], None), (120, None, 1)]
    df = spark.createDataFrame(rows + bad, KIND).repartition(3)
    want = brute(rows + bad)
    assert result(df) == want and len(want) > 20
    assert result(spark.createDataFrame([], KIND)) == [] == result(spark.createDataFrame(bad, KIND))
    assert result(spark.createDataFrame([(0, [1.0], 1)], KIND)) == []  # an anchor without others
    with pytest.raises(Exception, match="2\\^53|OVERFLOW|overflow"):
        result(spark.createDataFrame([(0, [1e30], 1)], KIND))


def filed(tree, x):
    ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points]

    def seen(at, side, apart):
        for j in np.unique(side):
            ranges[at][0][:, j] = np.minimum(ranges[at][0][:, j], apart[side == j].min(axis=0))
            ranges[at][1][:, j] = np.maximum(ranges[at][1][:, j], apart[side == j].max(axis=0))

    leaf = tree.file(x, seen)
    tree.ranges = ranges
    return leaf


def test_bounds_hold_and_rule_leaves_out():
    r = np.random.default_rng(5)
    centre = 40 * r.standard_normal((12, 6))
    x = np.floor(centre[r.integers(0, 12, 800)] + 3 * r.standard_normal((800, 6)))
    tree = Tree(float((x * x).sum(axis=1).max()))
    tree.grow(tree.lift(x[:300]), 2)
    leaf = filed(tree, x)
    assert tree.leaves > 8 and set(leaf) <= set(range(tree.leaves))
    least, most = tree.bounds(x[:50])
    query = np.concatenate([x[:50], np.zeros((50, 1))], axis=1)
    apart = distances(query, tree.lift(x))
    assert (apart >= least[:, leaf] - tree.slack).all() and (apart <= most[:, leaf] + tree.slack).all()
    # an annulus holds just the rows of its scores
    score = x[:50] @ x.T
    low, high = np.full((50, 1), 500.0), np.full((50, 1), 3000.0)
    inner, outer = annuli((x[:50] ** 2).sum(axis=1), tree.norm2, low, high)
    clear = (np.abs(score - 500) > 1) & (np.abs(score - 3000) > 1)
    assert (((apart >= inner) & (apart <= outer)) == ((score >= 500) & (score <= 3000)))[clear].all()

    def table(places, **more):
        return pa.table({"_v": pa.array([[int(c) for c in x[i]] for i in places], pa.list_(pa.int32())), "_row": pa.array(list(places)),
                         "_id": pa.array(list(places)), "_label": pa.array(["a"] * len(places)), **more})

    asking = table(range(50), _lo=pa.array([[float("-inf")]] * 50), _hi=pa.array([[float("inf")]] * 50))
    lane = Lane(tree, asking, 6, True, 5, 1, True)
    for at in np.argsort(least.min(axis=0)):
        if (leaf == at).any():
            lane.meet(int(at), table(np.flatnonzero(leaf == at).tolist()))
    np.fill_diagonal(score[:, :50], -np.inf)
    assert (lane.score == -np.sort(-score, axis=1)[:, :5]).all()
    assert lane.ruled_out > lane.met  # most leaves were not looked through


def test_sample_of_equal_rows_is_one_leaf():
    tree = Tree(5.0)
    assert tree.grow(tree.lift(np.ones((100, 4))), 3) == -1 and tree.leaves == 1 and not tree.points
