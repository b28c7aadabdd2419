import numpy as np
import pytest
from pyspark.sql import functions as F

from anontext.llm import stable_dedup
from anontext.llm.stable_dedup import collision, link_vectors, plan

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    fine = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows]
    links, root = {i: 0 for i, *_ in fine}, {i: i for i, *_ in fine}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fine)):
        for b in range(a):
            (i, x, y), (j, z, w) = fine[a], fine[b]
            if y == w and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i, *_ in fine}


@pytest.mark.parametrize("block", [7, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(stable_dedup, "BLOCK", block)  # 7: every bucket in pairs of blocks
    r = np.random.default_rng(1)
    rows = []
    for g in range(30):
        centre = r.standard_normal(24)
        for _ in range(r.integers(1, 12)):
            rows.append((len(rows), [float(v) for v in centre + 0.22 * r.standard_normal(24)], int(g % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(9)]  # equal vectors
    rows += [(len(rows) + i, [2 * v for v in rows[0][1]], rows[0][2]) for i in range(2)]
    df = spark.createDataFrame(rows, KIND).repartition(3).withColumn("_node", F.lit("x")).withColumn("n_links", F.lit(1))
    got = {x.vec_id: (x.n_links, x.component_id) for x in link_vectors(df).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.0], None),
            (7, [1.0, 0.0], 1), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (10, [float("inf"), 0.0], 1),
            (11, [1.0, 0.1], 1), (11, [1.0, 0.1], 1), (None, [1.0, 0.0], 1)]
    got = sorted(((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in link_vectors(spark.createDataFrame(rows, KIND)).collect()))
    assert got == [(0, 3, 7, False), *((i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)), (7, 3, 7, True), (8, 0, 8, True), (9, 0, 9, True),
                   (10, 0, 10, True), (11, 3, 7, False), (11, 3, 7, False)]
    assert link_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_plan_keeps_the_promised_chance():
    for rows in (0, 1, 10_000, 10 ** 9):
        k, tables = plan(rows, 0.93, 1.5, 1e-4)
        assert (1 - collision((2 - 2 * 0.93) ** 0.5, 1.5) ** k) ** tables <= 1e-4


def test_doubles_are_compared_as_doubles(spark):
    """Angles a hair beside the threshold, which floats would blur, and lengths whose squares leave the range."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for label in range(40):
        cosine = 0.93 + (1e-10 if label % 2 else -1e-10)
        turn = r.uniform(0, 6)
        size = (1.0, 1e-200, 1e200)[label % 3]
        for angle in (turn, turn + np.arccos(cosine)):
            want[len(rows)] = (label % 2, len(rows) // 2 * 2 if label % 2 else len(rows))
            rows.append((len(rows), [size * float(np.cos(angle)), size * float(np.sin(angle))], label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: (x.n_links, x.component_id) for x in link_vectors(df).collect()} == want
