import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from anontext.llm.code_vectors import Codebook, compress, cuts, hex_code

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract in plain Python over lists, for vectors of one length: id -> (codes, error), and the digest."""
    fine = [(i, [math.floor(256 * float(c)) for c in v], y) for i, v, y in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    edge = cuts(len(fine[0][1]), parts)
    books = [[v[a:b] for _, v, _ in fine[:entries]] for a, b in zip(edge, edge[1:])]

    def near(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(v[a:b], book) for book, a, b in zip(books, edge, edge[1:])] for _, v, _ in fine]
        if turn < rounds:
            for p, (a, b) in enumerate(zip(edge, edge[1:])):
                for k in range(len(books[p])):
                    own = [v[a:b] for (_, v, _), f in zip(fine, found) if f[p][1] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, y, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, y), f in zip(fine, found)]
    return sorted((i if i is not None else -1, c, e, sum(x[3] for x in out if x[1] == y)) for i, y, c, e in out), digest


def rounded(rows, kind="float"):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows]


def result(df):
    got = compress(df).withColumn("code", hex_code()).collect()
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize(("dim", "n"), [(64, 300), (16, 500), (37, 90), (5, 40), (1, 3)])
def test_equals_brute_force(spark, dim, n):
    r = np.random.default_rng(dim)
    rows = rounded([(i * 3, [float(c) for c in r.standard_normal(dim) * 0.2], [None, 1, 2][i % 3]) for i in range(n)])
    rows += [(i, rows[0][1], 1) for i in range(1, 60, 3)]  # equal vectors
    df = spark.createDataFrame(rows, KIND).repartition(5).withColumn("_v", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("codes", F.lit(1))
    assert result(df) == (brute(rows)[0], {brute(rows)[1]})


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [(10, [0.5, -0.25, 1.0], 1), (11, [0.5, -0.25, 1.0], 1), (11, [0.1, 0.0, 0.0], None), (None, [0.0, 0.0, 0.0], 2),
            (None, [-1.0, 0.3, 0.3], None)]
    bad = [(1, None, 1), (2, [nan, 0.0, 0.0], 1), (3, [0.0, inf, 0.0], 1), (4, [0.0, None, 0.0], 1)]
    got = result(spark.createDataFrame(base + bad, KIND))
    assert got == (brute(rounded(base))[0], {brute(rounded(base))[1]})
    other = [(5, [1.0, 2.0], 1), (6, [], 9)]  # lengths of their own: own codebooks, label errors over all
    mixed = compress(spark.createDataFrame(base + other, KIND)).collect()
    assert len(mixed) == 7 and len({r.codebooks_sha256 for r in mixed}) == 3
    assert [(list(r.codes), r.error) for r in mixed if r.vec_id in (5, 6)] == [([0] * 16, 0)] * 2
    assert compress(spark.createDataFrame([], KIND)).count() == 0 == compress(spark.createDataFrame(bad, KIND)).count()
    assert compress(spark.createDataFrame([(1, [1e6, -1e6], 1)], KIND)).first().error == 0
    with pytest.raises(Exception, match="fit a long"):
        compress(spark.createDataFrame([(1, [1e30, 2.0], 1)], KIND)).collect()


def test_search_stops_early_and_ties_go_to_the_lower_index():
    r = np.random.default_rng(2)
    for width, high in ((4, 3), (4, 200), (1, 2), (3, 1)):
        entries, x = r.integers(-high, high + 1, (64, width)), r.integers(-high, high + 1, (400, width))
        book = Codebook(entries)
        index, apart = book.nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (apart == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
        assert book.visited < 400 * 64
    spread = np.arange(64)[:, None] * np.array([[100, 100, 100, 100]])
    book = Codebook(spread)
    book.nearest(spread + 7)
    assert book.visited <= 64 * 3


def test_result_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.standard_normal(8)], i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    assert result(df.repartition(1)) == result(df.repartition(7))
