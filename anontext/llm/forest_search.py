"""Nearest neighbours by largest inner product, through a forest of random-projection trees.

Vectors are lifted onto a sphere by one more component, so that the largest inner product is the smallest
angle. Trees split a bounded sample (``sample_rows``, by hash of the id) at the median of random projections;
every row is filed in its leaf of every tree. A query walks all trees through one shared priority queue,
nearest split first, until it has seen ``share`` times as many leaves as one tree has; it then meets the rows of those
leaves, and what it finds is ranked by exact inner products in double precision.

Leaves that hold more than PART rows, or are asked for more than PART times, are cut into parts by hash; every
part of the rows meets every part of the queries, so no group outgrows its bound and none is left out. Each group sends a query's best ``k`` on, and those of one query
are merged by row. The forest has a fixed largest size, whatever the table: at most DEEPEST levels, so that what
groups send on grows in step with the queries.

Vectors that are null, empty, zero or hold null or non-finite parts take no part. Vectors of each length have a forest
of their own, and meet those of their length alone. Repeated rows are rows of their own; a query leaves out its own row alone. Rows
with null ids are no queries, and rank behind others on ties. Without usable vectors, the result is empty.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import stored
from anontext.llm.stable_dedup import dense, precision, usable

TREES, SHARE, NEAREST = 16, 1.2, 20
SAMPLE, LEAF, DEEPEST, PART = 20_000, 200, 5, 16_384
LAST_ID = (1 << 63) - 1


class Forest:
    """Splits of all trees, level by level: (trees, nodes, parts of a vector) and their thresholds."""

    def __init__(self, sample: np.ndarray, norm: float, depth: int, trees: int = TREES, seed: int = 3):
        r = np.random.default_rng(seed)
        self.norm, self.depth = max(norm, float(np.sqrt((sample * sample).sum(axis=1)).max())), depth
        nodes = (1 << depth) - 1
        points = self.lift(sample)
        self.lines = r.standard_normal((trees, nodes, points.shape[1]))
        self.lines /= np.sqrt((self.lines ** 2).sum(axis=2, keepdims=True))
        self.cuts = np.zeros((trees, nodes))
        for t in range(trees):
            own = {0: np.arange(len(points))}
            for i in range(nodes):
                s = own.pop(i)
                p = points[s] @ self.lines[t, i]
                self.cuts[t, i] = np.median(p) if len(s) else 0.0
                own[2 * i + 1], own[2 * i + 2] = s[p <= self.cuts[t, i]], s[p > self.cuts[t, i]]
        self.lines, self.cuts = self.lines.astype(np.float32), self.cuts.astype(np.float32)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            return np.concatenate([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))], axis=1)
        rest = np.sqrt(np.maximum(0, self.norm ** 2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) / self.norm

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        points, out = self.lift(x), np.zeros((len(x), len(self.lines)), np.int32)
        for t in range(len(self.lines)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", points, self.lines[t][at]) > self.cuts[t][at]
                at = 2 * at + 1 + side
            out[:, t] = at
        return out

    def walk(self, x: np.ndarray, visits: int) -> list[list[tuple[int, int]]]:
        """The leaves that each query visits, over all trees, nearest split first."""
        nodes, out = self.lines.shape[1], []
        margin = np.einsum("nd,tmd->ntm", self.lift(x, query=True), self.lines, optimize=True) - self.cuts
        for own in margin.tolist():
            queue, seen = [(0.0, t, 0) for t in range(len(own))], []
            while queue and len(seen) < visits:
                far, t, at = heapq.heappop(queue)
                while at < nodes:
                    m = own[t][at]
                    near = 2 * at + 2 if m > 0 else 2 * at + 1
                    heapq.heappush(queue, (max(far, abs(m)), t, 4 * at + 3 - near))
                    at = near
                seen.append((t, at))
            out.append(seen)
        return out


def best(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort((ident[some], -score[some]))[:k]]
    return np.lexsort((ident, -score))[:k]


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, trees: int = TREES, share: float = SHARE,
            sample_rows: int = SAMPLE, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the forest finds for each query."""
    spark = vectors.sparkSession
    good = vectors.where(usable("embedding")).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.col("embedding").cast(precision(vectors)).alias("embedding"),
        (F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).alias("_query"))
    rows = stored(good.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()  # a row a length
    got = [_of_length(rows.where(F.size("embedding") == d["d"]), d["count"], k, trees, share, sample_rows, seed) for d in dims]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, got, empty).withColumn("vec_id", F.when(F.col("vec_id") != LAST_ID, F.col("vec_id")))


def _of_length(rows: DataFrame, count: int, k: int, trees: int, share: float, sample_rows: int, seed: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    spark = rows.sparkSession
    norm = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]
    some = rows.orderBy(F.xxhash64("_id"), "_row").limit(sample_rows).select("embedding").toPandas()
    depth = min(DEEPEST, max(0, int(math.log2(max(1, count / LEAF)))))
    forest = Forest(dense(some["embedding"]), norm, depth, trees, seed)
    shared = spark.sparkContext.broadcast(forest)  # at most trees x 2**DEEPEST splits
    visits = max(trees, math.ceil(share * (1 << depth)))

    def file(frames):
        for frame in frames:
            if not len(frame):
                continue
            at = shared.value.leaves(dense(frame["embedding"]))
            yield pd.DataFrame({"_tree": np.tile(np.arange(trees, dtype=np.int32), len(frame)), "_leaf": at.ravel(),
                                "_row": np.repeat(frame["_row"].to_numpy(), trees)})

    filed = stored(rows.select("_row", "embedding").mapInPandas(file, "_tree int, _leaf int, _row long"), "forest-leaves")
    def ask(frames):
        for frame in frames:
            for at in range(0, len(frame), 256):
                own = frame.iloc[at:at + 256]
                seen = shared.value.walk(dense(own["embedding"]), visits)
                n = [len(s) for s in seen]
                flat = np.array([x for s in seen for x in s], np.int32).reshape(-1, 2)
                yield pd.DataFrame({"_tree": flat[:, 0], "_leaf": flat[:, 1], "_asker": np.repeat(own["_row"].to_numpy(), n)})

    asked = stored(rows.where("_query").select("_row", "embedding").mapInPandas(ask, "_tree int, _leaf int, _asker long"), "forest-walks")
    # Rows and queries of a leaf are both cut into parts, and every part of one meets every part of the other.
    leaf = ["_tree", "_leaf"]

    def parts_of(rows_, name):
        return rows_.groupBy(*leaf).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))  # trees x leaves rows

    parts = parts_of(filed, "_parts").join(F.broadcast(parts_of(asked, "_asking")), leaf)

    def dealt(rows_, ident, own, other, own_name, other_name):
        out = rows_.join(F.broadcast(parts), leaf).withColumn(own_name, F.pmod(F.xxhash64(ident), F.col(own)).cast("int"))
        return out.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_parts", "_asking")

    index = dealt(filed, "_row", "_parts", "_asking", "_part", "_turn").join(rows.select("_row", "_id", "embedding"), "_row")
    asked = dealt(asked, "_asker", "_asking", "_parts", "_turn", "_part").join(
        rows.select(F.col("_row").alias("_asker"), F.col("_id").alias("_asker_id"), F.col("embedding").alias("_wanted")), "_asker")

    out_names = ["_asker", "query_id", "_row", "vec_id", "score"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts_: list[list] = [[] for _ in out_names]
        if left.num_rows and right.num_rows:
            def matrix(table, name):
                column = table.column(name).combine_chunks()
                return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            x, row, ident = matrix(left, "embedding"), left.column("_row").to_numpy(), left.column("_id").to_numpy()
            asker, asker_id = right.column("_asker").to_numpy(), right.column("_asker_id").to_numpy()
            q = matrix(right, "_wanted")
            for at in range(0, len(q), 512):
                near = q[at:at + 512] @ x.T
                near[asker[at:at + 512, None] == row[None, :]] = -np.inf
                floor = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)] - 1e-9
                for i in range(len(near)):
                    c = np.flatnonzero((near[i] >= floor[i]) & (near[i] > -np.inf))
                    exact = (x[c] * q[at + i]).sum(axis=1)  # the same sum wherever a vector stands
                    c = c[best(exact, ident[c], k)]
                    for column, value in zip(parts_, (np.full(len(c), asker[at + i]), np.full(len(c), asker_id[at + i]), row[c],
                                                      ident[c], (x[c] * q[at + i]).sum(axis=1)), strict=True):
                        column.append(value)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(p) if p else np.zeros(0, t) for n, p, t in zip(out_names, parts_, kinds, strict=True)})

    key = [*leaf, "_part", "_turn"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        meet, "_asker long, query_id long, _row long, vec_id long, score double")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = found.repartition(n, "_asker").sortWithinPartitions("_asker")

    def merge(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            asker = frame["_asker"].to_numpy()
            last_ = int(np.searchsorted(asker, asker[-1]))
            if last_:
                yield top(frame.iloc[:last_])
            held = frame.iloc[last_:].reset_index(drop=True)
        if held is not None:
            yield top(held)

    def top(frame):
        frame = frame.drop_duplicates(["_asker", "_row"]).sort_values(["_asker", "score", "vec_id"], ascending=[True, False, True])
        rank = frame.groupby("_asker").cumcount() + 1
        frame = frame.assign(rank=rank.astype("int32"))[rank <= k]
        return frame[["query_id", "rank", "vec_id", "score"]]

    return found.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def recall(found: DataFrame, vectors: DataFrame, k: int = NEAREST, queries: int = 200) -> float:
    """Share of the true k nearest found, over some of the queries, by brute force on the driver's side (tests)."""
    x = vectors.where(usable("embedding")).select("vec_id", "embedding").toPandas()
    ids, m = x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(np.float64)
    got = found.select("query_id", "vec_id").toPandas()
    asked = np.sort(got["query_id"].unique())[:queries]
    hit = total = 0
    for q, own in got[got["query_id"].isin(asked)].groupby("query_id"):
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        true = ids[best(s, ids, k)]
        hit += len(set(true) & set(own["vec_id"]))
        total += min(k, len(ids) - 1)
    return hit / max(1, total)
