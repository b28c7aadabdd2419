"""Hard negatives of anchors, through a multiway hyperplane tree with distance ranges (GNAT).

Vectors become integers, floor(256 x); a row's score is its integer inner product with the anchor. Lifted by one more
component onto a sphere as large as the longest vector, rows lie the nearer to an anchor the higher they score, so a
window of scores is an annulus around the anchor. Each node of the tree has up to FANOUT split points; a
row goes to its nearest one. For every split point and sibling subtree the node stores the least and greatest distance
from the point to the subtree's rows, over all rows of the table. A subtree is out when, for one split point, that range
does not meet the annulus widened by the point's distance from the anchor. Leaves are looked through exactly, in integers.

The split points are chosen from SAMPLE rows by hash; every row is filed, and ranges cover every row. The tree has
at most DEEPEST levels (4,681 nodes and leaves), so it can be broadcast whatever the table. Anchors near each other form
blocks of about BLOCK; the rows of a leaf travel to the blocks that cannot rule it out, cut by hash into lanes, so no leaf
lands in one task. A lane keeps each window's running best and meets leaves nearest first, so its annuli shrink
and later leaves are ruled out unread. A first pass over the anchors' own leaves narrows the annuli before any row is sent.

Positives of an anchor: its first ``positives`` other rows of the same label. Negatives of a positive: the first ``negatives`` rows
of other labels with low*positive_score <= 100*negative_score <= high*positive_score. Higher scores come first, ties by
smaller id, null ids last. Rows with a null label or vector, or a null or non-finite component take no part. Vectors
of different length do not meet. Repeated rows are rows of their own; an anchor leaves out its own row alone. Rows
whose integers or inner products do not fit (2^53) raise an error. Other columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.code_vectors import finite
from anontext.llm.common import small_batches, stored

FANOUT, DEEPEST, LEAF = 8, 4, 512
SAMPLE, BLOCK, LANES = 32_768, 2048, 64
LAST_ID = (1 << 63) - 1


@dataclass
class Tree:
    """Split points by node, and what each leads to: a node (0 and up) or a leaf (-1 and down)."""

    norm2: float
    points: list[np.ndarray] = field(default_factory=list)
    leads: list[np.ndarray] = field(default_factory=list)
    ranges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: int = 0

    @property
    def slack(self) -> float:
        """More than rounding can amount to."""
        return 4e-6 * (math.sqrt(self.norm2) + 1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def grow(self, sample: np.ndarray, depth: int) -> int:
        """Split points for these (lifted) rows; returns what the parent's point leads to."""
        chosen = self.spread(sample) if depth and len(sample) >= 2 * FANOUT else []
        if len(chosen) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.points)
        self.points.append(sample[chosen])
        self.leads.append(np.zeros(len(chosen), np.int64))
        side = distances(sample, self.points[at]).argmin(axis=1)
        for i in range(len(chosen)):
            self.leads[at][i] = self.grow(sample[side == i], depth - 1)
        return at

    @staticmethod
    def spread(sample: np.ndarray) -> list[int]:
        """Up to FANOUT of the first rows, each as far as can be from those before it."""
        some = sample[:3 * FANOUT]
        chosen, far = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < FANOUT and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
        return chosen

    def file(self, x: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of every row; ``seen(node, side, distances)`` is told of every choice."""
        lifted, leaf = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            at, rows = todo.pop()
            apart = distances(lifted[rows], self.points[at])
            side = apart.argmin(axis=1)
            if seen:
                seen(at, side, apart)
            for i, lead in enumerate(self.leads[at]):
                own = rows[side == i]
                if lead >= 0 and len(own):
                    todo.append((int(lead), own))
                elif lead < 0:
                    leaf[own] = -lead - 1
        return leaf

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that rows of each leaf can have from these queries, from the stored ranges."""
        query = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        least, most = np.zeros((len(x), max(1, self.leaves)), np.float32), np.full((len(x), max(1, self.leaves)), np.inf, np.float32)
        todo = [(0, np.zeros(len(x)), np.full(len(x), np.inf))] if self.points else []
        while todo:
            at, low, high = todo.pop()
            apart, (lo, hi) = distances(query, self.points[at]), self.ranges[at]
            for j, lead in enumerate(self.leads[at]):
                if lo[0, j] > hi[0, j]:  # nothing was filed there
                    if lead < 0:
                        least[:, -lead - 1] = np.inf
                    else:
                        todo.append((int(lead), np.full(len(x), np.inf), high))
                    continue
                near = np.maximum(low, np.maximum(apart - hi[:, j], lo[:, j] - apart).max(axis=1))
                far = np.minimum(high, (apart + hi[:, j]).min(axis=1))
                if lead >= 0:
                    todo.append((int(lead), near, far))
                else:
                    least[:, -lead - 1], most[:, -lead - 1] = near, far
        return least, most


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(0.0, square))


def annuli(square: np.ndarray, norm2: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which rows score from low to high, for anchors of these squared norms (rows x windows)."""
    with np.errstate(invalid="ignore"):
        inner, outer = [np.sqrt(np.maximum(0.0, square[:, None] + norm2 - 2 * s)) for s in (high, low)]
    return np.where(low <= high, inner, np.inf), np.where(low <= high, outer, -np.inf)


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def windows(column, most: int, empty: float) -> np.ndarray:
    """Bounds of each anchor's windows; absent ones can hold nothing."""
    out = np.full((len(column), most), empty)
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row
    return out


class Lane:
    """Anchors of a block and each window's running best, while rows pass leaf by leaf."""

    def __init__(self, tree: Tree, table: pa.Table, dim: int, same: bool, keep: int, width: int, prune: bool):
        column = {n: table.column(n).combine_chunks() for n in ("_v", "_row", "_label", "_lo", "_hi")}
        self.tree, self.dim, self.same, self.prune = tree, dim, same, prune
        self.x, self.row = matrix(column["_v"], dim), column["_row"].to_numpy()
        self.names: dict[str, int] = {}
        self.label = np.array([self.names.setdefault(v, len(self.names)) for v in column["_label"].to_pylist()], np.int64)
        self.low, self.high = windows(column["_lo"], width, np.inf), windows(column["_hi"], width, -np.inf)
        self.square = (self.x * self.x).sum(axis=1)
        if prune:
            self.least, self.most = tree.bounds(self.x)
        shape = (len(self.x) * width, keep)
        self.score, self.ident, self.found = np.full(shape, -np.inf), np.full(shape, LAST_ID), np.full(shape, LAST_ID)
        self.met = self.ruled_out = 0

    def meet(self, leaf: int, rows: pa.Table) -> None:
        width, keep = self.low.shape[1], self.score.shape[1]
        low = np.maximum(self.low, self.score[:, -1].reshape(-1, width))  # below the running best nothing counts
        open_ = low <= self.high
        if self.prune:
            inner, outer = annuli(self.square, self.tree.norm2, low, self.high)
            open_ &= (self.least[:, leaf, None] <= outer + self.tree.slack) & (self.most[:, leaf, None] >= inner - self.tree.slack)
        some = np.flatnonzero(open_.any(axis=1))
        self.met, self.ruled_out = self.met + len(some), self.ruled_out + len(self.x) - len(some)
        if not len(some):
            return
        x = matrix(rows.column("_v").combine_chunks(), self.dim)
        row, ident = rows.column("_row").to_numpy(), rows.column("_id").to_numpy()
        coded = rows.column("_label").combine_chunks().dictionary_encode()
        label = np.array([self.names.get(v, -1) for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        score = self.x[some] @ x.T
        meets = self.label[some][:, None] == label[None, :]
        meets = meets & (self.row[some][:, None] != row[None, :]) if self.same else ~meets
        for w in range(width):
            own = open_[some, w]
            hit = meets & own[:, None] & (score >= low[some, w][:, None]) & (score <= self.high[some, w][:, None])
            a, r = np.nonzero(hit)
            if len(a):
                self.take(some[a] * width + w, score[a, r], ident[r], row[r], keep)

    def take(self, group, score, ident, row, keep) -> None:
        touched = np.unique(group)
        group = np.concatenate([group, np.repeat(touched, keep)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ident = np.concatenate([ident, self.ident[touched].ravel()])
        row = np.concatenate([row, self.found[touched].ravel()])
        order = np.lexsort((row, ident, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        first = order[place < keep]
        self.score[touched], self.ident[touched], self.found[touched] = (c[first].reshape(-1, keep) for c in (score, ident, row))

    def best(self) -> pa.RecordBatch:
        width = self.low.shape[1]
        group, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[group // width]), pa.array((group % width).astype(np.int32)), pa.array(self.score[group, place].astype(np.int64)),
             pa.array(self.ident[group, place]), pa.array(self.found[group, place])], names=["_anchor", "window", "score", "ident", "row"])


def plant(rows: DataFrame, dim: int, count: int, norm2: float) -> Tree:
    """A tree over all rows: split points from a bounded sample, ranges from every row."""
    few = rows.orderBy(F.xxhash64("_id", "_v"), "_row").limit(SAMPLE).select("_v").toArrow()
    tree = Tree(norm2)
    depth = min(DEEPEST, max(0, round(math.log(max(1, count / LEAF), FANOUT))))
    tree.grow(tree.lift(matrix(few.column("_v").combine_chunks(), dim)), depth)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batches):
        tree = shared.value
        low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]

        def seen(at, side, apart):
            for j in np.unique(side):
                own = apart[side == j]
                low[at][:, j] = np.minimum(low[at][:, j], own.min(axis=0))
                high[at][:, j] = np.maximum(high[at][:, j], own.max(axis=0))

        for batch in batches:
            tree.file(matrix(batch.column("_v"), dim), seen)
        for at in range(len(low)):
            i, j = np.nonzero(low[at] <= high[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), at, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(low[at][i, j]), pa.array(high[at][i, j])], names=["node", "point", "side", "low", "high"])

    measured = rows.select("_v").mapInArrow(measure, "node int, point int, side int, low double, high double")
    tree.ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points]
    # At most FANOUT rows for each node and split point.
    for r in measured.groupBy("node", "point", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.ranges[r["node"]][0][r["point"], r["side"]] = r["low"]
        tree.ranges[r["node"]][1][r["point"], r["side"]] = r["high"]
    return tree


class Search:
    """All rows of one vector length, filed, and passes of anchors over them."""

    def __init__(self, rows: DataFrame, dim: int, count: int, norm2: float):
        self.spark, self.dim = rows.sparkSession, dim
        small_batches(self.spark)
        tree = plant(rows, dim, count, norm2)
        self.tree = self.spark.sparkContext.broadcast(tree)
        shared = self.tree

        def file(batches):
            for batch in batches:
                leaf = shared.value.file(matrix(batch.column("_v"), dim)).astype(np.int32)
                yield batch.append_column("_leaf", pa.array(leaf))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        self.rows = stored(rows.mapInArrow(file, f"{kinds}, _leaf int"), "negatives-rows")
        own = self.rows.where("_asks").drop("_asks")
        # Leaf after leaf, and by hash within a leaf; a row for each leaf (at most FANOUT ** DEEPEST) travels.
        before, offsets = 0, []
        for r in own.groupBy("_leaf").count().orderBy("_leaf").collect():
            offsets.append((r["_leaf"], r["count"], before))
            before += r["count"]
        offsets = F.broadcast(self.spark.createDataFrame(offsets, "_leaf int, _n long, _before long"))
        place = F.col("_before") + F.pmod(F.xxhash64("_row"), F.col("_n"))
        own = own.join(offsets, "_leaf").withColumn("_block", F.floor(place / BLOCK).cast("int")).drop("_n", "_before")
        self.anchors, self.blocks = stored(own, "negatives-anchors"), max(1, -(-before // BLOCK))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tasks, self.lanes = max(1, tasks), max(1, min(LANES, -(-2 * tasks // self.blocks)))

    def first(self, anchors: DataFrame, same: bool, keep: int, width: int, label: str) -> DataFrame:
        """_anchor, window, score, ident, row, place: the first ``keep`` of every window.

        anchors: _row and the windows' bounds, _lo and _hi, over the rows of this search.
        """
        anchors = self.anchors.join(anchors, "_row")
        near = anchors.withColumn("_block", F.col("_leaf")).drop("_leaf")
        where = near.select("_block").distinct().select("_block", F.col("_block").alias("_leaf"), F.lit(0.0).alias("_near"))
        probe = self.run(near, where, same, keep, width, False)
        # What an anchor has found in its own leaf narrows its windows.
        least = probe.where(F.col("place") == keep).groupBy(F.col("_anchor").alias("_row")).agg(
            F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("_least"))
        anchors = anchors.join(least, "_row", "left").withColumn(
            "_lo", F.transform("_lo", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("_least", i), v))))
        anchors = stored(anchors.drop("_least", "_leaf"), f"negatives-{label}")
        return self.run(anchors, self.visits(anchors, width), same, keep, width, True)

    def visits(self, anchors: DataFrame, width: int) -> DataFrame:
        """(_block, _leaf, _near): the leaves that some window of a block cannot rule out."""
        shared, dim = self.tree, self.dim

        def look(batches):
            tree = shared.value
            for batch in batches:
                x, block = matrix(batch.column("_v"), dim), batch.column("_block").to_numpy()
                low, high = windows(batch.column("_lo"), width, np.inf), windows(batch.column("_hi"), width, -np.inf)
                inner, outer = annuli((x * x).sum(axis=1), tree.norm2, low, high)
                inner, outer = inner.min(axis=1, initial=np.inf), outer.max(axis=1, initial=-np.inf)
                least, most = tree.bounds(x)
                open_ = (least <= outer[:, None] + tree.slack) & (most >= inner[:, None] - tree.slack)
                for b in np.unique(block):
                    own = block == b
                    leaf = np.flatnonzero(open_[own].any(axis=0))
                    near = least[own].min(axis=0)[leaf].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), b, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(near)],
                                                     names=["_block", "_leaf", "_near"])

        seen = anchors.select("_block", "_v", "_lo", "_hi").mapInArrow(look, "_block int, _leaf int, _near double")
        return seen.groupBy("_block", "_leaf").agg(F.min("_near").alias("_near"))

    def run(self, anchors: DataFrame, visits: DataFrame, same: bool, keep: int, width: int, prune: bool) -> DataFrame:
        shared, dim = self.tree, self.dim
        none = F.lit(None).cast("array<double>")
        rows = self.rows.drop("_asks").join(visits, "_leaf").withColumn("_lane", F.pmod(F.xxhash64("_row"), F.lit(self.lanes)).cast("int"))
        asking = anchors.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1)))).withColumn(
            "_leaf", F.lit(-1)).withColumn("_near", F.lit(-1.0))
        names = ["_block", "_lane", "_near", "_leaf", "_row", "_id", "_label", "_v", "_lo", "_hi"]
        both = asking.select(*names).unionByName(rows.withColumn("_lo", none).withColumn("_hi", none).select(*names))
        both = both.repartition(self.tasks, "_block", "_lane").sortWithinPartitions("_block", "_lane", "_near", "_leaf")

        def search(batches):
            key, lane, asking = None, None, []
            for batch in batches:
                cols = [batch.column(c).to_numpy() for c in ("_block", "_lane", "_leaf")]
                new = np.zeros(max(0, batch.num_rows - 1), bool)
                for c in cols:
                    new |= c[1:] != c[:-1]
                edge = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
                for a, b in zip(edge, edge[1:]):
                    if a == b:
                        continue
                    block, number, leaf = (int(c[a]) for c in cols)
                    if (block, number) != key:
                        if lane is not None:
                            yield lane.best()
                        key, lane, asking = (block, number), None, []
                    part = pa.Table.from_batches([batch.slice(a, b - a)])
                    if leaf < 0:
                        asking.append(part)
                        continue
                    if lane is None:
                        lane = Lane(shared.value, pa.concat_tables(asking), dim, same, keep, width, prune)
                        asking = []
                    for at in range(0, part.num_rows, 1024):
                        lane.meet(leaf, part.slice(at, 1024))
            if lane is not None:
                yield lane.best()

        found = both.mapInArrow(search, "_anchor long, window int, score long, ident long, row long")
        order = Window.partitionBy("_anchor", "window").orderBy(F.desc("score"), "ident", "row")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    good = vectors.where(finite(vector) & label.isNotNull()).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("_id"), label.cast("string").alias("_label"),
        F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("_v"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col(id_column).isNotNull()).alias("_asks"))
    rows = stored(good.withColumn("_row", F.monotonically_increasing_id()), "negatives-vectors")
    square = F.aggregate("_v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    lengths = rows.groupBy(F.size("_v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("norm2")).orderBy("dim").collect()
    out = vectors.sparkSession.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in lengths:
        if r["norm2"] >= 1 << 53:
            raise OverflowError("inner products of these vectors do not fit 2^53")
        own = rows if len(lengths) == 1 else rows.where(F.size("_v") == r["dim"])
        out = out.unionByName(_mine(Search(own, r["dim"], r["n"], r["norm2"]), positives, negatives, low, high))
    return out


def _mine(search: Search, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    every = search.anchors.select("_row", F.array(F.lit(float("-inf"))).alias("_lo"), F.array(F.lit(float("inf"))).alias("_hi"))
    pairs = stored(search.first(every, True, positives, 1, "positives").select(
        F.col("_anchor"), (F.col("place") - 1).alias("window"), F.col("ident").alias("_positive"), F.col("score").alias("positive_score")),
        "negatives-pairs")
    # 100*score between low*positive and high*positive, in integers; at most ``positives`` windows an anchor.
    ceil, floor = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)"), F.expr(
        f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    asked = pairs.groupBy(F.col("_anchor").alias("_row")).agg(
        F.sort_array(F.collect_list(F.struct("window", ceil.cast("double").alias("lo"), floor.cast("double").alias("hi")))).alias("w"))
    asked = asked.select("_row", F.col("w.lo").alias("_lo"), F.col("w.hi").alias("_hi"))
    found = search.first(asked, False, negatives, positives, "windows")
    named = found.join(pairs, ["_anchor", "window"]).join(search.anchors.select(F.col("_row").alias("_anchor"), F.col("_id").alias("anchor_id")), "_anchor")

    def shown(name):
        return F.when(F.col(name) != LAST_ID, F.col(name))

    return named.select("anchor_id", shown("_positive").alias("positive_id"), F.col("place").cast("int").alias("rank"),
                        shown("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * e::DOUBLE) FOR e IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
