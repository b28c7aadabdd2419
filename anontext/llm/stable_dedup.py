"""Near-duplicate vectors by quantised random projections (2-stable hashing) and exact cosine checks.

Vectors are normalised, projected on Gaussian directions, shifted and cut to steps; a few steps make a
bucket, and enough tables are kept that a pair at the threshold is missed with at most ``miss`` chance. The
number of steps per bucket grows with the logarithm of the table, which keeps buckets small. Equal vectors
of one label are put together first and counted with their multiplicity. A bucket that is still large is
cut into blocks and pairs of blocks, each a task's group of bounded size. A pair counts in the first table
where it meets, so links add up without listing pairs; groups leave a bucket as stars.

Vectors that are null, empty, zero, or hold null or non-finite parts, and those without label, link with
nothing. Vectors of different length do not link. Repeated rows are vectors of their own. Null ids are
carried. Other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import components, stored

COSINE = 0.93
STEP = 1.5
BLOCK = 1024


def collision(distance: float, step: float) -> float:
    """Chance that one quantised projection agrees for two points at this distance."""
    c = step / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(rows: int, cosine: float, step: float, miss: float) -> tuple[int, int]:
    """Steps per bucket and number of tables: buckets of about 256 unrelated vectors (distance 1.2)."""
    k = max(3, math.ceil(math.log(max(rows, 1) / 256 + 1) / -math.log(collision(1.2, step))))
    p = collision(math.sqrt(2 - 2 * cosine), step) ** k
    return k, math.ceil(math.log(miss) / math.log(1 - p))


@lru_cache(maxsize=4)
def projections(dim: int, k: int, tables: int, step: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the multipliers that make one number of a bucket's steps."""
    rng = np.random.default_rng([seed, dim])
    lines = rng.standard_normal((dim, tables * k))
    return lines, rng.uniform(0, step, tables * k), rng.integers(1, 1 << 62, k, dtype=np.int64) | 1


def table_keys(unit: np.ndarray, k: int, tables: int, step: float, seed: int) -> np.ndarray:
    """Bucket of every unit vector in every table."""
    lines, shift, mix = projections(unit.shape[1], k, tables, step, seed)
    cells = np.floor((unit @ lines + shift) / step).astype(np.int64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        return (cells * mix).sum(axis=2)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their norms; scaled by a power of two, which changes no cosine, where squares leave the range."""
    with np.errstate(over="ignore", under="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        if not ((norm > 1e-140) & (norm < 1e140)).all():
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            norm = np.sqrt((x * x).sum(axis=1))
    return x, norm


def usable(vector: str):
    """Whether a vector takes part."""
    v = F.col(vector)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda e: e != 0), F.lit(False))


def precision(vectors: DataFrame, name: str = "embedding") -> str:
    """The type that holds a vector column's values: float where they are floats, else double."""
    kind = vectors.schema[name].dataType.elementType.simpleString()
    return "array<float>" if kind == "float" else "array<double>"


def dense(column: pd.Series) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    return np.stack([np.asarray(v, np.float64) for v in column])


def link_vectors(vectors: DataFrame, cosine: float = COSINE, step: float = STEP, miss: float = 1e-4,
                 seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    fine = usable("embedding") & F.col("label").isNotNull()
    key = F.when(fine, F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string"))))
    rows = stored(vectors.select("vec_id", F.when(fine, F.col("embedding").cast(precision(vectors))).alias("embedding"),
                                 "label", key.alias("_key")), "vectors")
    nodes = rows.where("_key IS NOT NULL").groupBy("_key").agg(
        F.min("vec_id").alias("_first"), F.count("*").alias("_copies"), F.first("embedding").alias("embedding"),
        F.first("label").alias("label")).withColumn("_node", F.monotonically_increasing_id())
    nodes = stored(nodes.withColumn("_dim", F.size("embedding")), "vectors-nodes")
    k, tables = plan(nodes.count(), cosine, step, miss)

    def hashed(frames):
        for frame in frames:
            for _, part in frame.groupby("_dim"):
                x, norm = _unit(dense(part["embedding"]))
                keys = table_keys(x / norm[:, None], k, tables, step, seed)
                n = len(part)
                yield pd.DataFrame({
                    "_node": np.repeat(part["_node"].to_numpy(), tables), "label": np.repeat(part["label"].to_numpy(), tables),
                    "_dim": np.repeat(part["_dim"].to_numpy(), tables), "_table": np.tile(np.arange(tables, dtype=np.int32), n),
                    "_bucket": keys.ravel()})

    kind = vectors.schema["label"].dataType.simpleString()
    cells = nodes.select("_node", "embedding", "label", "_dim").mapInPandas(
        hashed, f"_node long, label {kind}, _dim int, _table int, _bucket long")
    cells = stored(cells, "vectors-cells")
    bucket = ["label", "_dim", "_table", "_bucket"]
    sizes = cells.groupBy(*bucket).count().where("count > 1").withColumn(
        "_blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    met = cells.join(sizes, bucket)
    mine = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    met = met.withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    met = met.join(nodes.select("_node", "embedding", "_copies"), "_node")
    group = [*bucket, "_lo", "_hi"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.select(*group, "_own", "_node", "_copies", "embedding").repartition(n, *group).sortWithinPartitions(*group)

    def compare(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            cols = [frame[c].to_numpy() for c in group]
            new = np.zeros(len(frame) - 1, bool)
            for c in cols:
                new |= c[1:] != c[:-1]
            cut = np.flatnonzero(new) + 1
            last = int(cut[-1]) if len(cut) else 0
            bounds = np.concatenate([[0], cut]).astype(int)
            yield from found(frame, bounds)
            held = frame.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield from found(held, np.array([0, len(held)]))

    def found(frame, bounds):
        nodes_, links_, roots_ = [], [], []
        ends = np.concatenate([[0], np.cumsum(frame["embedding"].map(len).to_numpy())])
        values = np.concatenate(frame["embedding"].tolist()).astype(np.float64)  # groups are many and small: slices only
        node_, copies_, own_, low_, high_, table_ = (frame[c].to_numpy() for c in ("_node", "_copies", "_own", "_lo", "_hi", "_table"))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            node, copies, own = node_[lo:hi], copies_[lo:hi], own_[lo:hi]
            x, norm = _unit(values[ends[lo]:ends[hi]].reshape(hi - lo, -1))
            near = (x @ x.T) / norm[:, None] / norm >= cosine
            if np.count_nonzero(near) - np.count_nonzero(near.diagonal()) == 0:
                continue
            near = np.triu(near, 1)
            if low_[lo] != high_[lo]:
                near &= own[:, None] != own
            # From here on pairs, which every earlier table thins out: a pair counts in the first that it meets in.
            left, right = np.nonzero(near)
            if not len(left):
                continue
            some, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            left, right = place[:len(left)], place[len(left):]
            table = int(table_[lo])
            if table:
                keys = np.ascontiguousarray(table_keys(x[some] / norm[some, None], k, tables, step, seed).T)
                for t in range(table):
                    apart = keys[t][left] != keys[t][right]
                    left, right = left[apart], right[apart]
            if not len(left):
                continue
            root = np.arange(len(some))
            while True:
                low = root.copy()
                np.minimum.at(low, left, root[right])
                np.minimum.at(low, right, root[left])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            links = np.zeros(len(some), np.int64)
            np.add.at(links, left, copies[some[right]])
            np.add.at(links, right, copies[some[left]])
            linked = np.flatnonzero(links)
            nodes_.append(node[some[linked]])
            links_.append(links[linked])
            roots_.append(node[some[root[linked]]])
        if nodes_:
            yield pd.DataFrame({"_node": np.concatenate(nodes_), "_links": np.concatenate(links_),
                                "_root": np.concatenate(roots_)})

    seen = stored(met.mapInPandas(compare, "_node long, _links long, _root long"), "vectors-links")
    links = seen.groupBy("_node").agg(F.sum("_links").alias("_links"))
    roots = components(seen.select(F.col("_node").alias("a"), F.col("_root").alias("b")).where("a <> b"), "vectors")
    named = nodes.select("_key", "_node", "_first", "_copies").join(links, "_node", "left").join(
        roots.select(F.col("id").alias("_node"), F.col("root").alias("_root")), "_node", "left")
    named = named.withColumn("_root", F.coalesce("_root", "_node"))
    low = named.groupBy("_root").agg(F.min("_first").alias("_low"))
    named = named.join(low, "_root").select(
        F.col("_key"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), "_low")
    out = rows.select("vec_id", "_key").join(named, "_key", "left")
    component = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("_low"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
