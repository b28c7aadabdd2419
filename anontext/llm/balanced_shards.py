"""Shards of nearly equal bytes by differencing: whole groups of equal texts, largest spread first.

Partial partitions are combined in opposite order, the two with the largest spread at a time. That is done
at two levels, so that nothing unbounded meets in one place: tasks difference their groups into bundles of
about a 64th of a shard; the bundles, and the groups larger than one, are differenced into shards. There are
at most total/target of each, and one bundle more per task, however many rows there are.

Null texts count as empty (16 bytes) and are grouped with them; null ids and repeated rows are placed like
any others. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import row_numbers, stored

SHARDS = 40
BUNDLES_PER_SHARD = 64
BATCH_GROUPS, BATCH_BUNDLES = 20_000, 256


def differencing(sizes, k: int) -> np.ndarray:
    """The part, 0 to k - 1, of every item: multi-way largest differencing. Deterministic."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []

    def take(i):
        if i >= n:
            return sums.pop(i)
        alone = np.zeros(k, np.int64)
        alone[0] = sizes[i]
        return alone

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = take(a) + take(b)[::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        both = both[order]
        sums[n + len(made)] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(made)))
        made.append((a, b, order))
    part = np.zeros(n, np.int64)
    where = {heap[0][1]: np.arange(k, dtype=np.int32)}
    if heap[0][1] < n:
        return part
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        to = where.pop(n + i)
        made[i] = None
        back = np.empty(k, np.int32)
        back[order] = to
        for child, at in ((a, back), (b, back[::-1])):
            if child < n:
                part[child] = at[0]
            else:
                where[child] = at
    return part


def balance(docs: DataFrame, shards: int = SHARDS, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary"))
                       .alias("text_crc32"), F.md5(text.cast("binary")).alias("_group"))
    rows = stored(rows, "shard-rows")
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), "shard-groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    target = max(1, -(-total // (shards * bundles_per_shard)))

    def bundle(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        part = pd.concat(frames)
        name = (TaskContext.get().partitionId() << 32) + np.arange(len(part), dtype=np.int64)
        small = np.flatnonzero(part["_bytes"].to_numpy() <= target)
        size = part["_bytes"].to_numpy()
        if size[small].sum() <= target:
            name[small] = name[small[0]] if len(small) else 0
        else:
            for at in range(0, len(small), BATCH_GROUPS):
                own = small[at:at + BATCH_GROUPS]
                k = min(BATCH_BUNDLES, int(-(-size[own].sum() // target)))
                got = differencing(size[own], k)
                first = np.full(k, -1, np.int64)
                first[got[::-1]] = own[::-1]
                name[own] = name[first[got]]
        yield pd.DataFrame({"_group": part["_group"], "_bytes": size, "_bundle": name})

    bundles = stored(groups.mapInPandas(bundle, "_group string, _bytes long, _bundle long"), "shard-bundles")
    # Bounded by the target, not by the rows.
    whole = bundles.groupBy("_bundle").agg(F.sum("_bytes").alias("_bytes")).orderBy(F.desc("_bytes"), "_bundle").toPandas()
    shard = differencing(whole["_bytes"].to_numpy(), shards)
    spark = docs.sparkSession
    of = spark.createDataFrame(pd.DataFrame({"_bundle": whole["_bundle"].astype("int64"), "shard": shard.astype("int32")}),
                               "_bundle long, shard int")
    placed = rows.join(bundles.join(F.broadcast(of), "_bundle").select("_group", "shard"), "_group")
    numbered, _ = row_numbers(placed.select("doc_id", "size", "text_crc32", "shard"), "shard", "shard-slots")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
