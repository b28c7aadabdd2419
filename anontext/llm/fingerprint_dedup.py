"""Near-duplicates by 64-bit fingerprints of word shingles, candidates by chains of segments on a ring.

A fingerprint is cut into three segments on a ring. Two differing bits over three segments mean that from
some segment on every chain keeps its proportional budget: the first segment equal, the first two within one
bit, all three within two. So each distinct fingerprint is filed once per bit of the chain's second segment
with that bit and the third segment blanked; only those filed together are compared in full. Copies of a
fingerprint never meet, and a file holds at most 2**23 distinct fingerprints whatever the corpus.

Within a file links are found in blocks, or, where thousands meet, by blanking further bits, and leave as a
star per linked group, never as pairs. Null texts count as empty; texts without words have fingerprint zero
and link like others. Null ids are carried, and count for a component's id only if it has no other; repeated
rows each get a row. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import components, from_texts, stored, worker_cache

SEED = 42
SEGMENTS = ((0, 21), (21, 43), (43, 64))
DISTANCE = 2
BLOCK = 1024


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segment_mask(k: int) -> int:
    low, high = SEGMENTS[k % 3]
    return (1 << high) - (1 << low)


def chain_masks() -> list[int]:
    """For each bit, the mask that keeps the chain around it: its own segment without it, and the one before."""
    out = []
    for bit in range(64):
        k = next(i for i, (low, high) in enumerate(SEGMENTS) if low <= bit < high)
        out.append((_segment_mask(k) | _segment_mask(k + 2)) & ~(1 << bit))
    return out


def shingles(words: list[bytes], shingle: int):
    """The shingles in parts, which bounds memory; a text shorter than one is one."""
    for at in range(0, max(1, len(words) - shingle + 1), 1 << 16) if words else ():
        part = words[at:at + (1 << 16) + shingle - 1]
        if len(words) < shingle:
            yield [b" ".join(words)]
        else:
            yield list(map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)))


def hashed(words: list[bytes], shingle: int) -> np.ndarray:
    """Of all shingles, in order."""
    parts = [np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in made), "<u8", len(made)) for made in shingles(words, shingle)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, "<u8")


def majority(h: np.ndarray) -> int:
    """A bit is 1 when set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(words: list[bytes], shingle: int) -> int:
    """A bit is 1 when set in over half of the shingles' hashes."""
    return majority(hashed(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", lower: bool = True) -> DataFrame:
    """The columns of ``docs`` without the text, and ``_fp``."""
    def start():
        worker_cache("fingerprints", dict)

        def work(texts):
            fp = [fingerprint((t.lower() if lower else t).split(), shingle) for t in texts]
            return {"_fp": np.array(fp, "<u8").view("<i8")}
        return work

    return from_texts(docs, [c for c in docs.columns if c != text], {"_fp": "long"}, start, text)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked_roots(fp: np.ndarray, bit: int) -> np.ndarray:
    """Position of a representative for each of the distinct fingerprints of one file."""
    n = len(fp)
    parent = np.arange(n)

    def union(i, j):
        a, b = _find(parent, i), _find(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if n <= 4 * BLOCK:
        for at in range(0, n, BLOCK):
            near = np.bitwise_count(fp[at:at + BLOCK, None] ^ fp[None, at:]) <= DISTANCE
            for i, row in enumerate(near):
                for j in np.flatnonzero(row[i + 1:]):
                    union(at + i, at + i + 1 + int(j))
    else:
        # All differ in the third segment and this bit alone: blank one more bit, or two with this bit equal.
        k = next(i for i, (low, high) in enumerate(SEGMENTS) if low <= bit < high)
        rest = range(*SEGMENTS[(k + 1) % 3])
        masks = [(1 << bit) | (1 << a) for a in rest] + [(1 << a) | (1 << b) for a in rest for b in rest if a < b]
        for mask in masks:
            blank = fp & np.uint64(~mask & (1 << 64) - 1)
            order = np.argsort(blank, kind="stable")
            same = np.flatnonzero(blank[order[1:]] == blank[order[:-1]])
            for i in same.tolist():
                union(int(order[i]), int(order[i + 1]))
    return np.array([_find(parent, i) for i in range(n)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): stars over the groups linked within each file of chains, of distinct ``_fp``."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in chain_masks()])
    filed = fps.select("_fp", F.posexplode(masks).alias("_bit", "_mask")).select(
        "_fp", "_bit", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_file"))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    filed = filed.repartition(n, "_file", "_bit").sortWithinPartitions("_file", "_bit")

    def run(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            file, bit, fp = (frame[c].to_numpy() for c in ("_file", "_bit", "_fp"))
            cut = np.flatnonzero((file[1:] != file[:-1]) | (bit[1:] != bit[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = frame.iloc[last:].reset_index(drop=True)
            yield from stars(file[:last], bit[:last], fp[:last], cut)
        if held is not None:
            yield from stars(*(held[c].to_numpy() for c in ("_file", "_bit", "_fp")), np.zeros(0, np.int64))

    def stars(file, bit, fp, cut):
        bounds = np.concatenate([[0], cut[cut < len(fp)], [len(fp)]])
        a, b = [], []
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            own = fp[bounds[i]:bounds[i + 1]]
            root = linked_roots(own.view(np.uint64), int(bit[bounds[i]]))
            to = own[root]
            a.append(own[to != own])
            b.append(to[to != own])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return filed.mapInPandas(run, "a long, b long").distinct()


def _linked(marked: DataFrame, first) -> DataFrame:
    """Each distinct ``_fp`` with the smallest ``first`` among its rows, and the root of its group."""
    distinct = stored(marked.groupBy("_fp").agg(F.min(first).alias("_first")), "fingerprints-distinct")
    roots = components(links(distinct.select("_fp")), "fingerprints")
    return distinct.join(roots.withColumnRenamed("id", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, of each group of near-duplicates the one with the smallest id (nulls last) alone.

    Rows are told apart by id and a hash of the text; rows equal in both are one document and leave one row.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = stored(fingerprints(docs.select("doc_id", mark.alias("_mark"), "text"), shingle), "fingerprints")
    named = _linked(marked, F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_mark").alias("m")))
    return _rows_of(docs, mark, named.groupBy("root").agg(F.min("_first").alias("k")))


def _rows_of(docs: DataFrame, mark, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``k`` (a struct of n, id and mark)."""
    kept = kept.select(F.col("k.d").alias("_d"), F.col("k.m").alias("_m"))
    names = [f"k{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)],
                       F.col("doc_id").alias("_id"), mark.alias("_mark"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")))
    return rows.dropDuplicates(["_id", "_mark"]).select(*names).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    marked = stored(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    named = _linked(marked, F.col("doc_id"))
    first = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = named.join(first, "root").select("_fp", "component_id")
    out = marked.join(named, "_fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
