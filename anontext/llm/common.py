"""What several operators share: tables in the shared folder, splitting, ranks and connected components."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anontext.session import scratch_path, settings, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs a task, not the lineage.

    The shuffle files behind it are dropped once it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; ``bytes.split()`` then cuts at exactly 0x20 and 0x09-0x0D."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


_KEPT: dict = {}


def worker_cache(name: str, make, of=None):
    """What a Python worker keeps from task to task: one operator's tables at a time, remade when ``of`` changes."""
    if _KEPT.get("name") != name or _KEPT["of"] != of:
        _KEPT.clear()
        gc.collect()
        _KEPT.update(name=name, of=of, value=make())
    return _KEPT["value"]


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
         "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}


def from_texts(df: DataFrame, keep: list[str], outputs: dict[str, str], start, text: str = "text") -> DataFrame:
    """Add columns computed from whole texts, in one narrow stage of Arrow batches.

    ``start()`` is called once per task and returns a function from a list of UTF-8 texts to a dictionary of
    output columns. The kept columns pass through untouched, nulls and types included; an output may not have
    the name of one of them.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"columns {sorted(clash)} are there already")
    aliases = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        work = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(batch.column("_bytes").to_pylist())
            columns = [batch.column(c) for c in aliases] + [pa.array(made[o], type=ARROW[t]) for o, t in outputs.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*aliases, *(f"o{i}" for i in range(len(outputs)))])

    small_batches(df.sparkSession)
    schema = ", ".join([*(f"{a} {df.schema[c].dataType.simpleString()}" for a, c in zip(aliases, keep, strict=True)),
                        *(f"o{i} {t}" for i, t in enumerate(outputs.values()))])
    source = df.select(*[F.col(f"`{c}`").alias(a) for a, c in zip(aliases, keep, strict=True)], text_bytes(text).alias("_bytes"))
    return source.mapInArrow(run, schema).toDF(*keep, *outputs)


def held_out(doc_id: str, remainder: int, folds: int = 5) -> Column:
    """Whether crc32 of the id's text leaves this remainder (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == remainder


def row_numbers(df: DataFrame, group: str, label: str, spread: int = 64) -> tuple[DataFrame, str]:
    """Number the rows of each group from 0 without gaps, in no order that matters, as column ``slot``.

    Each group is spread over ``spread`` parts by a stored part number, so that a group that holds a third
    of all rows is numbered by many tasks; the parts' counts (groups x spread rows) give the offsets.
    """
    from pyspark.sql import Window

    base = stored(df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")), label)
    counts = base.groupBy(group, "_part").count()
    offsets = counts.withColumn("_from", F.sum("count").over(
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select(F.col(group).alias("_g"), F.col("_part").alias("_p"),
                             F.coalesce("_from", F.lit(0)).alias("_from"))
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.lit(0)))
    numbered = base.withColumn("_rank", rank)
    out = numbered.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("slot", F.col("_from") + F.col("_rank") - 1).drop("_g", "_p", "_part", "_from", "_rank"), "slot"


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges: (id, root), root the smallest id reachable.

    Large-star and small-star rounds: each keeps at most one edge per edge, links every vertex to smaller
    ones, and halves path lengths. The neighbours of one vertex are never gathered: only their minimum is
    (combined before the shuffle) and is joined back; adaptive execution splits a hot vertex's join. Each
    round is a written table. Ids in no edge are not returned; empty edges give an empty table.
    """
    def canonical(e):
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    cur = stored(canonical(edges), f"{label}-edges")
    seen = None
    for _ in range(max_rounds):
        # Large star: every neighbour above v is linked to the smallest of v and its neighbours.
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: every neighbour below v, and v, is linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
        small = large.join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = stored(small.unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct(), f"{label}-round")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ids = cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = cur.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))
    return ids.unionByName(roots)
