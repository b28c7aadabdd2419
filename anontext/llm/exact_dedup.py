"""Exact copies of texts, with frequent ones split off before anything is shuffled.

Texts are equal when they are identical after every run of 0x20 and 0x09-0x0D became one space; identity is the
SHA-256 of the normalised text. Of equal texts the row with the smallest id stays.

Each task hashes its texts once; only ids and digests are written and looked at again. Misra-Gries counters over the
digests (``approx_top_k``: the frequent-items sketch, Misra-Gries with batched decrements, TRACKED counters a task,
merged by adding them) name what may be frequent. The named digests are counted exactly, and those that fill at least
one in TRACKED of all rows are the heavy hitters: at most TRACKED of them, whatever the table. Their winners
are broadcast, so their rows are settled where they stand; all other digests meet in an ordinary shuffle, where no
group can hold more than one in TRACKED of the rows, or what the counters let slip (twice their error, 7 in TRACKED).

A null text is an empty one. Null ids come after all others. Rows that share both the smallest id and the text leave
one row, whichever; repeated rows are rows of their own. Other columns ride along in ``drop_copies`` and are dropped
in ``mark_copies``. An empty table gives an empty table. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import stored

TRACKED = 4096
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ").cast("binary"), 256))


def heavy_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(_heavy, _low, _size) of the digests that fill at least one in ``tracked`` of all rows; rows: _id, _digest."""
    named = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(xxhash64(_digest), {tracked}, {tracked})").alias("top")).first()
    least = -(-named["n"] // tracked)
    names = [(t["item"],) for t in named["top"] if t["count"] >= least]
    near = F.broadcast(rows.sparkSession.createDataFrame(names, "_name long"))  # at most ``tracked`` rows
    counted = rows.join(near, F.xxhash64("_digest") == F.col("_name"), "left_semi").groupBy(F.col("_digest").alias("_heavy")).agg(
        F.min("_id").alias("_low"), F.count("*").alias("_size"))
    return counted.where(F.col("_size") >= max(2, least))


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """id, keep_id, group_size, kept, digest of every row."""
    rows = stored(docs.select(F.col(id_column).alias("_id"), text_digest(text).alias("_digest"))
                  .withColumn("_row", F.monotonically_increasing_id()), "copies-digests")
    heavy = heavy_digests(rows, tracked)
    first = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy")).where(F.col("_id").eqNullSafe(F.col("_low")))
    first = first.groupBy("_heavy", "_low", "_size").agg(F.min("_row").alias("_winner"))
    heavy = stored(first, "copies-heavy")  # at most ``tracked`` rows, verified
    settled = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy")).select(
        "_id", F.col("_low").alias("_keep"), "_size", (F.col("_row") == F.col("_winner")).alias("_kept"), "_digest")

    rest = rows.join(F.broadcast(heavy.select("_heavy")), F.col("_digest") == F.col("_heavy"), "left_anti")
    equal = Window.partitionBy("_digest")
    rest = rest.select("_id", F.min("_id").over(equal).alias("_keep"), F.count("*").over(equal).alias("_size"),
                       (F.row_number().over(equal.orderBy(F.col("_id").asc_nulls_last(), "_row")) == 1).alias("_kept"), "_digest")
    both = settled.unionByName(rest)
    return both.select(F.col("_id").alias(id_column), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                       F.col("_kept").alias("kept"), F.col("_digest").alias("digest"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, with all their columns: copies of heavy texts go where they stand, others after a shuffle."""
    own = {c.lower() for c in docs.columns}

    def free(name):
        while name in own:
            name += "_"
        return name

    digest, part, hot, low = free("_digest"), free("_part"), free("_heavy"), free("_low")
    heavy = heavy_digests(docs.select(F.col(id_column).alias("_id"), text_digest(text).alias("_digest")), tracked)
    heavy = stored(heavy, "copies-heavy").select(F.col("_heavy").alias(hot), F.col("_low").alias(low))
    wide = docs.withColumn(digest, text_digest(text))
    light = wide.join(F.broadcast(heavy), F.col(digest) == F.col(hot), "left")
    light = light.where(F.col(hot).isNull() | F.col(id_column).eqNullSafe(F.col(low)))
    # Rows that share a heavy text and its smallest id leave one row a task, then one in all.
    light = light.withColumn(part, F.when(F.col(hot).isNotNull(), F.spark_partition_id())).drop(hot, low)
    tied = light.where(F.col(part).isNotNull()).withColumn(part + "n", F.row_number().over(Window.partitionBy(digest, part).orderBy(F.lit(0))))
    light = light.where(F.col(part).isNull()).unionByName(tied.where(F.col(part + "n") == 1).drop(part + "n"))
    nth = F.row_number().over(Window.partitionBy(digest).orderBy(F.col(id_column).asc_nulls_last()))
    return light.withColumn(part, nth).where(F.col(part) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
