"""Exactly n rows, by key order or at random but repeatably, without moving the rows.

The n-th key is found by counting: keys are split into RADIX ranges by their leading bits, counts of the ranges say which
of them holds the n-th key, and that range is split again. Only counts reach the driver, and no task sorts or
holds n keys, whether n is ten or half of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

RADIX = 1 << 12


def _hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def nth_integer(df: DataFrame, value: Column, n: int, least: int, most: int) -> tuple[int, int, int] | None:
    """The n-th smallest (from 1) of integers between two bounds, how many are smaller and how many equal it.

    None when there are fewer. Each pass counts at most RADIX ranges, and the next looks into one of them; a range
    of at most RADIX rows is looked at as it is.
    """
    before, held = 0, None
    rows = df.select(value.alias("v"))
    while True:
        inside = rows.where(F.col("v").between(least, most))
        if held is not None and held <= RADIX:
            values = sorted(r["v"] for r in inside.collect())
            found = values[n - before - 1]
            return found, before + values.index(found), values.count(found)
        width = max(1, -(-(most - least + 1) // RADIX))
        # Decimals, as bounds may be as far apart as two longs.
        away = F.col("v").cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")
        place = F.call_function("div", away, F.lit(width).cast("decimal(20,0)"))
        for r in inside.groupBy(place.alias("r")).count().orderBy("r").collect():  # at most RADIX rows
            if before + r["count"] >= n:
                break
            before += r["count"]
        else:
            return None
        least, held = least + r["r"] * width, r["count"]
        if width == 1:
            return least, before, held
        most = min(most, least + width - 1)


def stable_sample(df: DataFrame, n: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The n rows whose seeded key hash is smallest; an error when there are fewer rows.

    The key is unique, so hashes are. The n-th hash is found by its first 60 bits and, among hashes that share them, by the rest.
    """
    total = df.count()
    if n > total:
        raise ValueError(f"cannot take {n} of {total} rows")
    if n == 0:
        return df.limit(0)
    last, before = "", 0
    for start, digits in ((1, 15), (16, 15), (31, 2)):
        same = df.select(_hash(key, seed).alias("h")).where(F.col("h").startswith(last))
        part = F.conv(F.substring("h", start, digits), 16, 10).cast("bigint")
        found, smaller, equal = nth_integer(same, part, n - before, 0, 16 ** digits - 1)
        last, before = f"{last}{found:0{digits}x}", before + smaller
        if before + equal == n:
            break
    return df.filter(F.substring(_hash(key, seed), 1, len(last)) <= last)


def first_rows(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The n rows with the smallest value of a unique order column; all of them for None.

    Integers are found by counting; other types by sorting their n first, as far as they go.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    if isinstance(df.schema[order].dataType, IntegralType):
        ends = df.agg(F.min(order), F.max(order)).first()
        last = None if ends[0] is None else nth_integer(df.select(order), F.col(order).cast("bigint"), n, ends[0], ends[1])
        return df.filter(F.col(order).isNotNull()) if last is None else df.filter(F.col(order) <= F.lit(last[0]))
    last = df.select(order).orderBy(order).limit(n).agg(F.max(order)).first()[0]
    return df.filter(F.col(order) <= F.lit(last))
