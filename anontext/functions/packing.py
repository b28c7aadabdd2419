"""Texts told by what they share with another text.

A rewritten text mostly begins or ends as the text it was made from. Stored as the number of bytes it shares with that one
at either end, and what stands between, it takes little room; one that shares nothing is stored whole. Nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anontext.functions.text import let

PACKED = "struct<head:int,tail:int,rest:binary>"


def pack(text: Column, base: Column) -> Column:
    """``text`` as bytes shared with the beginning and the end of ``base``, and the rest; null for null."""
    both = F.struct(_bytes(base).alias("a"), text.cast("binary").alias("b"))

    def ends(t: Column) -> Column:
        a, b = t["a"], t["b"]
        most = F.least(F.length(a), F.length(b))
        head = _longest(most, lambda at, n: F.substring(a, at + 1, n) == F.substring(b, at + 1, n))
        return let(head, lambda head: let(
            _longest(most - head, lambda at, n: F.substring(a, F.length(a) - at - n + 1, n) == F.substring(b, F.length(b) - at - n + 1, n)),
            lambda tail: F.struct(head.alias("head"), tail.alias("tail"),
                                  F.substring(b, head + 1, F.length(b) - head - tail).alias("rest"))))

    return F.when(text.isNotNull(), let(both, ends))


def unpack(packed: Column, base: Column) -> Column:
    """The text that ``pack`` was given, from the same base."""
    def joined(a: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), packed["head"]), packed["rest"],
                        F.substring(a, F.length(a) - packed["tail"] + 1, packed["tail"])).cast("string")

    return F.when(packed.isNotNull(), let(_bytes(base), joined))


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _longest(most: Column, equal) -> Column:
    """The largest length up to ``most`` whose pieces are all equal, by halves: each byte is compared twice at most.

    ``equal(at, n)`` tells of the ``n`` bytes that follow ``at`` equal ones.
    """
    halves = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def further(at: Column, power: Column) -> Column:
        return let(F.call_function("shiftleft", F.lit(1), power), lambda n: F.when((at + n <= most) & equal(at, n), at + n).otherwise(at))

    return F.aggregate(halves, F.lit(0), further)
