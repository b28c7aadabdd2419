import os
import random

import pytest
from pyspark.sql import functions as F

from anontext.functions.packing import PACKED, pack, unpack

PAIRS = [("abc", "abc"), ("", "abc"), ("abc", ""), ("[m0] abc", "abc"), ("abc", "[m0] abc"), ("aaa", "aa"), ("aa", "aaaa"),
         ("Zed rose", "Blue Bolt rose"), ("Zed rose.", "Zed fell."), ("nothing", "shared?x"), ("né", "nè"), ("日本 rose", "日木 rose"),
         (None, "abc"), ("abc", None), (None, None), ("x" * 5000 + "y", "x" * 5000 + "z"), ("\0퟿", "\0퟾")]


def test_texts_come_back_as_they_were(spark):
    some = random.Random(5)
    made = ["".join(some.choice("abé日") for _ in range(some.randrange(40))) for _ in range(400)]
    pairs = PAIRS + list(zip(made[::2], made[1::2]))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, text string, base string").repartition(3)
    packed = df.withColumn("p", pack(F.col("text"), F.col("base")))
    assert packed.schema["p"].dataType.simpleString() == PACKED
    for r in packed.withColumn("back", unpack(F.col("p"), F.col("base"))).collect():
        assert r.back == r.text
        if r.text is None:
            assert r.p is None
            continue
        a, b = (r.base or "").encode(), r.text.encode()
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
        assert (r.p.head, r.p.tail, bytes(r.p.rest)) == (head, tail, b[head:len(b) - tail])
