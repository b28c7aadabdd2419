import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from anontext.llm.exact_dedup import drop_copies, heavy_digests, mark_copies, text_digest


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    big = float("inf")
    out = []
    for t, ids in groups.items():
        low = min(ids, key=lambda i: big if i is None else i)
        d = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, low, len(ids), d) for i in ids]
    return Counter(out)


def marks(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect())


def texts(n, seed):
    r = random.Random(seed)
    words = ["a", "b", " ", "\t", "\n", "\x0b", "\x0c", " ", "é", " "]
    rows = [(i, "hot  text") if r.random() < 0.35 else (i, "".join(r.choice(words) for _ in range(r.randint(0, 5)))) for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tracked", [8, 64, 4096])
def test_equals_brute_force(make, tracked):
    rows = texts(700, tracked)
    got = mark_copies(make(rows, parts=5), tracked=tracked).cache()
    assert marks(got) == brute(rows)
    kept = {(r.doc_id, r.keep_id) for r in got.where("kept").collect()}
    assert all(a == b for a, b in kept) and len(kept) == len({normal(t) for _, t in rows})
    stay = drop_copies(make(rows, parts=5), tracked=tracked)
    assert stay.columns == make(rows).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(a for a, _ in kept)


def test_heavy_texts_are_found_and_verified(make):
    from pyspark.sql import functions as F

    rows = [(i, "hot") for i in range(300)] + [(300 + i, f"cold {i}") for i in range(600)] + [(2000 + i, f"twice {i // 2}") for i in range(100)]
    df = make(rows, parts=4)
    heavy = heavy_digests(df.select(F.col("doc_id").alias("_id"), text_digest().alias("_digest")), 16).collect()
    assert [(bytes(h["_heavy"]).hex(), h["_low"], h["_size"]) for h in heavy] == [(hashlib.sha256(b"hot").hexdigest(), 0, 300)]


def test_nulls_ties_long_texts_and_repeated_rows(make):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (5, long), (5, long), (None, long), (6, "x"), (None, "x"), (None, "y"), (None, "y"),
            (8, " x"), (9, "x ")] + [(7, "hot")] * 50 + [(None, "cold")] * 50
    for tracked in (4, 4096):
        got = mark_copies(make(rows), tracked=tracked).cache()
        assert marks(got) == brute(rows)
        groups = {normal(t) for _, t in rows}
        kept = got.where("kept").collect()
        assert len(kept) == len(groups) == len({bytes(r.digest) for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
        stay = drop_copies(make(rows), tracked=tracked).collect()
        assert len(stay) == len(groups) and {normal(r.text) for r in stay} == groups


def test_empty_table_and_plan_without_python(make, capsys):
    df = make([])
    assert mark_copies(df).count() == 0 and drop_copies(df).count() == 0
    mark_copies(make(texts(20, 1))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan


def test_clashing_columns(make):
    from pyspark.sql import functions as F

    df = make([(1, "a"), (2, "a "), (3, "a")])
    for name in ("_digest", "_heavy", "_low", "_keep", "keep_id", "_row", "digest"):
        df = df.withColumn(name, F.lit("mine"))
    assert {(r.doc_id, r.keep_id) for r in mark_copies(df).collect()} == {(1, 1), (2, 2), (3, 1)}
    assert sorted((r.doc_id, r["_digest"]) for r in drop_copies(df).collect()) == [(1, "mine"), (2, "mine")]
