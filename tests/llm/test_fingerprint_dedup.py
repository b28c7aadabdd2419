import random

import numpy as np
import pytest
import xxhash

from anontext.llm import fingerprint_dedup as fd
from anontext.llm.common import components


def brute(text):
    w = (text or "").encode().lower().split()
    made = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in made) for b in range(64)]
    return sum(1 << b for b in range(64) if made and 2 * ones[b] > len(made))


def groups(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in items:
        for b in items:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in items}


def test_every_pair_within_two_bits_shares_a_file():
    r, masks = random.Random(1), fd.chain_masks()
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.choice([0, 1, 2])):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks), (a, b)


@pytest.mark.parametrize("block", [1, 1024])
def test_links_within_a_file(block, monkeypatch):
    """Both ways, in blocks and by blanking bits, join the same."""
    monkeypatch.setattr(fd, "BLOCK", block)
    r = random.Random(2)
    for bit in (5, 30, 60):
        k = next(i for i, (lo, hi) in enumerate(fd.SEGMENTS) if lo <= bit < hi)
        lo, hi = fd.SEGMENTS[(k + 1) % 3]
        base = r.getrandbits(64)
        fps = sorted({base ^ (r.getrandbits(1) << bit) ^ sum(1 << b for b in r.sample(range(lo, hi), r.randint(0, 3))) for _ in range(60)})
        want = groups(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
        root = fd.linked_roots(np.array(fps, np.uint64), bit)
        seen = {}
        for f, i in zip(fps, root, strict=True):
            assert seen.setdefault(want[f], i) == i
        assert len(set(root.tolist())) == len(set(want.values()))


def test_whole_corpus_equals_brute_force(make, words):
    texts = []
    for g in range(12):
        w = words(300, g)
        texts += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1] + ["zz"]), " ".join(["yy", *w])]
    texts += [None, "", "  \n", "one", "one two", "ONE two", "a" * 40_000, "x　y z"]
    got = {r.doc_id: r for r in fd.near_duplicates(make(texts)).collect()}
    fps = {i: brute(t) for i, t in enumerate(texts)}
    root = groups(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    kept = fd.keep_one(make(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and len(kept.columns) == 16
    assert kept.first().k0 == "k0"


def test_nulls_repeats_and_empty_tables(make):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (None, None), (None, "q r s t")]
    got = sorted(((r.doc_id, r.component_id) for r in fd.near_duplicates(make(rows)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (2, 2), (None, 2), (None, None)], key=str)
    assert sorted(((r.doc_id, r.text) for r in fd.keep_one(make(rows)).collect()), key=str) == sorted(
        [(4, "a b c"), (2, None), (None, "q r s t")], key=str)
    assert fd.near_duplicates(make([])).count() == 0 and fd.keep_one(make([])).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)]
    edges += [(7, 7), (201, 200)] * 3
    r.shuffle(edges)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert {got[i] for i in range(202)} == {0} and {got[i] for i in range(1000, 1100)} == {1000}
    assert {got[i] for i in range(5000, 5050)} == {5000}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
