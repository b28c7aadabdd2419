import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anontext.llm.best_fit import WordIds, opening, pack, pack_documents, sweep

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequential(sizes, capacity):
    """Best fit, largest first: number of sequences."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_ids_equal_the_library():
    with open(PATH, encoding="utf-8") as f:
        coder = WordIds(f.read(), cache_words=40)
    letters = list("abǅʰⅷªß  \n\t\x0b\x0c\x1c\x85\xa0　éß漢字🙂'\"ΣİsS1٣.,.,thé́̈\x00") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ͅ", "가", "ᄀ", "A", "Ä", "K"]
    r = random.Random(1)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 20))) for _ in range(4000)]
    library = Tokenizer.from_file(PATH)
    for t, got in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(6))
def test_sweep_needs_as_few_as_sequential_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    sizes = [r.randint(1, r.choice([capacity - 1, capacity // 2, 5])) for _ in range(r.randint(1, 400))]
    opened, rounds = sweep(dict(collections.Counter(sizes)), capacity)
    assert sum(n for n, *_ in opened) == sequential(sizes, capacity)
    assert sum(x[4] for x in opened) + sum(x[6] for rows in rounds.values() for x in rows) == len(sizes)


def check(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_places_every_row_once(spark):
    r = random.Random(7)
    sizes = [r.choice([3, 3, 3, r.randint(1, 50)]) for _ in range(500)] + [50, 50, 1, 26, 26]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, length long, _size string").repartition(4)
    rows = pack(df, 50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    assert check(rows, 50) == sequential([s for s in sizes if s < 50], 50) + sizes.count(50)


def test_documents(make, words):
    library = Tokenizer.from_file(PATH)
    texts = [" ".join(words(n, n)) for n in (1, 5, 80, 81, 200, 700)] + [None, "", "A, b. C's", "A, b. C's", " ".join(words(9000, 3))]
    rows = pack_documents(make(texts), PATH, 512).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.start == r.piece * 512 and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    sizes = [r.length for r in rows]
    assert check(rows, 512) == sequential([s for s in sizes if s < 512], 512) + sizes.count(512)


def test_edge_tables(make):
    assert pack_documents(make([]), PATH).count() == 0
    assert {r.length for r in pack_documents(make([(None, None), (1, ""), (1, "")]), PATH).collect()} == {1}
    full = pack_documents(make(["a " * 7]), PATH, 8).collect()
    assert [(r.length, r.offset) for r in full] == [(8, 0)]


def test_opening_makes_each_sequence_once_without_a_join(spark):
    plan = spark.createDataFrame([(0, 1, 9), (1, 1001, 8), (1001, 1008, 7)], "_from long, _to long, _size long")
    made = opening(plan, 10)
    assert sorted((r._seq, r._size) for r in made.collect()) == [(0, 9), *((i, 8) for i in range(1, 1001)), *((i, 7) for i in range(1001, 1008))]
    assert "Join" not in made._jdf.queryExecution().toString()
