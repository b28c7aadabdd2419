import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anontext.llm import span_dedup as sd

OUT = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "string"}


def brute(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def corpus(words):
    r = random.Random(4)
    passage = [words(n, 100 + n) for n in (19, 20, 21, 35, 60)]
    texts = []
    for i in range(60):
        w = words(r.randint(0, 150), i)
        for p in r.sample(passage, r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = p
        texts.append(" ".join(w))
    texts += [texts[3], texts[3] + " tail", "head " + texts[5], "\n".join(texts[7].split()), None, "", " \t ",
              " ".join(["x"] * 70), " ".join(["x", "y"] * 40), " ".join(words(50, 1) * 3), " ".join(["x"] * 70),
              "a\x1cb " * 25, "　".join(words(30, 8)), " ".join(words(30, 8)), " ".join(words(20_000, 9)), " ".join(words(20_000, 9)[5000:])]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot, shard", [(2_000, 4_000), (1, 4_000), (3, 1)])
def test_equals_brute_force(make, words, monkeypatch, hot, shard):
    """With anchors taken by segment, all window by window, and mixed in small shards."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    docs = corpus(words)
    got = {r.doc_id: r for r in sd.remove_repeats(make(docs, parts=4), ["doc_id", "_d", "lang"], OUT).collect()}
    for i, (n, gone, kept) in brute(docs).items():
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept) == (n, gone, kept.decode()), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and (r._d, r.lang) == ("_d", "en")


def test_segments_hold_every_window_once_and_agree_across_texts(words):
    w = words(400, 1)
    texts = [" ".join(w).encode(), b"", b"a b", (" ".join(words(30, 2) + w[50:120])).encode()]
    doc, first, count, anchor = sd.segments(texts)
    at = {}
    for d, s, k, a in zip(doc, first, count, anchor, strict=True):
        for j in range(s, s + k):
            assert at.setdefault((d, j), a) == a and k <= 16
    assert sorted(at) == [(0, i) for i in range(381)] + [(3, i) for i in range(81)]
    assert all(at[0, 50 + i] == at[3, 30 + i] for i in range(51))
    # The same whatever the slices.
    again = sd.segments(texts, block=64)
    spread = {(d, j): a for d, s, k, a in zip(*again, strict=True) for j in range(s, s + k)}
    assert spread == at


def test_word_hashes_do_not_depend_on_slices(monkeypatch, words):
    data = (" ".join(words(500, 3)) + "\n" + "z" * 900 + " end").encode()
    whole, starts = sd.word_hashes(data)
    assert [data[s:].split()[0] for s in starts.tolist()] == data.split()
    monkeypatch.setattr(sd, "SLICE", 1000)
    part, again = sd.word_hashes(data)
    assert (part == whole).all() and (starts == again).all()


def test_automaton_knows_every_substring_and_its_first_sequence():
    r = random.Random(5)
    for _ in range(60):
        seqs = [[r.randint(0, 2) for _ in range(r.randint(1, 14))] for _ in range(5)]
        sam = sd.SuffixAutomaton()
        for n, s in enumerate(seqs):
            sam.add(s, n)
        for n, s in enumerate(seqs):
            for window in (1, 2, 3, 5):
                want = [i for i in range(len(s) - window + 1)
                        if any(s[i:i + window] == o[j:j + window] for o in seqs[:n] for j in range(len(o)))]
                assert sam.earlier(s, n, window) == want


def test_nulls_repeated_rows_and_empty(make, words):
    t = " ".join(words(40, 1))
    rows = [(None, t), (5, t), (5, t), (2, None), (5, t + " more"), (None, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in sd.remove_repeats(make(rows), ["doc_id"], OUT).collect()))
    assert [g[3] for g in got if g[:2] == (True, 0)] == [0, 40]  # null ids come last
    assert sorted(g[3] for g in got if g[1] == 5) in ([0, 0, 40], [0, 40, 40])  # rows equal in id and text agree
    assert sd.remove_repeats(make([]), ["doc_id"], OUT).count() == 0
    assert np.array_equal(sd.covered(25, [(0, 1), (3, 2)], 20), [True] * 24 + [False])


def test_rows_without_id_are_told_apart_by_64_bits(spark):
    """Two texts that share a 32-bit hash, both without id: the passage of one is not cut from the other."""
    texts = spark.range(200_000).select(F.concat_ws(" ", *[F.concat(F.lit(chr(97 + j)), F.col("id")) for j in range(25)]).alias("text"))
    pair = texts.groupBy(F.hash("text", F.lit(1))).agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1).limit(1)
    one, two = pair.first().texts[:2]
    docs = spark.createDataFrame([(1, one + " tail"), (None, one), (None, two)], "doc_id long, text string")
    got = {r.kept: (r.n_words, r.n_removed) for r in
           sd.remove_repeats(docs, ["doc_id"], {"n_words": "long", "n_removed": "long", "kept": "string"}).collect()}
    assert got == {one + " tail": (26, 0), "": (25, 25), two: (25, 0)}
