import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anontext.llm import hmm_score
from anontext.llm.common import held_out


def small(seed=1, symbols=9, states=3):
    r = np.random.default_rng(seed)
    base = r.random(symbols)
    base[-1] = 0.001
    base /= base.sum()
    m = hmm_score.Model(base, slice(4, 6), symbols - 1, states, seed)
    m.start = r.dirichlet(np.ones(states))
    m.follow = r.dirichlet(np.ones(states), states)
    return m


def by_paths(m, s):
    total = 0.0
    for path in itertools.product(range(m.k), repeat=len(s)):
        p = m.start[path[0]] * m.emit[path[0], s[0]]
        for a, b, x in zip(path, path[1:], s[1:], strict=False):
            p *= m.follow[a, b] * m.emit[b, x]
        total += p
    return total


def test_probabilities_sum_to_one_and_likelihood_equals_all_paths():
    m = small()
    assert np.allclose(m.emit.sum(axis=1), 1) and np.allclose(m.follow.sum(axis=1), 1)
    r = np.random.default_rng(2)
    texts = [r.integers(0, 9, n) for n in (1, 2, 5, 5, 7, 3)]
    for got, s in zip(m.likelihood(texts), texts, strict=True):
        assert got == pytest.approx(math.log10(by_paths(m, s)), abs=1e-9)
    assert sum(10 ** x for x in m.likelihood([np.array(s) for s in itertools.product(range(9), repeat=2)])) == pytest.approx(1)


@pytest.mark.parametrize("held", [1, 3, 6, 100])  # of 14 tokens
def test_expected_counts_equal_all_paths(held):
    m = small(3)
    r = np.random.default_rng(4)
    blocks = [r.integers(0, 9, n) for n in (5, 4, 4, 1)]
    starts, follows, emits = m.expect(blocks, held)
    want = [np.zeros(m.k), np.zeros((m.k, m.k)), np.zeros((m.k, 9))]
    for s in blocks:
        whole = by_paths(m, s)
        for path in itertools.product(range(m.k), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= m.follow[a, b] * m.emit[b, x]
            want[0][path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += p / whole
            for a, x in zip(path, s, strict=True):
                want[2][a, x] += p / whole
    for got, w in zip((starts, follows, emits), want, strict=True):
        assert np.allclose(got, w)


def test_long_texts_are_one_sequence():
    """A text of many stretches gives the counts that it gives in one; every transition in it counts."""
    m = small(9)
    r = np.random.default_rng(10)
    texts = [r.integers(0, 9, n) for n in (6000, 700, 513, 512, 3)]
    want = m.expect(texts, 1 << 30)
    for got, w in zip(m.expect(texts, 1000), want, strict=True):
        assert np.allclose(got, w, rtol=1e-9)
    assert want[0].sum() == pytest.approx(len(texts))
    assert want[1].sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    assert want[2].sum() == pytest.approx(sum(len(t) for t in texts))


def test_training_raises_the_likelihood():
    r = np.random.default_rng(5)
    texts = [np.repeat(r.integers(0, 2, 6), 5) * 3 + r.integers(0, 3, 30) for _ in range(40)]
    m = small(6)
    before = m.likelihood(texts).sum()
    for _ in range(5):
        m = m.learn(*m.expect(texts))
    assert m.likelihood(texts).sum() > before + 10


def test_frames(make, words, monkeypatch):
    monkeypatch.setattr(hmm_score, "CHUNK_BYTES", 700)
    vocab = words(60, 1)
    texts = [" ".join(vocab[(i * 7 + j * (1 + i % 3)) % 60].upper() if j % 5 == 0 else vocab[(i + j) % 60] for j in range(i % 40))
             for i in range(120)]
    texts += [None, "", texts[7], "one two three " * 1000, "a\x1cb　c\x0bd"]
    docs = make(texts)
    got = {r.doc_id: r for r in hmm_score.score_texts(docs, ~held_out("doc_id", 1), rounds=2).collect()}
    count, own = collections.Counter(), {}
    for i, t in enumerate(texts):
        own[i] = (t or "").encode().lower().split() + [b""]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(own[i])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for i, w in own.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r.score) and r.score < 0
        assert r._train == (zlib.crc32(str(i).encode()) % 5 != 1)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert hmm_score.score_texts(make([]), F.lit(True)).count() == 0
    none = hmm_score.score_texts(make(["a b", ""]), F.lit(False)).collect()
    assert all(r.score == r.base_score and r.n_known == 0 for r in none)


def test_every_word_keeps_counts_of_its_own(make, spark, words, monkeypatch):
    """Rare words far beyond any list of frequent ones tell the topic, as in dense training on all words."""
    monkeypatch.setattr(hmm_score, "CHUNK_BYTES", 3000)
    r = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(6000)]
    texts = [" ".join(vocab[3000 * int(half) + i] for half in r.random(3) < 0.5 for i in r.integers(0, 3000, 60)) for _ in range(150)]
    docs = make(texts)
    got = {x.doc_id: x.score for x in hmm_score.score_texts(docs, F.lit(True), rounds=2, states=2).collect()}
    # The same by one dense matrix of all words.
    count = collections.Counter(w for t in texts for w in [*t.encode().split(), b""])
    names = sorted(count)
    number = {w: i for i, w in enumerate(names)}
    n, v = sum(count.values()), len(names)
    assert v > 5377
    frame = spark.createDataFrame([(w, count[w], True) for w in names], "_word binary, _c long, _lead boolean")
    norm = n + 0.5 * (v + 1)
    drawn = {bytes(x["_word"]): (x.n0, x.n1) for x in hmm_score.first_counts(frame, 2, norm).collect()}
    c = np.array([count[w] for w in names])
    dense = np.array([drawn[w] for w in names]).T
    chain = hmm_score.Chain(2, norm, (c == 1).sum() * 1.5 / norm)
    ids = [np.array([number[w] for w in [*t.encode().split(), b""]]) for t in texts]
    for _ in range(2):
        chain.hold_back(dense.sum(axis=1), dense[:, c == 1].sum(axis=1))
        m = hmm_score.Model.of(chain.start, chain.follow, chain.emissions(c, dense))
        assert np.allclose(m.emit.sum(axis=1) + chain.new, 1)
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        starts, follows, dense = m.expect([ids[i] for i in order])
        chain.start, chain.follow = (starts + 1) / (starts + 1).sum(), (follows + 1) / (follows + 1).sum(axis=1, keepdims=True)
    chain.hold_back(dense.sum(axis=1), dense[:, c == 1].sum(axis=1))
    want = hmm_score.Model.of(chain.start, chain.follow, chain.emissions(c, dense)).likelihood(ids)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), rel=1e-5)


def test_rounds_keep_two_tables_and_send_no_unknown_words(make, words, monkeypatch):
    import os

    monkeypatch.setattr(hmm_score, "CHUNK_BYTES", 700)
    docs = make([" ".join(words(30, i % 7) + [f"only{i}"]) for i in range(40)])
    sent, paths, inner = [], [], hmm_score.baum_welch

    def round_of(texts, known, own, chain, states, path):
        sent.append(own.where("_c = 0").count())
        out = inner(texts, known, own, chain, states, path)
        paths.append(path)
        counts = [x for x in os.listdir(os.path.dirname(path)) if f"{os.path.dirname(path)}/{x}" in paths]
        assert len(counts) == min(len(paths), 2)
        return out

    monkeypatch.setattr(hmm_score, "baum_welch", round_of)
    got = hmm_score.score_texts(docs, F.col("doc_id") % 4 != 1, rounds=4).collect()
    assert len(got) == 40 and sent == [0] * 4 and len(paths) == 4
    assert all(r.n_tokens - r.n_known == (r.doc_id % 4 == 1) and r.score < 0 for r in got)
