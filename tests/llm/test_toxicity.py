import random

import numpy as np
import pytest

from anontext.llm import toxicity
from anontext.llm.common import held_out

BAD = ["idiot", "scum", "moron"]


def corpus(words, n, seed=0):
    r, vocab = random.Random(seed), words(500, 1)
    out = []
    for i in range(n):
        w, bad = r.choices(vocab, k=r.randint(5, 200)), i % 3 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ",", "."]))
        out.append((" ".join(w), int(bad)))
    return out


def test_gradients_agree_with_differences():
    net = toxicity.Network(seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    found = toxicity.features([b"alpha", b"Beta,", b"c", b"delta"])
    idx = np.array([[0, 1, 2, -1], [3, 1, -1, -1]])
    y = np.array([1.0, 0.0])

    def loss():
        s = net.pool(net.states(net.project(net.embed(found)), idx), idx)[3]
        return -(y * np.log(toxicity._sigmoid(s)) + (1 - y) * np.log(1 - toxicity._sigmoid(s))).mean()

    g = net.gradients(found, idx, y)
    for name in ("xf", "hb", "att", "ask", "out", "cf"):
        flat, at = net.p[name].reshape(-1), 1
        flat[at] += 1e-3
        up = loss()
        flat[at] -= 2e-3
        down = loss()
        flat[at] += 1e-3
        assert np.asarray(g[name]).reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 72, 73, 500):
        table = toxicity.window_table(np.arange(n, dtype=np.int32))
        assert set(table.ravel().tolist()) - {-1} == set(range(n)) and table.shape[1] == toxicity.WINDOW


def test_learns_and_scores_held_out_texts(words):
    data = corpus(words, 240)
    net = toxicity.train([t.encode() for t, _ in data], [y for _, y in data], steps=350)
    test = corpus(words, 150, seed=9)
    score = toxicity.Scorer(net)([t.encode() for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((score >= 0.5) == y).mean() > 0.95
    # Every window counts: one bad word at the end of a very long text.
    long = " ".join(words(500, 1) * 60)
    clean, bad = toxicity.Scorer(net)([long.encode(), (long + " idiot moron scum").encode()])
    assert bad > clean and bad > 0.5


def test_frames(make, spark, words, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    data = corpus(words, 60)
    docs = make([t for t, _ in data] + [None, "", "x" * 50_000, data[0][0]])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 0)))
    got = toxicity.score(docs, model, ["doc_id", "_bytes"]).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[60] == pytest.approx(by[61]) and by[63] == pytest.approx(by[0], abs=1e-5)
    assert toxicity.score(make([]), model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 1")) == 1.0
    assert toxicity.fit(docs, labels.where("false")) == 0.0
    assert {r.score for r in toxicity.score(docs, 0.0).collect()} == {0.0}


def test_every_window_is_scored_and_learned_from(words):
    """A window from each word on, as one by one: a phrase cut by no window that holds it whole."""
    net = toxicity.Network(seed=4)
    texts = [words(n, n) for n in (0, 1, 39, 40, 41, 100, 700)]
    scorer = toxicity.Scorer(net)
    got = scorer([" ".join(t).encode() for t in texts])
    for t, s in zip(texts, got, strict=True):
        own = [w.encode() for w in t]
        each = []
        for at in range(max(1, len(own) - toxicity.WINDOW + 1)):
            part = own[at:at + toxicity.WINDOW]
            rows = net.project(net.embed(toxicity.features(part))) if part else np.zeros((1, 6 * toxicity.HIDDEN), np.float32)
            each.append(net.score(rows, np.array([[*range(len(part))] + [-1] * (toxicity.WINDOW - len(part))]))[0])
        assert s == pytest.approx(max(each), abs=1e-5)
    assert len(toxicity.window_table(np.arange(100, dtype=np.int32))) == 61


def test_sample_does_not_depend_on_partitions(spark):
    rows = [(i % 30, f"text {i} of many") for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [toxicity.sample(docs.repartition(n), labels).to_dict("list") for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and got[0]["doc_id"] == list(range(30))


def test_training_holds_input_sums_of_few_words_at_a_time(words, monkeypatch):
    """Of a vocabulary, only the words of a portion of windows are projected at once; the model is the same."""
    data = [(" ".join([f"{w}{i}" for w in words(60, i)] + ["scum"] * (i % 2)), i % 2) for i in range(150)]
    texts, y = [t.encode() for t, _ in data] + [b"", b" "], [y for _, y in data] + [0, 0]
    whole = toxicity.train(texts, y, steps=14)
    most, project = [], toxicity.Network.project
    monkeypatch.setattr(toxicity, "LOOKED", 25)
    monkeypatch.setattr(toxicity.Network, "project", lambda net, x: most.append(len(x)) or project(net, x))
    parts = toxicity.train(texts, y, steps=14)
    assert max(most) <= max(25, toxicity.BATCH) * toxicity.WINDOW < len({w for t in texts for w in toxicity.words_of(t)})
    assert all(np.allclose(parts.p[k], v, atol=1e-5) for k, v in whole.p.items())


def test_sliding_takes_one_exponential_and_no_other_function(monkeypatch):
    """A step's gates and tanh by one exponential each, also where it overflows; scores stay those of single windows."""
    net = toxicity.Network(seed=6)
    rows = np.concatenate([np.random.default_rng(7).standard_normal((90, 6 * toxicity.HIDDEN)) * 60, np.zeros((1, 6 * toxicity.HIDDEN))])
    rows, numbers = rows.astype(np.float32), np.arange(90, dtype=np.int32)
    want = net.score(rows, toxicity.window_table(numbers))
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "tanh", lambda *a, **k: pytest.fail("tanh is taken"))
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    got = net.slide(rows, numbers)
    assert np.isfinite(got).all() and got == pytest.approx(want, abs=1e-5)
    steps = len(got) * toxicity.WINDOW
    assert sum(taken) <= steps * (6 * toxicity.HIDDEN + toxicity.ATTEND + 1) + len(got)
