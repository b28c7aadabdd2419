"""Toxicity of documents: a bidirectional gated recurrent network with attention over words and characters.

Each word enters as the embedding of its hash and the mean embedding of its hashed character n-grams; two
gated recurrent layers read a window of words in both directions, attention pools their states, and a
logistic unit scores the window. Every document is scored over all its overlapping windows of WINDOW words, one
from each word on, and the highest counts. Training is in numpy: of a toxic document a window that scores highest is
taken for toxic, of a clean one windows that score highest and others. The others are drawn from all windows, the
highest is looked for every MINE words from a drawn one on.

The sample to learn from is bounded (``max_toxic``, ``max_clean`` rows, ``max_bytes`` each), picked by hash of
the id; the model has a fixed size. Scoring reads whole texts in one narrow stage. Null and empty texts have
one empty window. Labels that are null are not learned from; an id labelled both ways counts as toxic. With
labels of one class only, every score is that class. Repeated rows are scored each; other columns are not
read. Equal sums in training do not depend on partitions, as the sample is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import from_texts, text_bytes, worker_cache

WINDOW, STRIDE = 40, 1
SLIDE = 2048  # neighbouring windows read at a time
MINE = 20  # words between the windows that training looks for the highest among
WORDS, GRAMS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 15, 12, 12, 8
CACHE_WORDS = 300_000
LOOKED = 4096  # windows that training looks for the highest among at a time
PORTION = 4096  # words taken at a time, which bounds memory
STEPS, BATCH, RATE = 700, 64, 0.01
STRIP = b".,;:!?\"'()[]*|-"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(64 - bits)).astype(np.int64) if bits < 64 else h


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word numbers, hashed character n-grams of all words in a row, and where each word's begin."""
    if len(words) > PORTION:
        parts = [features(words[at:at + PORTION]) for at in range(0, len(words), PORTION)]
        before = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])[:-1]])
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                np.concatenate([p[2] + b for p, b in zip(parts, before, strict=True)]))
    bare = [b"<" + (w.strip(STRIP) or w) + b">" for w in words]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    flat = np.frombuffer(b"".join(bare), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(flat), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64))
        word = _mix(np.add.reduceat(flat * power, start) * np.uint64(31) + size.astype(np.uint64), 14)
        at = np.arange(len(flat)) - np.repeat(start, size)
        left = np.repeat(size, size) - at
        grams, owner = [], []
        own = np.repeat(np.arange(len(bare)), size)
        h = np.zeros(len(flat), np.uint64)
        for n in range(1, 7):
            h[:len(flat) - n + 1] = h[:len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1:]
            if n >= 3:
                fits = left >= n
                grams.append(_mix(h[fits] * np.uint64(7) + np.uint64(n), 15))
                owner.append(own[fits])
            elif n == 2:
                fits = (left >= 2) & (size[own] < 3)  # so that every word has an n-gram
                grams.append(_mix(h[fits] * np.uint64(7) + np.uint64(n), 15))
                owner.append(own[fits])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return word, grams[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(bare)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = 2 * DIM, HIDDEN
        normal = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "word": normal(WORDS, DIM, s=0.3), "gram": normal(GRAMS, DIM, s=0.3),
            **{f"x{k}": normal(d, 3 * h, s=d ** -0.5) for k in "fb"}, **{f"h{k}": normal(h, 3 * h, s=h ** -0.5) for k in "fb"},
            **{f"c{k}": np.zeros(3 * h, np.float32) for k in "fb"},
            "att": normal(2 * h, ATTEND, s=(2 * h) ** -0.5), "ask": normal(ATTEND, s=1.0),
            "out": normal(2 * h, s=0.3), "bias": np.array([-1.0], np.float32),
        }

    def embed(self, found) -> np.ndarray:
        word, grams, start = found
        ends = np.append(start[1:], len(grams))
        mean = np.empty((len(word), DIM), self.p["gram"].dtype)
        for at in range(0, len(word), PORTION):
            own, n = start[at:at + PORTION], ends[at:at + PORTION] - start[at:at + PORTION]
            some = self.p["gram"][grams[own[0]:own[-1] + n[-1]]]
            mean[at:at + PORTION] = np.add.reduceat(some, own - own[0]) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], mean], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input sums of words; a last row of zeros stands for no word."""
        p = self.p
        both = np.concatenate([x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"]], axis=1)
        return np.concatenate([both, np.zeros((1, both.shape[1]), both.dtype)])

    def states(self, rows: np.ndarray, idx: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (windows, words, 2 x hidden); ``idx`` counts from 0, -1 for no word."""
        n, t_all = idx.shape
        h = HIDDEN
        out = np.zeros((t_all, n, 2 * h), np.float32)
        real = idx >= 0
        for k, ts in (("f", range(t_all)), ("b", range(t_all - 1, -1, -1))):
            wh, low = self.p[f"h{k}"], 0 if k == "f" else 3 * h
            state = np.zeros((n, h), np.float32)
            trail = []
            for t in ts:
                m = real[:, t, None]
                gx = rows[idx[:, t], low:low + 3 * h]
                gh = state @ wh
                zr = _sigmoid(gx[:, :2 * h] + gh[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(gx[:, 2 * h:] + r * gh[:, 2 * h:])
                now = np.where(m, new + z * (state - new), state)
                if keep is not None:
                    trail.append((t, state, z, r, new, gh[:, 2 * h:], m))
                state = now
                out[t, :, :h] = state if k == "f" else out[t, :, :h]
                if k == "b":
                    out[t, :, h:] = state
            if keep is not None:
                keep.append(trail)
        return out

    def pool(self, states: np.ndarray, idx: np.ndarray):
        a = np.tanh(states @ self.p["att"])
        ask = a @ self.p["ask"] + np.where(idx.T >= 0, 0, -1e9).astype(np.float32)
        ask -= ask.max(axis=0)
        w = np.exp(ask) * (idx.T >= 0)
        w /= np.maximum(w.sum(axis=0), 1e-9)
        context = np.einsum("tn,tnk->nk", w, states)
        return a, w, context, context @ self.p["out"] + self.p["bias"][0]

    def score(self, rows: np.ndarray, idx: np.ndarray, batch: int = 1024) -> np.ndarray:
        out = np.empty(len(idx), np.float64)
        for at in range(0, len(idx), batch):
            part = idx[at:at + batch]
            out[at:at + batch] = _sigmoid(self.pool(self.states(rows, part), part)[3].astype(np.float64))
        return out

    @np.errstate(over="ignore")  # an infinite exponential makes a gate of 0 and a tanh of 1
    def slide(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Scores of all windows, one from each word on, of ``numbers``, which has WINDOW words at least.

        The same as ``score`` on ``window_table``: neighbouring windows read the same input sums one step apart,
        so a step's inputs of all windows are one slice.
        """
        p, h = self.p, HIDDEN
        # Gates are 1 / (1 + exp(-x)) and tanh is 1 - 2 / (1 + exp(2x)): one exponential each, of sums that come scaled.
        scale = np.repeat(np.array([-1, 2], np.float32), [2 * h, h])[:, None]
        turned = {k: np.ascontiguousarray(p[f"h{k}"].T) * scale for k in "fb"}
        # What attention asks of a state and what the state tells, in one product.
        seen = {k: np.concatenate([2 * p["att"][cut].T, p["out"][None, cut]]) for k, cut in (("f", slice(h)), ("b", slice(h, None)))}
        asked = -2 * p["ask"]  # without what is the same for every word
        logits = np.empty(len(numbers) - WINDOW + 1, np.float64)
        for at in range(0, len(logits), SLIDE):
            n = min(SLIDE, len(logits) - at)
            x = np.ascontiguousarray(rows[numbers[at:at + n + WINDOW - 1]].T)
            x *= np.concatenate([scale, scale])
            kept, other = np.empty((WINDOW, ATTEND + 1, n), np.float32), np.empty((ATTEND + 1, n), np.float32)
            ask, told = np.empty((2, WINDOW, n), np.float32)
            sums, new = np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
            gate, own = sums[:2 * h], sums[2 * h:]
            for k, ts, low in (("f", range(WINDOW), 0), ("b", range(WINDOW - 1, -1, -1), 3 * h)):
                state = np.zeros((h, n), np.float32)
                for t in ts:
                    np.matmul(turned[k], state, out=sums)
                    gate += x[low:low + 2 * h, t:t + n]
                    np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                    np.multiply(gate[h:], own, out=new)
                    new += x[low + 2 * h:low + 3 * h, t:t + n]
                    np.exp(new, out=new)
                    new += 1
                    np.divide(-2, new, out=new)
                    new += 1
                    state -= new
                    state *= gate[:h]
                    state += new
                    if k == "f":
                        np.matmul(seen[k], state, out=kept[t])
                        continue
                    np.matmul(seen[k], state, out=other)
                    other += kept[t]
                    told[t] = other[ATTEND]
                    looks = other[:ATTEND]
                    np.exp(looks, out=looks)
                    looks += 1
                    np.reciprocal(looks, out=looks)
                    np.matmul(asked, looks, out=ask[t])
            ask -= ask.max(axis=0)
            np.exp(ask, out=ask)
            logits[at:at + n] = (ask * told).sum(axis=0) / ask.sum(axis=0) + p["bias"][0]
        return _sigmoid(logits)

    def score_windows(self, rows: np.ndarray, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of every window of each document, given as numbers of rows."""
        out: list = [None] * len(docs)
        short = [i for i, d in enumerate(docs) if len(d) <= WINDOW]
        if short:
            for i, s in zip(short, self.score(rows, np.concatenate([window_table(docs[i]) for i in short])), strict=True):
                out[i] = np.array([s])
        long = [i for i, d in enumerate(docs) if len(d) > WINDOW]
        if long:
            # In one run; windows across two documents are left unread.
            scores, at = self.slide(rows, np.concatenate([docs[i] for i in long])), 0
            for i in long:
                out[i] = scores[at:at + len(docs[i]) - WINDOW + 1]
                at += len(docs[i])
        return out

    def gradients(self, found, idx: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x = self.embed(found)
        rows = self.project(x)
        keep: list = []
        states = self.states(rows, idx, keep)
        a, w, context, logit = self.pool(states, idx)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": context.T @ d, "bias": np.array([d.sum()])}
        dc = d[:, None] * p["out"]
        ds = w[:, :, None] * dc
        dw = np.einsum("nk,tnk->tn", dc, states)
        dask = w * (dw - (w * dw).sum(axis=0))
        g["ask"] = np.einsum("tn,tnk->k", dask, a)
        da = dask[:, :, None] * p["ask"] * (1 - a * a)
        g["att"] = np.einsum("tnk,tnj->kj", states, da)
        ds += da @ p["att"].T
        drows = np.zeros_like(rows)
        for k, trail, cut, low in (("f", keep[0], slice(0, h), 0), ("b", keep[1], slice(h, 2 * h), 3 * h)):
            wh, dwh = p[f"h{k}"], np.zeros_like(p[f"h{k}"])
            dh = np.zeros((len(idx), h), np.float32)
            for t, state, z, r, new, ghn, m in reversed(trail):
                dh = dh + ds[t, :, cut]
                own = np.where(m, dh, 0)
                dn = own * (1 - z) * (1 - new * new)
                dz = own * (state - new) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgh = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(drows[:, low:low + 3 * h], idx[:, t], np.concatenate([dz, dr, dn], axis=1))
                dwh += state.T @ dgh
                dh = dh - own + own * z + dgh @ wh.T
            g[f"h{k}"] = dwh
        drows = drows[:-1]
        f, b = drows[:, :3 * h], drows[:, 3 * h:]
        g |= {"xf": x.T @ f, "xb": x.T @ b, "cf": f.sum(axis=0), "cb": b.sum(axis=0)}
        dx = f @ p["xf"].T + b @ p["xb"].T
        word, grams, start = found
        count = np.diff(np.append(start, len(grams)))
        for name, at, d in (("word", word, dx[:, :DIM]), ("gram", grams, np.repeat(dx[:, DIM:] / count[:, None], count, axis=0))):
            touched, back = np.unique(at, return_inverse=True)
            order = np.argsort(back, kind="stable")
            g[name] = touched, np.add.reduceat(d[order], np.searchsorted(back[order], np.arange(len(touched))))
        return g


def window_table(numbers: np.ndarray) -> np.ndarray:
    """Word numbers of every window of one document (one from each word on), -1 where it has no word."""
    n = len(numbers)
    if n <= WINDOW:
        out = np.full((1, WINDOW), -1, np.int32)
        out[0, :n] = numbers
        return out
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)[starts]


def train(texts: list[bytes], toxic: list[int], steps: int = STEPS, seed: int = 11) -> Network:
    """Fit on whole documents that carry one label each."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    numbers = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    names = list(vocab)
    if not names:
        return net
    word, grams, start = features(names)
    ends = np.append(start[1:], len(grams))
    # Every document filled up to a window; a window is known by where it begins.
    filled = [np.pad(n, (0, max(0, WINDOW - len(n))), constant_values=-1) for n in numbers]
    first = np.concatenate([[0], np.cumsum([len(f) for f in filled])[:-1]])
    count = np.array([len(f) - WINDOW + 1 for f in filled])
    joined = np.concatenate(filled)
    y = np.array(toxic)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    # Dense parameters by their moments, embeddings by their summed squares, where a batch touches them.
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    refresh = max(1, steps // 7)
    best = None

    def gathered(begin):
        """Of windows: the features of the words in them, and each window's words as numbers among these (-1: no word)."""
        idx = joined[begin[:, None] + np.arange(WINDOW)]
        used, local = np.unique(idx, return_inverse=True)
        local = local.reshape(idx.shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        size = ends[used] - start[used]
        at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(used) else size
        return (word[used], grams[np.repeat(start[used] - at, size) + np.arange(size.sum())], at), local

    def looked_at(begin):
        """Scores of windows, of whose words only a portion's are held as input sums."""
        found, local = gathered(begin)
        return net.score(net.project(net.embed(found)), local)

    for step in range(steps):
        if step and step % refresh == 0:
            starts = [np.arange(min(rng.integers(MINE), n - 1), n, MINE) for n in count]
            owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
            begin = np.repeat(first, [len(s) for s in starts]) + np.concatenate(starts)
            told = np.concatenate([looked_at(begin[at:at + LOOKED]) for at in range(0, len(begin), LOOKED)])
            order = np.lexsort((-told, owner))
            best = begin[order[np.searchsorted(owner, np.arange(len(starts)))]]
        half = BATCH // 2
        p_docs, n_docs = rng.choice(pos, half), rng.choice(neg, half)
        any_window = lambda d: first[d] + (rng.random(len(d)) * count[d]).astype(np.int64)
        if best is None:
            pick = np.concatenate([any_window(p_docs), any_window(n_docs)])
        else:
            pick = np.concatenate([best[p_docs], best[n_docs[:half // 2]], any_window(n_docs[half // 2:])])
        found, local = gathered(pick)
        if not len(found[0]):
            continue
        g = net.gradients(found, local, np.repeat([1.0, 0.0], half))
        rate = RATE * min(1, (step + 1) / 50) * (1 - 0.9 * step / steps)
        for k, x in net.p.items():
            if isinstance(g[k], tuple):
                at, d = g[k]
                v[k][at] += d * d
                x[at] -= (5 * rate * d / (np.sqrt(v[k][at]) + 1e-6)).astype(np.float32)
                continue
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] * g[k] - v[k])
            x -= (rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts; the input sums of words seen before are kept, up to a bound."""

    def __init__(self, net: Network):
        self.net, self.number, self.rows, self.n = net, {}, None, 0

    def _learn(self, new: list[bytes]):
        if self.n + len(new) > CACHE_WORDS or self.rows is None:
            self.number, self.n = {}, 0
            self.rows = np.zeros((max(CACHE_WORDS, len(new)) + 1, 6 * HIDDEN), np.float32)
        self.rows[self.n:self.n + len(new)] = self.net.project(self.net.embed(features(new)))[:-1]
        self.number.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            part, words, size = [], [], 0
            while at < len(texts) and (not part or size < 60_000):
                part.append(words_of(texts[at]))
                size += len(part[-1])
                at += 1
            wanted = set()
            for w in part:
                wanted.update(w)
            new = [w for w in wanted if w not in self.number]
            if new:
                if self.n + len(new) > CACHE_WORDS:
                    self.number, self.n, new = {}, 0, list(wanted)
                self._learn(new)
            docs = [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in part]
            rows = self.rows if self.rows is not None else np.zeros((1, 6 * HIDDEN), np.float32)
            out.append(np.array([s.max() for s in self.net.score_windows(rows, docs)]))
        return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = 1200, max_clean: int = 1800,
           max_bytes: int = 20_000) -> pd.DataFrame:
    """A bounded sample of labelled rows: ids by hash from the labels alone, then their texts."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    ids = ids.withColumn("_h", F.xxhash64("doc_id"))
    some = ids.where("_y = 1").orderBy("_h", "doc_id").limit(max_toxic).unionByName(
        ids.where("_y <> 1").orderBy("_h", "doc_id").limit(max_clean))
    texts = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes).select("doc_id", text_bytes().alias("_text"))
    # An id with several texts gives the least by hash, settled before anything reaches the driver.
    got = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("_text"), "_text", "_y")).alias("_one")).select("doc_id", "_one._y", "_one._text").toPandas()
    return got.sort_values("doc_id").reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, **bounds):
    """A network, or the one score that the labels leave."""
    rows = sample(docs, labels, **bounds)
    toxic = [int(x == 1) for x in rows["_y"]]
    if len(set(toxic)) < 2:
        return float(toxic[0]) if toxic else 0.0
    return train([bytes(t) for t in rows["_text"]], toxic)


def score(docs: DataFrame, model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add the score of every whole text to the kept columns (all, unless named)."""
    keep = docs.columns if keep is None else keep
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 3 MB, of a fixed size

    def start():
        scorer = worker_cache("toxicity", lambda: Scorer(shared.value), shared.value)
        return lambda texts: {name: scorer(texts)}

    return from_texts(docs, keep, {name: "double"}, start)
