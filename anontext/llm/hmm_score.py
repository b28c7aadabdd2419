"""A hidden Markov language model over the corpus, and the exact likelihood of every text under it.

Latent states follow one another and emit words: every word seen in training has an expected count of its own
in every state, kept as a table by word, however many words there are. What a state gives to words seen once is
also what it holds back for unknown words, which are one event, as they are for the base. Baum-Welch counts are
gathered on all training texts by chunk and added up by word in Spark. Training and scoring both take every text
as one sequence, however long; training keeps forward states at a few edges and goes back stretch by stretch.

Words meet by word, not by text: each task turns its texts into numbers of a dictionary of its own and sends
that dictionary's words once per chunk of texts. In every round the counts of those seen in training come back to the chunk by
word, and the chunk's expected counts leave by word; the counts of two rounds are kept. The driver holds starts, follows and two sums per state.

A-Z is lower-cased; words are runs without 0x20 and 0x09-0x0D; every text has one more token, its end, so
null and empty texts are one token. Repeated rows are scored each. Without training texts, every word is
unknown and the score equals the base. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import scratch_path, settings, small_batches, stored, text_bytes

STATES = 8
ROUNDS = 4
HELD = 1_000_000  # tokens whose states a task holds at a time
CHUNK_BYTES = 16 << 20
PRIOR = 20  # tokens of the base that each state has besides its own
END = b""  # no word is empty


def numbered(docs: DataFrame, train: Column) -> DataFrame:
    """Rows of texts as numbers (ids) and of each chunk's words (word, local number, training count)."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", train.alias("_train"), text_bytes().alias("_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "_train", "_chunk", "_ids", "_n", "_word", "_local", "_seen"]

    def run(batches):
        task, chunk, size = TaskContext.get().partitionId(), 0, 0
        numbers: dict[bytes, int] = {END: 0}
        seen: list[int] = [0]
        pack = zstandard.ZstdCompressor(level=1).compress

        def words(doc_type):
            name = (task << 24) + chunk
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, doc_type), pa.nulls(n, pa.bool_()), pa.array([name] * n, pa.int64()), pa.nulls(n, pa.binary()),
                 pa.nulls(n, pa.int64()), pa.array(list(numbers), pa.binary()), pa.array(range(n), pa.int32()),
                 pa.array(seen, pa.int64())], names=fields)

        doc_type = None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            texts, train_ = batch.column("_bytes").to_pylist(), batch.column("_train").to_pylist()
            at = 0
            while at < len(texts):
                ids, count, begin = [], [], at
                while at < len(texts) and size < CHUNK_BYTES:
                    own = texts[at].lower().split()
                    own.append(END)
                    for w in own:
                        if w not in numbers:
                            numbers[w] = len(numbers)
                    coded = np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))
                    if train_[at]:
                        if len(seen) < len(numbers):
                            seen.extend([0] * (len(numbers) - len(seen)))
                        for i, k in zip(*np.unique(coded, return_counts=True), strict=True):
                            seen[i] += int(k)
                    ids.append(pack(coded.tobytes()))
                    count.append(len(own))
                    size += len(texts[at]) + 1
                    at += 1
                n = at - begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, n), batch.column("_train").slice(begin, n),
                     pa.array([(task << 24) + chunk] * n, pa.int64()), pa.array(ids, pa.binary()), pa.array(count, pa.int64()),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=fields)
                if size >= CHUNK_BYTES:
                    seen.extend([0] * (len(numbers) - len(seen)))
                    yield words(doc_type)
                    numbers, seen, size, chunk = {END: 0}, [0], 0, chunk + 1
        if size:
            seen.extend([0] * (len(numbers) - len(seen)))
            yield words(doc_type)

    return source.mapInArrow(run, f"doc_id {kind}, _train boolean, _chunk long, _ids binary, _n long, _word binary, _local int, _seen long")


class Model:
    """Start, follow and emission probabilities; ``base`` is the smoothed share of each symbol."""

    def __init__(self, base: np.ndarray, once: slice, unknown: int, states: int = STATES, seed: int = 5):
        r = np.random.default_rng(seed)
        self.base, self.once, self.unknown, self.k = base, once, unknown, states
        self.start = np.full(states, 1 / states)
        self.follow = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.follow, 0.9)
        self.follow /= self.follow.sum(axis=1, keepdims=True)
        self.emit = self._held_back(base * r.gamma(2.0, 0.5, (states, len(base))))

    def _held_back(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.copy()
        counts[:, self.unknown] = 0
        total = counts.sum(axis=1, keepdims=True)
        p = (counts + PRIOR * self.base) / (total + PRIOR)
        p[:, self.unknown] = 0
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        new = np.clip(p[:, self.once].sum(axis=1, keepdims=True), self.base[self.unknown], 0.5)
        p *= 1 - new
        p[:, self.unknown] = new[:, 0]
        return p

    @classmethod
    def of(cls, start: np.ndarray, follow: np.ndarray, emit: np.ndarray) -> Model:
        """A model of one chunk's words."""
        out = object.__new__(cls)
        out.start, out.follow, out.emit, out.k = start, follow, emit, len(start)
        return out

    def learn(self, start, follow, emit) -> Model:
        out = object.__new__(Model)
        out.base, out.once, out.unknown, out.k = self.base, self.once, self.unknown, self.k
        out.start = (start + 1) / (start + 1).sum()
        out.follow = (follow + 1) / (follow + 1).sum(axis=1, keepdims=True)
        out.emit = out._held_back(emit)
        return out

    def expect(self, texts: list[np.ndarray], held: int = HELD):
        """Expected starts, follows and emissions of whole sequences, longest first, each of at least one symbol.

        All sequences step together. Time is cut into stretches of about ``held`` live tokens; a first pass keeps the forward states
        at the edges of stretches only, then each stretch, the last one first, is run forward again and backward.
        """
        size = np.array([len(x) for x in texts])
        flat, begin = np.concatenate(texts), np.concatenate([[0], np.cumsum(size)[:-1]])
        t_all = int(size[0])
        live = np.searchsorted(-size, -np.arange(1, t_all + 1), side="right")
        done = np.concatenate([[0], np.cumsum(live)])  # tokens before each step, in order of steps
        edges = [0]
        while edges[-1] < t_all:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(done, done[edges[-1]] + held, side="right")) - 1))
        emit, follow = np.ascontiguousarray(self.emit.T), self.follow

        def forward(t, a, out=None, scale=None):
            m = live[t]
            a = (a[:m] @ follow if t else self.start) * emit[flat[begin[:m] + t]]
            s = a.sum(axis=1)
            a = a / s[:, None]
            if out is not None:
                out[:], scale[:] = a, s
            return a

        kept, a = [None], None  # the state that each stretch goes on from
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            for t in range(lo, hi):
                a = forward(t, a)
            kept.append(a)
        follows, emits = np.zeros((self.k, self.k)), np.zeros(self.emit.shape)
        b = np.ones((live[-1], self.k))
        after = None  # the first step of the stretch behind: its emissions, backward chances and scale in one
        for at in range(len(edges) - 2, -1, -1):
            lo, hi = edges[at], edges[at + 1]
            first = done[lo]
            alpha, scale = np.empty((done[hi] - first, self.k)), np.empty(done[hi] - first)
            symbols = np.empty(len(alpha), flat.dtype)
            a = kept.pop()
            for t in range(lo, hi):
                own = slice(done[t] - first, done[t + 1] - first)
                symbols[own] = flat[begin[:live[t]] + t]
                a = forward(t, a, alpha[own], scale[own])
            for t in range(hi - 1, lo - 1, -1):
                m, own = live[t], slice(done[t] - first, done[t + 1] - first)
                if after is not None:
                    follows += alpha[own][:len(after)].T @ after
                    b = after @ follow.T
                if len(b) < m:
                    b = np.concatenate([b, np.ones((m - len(b), self.k))])
                after = emit[symbols[own]] * b / scale[own, None]
                alpha[own] *= b
            for j in range(self.k):
                emits[j] += np.bincount(symbols, alpha[:, j], minlength=emits.shape[1])
        return alpha[:live[0]].sum(axis=0), follows * follow, emits

    def likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each whole sequence of symbols, which has at least one."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        out = np.zeros(len(texts))
        emit, follow = np.ascontiguousarray(self.emit.T), self.follow
        at = 0
        while at < len(order):
            to = max(at + 1, min(len(order), at + max(64, 2_000_000 // len(texts[order[at]]))))
            part = [texts[i] for i in order[at:to]]
            size = np.array([len(p) for p in part])
            flat, begin = np.concatenate(part), np.concatenate([[0], np.cumsum(size)[:-1]])
            live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
            total, a = np.zeros(len(part)), None
            for t in range(size[0]):
                m = live[t]
                e = emit[flat[begin[:m] + t]]
                a = self.start * e if a is None else (a[:m] @ follow) * e
                s = a.sum(axis=1)
                a = a / s[:, None]
                total[:m] += np.log10(s)
            out[order[at:to]] = total
            at = to
        return out


def _plain(ids: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(ids), kind)


class Chain:
    """Starts, follows and what turns a word's counts into its emissions; the counts themselves are a table."""

    def __init__(self, states: int, norm: float, once: float):
        self.norm, self.once = norm, once  # of the base: its divisor, and the share of words seen once
        self.start = np.full(states, 1 / states)
        self.follow = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.follow, 0.9)
        self.follow /= self.follow.sum(axis=1, keepdims=True)

    def hold_back(self, total: np.ndarray, once: np.ndarray) -> Chain:
        """From each state's count of all words and of words seen once."""
        unknown = 0.5 / self.norm
        whole = total + PRIOR * (1 - unknown)
        self.new = np.clip((once + PRIOR * self.once) / whole, unknown, 0.5)
        self.factor = (1 - self.new) / whole
        return self

    def emissions(self, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p = (counts + PRIOR * (c + 0.5) / self.norm) * self.factor[:, None]
        p[:, c == 0] = self.new[:, None]
        return p


def encoded(docs: DataFrame, train: Column):
    """Texts as numbers, each chunk's words with their training counts, and the number of training tokens and words."""
    both = stored(numbered(docs, train), "lm-numbers")
    # A word has a row per chunk, so no word's rows outweigh a partition; one of them leads.
    by_word = Window.partitionBy("_word")
    words = both.where("_word IS NOT NULL").select("_chunk", "_word", "_local", "_seen")
    words = words.withColumn("_c", F.sum("_seen").over(by_word)).withColumn(
        "_lead", F.row_number().over(by_word.orderBy("_chunk")) == 1).drop("_seen")
    words = stored(words, "lm-words")
    total = words.where("_lead AND _c > 0").agg(F.sum("_c"), F.count("*"), F.count(F.when(F.col("_c") == 1, 1))).first()
    return both.where("_word IS NULL").select("doc_id", "_train", "_chunk", "_ids", "_n"), words, int(total[0] or 0), int(total[1]), int(total[2])


def first_counts(words: DataFrame, states: int, norm: float, seed: int = 5) -> DataFrame:
    """The words with a drawn count in every state: their base times a gamma of shape 2 and mean 1."""
    def uniform(*of):
        return (F.pmod(F.xxhash64("_word", *map(F.lit, of)), F.lit(1 << 53)) + 0.5) / float(1 << 53)

    base = F.when(F.col("_c") > 0, (F.col("_c") + 0.5) / norm).otherwise(0.0)
    return words.withColumns({f"n{k}": (base * -0.5 * (F.log(uniform(seed, k, 0)) + F.log(uniform(seed, k, 1)))).cast("float")
                              for k in range(states)})


def _sums(counts: DataFrame, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each state, the count of all words and of those seen once."""
    named = [F.sum(F.col(f"n{k}").cast("double")) for k in range(states)]
    once = [F.sum(F.when(F.col("_c") == 1, F.col(f"n{k}").cast("double"))) for k in range(states)]
    got = np.array([x or 0.0 for x in counts.agg(*named, *once).first()])
    return got[:states], got[states:]


def _in_order(right: pa.Table, ids: list[np.ndarray], states: int):
    """A chunk's words by their local numbers: row, training count, and counts by state; words without a row are unknown."""
    local = right.column("_local").to_numpy()
    size = 1 + max([int(local.max(initial=-1)), *(int(i.max()) for i in ids)])
    row, c, counts = np.full(size, -1), np.zeros(size, np.int64), np.zeros((states, size))
    row[local] = np.arange(len(local))
    c[local] = right.column("_c").to_numpy()
    for k in range(states):
        counts[k, local] = right.column(f"n{k}").to_numpy()
    return row, c, counts


def _written(counts: DataFrame, path: str) -> DataFrame:
    """Written in the place of the table that lay there."""
    spark = counts.sparkSession
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        counts.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(counts.schema).parquet(path)


def baum_welch(texts: DataFrame, words: DataFrame, own: DataFrame, chain: Chain, states: int, path: str) -> tuple[DataFrame, Chain]:
    """One round: every chunk's expected counts, added up by word; ``own`` are the words with their counts.

    ``words`` are those seen in training. The counts go to ``path``; ``own`` must not be read from there.
    """
    fields = ["_kind", "_word", "_c", *(f"n{k}" for k in range(states))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = sorted((_plain(raw, np.int32) for raw in left.column("_ids").to_pylist()), key=len, reverse=True)
        row, c, counts = _in_order(right, ids, states)
        m = Model.of(chain.start, chain.follow, chain.emissions(c, counts))
        sums = m.expect(ids) if ids else (np.zeros(states), np.zeros((states, states)), np.zeros(counts.shape))
        some = np.flatnonzero(sums[2].any(axis=0))
        flat = np.concatenate([sums[0][:, None], sums[1].T, sums[2][:, some]], axis=1)  # a column of starts, one of follows per state
        kind = np.concatenate([np.arange(states + 1), np.full(len(some), -1)]).astype(np.int32)
        named = pa.concat_arrays([pa.nulls(states + 1, pa.binary()),
                                  right.column("_word").combine_chunks().take(pa.array(row[some])).cast(pa.binary())])
        return pa.table([pa.array(kind), named, pa.array(np.concatenate([np.zeros(states + 1, np.int64), c[some]])),
                         *(pa.array(flat[k]) for k in range(states))], names=fields)

    got = texts.where("_train").groupBy("_chunk").cogroup(own.groupBy("_chunk")).applyInArrow(
        run, "_kind int, _word binary, _c long, " + ", ".join(f"n{k} double" for k in range(states)))
    got = got.groupBy("_kind", "_word").agg(F.max("_c").alias("_c"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(states)])
    # Sums of words are kept as floats; those of starts and follows, a row for each state and one, as they are.
    got = _written(got.select("_kind", "_word", "_c", *[F.col(f"n{k}").cast("float").alias(f"n{k}") for k in range(states)], *[
        F.when(F.col("_kind") >= 0, F.col(f"n{k}")).alias(f"d{k}") for k in range(states)]), path)
    rest = np.zeros((states + 1, states))
    for r in got.where("_kind >= 0").collect():
        rest[r["_kind"]] = [r[f"d{k}"] for k in range(states)]
    counts = got.where("_kind < 0").select("_word", "_c", *[f"n{k}" for k in range(states)])
    after = Chain(states, chain.norm, chain.once).hold_back(*_sums(counts, states))
    after.start = (rest[0] + 1) / (rest[0] + 1).sum()
    after.follow = (rest[1:] + 1) / (rest[1:] + 1).sum(axis=1, keepdims=True)
    back = words.join(counts.drop("_c"), "_word", "left").select("_chunk", "_word", "_local", "_c", *[
        F.coalesce(f"n{k}", F.lit(0.0).cast("float")).alias(f"n{k}") for k in range(states)])
    return back, after


def score_texts(docs: DataFrame, train: Column, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, _train for every row."""
    texts, words, n, v, once = encoded(docs, train)
    norm = n + 0.5 * (v + 1)
    known = words.where("_c > 0")  # the others have no counts to send
    own, chain = first_counts(known, states, norm), None
    if n:
        chain = Chain(states, norm, once * 1.5 / norm).hold_back(*_sums(own.where("_lead"), states))
        # A round reads the counts of the one before, and takes the place of those before that.
        paths = [scratch_path(docs.sparkSession, "lm-counts") for _ in range(2)]
        for turn in range(rounds):
            own, chain = baum_welch(texts, known, own, chain, states, paths[turn % 2])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = [_plain(x, np.int32) for x in left.column("_ids").to_pylist()]
        _, c, counts = _in_order(right, ids, states)
        log_p = np.log10((c + 0.5) / norm)
        base = np.array([float(log_p[i].sum()) for i in ids])
        score = base if chain is None else Model.of(chain.start, chain.follow, chain.emissions(c, counts)).likelihood(ids)
        return pa.table({
            "doc_id": left.column("doc_id"), "n_tokens": left.column("_n"),
            "n_known": pa.array([int((c[i] > 0).sum()) for i in ids], pa.int64()),
            "train_tokens": pa.array([n] * len(ids), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()), "_train": left.column("_train")})

    own = own.select("_chunk", "_local", "_c", *[f"n{k}" for k in range(states)])
    return texts.groupBy("_chunk").cogroup(own.groupBy("_chunk")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, _train boolean")
