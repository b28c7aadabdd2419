"""Passages that stand earlier in the corpus, found by suffix automata and removed word by word.

Every window of ``window`` words has one anchor, the least hashed run of ANCHOR words in it; neighbouring
windows with the same anchor are one segment. Equal windows have equal anchors, so only segments whose anchor
occurs more than once can repeat. Those, with their words, meet by anchor: the distinct segments of a shard of
anchors form the reference, one suffix automaton is built over it in corpus order, and every segment is
streamed through it for matching statistics. Where a window is matched in full, its state's first end tells
whether it starts earlier. Covered words are removed as maximal spans.

An automaton over all text could not be broadcast, so segments travel to their shard instead; each shard
holds the segments of a few anchors with at most HOT occurrences each. Segments of more frequent anchors are
taken window by window and spread by the windows' own digest and a salt, so a passage found in a third of all
documents is judged by many tasks, each keeping one row at a time.

Windows are judged on the input. "Earlier" is by doc_id (nulls last), then a 64-bit hash of the text, then start;
rows with equal id and text are one document and get the same result. Null texts have no words. Documents
shorter than a window lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import small_batches, stored, text_bytes, worker_cache

WINDOW, ANCHOR = 20, 5
HOT = 2_000
SALTS = 64
SHARD_WORDS = 4_000
SLICE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(_MULT, SLICE + 1)
_INVERSE = _powers(np.uint64(pow(int(_MULT), -1, 1 << 64)), SLICE + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the byte at which it starts; sliced so that memory stays bounded."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        if to < len(data):
            gap = max(data.rfind(bytes([c]), at, to) for c in (32, 10, 9, 11, 12, 13))
            if gap < 0:  # one word longer than a slice
                ends = [e for c in (32, 10, 9, 11, 12, 13) if (e := data.find(bytes([c]), to)) >= 0]
                to = min(ends, default=len(data))
                word = data[at:to].lstrip(b" \t\n\v\f\r")
                if word:
                    hashes.append(np.array([int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")], np.uint64))
                    starts.append(np.array([to - len(word)], np.int64))
                at = to
                continue
            to = gap + 1
        part = np.frombuffer(data, np.uint8, to - at, at)
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[:len(part)], dtype=np.uint64)])
            hashes.append(_mix((total[end] - total[start]) * _INVERSE[start] + (end - start).astype(np.uint64)))
        starts.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def segments(texts: list[bytes], window: int = WINDOW, block: int = 1 << 22):
    """Of each run of windows with one anchor: text number, first window, windows, anchor."""
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, side="right")
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    width = window - ANCHOR + 1
    out = [np.zeros((0,), np.int64)] * 4
    if len(hashes) < window:
        return out
    with np.errstate(over="ignore"):
        run = np.zeros(len(hashes) - ANCHOR + 1, np.uint64)
        for j in range(ANCHOR):
            run = run * np.uint64(0x100000001B3) + hashes[j:j + len(run)]
    run = _mix(run)
    parts = []
    for at in range(0, len(hashes) - window + 1, block):
        n = min(block, len(hashes) - window + 1 - at)
        local = np.arange(n + width - 1, dtype=np.uint64)
        # The upper bits decide, then the leftmost; equal windows decide alike wherever they stand.
        key = (run[at:at + n + width - 1] >> np.uint64(24) << np.uint64(24)) | local
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[:n], key[width - span:width - span + n])
        where = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        begin = np.arange(at, at + n)
        whole = doc[begin] == doc[begin + window - 1]
        begin, where = begin[whole], where[whole]
        if not len(begin):
            continue
        new = np.ones(len(begin), bool)
        new[1:] = (where[1:] != where[:-1]) | (begin[1:] != begin[:-1] + 1) | (doc[begin[1:]] != doc[begin[:-1]])
        cut = np.flatnonzero(new)
        own = doc[begin[cut]]
        parts.append((own, begin[cut] - first_word[own], np.diff(np.append(cut, len(begin))),
                      run[at + where[cut]].view(np.int64)))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else out


class SuffixAutomaton:
    """Of several sequences in order; each state knows in which sequence its strings first end."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]

    def add(self, sequence: list[int], number: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(number)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link = self.next, self.link
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = made
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        return made

    def earlier(self, sequence: list[int], number: int, window: int) -> list[int]:
        """Starts of the windows of a sequence that some sequence of a smaller number holds."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                if first[at] < number:
                    out.append(i - window + 1)
        return out


def judge(groups: list[list[tuple]], window: int = WINDOW):
    """(id, hash, first window, windows) of the repeats among the distinct segments of one shard, in order."""
    shard, names = SuffixAutomaton(), {}
    coded, number = [], 0
    for group in groups:
        for d, h, s, text in group:
            sequence = [names.setdefault(w, len(names)) for w in text.split(b" ")]
            shard.add(sequence, number)
            coded.append((d, h, s, number, sequence))
            number += 1
    for d, h, s, number, sequence in coded:
        run = None
        for at in shard.earlier(sequence, number, window):
            if run and run[1] == at:
                run[1] += 1
            else:
                if run:
                    yield d, h, s + run[0], run[1] - run[0]
                run = [at, at + 1]
        if run:
            yield d, h, s + run[0], run[1] - run[0]


def repeated_windows(docs: DataFrame, dealt: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_d, _h, _from, _n): runs of windows that start earlier in the corpus.

    ``docs`` has _d, _h, _bytes and is scanned in place; ``dealt`` has _d, _h, _bytes and is partitioned by those two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches):
        worker_cache("spans", dict)
        for batch in batches:
            texts, at = batch.column("_bytes").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < SLICE):
                    size += len(texts[to])
                    to += 1
                doc, first, count, anchor = segments(texts[at:to], window)
                take = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_d").take(take), batch.column("_h").take(take), pa.array(first.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(anchor)], names=["_d", "_h", "_from", "_n", "_anchor"])
                at = to

    # Scanned twice, to count and to look up, which is cheaper than keeping a row for every seventh word.
    found = docs.select("_d", "_h", "_bytes").mapInArrow(scan, "_d long, _h long, _from int, _n int, _anchor long")
    # Stored, so that both sides of the join are dealt for it alone and Spark can split a common anchor's rows.
    often = stored(found.groupBy("_anchor").agg(F.count("*").alias("_count")).where("_count > 1").select(
        "_anchor", (F.col("_count") > HOT).alias("_hot")), "spans-often")
    marks = found.join(often, "_anchor").groupBy("_d", "_h").agg(
        F.collect_set(F.struct("_from", "_n", "_anchor", "_hot")).alias("_marks"))
    marks = stored(marks, "spans-marks")

    def cut(batches):
        for batch in batches:
            d, h = batch.column("_d").to_pylist(), batch.column("_h").to_pylist()
            rows: list[list] = [[] for _ in range(7)]
            for i, (text, own) in enumerate(zip(batch.column("_bytes").to_pylist(), batch.column("_marks").to_pylist(), strict=True)):
                words = text.split()
                for mark in own:
                    s, k = mark["_from"], mark["_n"]
                    steps = range(s, s + k) if mark["_hot"] else (s,)
                    for at in steps:
                        size = 1 if mark["_hot"] else k
                        piece = b" ".join(words[at:at + size + window - 1])
                        route = mark["_anchor"]
                        if mark["_hot"]:
                            salt = bytes([(d[i] * 31 + h[i]) % SALTS])
                            route = int.from_bytes(hashlib.blake2b(piece, digest_size=8, salt=salt).digest(), "little", signed=True)
                        for column, value in zip(rows, (d[i], h[i], at, size, mark["_hot"], route, piece), strict=True):
                            column.append(value)
                if len(rows[0]) > 5_000:
                    yield batch_of(rows)
                    rows = [[] for _ in range(7)]
            if rows[0]:
                yield batch_of(rows)

    names = ["_d", "_h", "_from", "_n", "_hot", "_route", "_piece"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(r, type=k) for r, k in zip(rows, kinds, strict=True)], names=names)

    # Every column goes along, so that the plan has one exchange of texts, here and where spans are removed.
    items = dealt.join(marks, ["_d", "_h"]).mapInArrow(cut, "_d long, _h long, _from int, _n int, _hot boolean, _route long, _piece binary")
    items = items.repartition(n, "_route").sortWithinPartitions("_route", "_piece", "_d", "_h", "_from")

    out_names = ["_d", "_h", "_from", "_n", "_first"]

    def weigh(batches):
        """Equal segments follow each other in corpus order: all but the first repeat. Then the automaton."""
        rows: list[list] = [[] for _ in range(5)]

        def put(d, h, s, k, first=None):
            for column, value in zip(rows, (d, h, s, k, first), strict=True):
                column.append(value)

        def flush():
            nonlocal rows
            made = pa.RecordBatch.from_arrays(
                [pa.array(r, type=k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=out_names)
            rows = [[] for _ in range(5)]
            return made

        route = held = place = None
        group: list[tuple] = []
        shard: list[list[tuple]] = []
        words = 0

        def close():
            nonlocal group, shard, words
            if len(group) > 1:
                group.sort()
                shard.append(group)
                words += sum(len(g[3]) for g in group) // 6
            group = []
            if words > SHARD_WORDS:
                settle()

        def settle():
            nonlocal shard, words
            for repeat in judge(shard, window):
                put(*repeat)
            shard, words = [], 0

        for batch in batches:
            for d, h, s, k, hot, r, piece in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if r != route:
                    close()
                    route, held, place = r, None, None
                if piece != held:
                    held, place = piece, (d, h, s)
                    if hot:
                        put(d, h, s, k, hashlib.blake2b(piece, digest_size=16).digest())
                    else:
                        group.append((d, h, s, piece))
                elif (d, h, s) != place:
                    put(d, h, s, k)
            if len(rows[0]) > 5_000:
                yield flush()
        close()
        settle()
        yield flush()

    weighed = items.mapInArrow(weigh, "_d long, _h long, _from int, _n int, _first binary")
    # The first of a hot window in each salt: at most SALTS rows a window, of which one is the first of all.
    alone = F.col("_first").isNull()
    own = ["_first", *(F.when(alone, F.col(c)) for c in ("_d", "_h", "_from"))]
    place = F.row_number().over(Window.partitionBy(*own).orderBy("_d", "_h", "_from"))
    return weighed.withColumn("_place", place).where("_first IS NULL OR _place > 1").select("_d", "_h", "_from", "_n")


def place() -> list:
    """A document's place in the corpus order (_d, _h) and its bytes."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return [ident.alias("_d"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("_h"), text_bytes().alias("_bytes")]


def covered(count: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(count + 1, np.int64)
    for s, k in spans:
        edge[s] += 1
        edge[min(count, s + k + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, keep: list[str], outputs: dict[str, str], window: int = WINDOW) -> DataFrame:
    """The kept columns and, of ``outputs``: n_words, n_removed, kept (the words left, joined by one space),
    kept_sha256, and text (the kept words if any were removed, else the text as it was)."""
    from anontext.llm.common import ARROW

    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *place())
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "_d", "_h")
    repeats = repeated_windows(docs.select(*place()), rows, window).groupBy("_d", "_h").agg(
        F.collect_list(F.struct("_from", "_n")).alias("_spans"))
    joined = rows.join(repeats, ["_d", "_h"], "left")

    def run(batches):
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for data, spans in zip(batch.column("_bytes").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                words, gone = data.split(), 0
                total = len(words)
                if spans:
                    lost = covered(total, [(x["_from"], x["_n"]) for x in spans], window)
                    gone = int(lost.sum())
                    words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                row = {"n_words": total, "n_removed": gone, "kept": kept.decode() if "kept" in made else None,
                       "text": (kept if gone else data).decode() if "text" in made else None,
                       "kept_sha256": hashlib.sha256(kept).hexdigest() if "kept_sha256" in made else None}
                for o in made:
                    made[o].append(row[o])
            yield pa.RecordBatch.from_arrays(
                [batch.column(f"k{i}") for i in range(len(keep))] + [pa.array(made[o], type=ARROW[t]) for o, t in outputs.items()],
                names=[*[f"k{i}" for i in range(len(keep))], *outputs])

    schema = ", ".join([*kinds, *(f"`{o}` {t}" for o, t in outputs.items())])
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *outputs)


SQL = f"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS ws
           FROM documents),
c AS (SELECT doc_id, CASE WHEN ws = [''] THEN [] ELSE ws END AS ws FROM w),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM c),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM r WHERE nth > 1),
k AS (SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id)
SELECT c.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(gone, j)]
              END, ' ')) AS kept_sha256
FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""
