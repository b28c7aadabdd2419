"""Finding spellings of several words in texts: an automaton over word numbers, and a filter of beginnings.

These are the per-text helpers of ``entities``; Spark deals out the texts and the spellings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD, _GAP = re.compile(r"\w+"), re.compile(r"[\s\-&.,'‐-―]+")

Found = dict[int, tuple[int, str, str | None]]


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    spans = [m.span() for m in _WORD.finditer(text)]
    return [text[a:b].lower() for a, b in spans], spans


def distinct_words(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[list[str]]:
    """The words of columns ``text`` and ``own`` (a text's words as ``words_of`` has them), each once for every ``held`` or so."""
    seen: set[str] = set()
    for batch in batches:
        for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist()):
            seen.update(w.lower() for w in set(_WORD.findall(text or "")))
            seen.update(w for w in own or () if w is not None)
            if len(seen) > held:
                yield list(seen)
                seen.clear()
    yield list(seen)


def joined(text: str, spans: list[tuple[int, int]], at: int) -> bool:
    """Whether only gap characters stand between a word and the one before it."""
    return _GAP.fullmatch(text, spans[at - 1][1], spans[at][0]) is not None


def names_of(own, kind: str | None, entity: str | None) -> tuple[list[str] | None, str | None]:
    """The article's own firm: its words and the entity its name stands for."""
    words = None if own is None else list(own)
    plain = " ".join(words) if words else None
    return words, (entity or plain) if kind == "company" else plain


class Automaton:
    """Aho-Corasick over word numbers: one step a word, whatever the number of spellings.

    States are numbers; a transition is keyed by state and word number together. ``ends`` holds a state's own spelling,
    ``shorter`` the next state down the failure links at which a spelling ends.
    """

    def __init__(self, surfaces: Iterable[tuple[str, str, str | None]]):
        spelled = [(s.split(" "), k, e) for s, k, e in surfaces]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for words, _, _ in spelled for w in words))}
        self.width = max(1, len(self.numbers))
        self.step: dict[int, int] = {}
        self.ends: dict[int, tuple[int, str, str | None]] = {}
        parent, through, depth = [0], [0], [0]
        for words, kind, entity in spelled:
            at = 0
            for n, word in enumerate(words, 1):
                number = self.numbers[word]
                nxt = self.step.get(at * self.width + number)
                if nxt is None:
                    nxt = self.step[at * self.width + number] = len(parent)
                    parent.append(at)
                    through.append(number)
                    depth.append(n)
                at = nxt
            self.ends.setdefault(at, (len(words), kind, entity))
        self.fail, self.shorter = [0] * len(parent), [0] * len(parent)
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[state] > 1:
                self.fail[state] = self._next(self.fail[parent[state]], through[state])
            fail = self.fail[state]
            self.shorter[state] = fail if fail in self.ends else self.shorter[fail]

    def _next(self, state: int, number: int) -> int:
        while True:
            nxt = self.step.get(state * self.width + number)
            if nxt is not None or not state:
                return nxt or 0
            state = self.fail[state]

    def find(self, text: str, words: list[str], spans: list[tuple[int, int]]) -> Found:
        """The longest spelling at each place where one begins."""
        found: Found = {}
        state = 0
        for i, word in enumerate(words):
            number = self.numbers.get(word)
            if number is None:
                state = 0
                continue
            if state and not joined(text, spans, i):
                state = 0
            state = at = self._next(state, number)
            while at:
                if at in self.ends:
                    spelling = self.ends[at]
                    start = i + 1 - spelling[0]
                    if start not in found or found[start][0] < spelling[0]:
                        found[start] = spelling
                at = self.shorter[at]
        return found

    def own(self, words) -> tuple[list[str] | None, str | None]:
        if words is None:
            return None, None
        state = 0
        for word in words:
            number = self.numbers.get(word)
            state = None if number is None or state is None else self.step.get(state * self.width + number)
        _, kind, entity = self.ends.get(state, (0, None, None)) if state else (0, None, None)
        return names_of(words, kind, entity)

    def mask(self, text: str | None, own) -> str | None:
        if text is None:
            return None
        words, spans = words_of(text)
        return replace(text, words, spans, self.find(text, words, spans), self.own(own))


def replace(text: str, words: list[str], spans: list[tuple[int, int]], found: Found, own: tuple[list[str] | None, str | None]) -> str:
    """Labels in place of spellings, from left to right.

    Names of one entity share a number; a name without entity is its own. The article's firm is 1.
    """
    own_words, own_entity = own
    firm = {}
    if own_words:
        size = len(own_words)
        for i, word in enumerate(words):
            if word == own_words[0] and words[i:i + size] == own_words and all(joined(text, spans, j) for j in range(i + 1, i + size)):
                firm[i] = size
    numbers: dict[str, int] = {}
    pieces, done, after = [], 0, 0
    for i in sorted(found.keys() | firm.keys()):
        if i < after:
            continue
        size, kind, entity = found.get(i, (0, "company", None))
        if i in firm and firm[i] >= size:
            label, size = "Company_1", firm[i]
        elif kind == "company":
            entity = entity or " ".join(words[i:i + size])
            label = f"Company_{1 if entity == own_entity else numbers.setdefault(entity, len(numbers) + 2)}"
        else:
            label = f"{kind}_x"
        pieces += [text[done:spans[i][0]], label]
        done, after = spans[i + size - 1][1], i + size
    return "".join(pieces) + text[done:]


class PrefixFilter:
    """Bloom filter of all beginnings of all spellings, by whole words.

    Ten bits a beginning, at most 2^27 bits (16 MB): beyond that more false tails meet the dictionary, and results stay.
    """

    BITS, MOST, HASHES = 10, 1 << 27, 4

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 64

    @staticmethod
    @lru_cache(1 << 16)
    def _word(word: str) -> int:
        return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")

    @classmethod
    def longer(cls, before: int, word: str) -> int:
        """Hash of a beginning with one more word."""
        return ((before * 0x9E3779B97F4A7C15 + cls._word(word)) ^ (before >> 31)) & 0xFFFFFFFFFFFFFFFF

    @classmethod
    def places(cls, beginning: int, size: int) -> list[int]:
        low, high = beginning & 0xFFFFFFFF, beginning >> 32 | 1
        return [(low + k * high) % size for k in range(cls.HASHES)]

    def has(self, beginning: int) -> bool:
        bits, size = self.bits, self.size
        return all(int(bits[p >> 6]) >> (p & 63) & 1 for p in self.places(beginning, size))

    @classmethod
    def of(cls, surfaces: DataFrame) -> PrefixFilter:
        """Built by tasks as 64-bit words, which are merged by OR before the few megabytes reach the driver."""
        beginnings = surfaces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
        size = 64
        while size < min(cls.MOST, cls.BITS * beginnings):
            size *= 2

        def set_bits(batches):
            for batch in batches:
                places = []
                for surface in batch.column("surface").to_pylist():
                    beginning = 0
                    for word in surface.split(" "):
                        beginning = cls.longer(beginning, word)
                        places += cls.places(beginning, size)
                place = np.unique(np.array(places, np.int64))
                block, start = np.unique(place >> 6, return_index=True)
                one = np.left_shift(np.uint64(1), (place & 63).astype(np.uint64))
                bits = np.bitwise_or.reduceat(one, start) if len(block) else one
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], names=["block", "bits"])

        made = surfaces.select("surface").mapInArrow(set_bits, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[made.column("block").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
        return cls(bits)


def tails(text: str | None, beginnings: PrefixFilter) -> Iterator[tuple[int, str]]:
    """(place, words) for every word at which a spelling may begin: as many words as some spelling begins with."""
    if text is None:
        return
    words, spans = words_of(text)
    first = {w: beginnings.has(beginnings.longer(0, w)) for w in set(words)}
    for i, word in enumerate(words):
        if not first[word]:
            continue
        beginning, end = beginnings.longer(0, word), i + 1
        while end < len(words) and joined(text, spans, end):
            beginning = beginnings.longer(beginning, words[end])
            if not beginnings.has(beginning):
                break
            end += 1
        yield i, " ".join(words[i:end])
