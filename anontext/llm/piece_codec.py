"""SentencePiece encoding and decoding that keeps the place of every piece in the source bytes.

A text is normalised by the longest prefix found in the model's compiled character map (an empty map leaves
characters as they are); for every normalised byte the source offset is kept. Pieces are merged best score
first, leftmost on ties, and projected through that alignment to spans of the source.

No vocabulary piece crosses the start of a word mark, and characters that occur in no longer piece stand
alone, so merging works on words; a bounded cache of words makes repeated ones cheap. A vocabulary for which
this does not hold is merged over the whole text.

Null and empty texts give the begin and end ids alone. Repeated rows are encoded each. Other columns are
dropped unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import from_texts, worker_cache

MARK = "▁"
MARK_BYTES = MARK.encode()
CACHE_WORDS = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string",
    "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string",
}


class CharMap:
    """The compiled character map: a double-array trie over source prefixes and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of data[at:], and that prefix's length."""
        units, best = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if (unit >> 8) & 1:
                best = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if best is None:
            return None
        return self.pool[best[0]:self.pool.index(b"\0", best[0])], best[1]


def _char_length(data: bytes, at: int) -> int:
    """Length of the well-formed character at this place, 0 if there is none."""
    lead = data[at]
    n = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
    try:
        data[at:at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n if n and at + n <= len(data) else 0


class PieceCodec:
    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only pair-merging models with the word mark in front")
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.id_of = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        names = {p: i for i, (p, _, _) in enumerate(pieces)}
        self.begin, self.end = names[proto.trainer_spec.bos_piece or "<s>"], names[proto.trainer_spec.eos_piece or "</s>"]
        self.byte_id = [names.get(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        space = " " if self.escape else MARK
        self.surface = [
            b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE
            else (proto.trainer_spec.unk_surface or " ⁇ ").encode() if t == UNKNOWN else p.replace(MARK, space).encode()
            for p, _, t in pieces]
        self.is_byte = np.array([t == BYTE for _, _, t in pieces])
        self.is_control = np.array([t == CONTROL for _, _, t in pieces])
        longer = [p for p in self.id_of if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            self.words = re.compile("(?s).+")
        elif any("\n" in p for p in longer):
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.marked = [t == NORMAL and p.startswith(MARK) for p, _, t in pieces]
        self.width = np.array([1 if t == BYTE else len(p.encode()) for p, _, t in pieces], np.int32)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) its offset in the source."""
        if not self.map.units and not self.squeeze and self.escape:
            try:
                data.decode()
            except UnicodeDecodeError:
                return self._normalise_slowly(data)
            if not data:
                return b"", np.zeros(1, np.int32)
            width = np.ones(len(data), np.int8)
            width[np.frombuffer(data, np.uint8) == 32] = len(MARK_BYTES)
            at = np.repeat(np.arange(len(data), dtype=np.int32), width)
            head = MARK_BYTES if self.prefix else b""
            lead = np.zeros(len(head), np.int32)
            return head + data.replace(b" ", MARK_BYTES), np.concatenate([lead, at, np.array([len(data)], np.int32)])
        return self._normalise_slowly(data)

    def _normalise_slowly(self, data: bytes) -> tuple[bytes, np.ndarray]:
        def prefix(at):
            hit = self.map.longest(data, at)
            if hit is not None:
                return hit
            n = _char_length(data, at)
            return (data[at:at + n], n) if n else ("�".encode(), 1)

        mark = MARK_BYTES if self.escape else b" "
        at = 0
        if self.squeeze:
            while at < len(data):
                made, n = prefix(at)
                if made != b" ":
                    break
                at += n
        if at == len(data):
            return b"", np.zeros(1, np.int32)
        out, where = bytearray(), []
        if self.prefix:
            out += mark
            where += [at] * len(mark)
        after_space = self.squeeze
        while at < len(data):
            made, n = prefix(at)
            if self.squeeze and after_space:
                made = made.lstrip(b" ")
            if made:
                made_space = made.endswith(b" ")
                written = made.replace(b" ", mark)
                out += written
                where += [at] * len(written)
                after_space = made_space
            at += n
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(mark) and out:
                del out[-len(mark):]
                at = where[len(out)]
                del where[len(out):]
        return bytes(out), np.array([*where, at], np.int32)

    def merge(self, word: str) -> list[str]:
        """The pieces of a word: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(word)
        score = self.score.get
        if len(parts) <= 48:
            pairs = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            while True:
                best, at = None, -1
                for i, s in enumerate(pairs):
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    return parts
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at:
                    pairs[at - 1] = score(parts[at - 1] + parts[at])
                if at < len(pairs):
                    pairs[at] = score(parts[at] + parts[at + 1])
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := score(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, b, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def word(self, word: str) -> bytes:
        """The ids of a word, four bytes each, from the older half of the cache or by merging."""
        got = self.older.get(word)
        if got is None:
            ids = []
            for piece in self.merge(word):
                known = self.id_of.get(piece)
                if known is not None:
                    ids.append(known)
                elif self.byte_id:
                    ids += [self.byte_id[b] for b in piece.encode()]
                else:
                    ids.append(self.unk)
            got = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self.cache) >= self.cache_words:
                self.older, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def encode(self, data: bytes, spans: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Ids with begin and end, and where in the source bytes each starts and ends."""
        normal, where = self.normalise(data)
        text, word = normal.decode(), self.word
        ids = []
        found = self.words.findall(text)
        for at in range(0, len(found), 4096):
            get = self.cache.get
            ids.append(b"".join([get(w) or word(w) for w in found[at:at + 4096]]))
        body = np.frombuffer(b"".join(ids), "<u4")
        sizes = None
        if spans or not self.byte_id:
            sizes = self.width[body]
            if not self.byte_id and (body == self.unk).any():
                body, sizes = self._unknown_runs(text, body, sizes)
        ids = np.empty(len(body) + 2, "<u4")
        ids[0], ids[1:-1], ids[-1] = self.begin, body, self.end
        if not spans:
            return ids, None, None
        to = np.zeros(len(body) + 2, np.int32)
        np.cumsum(sizes, out=to[1:-1])
        to[-1] = to[-2]
        start = np.empty_like(to)
        start[0], start[1:] = 0, to[:-1]
        # A spelt-out character is covered by its last byte; those before it are empty, at its start.
        spelt = self.is_byte[ids]
        if spelt.any():
            done = 0
            for i in np.flatnonzero(spelt).tolist():
                if i >= done:
                    lead = normal[start[i]]
                    n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    full = start[i] + n
                    start[i:i + n] = start[i]
                    to[i:i + n - 1] = start[i]
                    to[i + n - 1] = full
                    done = i + n
        return ids, where[start], where[to]

    def _unknown_runs(self, text, body, sizes):
        """Without byte pieces: neighbouring unknown characters are one unknown piece."""
        unknown = body == self.unk
        at = 0
        widths = sizes.copy()
        raw = text.encode()
        for i, u in enumerate(unknown.tolist()):
            if u:
                widths[i] = _char_length(raw, at)
            at += int(widths[i])
        first = np.ones(len(body), bool)
        first[1:] = ~(unknown[1:] & unknown[:-1])
        return body[first], np.add.reduceat(widths, np.flatnonzero(first))

    def decode(self, ids) -> bytes:
        """The text of these ids; bytes that form no character become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        text = np.flatnonzero(~self.is_control[ids])
        if not len(text):
            return b""
        surface, first = self.surface, int(text[0])
        parts = [surface[i] for i in ids.tolist()]
        if (self.prefix or self.squeeze) and self.marked[ids[first]] and parts[first][:1] == b" ":
            parts[first] = parts[first][1:]
        raw = b"".join(parts)
        inside = len(ids) - 1 - int(np.argmax(~self.is_control[ids][::-1])) + 1 - first > len(text)
        try:
            if not inside:
                raw.decode()
                return raw
        except UnicodeDecodeError:
            pass
        out, run, spelt = bytearray(), bytearray(), self.is_byte[ids].tolist()
        for part, of_bytes in [*zip(parts, spelt, strict=True), (b"", False)]:
            if of_bytes:
                run += part
                continue
            at, held = 0, bytes(run)
            while at < len(held):
                n = _char_length(held, at)
                out += held[at:at + n] if n else "\ufffd".encode()
                at += n or 1
            run.clear()
            out += part
        return bytes(out)


def encode_texts(docs: DataFrame, model_path: str, outputs=("n_tokens", "ids", "begins", "ends"), keep=("doc_id",),
                 text: str = "text") -> DataFrame:
    """Encode and decode every text; one narrow stage, no shuffle. ``outputs`` names columns of OUTPUTS.

    The model (half a megabyte, of a fixed size) travels with the tasks. Ids include begin and end.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    spans = {"begins", "ends", "spans_sha256"} & set(outputs)
    decoded = {"decoded", "decoded_sha256"} & set(outputs)

    def row(codec, data):
        ids, begins, ends = codec.encode(data, bool(spans))
        made = {"n_tokens": len(ids), "ids": ids, "begins": begins, "ends": ends}
        if "ids_sha256" in outputs:
            made["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
        if "spans_sha256" in outputs:
            made["spans_sha256"] = hashlib.sha256(begins.tobytes() + ends.tobytes()).hexdigest()
        if decoded:
            text_out = codec.decode(ids)
            made["decoded_sha256"] = hashlib.sha256(text_out).hexdigest()
            if "decoded" in outputs:
                made["decoded"] = text_out.decode()
        return [made[o] for o in outputs]

    def start():
        codec = worker_cache("pieces", lambda: PieceCodec(model), model)
        return lambda texts: dict(zip(outputs, zip(*[row(codec, t) for t in texts], strict=True), strict=True))

    return from_texts(docs, list(keep), {o: OUTPUTS[o] for o in outputs}, start, text)


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and a digest of the spans."""
    return encode_texts(docs.select(F.col("doc_id"), F.col("text")), model_path,
                        ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))
