"""Documents packed into sequences of a fixed number of tokens by bulk-synchronous best fit.

Documents are tokenised and cut into pieces; only those longer than a sequence are cut. Full pieces are
sequences by themselves. The others are range-sorted by size, which gives each its rank among those of its
size. In each round the gaps that the last one has changed are range-sorted and ranked likewise; every piece
meets the smallest gap that takes it, its successor, and where several want gaps of one size, ranks decide
who gets which. Then the gaps are updated, and the round is repeated. Sequences are opened only for pieces
that no gap takes.

Sizes are whole numbers up to the capacity, so who meets whom is settled on the number of pieces of each size
(at most the capacity's number of counts, whatever the corpus); rows are sorted, ranked and matched by size
and rank on the executors.

Null and empty texts are one end token. Repeated rows are packed each; null ids are carried. An empty table
gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import small_batches, stored, text_bytes, worker_cache

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 400_000
RUN = 1 << 16  # sequences that one row of a plan opens at a time


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class WordIds:
    """Ids of whole texts from a bounded, two-generation cache of white-space separated words."""

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.spelt = byte_letters()
        self.layouts = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.new, self.old, self.limit = {}, {}, cache_words
        self.stops = {k[0]: v for k, v in self._code([b",", b"."]).items()}

    def _code(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Lower-case words of letters alone are one token group, which skips normalising and splitting."""
        made, tokenize, spelt, layouts = {}, self.tokenizer.model.tokenize, self.spelt, self.layouts
        for w in words:
            text = w.decode()
            plain = text.isascii()
            if text.isalpha() and text.islower() and (plain or is_normalized("NFC", text)):
                if not plain:
                    text = w.decode("latin-1").translate(spelt)
                ids = [t.id for t in tokenize(text)]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            made[w] = layouts[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
        return made

    def _learn(self, missing: set[bytes]) -> None:
        new, old, stops = self.new, self.old, self.stops
        bare, ends = set(), []
        for w in missing:
            got = old.get(w)
            if got is not None:
                new[w] = got
            elif w[-1] in stops and w[-2:-1].isalpha() and b"<|" not in w:
                ends.append(w)
                if w[:-1] not in new:
                    bare.add(w[:-1])
            else:
                bare.add(w)
        known = [w for w in bare if w in old]
        for w in known:
            new[w] = old[w]
        bare.difference_update(known)
        new.update(self._code(list(bare)))
        for w in ends:
            new[w] = new[w[:-1]] + stops[w[-1]]

    def encode(self, texts: list[bytes]):
        """The ids of each text, four bytes each.

        The tokenizer drops white space and folds case, so words stand alone and A-Z can be folded before;
        one comma or full stop after an ASCII letter is a token by itself. Texts that may hold a special
        token keep their case.
        """
        for at in range(0, len(texts), 64):
            words = [(t if b"<|" in t else t.lower()).split() for t in texts[at:at + 64]]
            get = self.new.get
            rows = [list(map(get, w)) for w in words]
            missing = set()
            for w, row in zip(words, rows, strict=True):
                if None in row:
                    missing.update([x for x, r in zip(w, row, strict=True) if r is None])
            if missing:
                self._learn(missing)
            new = self.new
            for w, row in zip(words, rows, strict=True):
                yield b"".join([r or new[x] for x, r in zip(w, row, strict=True)] if None in row else row)
            if len(self.new) > self.limit:
                self.old, self.new = self.new, {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut where too long."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one tokenizer file of a fixed size
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        coder = worker_cache("best fit", lambda: WordIds(shared.value), shared.value)
        for batch in batches:
            row, number, length, crc = [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column("_text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at:at + capacity * 4]
                    row.append(i)
                    number.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = np.array(number, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number.astype(np.int32)),
                 pa.array(number * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", text_bytes().alias("_text")).mapInArrow(run, schema)


def ranked(df: DataFrame, size: str, ident: str, label: str) -> DataFrame:
    """Range-sort by size and number the rows of each size from 0 as ``_rank``; a common size spans many parts."""
    sorted_ = stored(df.repartitionByRange(F.desc(size), F.col(ident)).withColumn("_part", F.spark_partition_id()), label)
    before = Window.partitionBy(size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy(size, "_part").count().select(
        F.col(size).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    here = F.row_number().over(Window.partitionBy(size, "_part").orderBy(ident)) - 1
    out = sorted_.withColumn("_here", here).join(counts, (F.col(size) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("_rank", F.col("_from") + F.col("_here")).drop("_s", "_p", "_part", "_from", "_here")


def sweep(left: dict[int, int], capacity: int) -> tuple[list[tuple], dict[int, list[tuple]]]:
    """Best fit, largest first, over the number of pieces of each size: who opens, and who meets in which round.

    opened: (sequences, piece size, first piece rank, pieces per sequence, pieces). rounds: for each round,
    (gap size, first gap rank, gaps, piece size, first piece rank, pieces per gap, pieces), where the gaps are
    those that the round before has changed. A gap takes as many pieces of one size as fit, so what is left of
    it is less than half, and there are at most about log2(capacity) rounds.
    """
    opened, rounds = [], {}
    free: dict[int, dict[int, int]] = {}
    used: Counter = Counter()

    def fill(gap, size, each, n, pieces_, made_in):
        full = pieces_ // each
        for rest, k in ((gap - each * size, full), (gap - (pieces_ - full * each) * size, n - full)):
            if rest and k:
                own = free.setdefault(rest, {})
                own[made_in] = own.get(made_in, 0) + k

    for size in sorted(left, reverse=True):
        todo, first = left[size], 0
        for gap in sorted(g for g in free if g >= size):
            each = gap // size
            for made_in in sorted(free[gap]):
                if not todo:
                    break
                n = min(free[gap][made_in], -(-todo // each))
                got = min(todo, n * each)
                rounds.setdefault(made_in, []).append((gap, used[gap, made_in], n, size, first, each, got))
                used[gap, made_in] += n
                free[gap][made_in] -= n
                if not free[gap][made_in]:
                    del free[gap][made_in]
                fill(gap, size, each, n, got, made_in + 1)
                first, todo = first + got, todo - got
            if not free[gap]:
                del free[gap]
        if todo:
            each = capacity // size
            n = -(-todo // each)
            opened.append((n, size, first, each, todo))
            fill(capacity, size, each, n, todo, 1)
    return opened, rounds


def opening(plan: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each ``_seq`` from ``_from`` up to ``_to``, made from the plan's rows without a join.

    Ranges are cut into runs first and these are dealt to all tasks, so no task makes more than its share.
    """
    n = max(1, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = plan.withColumn("_run", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(run).cast("long"))))
    last = F.least(F.col("_run") + run, F.col("_to")) - 1
    return runs.repartition(n, "_run").withColumn("_seq", F.explode(F.sequence(F.col("_run"), last))).drop("_run")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to capacity."""
    spark = items.sparkSession
    items = stored(items.withColumn("_id", F.monotonically_increasing_id()), "pack-items")
    loose = stored(ranked(items.where(F.col("length") < capacity).select("_id", "length"), "length", "_id", "pack-sorted"),
                   "pack-ranked")
    sizes = {r["length"]: r["count"] for r in loose.groupBy("length").count().collect()}  # at most capacity rows
    opened, rounds = sweep(sizes, capacity)
    full = items.where(F.col("length") >= capacity).select(
        *items.columns, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not opened:
        return full.drop("_id")

    def filled(rows, gap, rank):
        """How many pieces each row takes, of which size and from which rank on."""
        own = (rank - F.col("_from")) * F.col("_each")
        n = F.least(F.col("_each"), F.col("_pieces") - own)
        return rows.select("_seq", (gap - n * F.col("_size")).alias("_gap"), "_size", (F.col("_first") + own).alias("_lo"),
                           n.alias("_n"), (F.lit(capacity) - gap).alias("_at"))

    # The plans are bounded by the capacity: a row for each pair of a piece size and a gap size that meet.
    plan, at = [], 0
    for n, size, first, each, pieces_ in opened:
        plan.append((at, at + n, size, first, each, pieces_))
        at += n
    columns = "_from long, _to long, _size long, _first long, _each long, _pieces long"
    state = stored(filled(opening(spark.createDataFrame(plan, columns)), F.lit(capacity).cast("long"), F.col("_seq")), "pack-round")
    placed = [state]
    for k in sorted(rounds):
        plan = spark.createDataFrame([(g, f, f + n, s, p, e, m) for g, f, n, s, p, e, m in rounds[k]], f"_g long, {columns}")
        gaps = ranked(state.where("_gap > 0").select("_seq", "_gap"), "_gap", "_seq", "pack-gaps")
        rows = gaps.join(F.broadcast(plan), (F.col("_gap") == F.col("_g")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")))
        state = stored(filled(rows, F.col("_gap"), F.col("_rank")), "pack-round")
        placed.append(state)
    moved = placed[0]
    for p in placed[1:]:
        moved = moved.unionByName(p)
    moved = moved.select(F.col("_seq").alias("sequence_id"), F.col("_size").alias("_length"), "_lo", "_at",
                         F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_i"))
    moved = moved.select("sequence_id", "_length", (F.col("_lo") + F.col("_i")).alias("_r"),
                         (F.col("_at") + F.col("_i") * F.col("_length")).cast("long").alias("offset"))
    where = loose.join(moved, (F.col("length") == F.col("_length")) & (F.col("_rank") == F.col("_r"))).select(
        F.col("_id").alias("_j"), "sequence_id", "offset")
    out = items.join(where, F.col("_id") == F.col("_j")).select(*items.columns, "sequence_id", "offset")
    return out.unionByName(full).drop("_id")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
