"""Near-duplicates by the similarity of their sets of word shingles: Jaccard of at least 0.8 on five words.

Pairs are proposed twice. First by the method of op6: fingerprints of three-word shingles, filed by chains of ring segments,
which finds copies within two bits; they are decided like all others. A pair at 0.8 differs in ten bits of 64, which no chain of
segments finds without comparing everything. So those not linked by then are proposed by equal bands of minima: of BANDS bands of
ROWS minimal shingle hashes each, a pair at 0.8 shares none with chance (1 - 0.8**4)**24 = 3e-6, a closer pair
less. A pair whose minima agree in fewer than LEAST of their lowest bytes goes no further: one at 0.8 agrees in 77 of
96, give or take four, and in so few with chance 2e-6. Only the texts of the pairs left travel, each once to a pair, and
every such pair is decided on the shingles of the whole texts themselves.

Texts of equal words (case aside) are put together first. Within a band's bucket the members meet its centre
first, for a few centres; texts that share a bucket with one not linked by then are paired by the rarest shingles they
share, which is exact; marks of all that each shares tell most of those apart that are not similar. Sizes that rule out the similarity are not compared.
Null texts count as empty; empty texts are alike, and like nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import components, from_texts, small_batches, stored, text_bytes, worker_cache
from anontext.llm.fingerprint_dedup import SEED, hashed, majority, links as near_prints, shingles

SHINGLE, SIMILARITY = 5, 0.8
PRINT_SHINGLE = 3  # of the fingerprints, as in op6
BANDS, ROWS = 24, 4
CENTRES = 2
LEAST = 58  # of BANDS * ROWS minima
PRUNED = 2  # times that texts with too few shared shingles are put aside
BITS = 16  # longs that a text's shared shingles are marked in
PART = 1024  # shingles whose minima are taken at a time
_MULTIPLY = np.random.default_rng(SEED).integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Of the different shingles."""
    parts = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in made], np.uint64) for made in shingles(words, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _widened(h: np.ndarray, short: int, shingle: int) -> np.ndarray:
    """Hashes of the different shingles of ``shingle`` words from those of ``short`` words in order, which cover them."""
    at = [*range(0, shingle - short, short), shingle - short]
    n = len(h) - at[-1]
    mixed = np.zeros(n, np.uint64)
    for k in at:
        mixed = (mixed ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(text: bytes, shingle: int = SHINGLE) -> tuple[int, int, list[int], bytes, int]:
    """A hash of the words, the number of different shingles, a hash of each band of minima, each minimum's lowest byte, and the fingerprint."""
    words = text.lower().split()
    own = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))
    if not words:
        return own, 0, [], b"", 0
    short = hashed(words, PRINT_SHINGLE)
    h = _widened(short, PRINT_SHINGLE, shingle) if len(words) >= shingle >= PRINT_SHINGLE else _hashes(words, shingle)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    high = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), PART):
        # The hashes are as good as drawn, so an odd factor for each minimum orders them anew.
        np.minimum(low, (high[at:at + PART] * _MULTIPLY).min(axis=1), out=low)
    bands = [xxhash.xxh64_intdigest(low[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return own, len(h), np.array(bands, np.uint64).view(np.int64).tolist(), low.astype(np.uint8).tobytes(), majority(short)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` without the text, and ``_fp``, ``_n``, ``_bands``, ``_low`` and the fingerprint ``_print``."""
    def start():
        worker_cache("sketches", dict)

        def work(texts):
            made = [sketch(t, shingle) for t in texts]
            prints = np.array([m[4] for m in made], "<u8").view("<i8")
            return {"_fp": [m[0] for m in made], "_n": [m[1] for m in made], "_bands": [m[2] for m in made], "_low": [m[3] for m in made],
                    "_print": prints}
        return work

    outputs = {"_fp": "long", "_n": "long", "_bands": "array<bigint>", "_low": "binary", "_print": "long"}
    return from_texts(docs, [c for c in docs.columns if c != "text"], outputs, start)


def likely(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that agree in LEAST minima at least."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("la", "lb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST))

    low = distinct.where("_n > 0")
    first = low.select(F.col("_fp").alias("a"), F.col("_low").alias("la"))
    second = low.select(F.col("_fp").alias("b"), F.col("_low").alias("lb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, texts_of, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts are similar enough, decided on their shingles.

    ``texts_of(ids)`` gives (_fp, _text) of the texts asked for.
    """
    def of(text):
        out = set()
        for made in shingles(text.lower().split(), shingle):
            out.update(made)
        return out

    def run(batches):
        worker_cache("alike", dict)
        last, mine = None, set()
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, x in enumerate(a):
                if x != last:
                    last, mine = x, of(batch.column("ta")[i].as_py())
                other = of(batch.column("tb")[i].as_py())
                both = len(mine & other)
                if both >= similarity * (len(mine) + len(other) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                                             names=["a", "b"])

    small_batches(pairs.sparkSession)
    ids = pairs.select(F.col("a").alias("_fp")).unionByName(pairs.select(F.col("b").alias("_fp"))).distinct()
    texts = stored(texts_of(ids), "similar-texts")
    first = texts.select(F.col("_fp").alias("a"), F.col("_text").alias("ta"))
    second = texts.select(F.col("_fp").alias("b"), F.col("_text").alias("tb"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def printed_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct texts whose fingerprints lie within two bits: stars over the groups, never all pairs."""
    texts = distinct.where("_n > 0").select("_fp", "_print")
    first = stored(texts.groupBy("_print").agg(F.min("_fp").alias("_c")), "similar-prints")
    same = texts.join(first, "_print").where("_fp <> _c").select("_fp", "_c")
    near = near_prints(first.select(F.col("_print").alias("_fp")))
    near = near.join(first.select(F.col("_print").alias("a"), F.col("_c").alias("_fp")), "a").join(
        first.select(F.col("_print").alias("b"), "_c"), "b").select("_fp", "_c")
    return same.unionByName(near).select(F.least("_fp", "_c").alias("a"), F.greatest("_fp", "_c").alias("b")).distinct()


def rare_pairs(members: DataFrame, texts_of, shingle: int, similarity: float) -> DataFrame:
    """Pairs of members (_fp, _n, _root) of different roots, all that are similar among them, by the rarest shingles they share.

    Only shingles that stand under two roots link a text with one of another root. Similar texts of n and m shingles share
    similarity / (1 + similarity) * (n + m) of these at least. Of the first one they share, rarest first, both have so many
    left from there on; pairs without such a shingle are not similar. Texts with fewer than similarity * n go first.
    A mark that one text has and the other has not stands for a shingle at least that they do not share, so pairs of a
    text with the many copies of another are ruled out where they meet.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = _hashes(batch.column("_text")[i].as_py().lower().split(), shingle).view(np.int64)
                same = pa.array(np.zeros(len(h), np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1).take(same) for c in ("_fp", "_n", "_root")), pa.array(h)],
                                                 names=["_fp", "_n", "_root", "_s"])

    small_batches(members.sparkSession)
    texts = members.join(texts_of(members.select("_fp")), "_fp").select("_fp", "_n", "_root", "_text")
    made = texts.mapInArrow(run, "_fp long, _n long, _root long, _s long")
    least = F.ceil(F.lit(similarity) * F.col("_n") - 1e-6)
    for turn in range(PRUNED):
        made = stored(made, "similar-shingles")
        across = made.groupBy("_s").agg(F.count("*").alias("_c"), F.min("_root").alias("lo"), F.max("_root").alias("hi")).where("lo <> hi")
        made = made.join(across.select("_s", "_c"), "_s")
        counted = made.withColumn("_k", F.count("*").over(Window.partitionBy("_fp"))).where(F.col("_k") >= least)
        made = counted.select("_fp", "_n", "_root", "_s")
    # What is left of a text from each shared shingle on, the rarest first.
    place = F.row_number().over(Window.partitionBy("_fp").orderBy("_c", "_s"))
    mark, cell = F.expr("shiftleft(1L, cast(_s & 63 AS INT))"), F.expr(f"pmod(shiftright(_s, 6), {BITS})")
    marks = {f"x{i}": F.coalesce(F.bit_or(F.when(cell == i, mark)).over(Window.partitionBy("_fp")), F.lit(0)) for i in range(BITS)}
    first = counted.withColumns({"_rest": F.col("_k") - place + 1, **marks}).where(F.col("_rest") >= least)
    first = stored(first.select("_fp", "_n", "_root", "_s", "_rest", "_k", *marks), "similar-rarest")
    other = first.select("_s", F.col("_fp").alias("_c"), F.col("_n").alias("_m"), F.col("_root").alias("_other"), F.col("_rest").alias("_left"),
                         F.col("_k").alias("_l"), *[F.col(x).alias(f"y{x}") for x in marks])
    wanted = F.lit(similarity / (1 + similarity)) * (F.col("_n") + F.col("_m")) - 1e-6
    mine = F.col("_k") - sum(F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(f"y{x}"))) for x in marks)
    theirs = F.col("_l") - sum(F.bit_count(F.col(f"y{x}").bitwiseAND(F.bitwise_not(x))) for x in marks)
    return first.join(other, (first["_s"] == other["_s"]) & (F.col("_root") < F.col("_other")) & (F.least("_rest", "_left") >= wanted) & (
        F.least(mine, theirs) >= wanted)).select("_fp", "_n", "_c", "_m")


def similar_links(distinct: DataFrame, texts_of, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the groups linked among distinct texts, as ``sketches`` gives them; texts in no pair are left out."""
    filed = distinct.select("_fp", "_n", F.posexplode("_bands").alias("_band", "_file"))
    shared = filed.groupBy("_band", "_file").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    filed = stored(filed.join(shared, ["_band", "_file"]), "similar-files")
    fits = F.least("_n", "_m") >= F.lit(similarity) * F.greatest("_n", "_m") - 1e-9
    done = stored(printed_pairs(distinct), "similar-pairs")
    close = stored(likely(done, distinct), "similar-close")
    roots = components(stored(alike(close, texts_of, shingle, similarity), "similar-links"), "similar")
    for turn in range(CENTRES + 1):
        named = filed.join(
            roots.withColumnRenamed("id", "_fp").withColumnRenamed("root", "_root"), "_fp", "left").withColumn(
            "_root", F.coalesce("_root", "_fp"))
        open_files = named.groupBy("_band", "_file").agg(
            F.min("_root").alias("lo"), F.max("_root").alias("hi"),
            F.min(F.struct(F.xxhash64("_fp", F.lit(turn)).alias("h"), F.col("_fp").alias("_c"), F.col("_n").alias("_m"),
                           F.col("_root").alias("_other"))).alias("_s")).where("lo <> hi")
        named = named.join(open_files.select("_band", "_file", "_s"), ["_band", "_file"])
        if turn < CENTRES:
            pairs = named.select("_fp", "_n", "_root", "_s.*").where(F.col("_root") != F.col("_other"))
        else:
            members = stored(named.select("_fp", "_n", "_root").distinct(), "similar-open")
            pairs = rare_pairs(members, texts_of, shingle, similarity)
        pairs = pairs.where(fits).select(F.least("_fp", "_c").alias("a"), F.greatest("_fp", "_c").alias("b")).distinct()
        pairs = stored(pairs.join(done, ["a", "b"], "left_anti"), "similar-pairs")
        close = stored(likely(pairs, distinct), "similar-close")
        found = stored(alike(close, texts_of, shingle, similarity), "similar-links")
        done = done.unionByName(pairs)
        # Groups are known already: each goes on as a star.
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found), "similar")
    return roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, of each group of similar texts the one with the smallest id (nulls last) alone."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = stored(sketches(docs.select("doc_id", mark.alias("_mark"), "text"), shingle), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_mark").alias("m"))
    distinct = stored(marked.groupBy("_fp").agg(F.min(first).alias("_first"), F.first("_n").alias("_n"),
                                                F.first("_bands").alias("_bands"), F.first("_low").alias("_low"),
                                                F.first("_print").alias("_print")), "sketches-distinct")
    own = distinct.select("_fp", F.col("_first.d").alias("_d"), F.col("_first.m").alias("_m"))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = own.join(ids, "_fp")
        rows = docs.select(F.col("doc_id").alias("_id"), mark.alias("_mark"), text_bytes().alias("_text"))
        rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")))
        return rows.select("_fp", "_text").dropDuplicates(["_fp"])

    roots = similar_links(distinct, texts_of, shingle, similarity).withColumnRenamed("id", "_fp")
    named = distinct.join(roots, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    stays = named.groupBy("root").agg(F.min("_first").alias("k")).select(F.col("k.d").alias("_d"), F.col("k.m").alias("_m"))
    # Most rows stay where they are; those that go, and rows that stand more than once, are the few that are looked up.
    rows = marked.groupBy(F.col("doc_id").alias("_id"), "_mark").count()
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m"))
    told = stored(rows.join(stays.withColumn("_stays", F.lit(True)), same, "left").select(
        "_id", "_mark", "count", F.coalesce("_stays", F.lit(False)).alias("_stays")).where("NOT _stays OR count > 1"), "similar-rows")
    told = told.select(F.col("_id").alias("_d"), F.col("_mark").alias("_m"), "_stays")
    names = [f"k{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)],
                       F.col("doc_id").alias("_id"), mark.alias("_mark"))
    single = wide.join(told, same, "left_anti")
    repeated = wide.join(told.where("_stays"), same, "left_semi").dropDuplicates(["_id", "_mark"])
    return single.unionByName(repeated).select(*names).toDF(*docs.columns)
