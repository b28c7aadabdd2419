"""Short codes for vectors: parts rounded to the nearest of a part's codebook, found by equal-average search.

Components become integers, floor(256 x), and all that follows is integer arithmetic, so results do not depend on
partitions or on the order of sums. A vector is cut into PARTS consecutive parts (when its length is no multiple, the
first parts are one longer). Codebooks start as the parts of the ENTRIES rows with the smallest ids, and each round
assigns every part, then moves each entry to the floored mean of its parts; an unused entry stays.

Equal-average search: a codebook is sorted by the sum of its entries' components. A part looks outward from the place of
its own sum; since the squared gap of sums over the part's length never exceeds the squared distance, it stops
once that exceeds the best distance strictly (so that ties still go to the lower index). Whole batches of parts walk at once.

Each round is one narrow pass: a task adds up its rows per entry and sends at most entries x vector length sums on.
Codebooks travel to tasks by broadcast: ENTRIES x length integers for each vector length in the table.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length have codebooks of
their own, from the smallest ids of that length; with fewer rows than ENTRIES there are as many entries as rows. An empty
vector has code 0 in every part and error 0. Null ids come last, repeated ids by vector. A distance that does not
fit a long raises an error, like Spark's ANSI sums do. Other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 62


def finite(vector: str):
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(F.col(vector), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def cuts(length: int, parts: int = PARTS) -> list[int]:
    """Where parts begin, and the end."""
    short, longer = divmod(length, parts)
    return [i * short + min(i, longer) for i in range(parts + 1)]


class Codebook:
    """One part's entries, laid out by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.lexsort((np.arange(len(entries)), sums))
        self.entries, self.sums = entries[self.index], sums[self.index]
        self.visited = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index."""
        n, width = x.shape
        best, chosen = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.index))
        if not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        sums, last = x.sum(axis=1), len(self.sums)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        far = np.iinfo(np.int64).max
        walking = np.arange(n)
        while len(walking):
            s, u, d = sums[walking], up[walking], down[walking]
            above = np.where(u < last, np.abs(self.sums[np.minimum(u, last - 1)] - s), far)
            below = np.where(d >= 0, np.abs(s - self.sums[np.maximum(d, 0)]), far)
            gap = np.minimum(above, below)
            # gap² / width > best, without overflow where no entry is left
            on = (gap < far) & (np.where(gap < far, gap, 0) ** 2 <= width * np.minimum(best[walking], LARGEST // width))
            walking, go_up = walking[on], (above <= below)[on]
            at = np.where(go_up, up[walking], down[walking])
            up[walking] += go_up
            down[walking] -= ~go_up
            self.visited += len(walking)
            apart = ((x[walking] - self.entries[at]) ** 2).sum(axis=1)
            index = self.index[at]
            better = (apart < best[walking]) | ((apart == best[walking]) & (index < chosen[walking]))
            best[walking[better]], chosen[walking[better]] = apart[better], index[better]
        return chosen, best


def integers(rows) -> np.ndarray:
    """Batch of equally long vectors as integers."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat).reshape(len(rows), -1)
    if x.size and (2 * np.abs(x).max() * x.shape[1]) ** 2 >= LARGEST:  # bounds squared distances and gaps of sums
        raise OverflowError("squared distances of these vectors do not fit a long")
    return x.astype(np.int64)


def by_length(batch: pa.RecordBatch):
    """(length, places in the batch, integers) of every vector length in a batch."""
    vectors = batch.column("_v")
    size = np.diff(vectors.offsets.to_numpy())
    for length in np.unique(size):
        places = np.flatnonzero(size == length)
        yield int(length), places, integers(vectors.take(pa.array(places)))


def assign(x: np.ndarray, books: list[Codebook], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts (rows x parts) and each row's summed squared distance."""
    edge, codes, error = cuts(x.shape[1], parts), np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        codes[:, p], apart = book.nearest(x[:, edge[p]:edge[p + 1]])
        error += apart
    return codes, error


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Entries x length integers for every vector length: the rows with the smallest ids."""
    out = {}
    for r in rows.groupBy(F.size("_v").alias("n")).count().collect():
        few = rows.where(F.size("_v") == r["n"]).orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").toArrow()
        out[r["n"]] = integers(few.column("_v").combine_chunks()) if r["n"] else np.zeros((few.num_rows, 0), np.int64)
    return out


def books_of(tables: dict[int, np.ndarray], parts: int) -> dict[int, list[Codebook]]:
    return {n: [Codebook(t[:, a:b]) for a, b in zip(cuts(n, parts), cuts(n, parts)[1:])] for n, t in tables.items()}


def moved(rows: DataFrame, tables: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """Codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def add_up(batches):
        books, sums = books_of(shared.value, parts), {n: np.zeros((2, *t.shape), np.int64) for n, t in shared.value.items()}
        for batch in batches:
            for n, _, x in by_length(batch):
                codes, _ = assign(x, books[n], parts)
                for p, (a, b) in enumerate(zip(cuts(n, parts), cuts(n, parts)[1:])):
                    for c in range(a, b):
                        np.add.at(sums[n][0, :, c], codes[:, p], x[:, c])
                        sums[n][1, :, c] += np.bincount(codes[:, p], minlength=sums[n].shape[1])
        for n, (total, count) in sums.items():
            entry, place = np.nonzero(count)
            if len(entry):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(entry), n, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)),
                     pa.array(total[entry, place]), pa.array(count[entry, place])], names=["n", "entry", "place", "total", "count"])

    added = rows.select("_v").mapInArrow(add_up, "n int, entry int, place int, total long, count long")
    # At most entries x length rows for each vector length.
    added = added.groupBy("n", "entry", "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect()
    out = {n: t.copy() for n, t in tables.items()}
    for r in added:
        out[r["n"]][r["entry"], r["place"]] = r["total"] // r["count"]
    return out


def codebook_digest(table: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place in the part."""
    edge = cuts(table.shape[1], parts)
    flat = [str(v) for a, b in zip(edge, edge[1:]) for v in table[:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks of every vector length, entries x length, from a table with _id and _v."""
    tables = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        tables = moved(rows, tables, parts)
    return tables


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id",
             vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, codes (a number a part), error, label_error, codebooks_sha256 of every vector kept."""
    rows = stored(vectors.where(finite(vector)).select(
        F.col(id_column).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v")), "codes-rows")
    tables = learn(rows, parts, entries, rounds)
    shared = rows.sparkSession.sparkContext.broadcast((tables, {n: codebook_digest(t, parts) for n, t in tables.items()}))

    def code(batches):
        tables, digests = shared.value
        books = books_of(tables, parts)
        for batch in batches:
            for n, places, x in by_length(batch):
                codes, error = assign(x, books[n], parts)
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(at), batch.column("_label").take(at),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.astype(np.int32).ravel())),
                     pa.array(error), pa.array([digests[n]] * len(x))], names=["_id", "_label", "codes", "error", "codebooks_sha256"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_label")]
    coded = stored(rows.mapInArrow(code, f"_id {kinds[0]}, _label {kinds[1]}, codes array<int>, error long, codebooks_sha256 string"),
                   "codes-rows-coded")
    # One row a label, summed before the shuffle; adaptive execution broadcasts or splits the join.
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_column), F.col("_label").alias(label), "codes", "error", "label_error", "codebooks_sha256")


def hex_code(codes: str = "codes"):
    """Two hex digits a part."""
    return F.array_join(F.transform(F.col(codes), lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def _sql(width: int = 4) -> str:
    """The whole computation for vectors of PARTS x width components."""
    steps = [f"""WITH v AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x
    FROM embeddings WHERE embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
p AS MATERIALIZED (SELECT vec_id, i AS part, list_slice(x, i * {width} + 1, (i + 1) * {width}) AS x
    FROM v, range({PARTS}) t(i)),
b0 AS MATERIALIZED (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry
    FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""]
    apart = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, x, entry, apart FROM (
    SELECT p.vec_id, p.part, p.x, b.entry, {apart} AS apart, row_number() OVER (
        PARTITION BY p.vec_id, p.part ORDER BY {apart}, b.entry) AS nth
    FROM p JOIN b{r} b ON p.part = b.part) WHERE nth = 1)""")
        if r < ROUNDS:
            mean = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, coalesce(m.x, b.x) AS x, b.entry FROM b{r} b LEFT JOIN (
    SELECT part, entry, [{mean}] AS x FROM a{r} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    steps.append(f"""c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error
    FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), h""")
    return ",\n".join(steps)


SQL = _sql()
