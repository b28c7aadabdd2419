"""Masking from a dictionary of known names.

A dictionary has one row per spelling: ``surface``, ``kind`` (company, name, location, industry,
sector, product, product_type, product_line, service) and ``entity``, which ties spellings of one
firm together. The longest spelling at a place wins, from left to right. Companies become
Company_1 (the article's own), Company_2 and so on by first mention; other kinds become <kind>_x.

Texts are read word by word by an automaton over word numbers (``automaton``), which meets every
spelling in one pass. A dictionary within the size limit goes to every task. Of a larger one a Bloom
filter of all beginnings of spellings goes ahead; it cuts what a text may hold to short tails, each
no longer than the beginning of some spelling. Distinct tails, never texts, meet the dictionary in a join, which
leaves the spellings that occur. Those go to every task if they are within the limit, and texts are masked where
they are. Otherwise each text is sent its own hits, joined by key. All three ways give the same result.

A filter of bounded size tells nothing once a dictionary is far beyond it. Of such a dictionary the spellings go first
whose words no text holds: the distinct words of all texts meet those at one place of the spellings after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.operators.automaton import Automaton, PrefixFilter, distinct_words, names_of, replace, tails, words_of
from anontext.operators.rulemask import core_words
from anontext.session import small_batches, stored

MAX_SURFACES = 200_000
MAX_BYTES = 16 << 20
# Places of a spelling whose words are looked for in the texts; of longer spellings the rest is left to the filter.
PLACES = 3
# Distinct words that a task holds before it hands them on.
WORDS_HELD = 100_000

_WORDS = r"[\p{L}\p{N}_]+"


def normalise_surfaces(dictionary: DataFrame) -> DataFrame:
    """Spellings as lower-case words with one space between; one row each, the first kind kept."""
    return _merged(_plain(dictionary))


def _plain(dictionary: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.lower("surface"), F.lit(_WORDS), 0)
    return dictionary.select(F.array_join(words, " ").alias("surface"), "kind",
                             F.col("entity").cast("string").alias("entity"),
                             F.size(words).alias("n_words"))


def _merged(plain: DataFrame) -> DataFrame:
    # Filtered no sooner, as a filter below would have every spelling's words looked for twice.
    return plain.filter("n_words > 0").groupBy("surface").agg(F.min(F.struct("kind", "entity", "n_words")).alias("e")).select("surface", "e.*")


def mask_entities(df: DataFrame, dictionary: DataFrame, text: str, name: str, into: str,
                  key: str = "doc_id", max_surfaces: int = MAX_SURFACES,
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``into``, the text with dictionary names masked. ``key`` is unique."""
    small_batches(df.sparkSession)
    plain = _plain(dictionary)
    if _overfills(plain):
        plain = _said(plain, df, text, name, lambda left: _fits(_merged(left), max_surfaces, max_bytes))
    surfaces = _merged(plain)
    if _fits(surfaces, max_surfaces, max_bytes):
        return _mask_in_place(df, surfaces, text, name, into)
    surfaces = stored(surfaces, "entity-surfaces")
    hits = stored(_candidates(df, surfaces, text, name, key), "entity-tails")
    met = _meet(hits, surfaces)
    held = stored(met.select("surface", "kind", "entity").distinct(), "entity-held")
    if _fits(held, max_surfaces, max_bytes):
        return _mask_in_place(df, held, text, name, into)
    return _mask_by_hits(df, hits, met, text, name, into, key)


def _fits(surfaces: DataFrame, max_surfaces: int, max_bytes: int) -> bool:
    size = surfaces.agg(F.count(F.lit(1)).alias("rows"),
                        F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "surface", "kind", "entity"))), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_surfaces and size["bytes"] <= max_bytes


def _overfills(plain: DataFrame) -> bool:
    """Whether the beginnings of all spellings are more than the filter can tell apart."""
    told = plain.agg(F.approx_count_distinct("surface").alias("spellings"), F.avg("n_words").alias("words")).first()
    return PrefixFilter.BITS * told["spellings"] * (told["words"] or 0) > PrefixFilter.MOST


def _said(plain: DataFrame, df: DataFrame, text: str, name: str, enough) -> DataFrame:
    """The spellings whose words at the first places all occur in some text or own name; ``enough`` tells when to stop looking.

    No other spelling can be found in a text. Only distinct words meet, so no key holds many rows.
    """
    def collected(batches):
        for words in distinct_words(batches, WORDS_HELD):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    source = df.select(F.col(text).alias("text"), core_words(F.col(name)).alias("own"))
    heard = stored(source.mapInArrow(collected, "word string").distinct(), "entity-words")
    for place in range(PLACES):
        word = F.get(F.split("surface", " "), F.lit(place))
        there = stored(plain.select(word.alias("word")).where("word IS NOT NULL").distinct().join(heard, "word", "left_semi"), "entity-said-words")
        left = plain.withColumn("word", word).join(there, "word", "left_semi").drop("word")
        plain = stored(left.unionByName(plain.where(word.isNull())) if place else left, "entity-said")
        if enough(plain):
            break
    return plain


def _mask_in_place(df: DataFrame, surfaces: DataFrame, text: str, name: str, into: str) -> DataFrame:
    rows = [tuple(r) for r in surfaces.select("surface", "kind", "entity").collect()]  # within the limit
    shared = df.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("string")
    def masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = Automaton(shared.value)
        for texts, owns in batches:
            yield pd.Series([automaton.mask(t, o) for t, o in zip(texts, owns)], dtype=object)

    return df.withColumn(into, masked(F.col(text), core_words(F.col(name))))


def _candidates(df: DataFrame, surfaces: DataFrame, text: str, name: str, key: str) -> DataFrame:
    """(key, at, tail): where in a text a spelling may begin, and how far; the article's own name at -1."""
    shared = df.sparkSession.sparkContext.broadcast(PrefixFilter.of(surfaces))

    def find(batches):
        for batch in batches:
            keys, ats, found = [], [], []
            own_words = batch.column("own").to_pylist()
            for row, (t, own) in enumerate(zip(batch.column("text").to_pylist(), own_words)):
                if own:
                    keys.append(row)
                    ats.append(-1)
                    found.append(" ".join(own))
                for at, tail in tails(t, shared.value):
                    keys.append(row)
                    ats.append(at)
                    found.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(ats, pa.int32()),
                                              pa.array(found, pa.string())], names=["key", "at", "tail"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), core_words(F.col(name)).alias("own"))
    return source.mapInArrow(find, f"key {df.schema[key].dataType.simpleString()}, at int, tail string")


def _meet(hits: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(tail, surface, kind, entity, n_words) of all spellings that a tail begins with.

    Distinct tails are beginnings of spellings or false hits of the filter, so no key holds many rows.
    """
    words = F.split("tail", " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return hits.select("tail").distinct().select("tail", F.explode(begins).alias("surface")).join(surfaces, "surface")


def _mask_by_hits(df: DataFrame, hits: DataFrame, met: DataFrame, text: str, name: str, into: str, key: str) -> DataFrame:
    # A struct compares by its first field: the longest spelling of a tail. The own name counts only whole.
    longest = met.groupBy("tail").agg(F.max(F.struct("n_words", "kind", "entity")).alias("s"))
    whole = F.size(F.split("tail", " ")) == F.col("s.n_words")
    named = hits.join(longest, "tail").where((F.col("at") >= 0) | whole)
    per_text = named.groupBy(F.col("key").alias(key)).agg(
        F.collect_list(F.struct("at", F.col("s.n_words").alias("n"), F.col("s.kind").alias("kind"), F.col("s.entity").alias("entity"))).alias("__held"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, owns: pd.Series, helds: pd.Series) -> pd.Series:
        out = []
        for t, own, held in zip(texts, owns, helds):
            found = {h["at"]: (h["n"], h["kind"], h["entity"]) for h in ([] if held is None else held)}
            _, kind, entity = found.pop(-1, (0, None, None))
            words, spans = (None, None) if t is None else words_of(t)
            out.append(None if t is None else replace(t, words, spans, found, names_of(own, kind, entity)))
        return pd.Series(out, dtype=object)

    joined = df.join(per_text, key, "left")
    return joined.withColumn(into, masked(F.col(text), core_words(F.col(name)), F.col("__held"))).drop("__held")
