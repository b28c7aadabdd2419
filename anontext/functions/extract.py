"""Fields of free-form model answers, read with native column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anontext.functions.text import SPACE

NA = "NA"

# Spellings that mean "no value", for guesses and for sentiment.
GUESS_BLANKS = ("", "na", "n/a", "nan", "none", "null", "missing")
SENTIMENT_BLANKS = ("na", "n/a", "nan", "none", "missing")

# Labels under which each guessed field may appear.
GUESS_LABELS = {
    "ticker": ("ticker",),
    "name": ("name",),
    "date": ("date", "year"),
    "industry": ("industry", "sector"),
}

_ANY_LABEL = "|".join(label for labels in GUESS_LABELS.values() for label in labels)


def _field_pattern(labels: tuple[str, ...]) -> str:
    # Text is single-spaced by then, so one optional space stands for any gap. The value ends at
    # the next label, which is consumed: only the first match is read.
    return (f"(?iu)(?:{'|'.join(labels)}) ?estimate ?: ?(.*?) ?[,;]? ?"
            f"(?:(?:{_ANY_LABEL}) ?estimate|$)")


GUESS_PATTERNS = {field: _field_pattern(labels) for field, labels in GUESS_LABELS.items()}
DIRECTION_PATTERN = "(?iu)direction ?estimate ?: ?(.*?) ?(?:,| magnitude ?estimate|$)"
MAGNITUDE_PATTERN = "(?iu)magnitude ?estimate ?: ?(.*?) ?(?:,|$)"

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INFINITY = "^(?i)[+-]?inf(?:inity)?$"


def normalise_answer(answer: Column) -> Column:
    """Remove markdown marks, make every run of white space one space, trim."""
    return F.trim(F.regexp_replace(F.translate(answer, "*`_", ""), f"{SPACE}+", " "))


def blank_to_na(value: Column) -> Column:
    """Any spelling of "no value", and null, become ``NA``; other values are trimmed."""
    bare = F.trim(value)
    return F.when(bare.isNull() | F.lower(bare).isin(*GUESS_BLANKS), F.lit(NA)).otherwise(bare)


def guess_field(normalised: Column, field: str) -> Column:
    """One guessed field of an already normalised answer, or ``NA``."""
    found = F.regexp_extract(normalised, GUESS_PATTERNS[field], 1)
    return blank_to_na(F.rtrim(F.trim(found), F.lit(",;")))


def guess_fields(normalised: Column) -> Column:
    """STRUCT<ticker, name, date, industry> of a normalised answer; never null inside."""
    return F.struct(*(guess_field(normalised, field).alias(field) for field in GUESS_LABELS))


def extract_guess(df, answer: str, into: tuple[str, str, str, str]):
    """Add ticker, name, date and industry columns, named by ``into``, from an answer column."""
    plain = "__plain_answer"
    return (
        df.withColumn(plain, normalise_answer(F.col(answer)))
        .withColumns({name: guess_field(F.col(plain), field)
                      for name, field in zip(into, GUESS_LABELS)})
        .drop(plain)
    )


def _sentiment_field(normalised: Column, pattern: str) -> Column:
    # A match on nothing stays empty; only the absence of the label gives NA.
    value = F.trim(F.regexp_extract(normalised, pattern, 1))
    found = F.coalesce(normalised.rlike(pattern), F.lit(False))
    return F.when(found & ~F.lower(value).isin(*SENTIMENT_BLANKS), value).otherwise(F.lit(NA))


def direction_text(normalised: Column) -> Column:
    return _sentiment_field(normalised, DIRECTION_PATTERN)


def magnitude_text(normalised: Column) -> Column:
    return _sentiment_field(normalised, MAGNITUDE_PATTERN)


def to_number(value: Column) -> Column:
    """Lenient text to DOUBLE: plain decimals, exponents and infinities; anything else is null."""
    bare = F.trim(value)
    plain = F.when(bare.rlike(_NUMBER), bare).try_cast("double")
    finite = F.when(F.abs(plain) < F.lit(float("inf")), plain)
    endless = F.when(bare.rlike(_INFINITY),
                     F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(finite, endless)


def extract_sentiment(df, answer: str, into: tuple[str, str]):
    """Add a direction (text) and a magnitude (DOUBLE or null) column from an answer column."""
    plain = "__plain_answer"
    return (
        df.withColumn(plain, normalise_answer(F.col(answer)))
        .withColumns({into[0]: direction_text(F.col(plain)),
                      into[1]: to_number(magnitude_text(F.col(plain)))})
        .drop(plain)
    )
