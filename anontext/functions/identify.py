"""Was the firm or the date of a text guessed right?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anontext.functions.names import name_similarity

# Defaults of the audit.
NAME_THRESHOLD = 75
DATE_TOLERANCE_DAYS = 7

# The first and last whole day of a nanosecond timestamp.
FIRST_DATE, LAST_DATE = "1677-09-22", "2262-04-11"


def parse_iso_date(text: Column) -> Column:
    """Year-month-day text to TIMESTAMP_NTZ; anything else, and dates out of range, are null."""
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), text)
    day = F.try_to_date(shaped, "y-M-d")
    return F.when(day.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")),
                  day.cast("timestamp_ntz"))


def date_guess_correct(true_date: Column, guess: Column,
                       tolerance_days: int = DATE_TOLERANCE_DAYS) -> Column:
    """1 when both are known and at most the tolerance apart, to the microsecond; else 0."""
    gap = F.abs(true_date.cast("timestamp_ntz") - guess.cast("timestamp_ntz"))
    return F.when(gap <= F.make_dt_interval(days=F.lit(tolerance_days)), F.lit(1)).otherwise(F.lit(0))


def identification_flags(similarity: Column, true_date: Column, parsed_date: Column,
                         threshold: int = NAME_THRESHOLD,
                         tolerance_days: int = DATE_TOLERANCE_DAYS) -> dict[str, Column]:
    """Name right, date right, and either of them, each 1 or 0.

    The name is right when the similarity reaches the threshold. Ticker and industry guesses play
    no part.
    """
    by_name = F.when(similarity >= threshold, F.lit(1)).otherwise(F.lit(0))
    by_date = date_guess_correct(true_date, parsed_date, tolerance_days)
    return {"name_guess_correct": by_name, "date_guess_correct": by_date,
            "iort_guess_correct": F.greatest(by_name, by_date)}


def check_identified(df: DataFrame, suffix: str = "", true_name: str = "comnam",
                     true_date: str = "pub_date", name_guess: str = "name_guess",
                     date_guess: str = "date_guess_raw", parsed_date: str = "date_guess",
                     threshold: int = NAME_THRESHOLD,
                     tolerance_days: int = DATE_TOLERANCE_DAYS, method: str = "lcs",
                     escape_dots: bool = False) -> DataFrame:
    """Add the parsed date and, under ``suffix``, similarity, name, date and combined flags."""
    similarity = f"name_similarity{suffix}"
    scored = df.withColumns({
        parsed_date: parse_iso_date(F.col(date_guess)),
        similarity: name_similarity(F.col(true_name), F.col(name_guess), method, escape_dots),
    })
    flags = identification_flags(F.col(similarity), F.col(true_date), F.col(parsed_date), threshold,
                                 tolerance_days)
    return scored.withColumns({f"{name}{suffix}": flag for name, flag in flags.items()})
