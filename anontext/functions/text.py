"""Small text helpers: character clean-up, word and token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the optional clean-up removes.
REMOVED_CHARACTERS = "\n'*\\"

# Tokens per word, general and for batch scoring.
TOKENS_PER_WORD = 1.45
BATCH_TOKENS_PER_WORD = 2

# White space as Python sees it: low characters one by one, which Java matches by bitmap, and the
# rest behind a range test, so that ordinary letters are passed over quickly.
_LOW = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
_HIGH = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = _LOW + _HIGH
SPACE = rf"[{_LOW}[\u1680-\u3000&&[{_HIGH}]]]"
WHITE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                 0x2028, 0x2029, 0x202f, 0x205f, 0x3000))


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITE))



def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda evaluates what it refers to anew for every element; a value bound this way is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_characters(text: Column) -> Column:
    """Drop newlines, single quotes, asterisks and backslashes."""
    return F.translate(text, REMOVED_CHARACTERS, "")


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for empty or blank text, null for null."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit(f"{SPACE}+")) + 1)


def estimated_tokens(words: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """Rough token count of a text with that many words, truncated."""
    return (words * F.lit(float(per_word))).cast("bigint")
