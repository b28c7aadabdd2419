"""Firm-name cleaning and a 0..100 similarity of cleaned names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anontext.functions.text import SPACE, SPACES, let

# Legal-form tokens dropped as whole words. The two dotted ones are patterns: the
# dot stands for any character unless ``escape_dots`` is asked for.
LEGAL_FORMS = (
    "group", "holdings", "holding", "ltd", "corp", "inc", "co", "llc", "plc", "gmbh", "ag",
    "s.a.", "s.a", "bv", "nv", "sa", "spa", "pte", "limited", "incorporated", "company",
    "corporation", "lp", "llp", "technologies", "tech",
)

_WORD = r"[\p{L}\p{N}_]"

# Bits used of a BIGINT: one is the sign, one takes the carry of an addition.
_LIMB = 62
_ONES = (1 << _LIMB) - 1


def _legal_form_pattern(escape_dots: bool) -> str:
    dot = r"\." if escape_dots else r"[^\n]"
    words = "|".join(form.replace(".", dot) for form in LEGAL_FORMS)
    at_start = f"(?<!{_WORD})(?={_WORD})"
    at_edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return f"{at_start}(?:{words}){at_edge}"


def clean_name(name: Column, escape_dots: bool = False) -> Column:
    """Lower-case, drop bracketed parts, punctuation, legal forms and all spaces, in that order."""
    keep = r"\p{L}\p{N}_"
    bare = F.regexp_replace(F.lower(name), r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, f"[^{keep}{SPACES}]", "")
    bare = F.regexp_replace(bare, _legal_form_pattern(escape_dots), "")
    return F.regexp_replace(bare, f"{SPACE}+", "")


def _drop_latin1(text: Column) -> Column:
    return F.regexp_replace(text, "[\\u0080-\\u00ff]", "")


def _char_masks(chars: Column) -> Column:
    """MAP<char, BIGINT>: at which of the first 62 positions each character stands."""
    zero = F.lit(0).cast("bigint")
    bits = F.transform(chars, lambda c, i: F.struct(
        c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i).alias("bit")))

    def masks(bits):
        seen = F.array_distinct(bits["c"])
        return F.map_from_arrays(seen, F.transform(seen, lambda c: F.aggregate(
            bits, zero, lambda mask, b: mask + F.when(b["c"] == c, b["bit"]).otherwise(zero))))
    return let(bits, masks)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two non-empty strings.

    Bit-parallel: the shorter string becomes one BIGINT mask per character and each character of
    the longer one costs a handful of integer operations. Past 62 characters on both sides the
    same recurrence runs over an array of limbs.
    """
    zero = F.lit(0).cast("bigint")

    def one_limb(masks: Column, other: Column) -> Column:
        def step(v, c):
            hit = v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), zero))
            return let(hit, lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(F.lit(_ONES)))
        left = F.aggregate(F.split(other, ""), F.lit(_ONES).cast("bigint"), step)
        return F.lit(_LIMB) - F.bit_count(left)

    def many_limbs(chars: Column, other: Column) -> Column:
        limbs = F.transform(F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / _LIMB).cast("int")),
                            lambda k: _char_masks(F.slice(chars, k * _LIMB + 1, _LIMB)))

        def run(limbs):
            start = F.transform(limbs, lambda m: F.lit(_ONES).cast("bigint"))

            def step(state, c):
                pairs = F.zip_with(state, limbs, lambda v, m: F.struct(
                    v.alias("v"),
                    v.bitwiseAND(F.coalesce(F.try_element_at(m, c), zero)).alias("u")))
                empty = F.struct(zero.alias("carry"), F.slice(start, 1, 0).alias("out"))

                def limb(acc, p):
                    total = p["v"] + p["u"] + acc["carry"]
                    return F.struct(
                        F.shiftright(total, _LIMB).alias("carry"),
                        F.concat(acc["out"], F.array(
                            total.bitwiseAND(F.lit(_ONES)).bitwiseOR(p["v"] - p["u"]))).alias("out"))
                return F.aggregate(pairs, empty, limb, lambda acc: acc["out"])

            rest = F.aggregate(F.split(other, ""), start, step)
            return F.aggregate(rest, F.lit(0), lambda n, v: n + F.lit(_LIMB) - F.bit_count(v))
        return let(limbs, run)

    def by_length(pair: Column) -> Column:
        short, long = pair["short"], pair["long"]
        return F.when(
            F.length(short) <= _LIMB,
            let(F.split(short, ""),
                 lambda chars: let(_char_masks(chars), lambda m: one_limb(m, long))),
        ).otherwise(let(F.split(short, ""), lambda chars: many_limbs(chars, long)))

    a_is_short = F.length(a) <= F.length(b)
    return let(F.struct(F.when(a_is_short, a).otherwise(b).alias("short"),
                         F.when(a_is_short, b).otherwise(a).alias("long")), by_length)


def _difflib_percent():
    @F.pandas_udf("int")
    def percent(true_name: pd.Series, guess: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": true_name, "b": guess})
        few = pairs.drop_duplicates()
        few = few.assign(p=[
            None if a is None or b is None
            else int(round(100 * difflib.SequenceMatcher(None, a, b).ratio()))
            for a, b in zip(few["a"], few["b"])])
        return pairs.merge(few, on=["a", "b"], how="left")["p"].astype("Int32")
    return percent


def cleaned_similarity(a: Column, b: Column, method: str = "lcs") -> Column:
    """INT 0..100 for two comparable strings; null on either side gives 0.

    ``lcs`` is 2*LCS/(len+len) and stays in the JVM; ``difflib`` is the Ratcliff-Obershelp ratio
    from the Python standard library, first argument first. Halves round to even.
    """
    if method == "difflib":
        return F.coalesce(_difflib_percent()(a, b), F.lit(0))
    if method != "lcs":
        raise ValueError(f"unknown similarity method {method!r}")

    def score(p):
        x, y = p["x"], p["y"]
        share = F.lit(2.0) * lcs_length(x, y) / (F.length(x) + F.length(y))
        return (F.when(x.isNull() | y.isNull(), F.lit(0))
                .when(x == y, F.lit(100))
                .when((x == "") | (y == ""), F.lit(0))
                .otherwise(F.bround(F.lit(100.0) * share, 0).cast("int")))
    return let(F.struct(a.alias("x"), b.alias("y")), score)


def name_similarity(true_name: Column, guess: Column, method: str = "lcs",
                    escape_dots: bool = False) -> Column:
    """Similarity of a true and a guessed firm name after cleaning, 0..100.

    Cleaned names have no spaces left, so sorting their tokens changes nothing; what remains of
    the token-sorted form is that characters U+0080..U+00FF are ignored.
    """
    return cleaned_similarity(_drop_latin1(clean_name(true_name, escape_dots)),
                              _drop_latin1(clean_name(guess, escape_dots)), method)


def plain_name_similarity(true_name: Column, guess: Column, method: str = "lcs",
                          escape_dots: bool = False) -> Column:
    """The form without token sorting: accented characters count."""
    return cleaned_similarity(clean_name(true_name, escape_dots), clean_name(guess, escape_dots),
                              method)


def token_sorted(text: Column) -> Column:
    """Tokens of an uncleaned string in order, for use where spaces are kept."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "),
                     lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def similarity_by_pair(df: DataFrame, true_name: str, guess: str, into: str = "name_similarity",
                       method: str = "lcs", escape_dots: bool = False, max_pairs: int = 100_000,
                       max_bytes: int = 16 << 20) -> DataFrame:
    """Add the similarity, computing each distinct pair once where there are few.

    Pairs are counted and measured up to just past ``max_pairs``. Within both limits the pair
    table is broadcast, so wide rows never move; beyond them the similarity is computed in place,
    row by row, and nothing moves either. ``df`` is read twice: give a stored table.
    """
    pairs = df.select(true_name, guess).distinct()
    length = F.coalesce(F.octet_length(true_name), F.lit(0)) + F.coalesce(F.octet_length(guess), F.lit(0))
    size = pairs.limit(max_pairs + 1).agg(F.count(F.lit(1)).alias("pairs"), F.sum(length).alias("bytes")).first()
    score = name_similarity(F.col(true_name), F.col(guess), method, escape_dots)
    if size["pairs"] > max_pairs or (size["bytes"] or 0) > max_bytes:
        return df.withColumn(into, score)
    scored = pairs.select(F.col(true_name).alias("__t"), F.col(guess).alias("__g"), score.alias(into))
    return df.join(F.broadcast(scored),
                   df[true_name].eqNullSafe(scored["__t"]) & df[guess].eqNullSafe(scored["__g"]),
                   "left").drop("__t", "__g")
