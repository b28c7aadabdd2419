"""Profiles of the input and summaries of attempts and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anontext.operators.responders import Step
from anontext.plans.ladder import step_name

# Columns of an attempt that the wide view shows for each step.
WIDE_COLUMNS = ("guess_response", "name_similarity", "name_guess_correct", "date_guess_correct",
                "identified")


def profile(articles: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct firms, tickers and industries, nulls not counted, and the first and last date."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return articles.agg(
        count(F.col("comnam")).alias("firms"), count(F.col("ticker")).alias("tickers"),
        count(F.col("industry")).alias("industries"),
        F.min("pub_date").alias("earliest"), F.max("pub_date").alias("latest"))


# Sketches of 2^14 registers: a standard error of 0.8 %, so 2.5 % is exceeded once in some hundred counts.
SKETCH_BITS = 14
MEASURES = {"firms": "comnam", "tickers": "ticker", "industries": "industry"}


def profile_sketch(articles: DataFrame) -> DataFrame:
    """One row that profiles of several inputs are merged from: a sketch of each column's values, and the date range.

    A few kilobytes, to be stored with a run; ``merge_profiles`` gives what ``profile`` would over all their rows.
    """
    return articles.agg(
        *(F.hll_sketch_agg(F.col(c), F.lit(SKETCH_BITS)).alias(f"{m}_sketch") for m, c in MEASURES.items()),
        F.min("pub_date").alias("earliest"), F.max("pub_date").alias("latest"), F.count(F.lit(1)).alias("texts"))


def merge_profiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct firms, tickers and industries (estimated), dates and texts, over all rows or by columns."""
    merged = sketches.groupBy(*by).agg(
        *(F.hll_sketch_estimate(F.hll_union_agg(F.col(f"{m}_sketch"))).alias(m) for m in MEASURES),
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"))
    return merged


def percent(flag: Column) -> Column:
    """Share of ones in percent, three decimals; null over no rows."""
    return F.round(100 * F.avg(flag), 3)


def identification_rate(results: DataFrame, flag: str = "iort_guess_correct_neutered", waiting: int = 0) -> DataFrame:
    """The share of texts still identified; null for runs that were never audited, and while texts wait for answers."""
    column = F.col(flag) if flag in results.columns and not waiting else F.lit(None).cast("int")
    return results.agg(percent(column).alias("identification_rate"))


def step_summary(results: DataFrame, waiting: int = 0) -> DataFrame:
    """Number of texts by the step they passed at, most first; texts that wait for answers are counted as such."""
    counts = results.groupBy("neutered_at_step").agg(F.count(F.lit(1)).alias("texts"))
    if waiting:
        counts = counts.unionByName(results.sparkSession.createDataFrame([("waiting", waiting)], counts.schema))
    return (counts
            .orderBy(F.desc("texts"), "neutered_at_step"))


def first_passed_step(attempts: DataFrame) -> DataFrame:
    """Per text, the first step at which it was not identified, and how many it went through.

    A text has at most one row per step, so groups are small whatever the data.
    """
    passed = F.col("identified") == 0
    first = F.min_by(F.when(passed, step_name()), F.when(passed, F.col("step_no")))
    return attempts.select("doc_id", "step_no", "round", "kind", "identified").groupBy("doc_id").agg(
        F.coalesce(first, F.lit("never_neutered")).alias("first_passed_at"),
        F.count(F.lit(1)).alias("attempts"))


def last_guess(attempts: DataFrame) -> DataFrame:
    """Per text, the guesses of its last step: later answers replace earlier ones."""
    kept = ["ticker_guess", "name_guess", "date_guess_raw", "industry_guess", "step_no"]
    return attempts.groupBy("doc_id").agg(
        F.max_by(F.struct(*kept), "step_no").alias("last")).select("doc_id", "last.*")


def wide_attempts(attempts: DataFrame, steps: list[Step],
                  columns: tuple[str, ...] = WIDE_COLUMNS) -> DataFrame:
    """One row per text with the columns of each step side by side, named ``<column>_<step>``.

    One pass: each text's attempts become a map from step to struct, which is then spread out.
    """
    by_step = attempts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(
        F.struct("step_no", F.struct(*columns)))).alias("steps"))
    names = {"mask": "masking_step", "para": "paraphrasing_step"}
    return by_step.select("doc_id", *(
        F.try_element_at("steps", F.lit(s.step_no))[c].alias(f"{c}_{names[s.kind]}_{s.round}")
        for s in steps for c in columns))
