"""Guess the same finished texts with several models and compare identification rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.functions.extract import extract_guess
from anontext.functions.identify import check_identified
from anontext.operators.templates import GUESS_PROMPT
from anontext.plans.metrics import percent


def guess_with_models(texts: DataFrame, models: list[str], responder, text: str = "neutered_text",
                      prompt: str = GUESS_PROMPT) -> DataFrame:
    """Each text once per model, with the model's answer and its four guesses.

    Models are listed on each row and unfolded, so the texts are scanned once. The responder sees
    the ``model`` column. Its policy should skip blank texts and lose failed answers
    (``responders.ROBUSTNESS``).
    """
    per_model = texts.withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))
    scored = responder.score(per_model, F.lit(prompt), F.col(text), "__answer")
    scored = scored.withColumns({"guess_response": F.col("__answer.text"),
                                 "guess_status": F.col("__answer.status")}).drop("__answer")
    return extract_guess(scored, "guess_response",
                         ("ticker_guess", "name_guess", "date_guess_raw", "industry_guess"))


def audit_models(guesses: DataFrame, **audit) -> DataFrame:
    """Add identification flags to guesses that carry the true name and date."""
    return check_identified(guesses, **audit)


def rate_by_model(audited: DataFrame) -> DataFrame:
    """Texts and identification rate of each model; partial sums are combined before the shuffle."""
    return audited.groupBy("model").agg(
        F.count(F.lit(1)).alias("texts"),
        percent(F.col("iort_guess_correct")).alias("identification_rate"))


def wide_guesses(guesses: DataFrame, models: list[str]) -> DataFrame:
    """One row per text with each model's four guesses side by side."""
    kept = ("guess_response", "ticker_guess", "name_guess", "date_guess_raw", "industry_guess")
    by_model = guesses.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(
        F.struct("model", F.struct(*kept)))).alias("models"))
    return by_model.select("doc_id", *(
        F.try_element_at("models", F.lit(m))[c].alias(f"{c}_{m}") for m in models for c in kept))
