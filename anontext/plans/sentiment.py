"""Sentiment of a text column: answer, direction and magnitude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.functions.extract import extract_sentiment
from anontext.operators.responders import SENTIMENT_STEP, Step
from anontext.operators.templates import compile_prompt

NEUTERED, RAW = "neutered", "raw"


def add_sentiment(df: DataFrame, scorer, prompt, text: str, response: str, direction: str,
                  magnitude: str, target: str) -> DataFrame:
    """Score ``text`` and add the raw answer, its status and message, direction and magnitude.

    ``target`` tells recorded answers of the neutered text from those of the raw one.
    """
    step = Step(SENTIMENT_STEP, SENTIMENT_STEP, "sentiment", prompt, target)
    scored = scorer.score(df, compile_prompt(prompt, df.columns), F.col(text), "__sentiment", step)
    scored = scored.withColumns({
        response: F.col("__sentiment.text"),
        f"{response}_status": F.col("__sentiment.status"),
        f"{response}_message": F.col("__sentiment.message"),
    }).drop("__sentiment")
    return extract_sentiment(scored, response, (direction, magnitude))
