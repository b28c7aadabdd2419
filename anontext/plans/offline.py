"""Scoring away from the cluster: write a step's requests, score them anywhere, replay the answers.

A run that waits for answers is a ladder with ``ReplayResponder`` and ``resume``. It stops at the first
step that has not all its answers (``LadderRun.pending``); once those of one more step have arrived, resume
it and write the requests of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.operators.requests import build_requests
from anontext.operators.responders import Step
from anontext.operators.templates import compile_prompt
from anontext.plans.sentiment import NEUTERED, RAW
from anontext.schema import RunConfig


def _requests(texts: DataFrame, template, text: str, config: RunConfig, **arguments) -> DataFrame:
    return build_requests(texts, compile_prompt(template, texts.columns), F.col(text),
                          config.model_name, config.provider, **arguments)


def rewrite_requests(texts: DataFrame, step: Step, config: RunConfig, text: str = "body",
                     **arguments) -> DataFrame:
    """Requests that rewrite each text at a step, keyed by document and step."""
    return _requests(texts, step.template, text, config, **arguments).withColumn(
        "step_no", F.lit(step.step_no))


def guess_requests(texts: DataFrame, config: RunConfig, text: str, step: Step | None = None,
                   **arguments) -> DataFrame:
    """Requests that guess firm and date from each text."""
    made = _requests(texts, config.guess_prompt, text, config, **arguments)
    return made if step is None else made.withColumn("step_no", F.lit(step.step_no))


def sentiment_requests(texts: DataFrame, config: RunConfig, text: str, target: str | None = None,
                       **arguments) -> DataFrame:
    """Requests for the direction and magnitude of each text, keyed by document and target."""
    made = _requests(texts, config.sentiment_prompt, text, config, **arguments)
    return made.withColumn("target", F.lit(target or (RAW if text == "body" else NEUTERED)))
