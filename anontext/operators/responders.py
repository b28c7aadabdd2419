"""Responders turn a system text and a user text into an answer with a status.

All share ``score(df, system, user, into, step)``, which adds one column
STRUCT<text, status, message>. No network client is included: answers come from a Column
expression, from a table of recorded answers, or from a Python function the caller brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anontext.functions.text import strip

# Parts of error messages that lose the answer (null) rather than empty it.
TOO_LONG_MESSAGES = ("context_length_exceeded", "maximum context length")
HTML_MESSAGE = "<!DOCTYPE html>"

OK, TOO_LONG, HTML, ERROR, MISSING, SKIPPED = "ok", "too_long", "html", "error", "missing", "skipped"


@dataclass(frozen=True)
class Step:
    """One position of the ladder: which pass, of which round, with which prompt.

    Sentiment has no position: its step is SENTIMENT_STEP, and ``target`` says of which text.
    """
    step_no: int
    round: int
    kind: str
    template: object = None
    target: str | None = None


SENTIMENT_STEP = -1


@dataclass(frozen=True)
class Call:
    system: Column
    user: Column
    step: Step | None = None


@dataclass(frozen=True)
class Policy:
    """How answers are cleaned up and which texts are sent at all."""
    trim: bool = True
    null_on_error: bool = False
    empty_to_null: bool = False
    skip_blank: bool = False


# Fixed policies: hosted models have their answers trimmed and local ones do not; a robustness
# run skips blank texts and never keeps an empty answer.
HOSTED = Policy()
LOCAL = Policy(trim=False)
ROBUSTNESS = Policy(null_on_error=True, empty_to_null=True, skip_blank=True)


def policy_for(provider: str) -> Policy:
    return LOCAL if provider.strip().lower() == "ollama" else HOSTED


def is_recorded(responder) -> bool:
    """Whether a missing answer may still arrive, because answers come from a table."""
    return bool(getattr(responder, "recorded", False))


def error_status(message: Column) -> Column:
    too_long = message.contains(TOO_LONG_MESSAGES[0]) | message.contains(TOO_LONG_MESSAGES[1])
    return (F.when(too_long, F.lit(TOO_LONG)).when(message.contains(HTML_MESSAGE), F.lit(HTML))
            .otherwise(F.lit(ERROR)))


def answer_struct(text: Column, error: Column, user: Column, policy: Policy) -> Column:
    """Text, status and message of one answer. A lost answer is null, a failed one is empty."""
    kept = strip(text) if policy.trim else text
    if policy.empty_to_null:
        kept = F.when(kept != "", kept)
    status = (F.when(error.isNotNull(), error_status(error))
              .when(text.isNull(), F.lit(MISSING)).otherwise(F.lit(OK)))
    if policy.skip_blank:
        blank = user.isNull() | (user == "")
        status = F.when(blank, F.lit(SKIPPED)).otherwise(status)
    value = F.when(status == OK, kept)
    if not policy.null_on_error:
        value = value.when(status == ERROR, F.lit(""))
    return F.struct(value.alias("text"), status.alias("status"), error.alias("message"))


@dataclass(frozen=True)
class ExpressionResponder:
    """``build(call)`` gives the answer as a Column, or as an (answer, error) pair of Columns."""
    build: Callable[[Call], Column | tuple[Column, Column]]
    policy: Policy = HOSTED

    def score(self, df: DataFrame, system: Column, user: Column, into: str,
              step: Step | None = None) -> DataFrame:
        made = self.build(Call(system, user, step))
        text, error = made if isinstance(made, tuple) else (made, F.lit(None).cast("string"))
        answer = answer_struct(F.col("__text"), F.col("__error"), user, self.policy)
        return (df.select("*", text.alias("__text"), error.alias("__error"))
                .select(*(f"`{c}`" for c in df.columns), answer.alias(into)))


@dataclass(frozen=True)
class ReplayResponder:
    """Join recorded answers back by key; this is how a run scored offline comes home.

    ``answers`` has the key columns, an answer and, optionally, an error column. One answer per key
    counts: the newest by ``latest_by``, or else the greatest text. The columns ``step_no`` and
    ``target`` are turned into filters, so a table partitioned by them is read one step at a time;
    ``target`` ("neutered" or "raw") is looked at wherever the answers have it.
    """
    answers: DataFrame
    keys: tuple[str, ...] = ("doc_id", "step_no")
    answer: str = "response"
    error: str | None = "error"
    latest_by: str | None = None
    policy: Policy = HOSTED
    recorded = True

    def score(self, df: DataFrame, system: Column, user: Column, into: str,
              step: Step | None = None) -> DataFrame:
        answers, keys = self.answers, [k for k in self.keys if step is None or k not in ("step_no", "target")]
        if step is not None and "step_no" in self.keys and step.step_no != SENTIMENT_STEP:
            answers = answers.filter(F.col("step_no") == step.step_no)
        if step is not None and step.target is not None and "target" in answers.columns:
            answers = answers.filter(F.col("target") == step.target)
        recorded = _recorded(answers, keys, self.answer, self.error, self.latest_by)
        joined = df.join(recorded, keys, "left")
        return _attach(joined, into, user, self.policy)


@dataclass(frozen=True)
class ContentReplayResponder:
    """Join recorded answers by a digest of system and user text, whoever asked.

    Many copies of one text share a digest; adaptive execution splits such a partition of a left join.
    """
    answers: DataFrame
    digest: str = "digest"
    answer: str = "response"
    error: str | None = "error"
    latest_by: str | None = None
    policy: Policy = HOSTED
    recorded = True

    def score(self, df: DataFrame, system: Column, user: Column, into: str,
              step: Step | None = None) -> DataFrame:
        recorded = _recorded(self.answers.withColumnRenamed(self.digest, "__digest"), ["__digest"],
                             self.answer, self.error, self.latest_by)
        asked = df.withColumn("__digest", request_digest(system, user))
        joined = asked.join(recorded, "__digest", "left")
        return _attach(joined, into, user, self.policy).drop("__digest")


def request_digest(system: Column, user: Column) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat(F.coalesce(system, blank), F.lit("\x1f"), F.coalesce(user, blank)), 256)


def _recorded(answers: DataFrame, keys: list[str], answer: str, error: str | None,
              latest_by: str | None) -> DataFrame:
    message = F.col(error) if error else F.lit(None).cast("string")
    pair = F.struct(F.col(answer).alias("text"), message.alias("error"))
    if latest_by is None:
        return answers.groupBy(*keys).agg(F.max(pair).alias("__recorded"))
    return answers.groupBy(*keys).agg(F.max_by(pair, latest_by).alias("__recorded"))


def _attach(joined: DataFrame, into: str, user: Column, policy: Policy) -> DataFrame:
    got = F.col("__recorded")
    return joined.withColumn(into, answer_struct(got["text"], got["error"], user, policy)).drop("__recorded")


@dataclass(frozen=True)
class CallableResponder:
    """Run a function the caller brings, once per text, in Arrow batches.

    ``make()`` builds it once per partition and it is called as ``fn(system, user)``; an exception
    becomes the row's error. Only the two texts travel to Python. ``partitions`` spreads a slow
    function over more tasks than the input files would give.
    """
    make: Callable[[], Callable[[str, str], str]]
    policy: Policy = HOSTED
    partitions: int | None = field(default=None)

    def score(self, df: DataFrame, system: Column, user: Column, into: str,
              step: Step | None = None) -> DataFrame:
        make, skip = self.make, self.policy.skip_blank

        @F.pandas_udf("text string, error string")
        def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            respond = make()
            for systems, users in batches:
                texts, errors = [], []
                for one_system, one_user in zip(systems, users):
                    if skip and not one_user:
                        texts.append(None)
                        errors.append(None)
                        continue
                    try:
                        texts.append(respond(one_system, one_user))
                        errors.append(None)
                    except Exception as problem:  # noqa: BLE001 - the row records it
                        texts.append(None)
                        errors.append(str(problem) or type(problem).__name__)
                yield pd.DataFrame({"text": texts, "error": errors}, dtype=object)

        if self.partitions:
            df = df.repartition(self.partitions)
        # A model may answer differently each time; say so, lest the plan asks it twice.
        asked = df.withColumn("__made", call.asNondeterministic()(system, user))
        made = F.col("__made")
        return asked.withColumn(into, answer_struct(made["text"], made["error"], user, self.policy)).drop("__made")


@dataclass(frozen=True)
class WrappedResponder:
    """Another responder with Column functions around it, such as ``clean_characters``.

    ``prepare`` changes the user text on its way in and ``finish`` the answer on its way out.
    """
    inner: object
    prepare: Callable[[Column], Column] | None = None
    finish: Callable[[Column], Column] | None = None

    @property
    def recorded(self) -> bool:
        return is_recorded(self.inner)

    def score(self, df: DataFrame, system: Column, user: Column, into: str,
              step: Step | None = None) -> DataFrame:
        scored = self.inner.score(df, system, self.prepare(user) if self.prepare else user, into, step)
        if self.finish is None:
            return scored
        return scored.withColumn(into, F.col(into).withField("text", self.finish(F.col(into)["text"])))
