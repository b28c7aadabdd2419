"""Request payloads for scoring offline, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request defaults, and the model family that takes a completion-token limit and
# no temperature.
MAX_TOKENS = 16384
TOP_P = 1
TEMPERATURE = 0
FREQUENCY_PENALTY = 0
PRESENCE_PENALTY = 0
COMPLETION_TOKEN_FAMILY = r"(?i)\bgpt-5"


def chat_messages(system: Column, user: Column) -> Column:
    """ARRAY<STRUCT<role, content>>: the system text, then the user text."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def _constant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def hosted_request(system: Column, user: Column, model, *, max_tokens=MAX_TOKENS, top_p=TOP_P,
                   temperature=TEMPERATURE, frequency_penalty=FREQUENCY_PENALTY,
                   presence_penalty=PRESENCE_PENALTY, logprobs=False, top_logprobs=None) -> Column:
    """Payload for a hosted chat model as JSON; arguments that are null are left out."""
    name = _constant(model)
    by_completion = name.rlike(COMPLETION_TOKEN_FAMILY)
    return F.to_json(F.struct(
        name.alias("model"),
        chat_messages(system, user).alias("messages"),
        _constant(top_p).alias("top_p"),
        _constant(frequency_penalty).alias("frequency_penalty"),
        _constant(presence_penalty).alias("presence_penalty"),
        _constant(logprobs).alias("logprobs"),
        _constant(top_logprobs).cast("int").alias("top_logprobs"),
        F.when(by_completion, _constant(max_tokens)).alias("max_completion_tokens"),
        F.when(~by_completion, _constant(temperature)).alias("temperature"),
        F.when(~by_completion, _constant(max_tokens)).alias("max_tokens"),
    ), {"ignoreNullFields": "true"})


def local_request(system: Column, user: Column, model, *, max_tokens=MAX_TOKENS, top_p=TOP_P,
                  temperature=TEMPERATURE, frequency_penalty=FREQUENCY_PENALTY,
                  presence_penalty=PRESENCE_PENALTY) -> Column:
    """Payload for a locally hosted model as JSON."""
    return F.to_json(F.struct(
        _constant(model).alias("model"),
        chat_messages(system, user).alias("messages"),
        F.struct(
            _constant(temperature).alias("temperature"),
            _constant(top_p).alias("top_p"),
            _constant(presence_penalty).alias("presence_penalty"),
            _constant(frequency_penalty).alias("frequency_penalty"),
            _constant(max_tokens).alias("max_tokens"),
            F.lit(True).alias("reset"),
        ).alias("options"),
    ), {"ignoreNullFields": "true"})


def build_requests(df: DataFrame, system: Column, user: Column, model, provider: str,
                   keys: tuple[str, ...] = ("doc_id",), **arguments) -> DataFrame:
    """Key columns and a ``request`` column; write with ``df.write.text`` or as parquet."""
    build = local_request if provider.strip().lower() == "ollama" else hosted_request
    return df.select(*keys, build(system, user, model, **arguments).alias("request"))
