"""Table schemas, the input contract and the configuration of a run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anontext.functions.dates import parse_mixed_date
from anontext.functions.identify import DATE_TOLERANCE_DAYS, NAME_THRESHOLD
from anontext.operators import templates

SOURCE_COLUMNS = templates.SOURCE_COLUMNS

ARTICLES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("comnam", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])

ATTEMPT = T.StructType([
    T.StructField("round", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_status", T.StringType()),
    T.StructField("text_message", T.StringType()),
    T.StructField("guess_response", T.StringType()),
    T.StructField("guess_status", T.StringType()),
    T.StructField("guess_message", T.StringType()),
    T.StructField("ticker_guess", T.StringType()),
    T.StructField("name_guess", T.StringType()),
    T.StructField("date_guess_raw", T.StringType()),
    T.StructField("date_guess", T.TimestampNTZType()),
    T.StructField("industry_guess", T.StringType()),
    T.StructField("name_similarity", T.IntegerType()),
    T.StructField("name_guess_correct", T.IntegerType()),
    T.StructField("date_guess_correct", T.IntegerType()),
])

# One step's table: keys and prompt columns of the article, not its body. ``asked_text`` is kept of texts that wait,
# and ``identified`` is 0 for passed, 1 for still identified, 2 for waiting.
STEP_TABLE = T.StructType([f for f in ARTICLES.fields if f.name != "body"] + [T.StructField("step_no", T.IntegerType())]
                          + ATTEMPT.fields + [T.StructField("asked_text", T.StringType()), T.StructField("identified", T.IntegerType())])

# Names that runs give to columns of their own.
RESERVED = frozenset({f.name for f in STEP_TABLE} | {f.name for f in ARTICLES} | {
    "current_text", "write", "run_id", "neutered_text", "neutered_at_round", "neutered_at_step", "ticker_guess_neutered",
    "name_guess_neutered", "date_guess_neutered", "industry_guess_neutered", "name_similarity_neutered",
    "name_guess_correct_neutered", "date_guess_correct_neutered", "iort_guess_correct_neutered", "direction", "magnitude",
    "direction_neut", "magnitude_neut", "sentiment_neut_response", "sentiment_neut_response_status", "sentiment_neut_response_message"})


def other_columns(columns: list[str], used: set[str]) -> dict[str, str]:
    """The user's other columns and their names in a run: a name that runs use gets ``_input`` behind it."""
    out: dict[str, str] = {}
    taken = {c.lower() for c in columns} | RESERVED
    for c in columns:
        if c in used:
            continue
        name = c
        if c.lower() in RESERVED or c.startswith("__"):
            name = f"{c.lstrip('_')}_input"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out[c] = name
    return out


def conform_articles(df: DataFrame, key: str = "doc_id", strict_dates: bool = True) -> DataFrame:
    """Check the input contract: the ``ARTICLES`` columns first, then all others (see ``other_columns``).

    Columns may carry the source names or the names used here. ``key`` is the unique row key. A
    date that is text is parsed; one that fits no format stops the job, or becomes null when
    ``strict_dates`` is off.
    """
    present = {ours: (theirs if theirs in df.columns else ours)
               for theirs, ours in SOURCE_COLUMNS.items()
               if theirs in df.columns or ours in df.columns}
    missing = [theirs for theirs, ours in SOURCE_COLUMNS.items() if ours not in present]
    if key not in df.columns:
        missing.append(key)
    if missing:
        raise ValueError(f"input lacks required columns: {', '.join(missing)}")
    date = F.col(f"`{present['pub_date']}`")
    if isinstance(df.schema[present["pub_date"]].dataType, T.StringType):
        parsed = parse_mixed_date(date)
        if strict_dates:
            unread = date.isNotNull() & (F.trim(date) != "") & parsed.isNull()
            parsed = F.when(unread, F.raise_error(F.concat(F.lit("unreadable date: "), date))
                            .cast("timestamp_ntz")).otherwise(parsed)
        date = parsed
    text = {c: F.col(f"`{present[c]}`").cast("string").alias(c)
            for c in ("body", "comnam", "ticker", "industry")}
    others = other_columns(df.columns, {key, *present.values()})
    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), *text.values(),
                     date.cast("timestamp_ntz").alias("pub_date"), *(F.col(f"`{c}`").alias(n) for c, n in others.items()))


def require_unique(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stop when a key is null or repeats; only the key column is read and shuffled."""
    counts = df.groupBy(key).count()
    worst = counts.filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if worst:
        raise ValueError(f"{key} is not a unique key, see {worst[0][0]!r}")
    return df


@dataclass(frozen=True)
class RunConfig:
    """Everything a run can be told. Prompts are strings or templates."""
    run_id: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex[:12]}")
    output_path: str | None = None
    masking: bool = True
    paraphrase: bool = True
    max_rounds: int = 8
    mask_template: object = field(default_factory=lambda: templates.MASK_TEMPLATE)
    para_template: object = field(default_factory=lambda: templates.PARA_TEMPLATE)
    mask_template_iter: object = field(default_factory=lambda: templates.MASK_TEMPLATE_ITER)
    para_template_iter: object = field(default_factory=lambda: templates.PARA_TEMPLATE_ITER)
    guess_prompt: object = templates.GUESS_PROMPT
    sentiment_prompt: object = templates.SENTIMENT_PROMPT
    perform_sentiment: bool = True
    sentiment_on_raw: bool = True
    sentiment_on_neutered: bool = True
    extraction_name: str = "LLM_RAW"
    model_name: str = "gemma3:4b"
    provider: str = "ollama"
    threshold: int = NAME_THRESHOLD
    tolerance_days: int = DATE_TOLERANCE_DAYS
    similarity_method: str = "lcs"
    escape_dots: bool = False
    # A lost or failed answer names nobody and so passes as anonymised; strict turns that round.
    strict: bool = False
    # Keep the step tables of a finished run, and take up a broken-off run where it stopped.
    keep_attempts: bool = True
    resume: bool = False
    # Buckets that articles and attempts are laid out in, and so the tasks of a step. Left out, as many as a shuffle
    # has partitions, but no more than the rows can use.
    partitions: int | None = None

    def __post_init__(self):
        if self.max_rounds < 0:
            raise ValueError("max_rounds must not be negative")
        if not self.run_id or "/" in self.run_id:
            raise ValueError("run_id must be a plain folder name")

    @property
    def rewrites(self) -> bool:
        return self.masking or self.paraphrase
