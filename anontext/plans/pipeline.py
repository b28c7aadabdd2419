"""The whole job: ladder, results, sentiment before and after, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.operators.responders import MISSING, OK, SKIPPED
from anontext.plans.ladder import LadderRun, ladder_results, run_ladder, untouched_results
from anontext.plans.sentiment import NEUTERED, RAW, add_sentiment
from anontext.schema import RunConfig
from anontext.session import scratch_path
from anontext.sources.results import write_stage

NEUTERED_RESPONSE = "sentiment_neut_response"
WAITS = "waiting"
ERRORS = "run_id string, doc_id long, step_no int, stage string, status string, message string"


@dataclass(frozen=True)
class RunOutput:
    """Stored results, the attempts behind them (None when nothing was rewritten or kept) and errors.

    ``waiting`` texts lack a recorded answer; while there are any, results are partial.
    """
    results: DataFrame
    attempts: DataFrame | None
    errors: DataFrame
    ladder: LadderRun | None
    waiting: int = 0


def run(articles: DataFrame, config: RunConfig, rewriter=None, guesser=None,
        scorer=None) -> RunOutput:
    """Run everything the configuration asks for; each stage is written once and read back.

    ``rewriter`` and ``guesser`` are needed unless both rewriting steps are off, ``scorer`` when
    sentiment is wanted.
    """
    root = config.output_path or scratch_path(articles.sparkSession, "run")
    ladder = None
    if config.rewrites:
        ladder = run_ladder(articles, config, rewriter, guesser)
        results = ladder_results(ladder)
    else:
        results = untouched_results(articles, config)
    if ladder is not None and ladder.missing:
        # Nothing is final while texts wait: neither a rate nor a sentiment would hold.
        results = write_stage(results, root, config.run_id, "partial")
    else:
        results = _with_sentiment(results, config, scorer, root)
        results = write_stage(results, root, config.run_id, "final")
    attempts = ladder.attempts if ladder else None
    errors = error_table(config.run_id, attempts, results, config, ladder.waiting if ladder and ladder.missing else None)
    if ladder is not None and not config.keep_attempts:
        errors = write_stage(errors, root, config.run_id, "errors")
        ladder.tables.discard()
        attempts = None
    return RunOutput(results, attempts, errors, ladder, ladder.missing if ladder else 0)


def _with_sentiment(results: DataFrame, config: RunConfig, scorer, root: str) -> DataFrame:
    if not config.perform_sentiment:
        return results
    # Stages are kept for the user; a run without an output path has none to keep. Texts are read from the run's tables,
    # where they lie by document, so that recorded answers travel to them and not they to the answers.
    kept = bool(config.output_path)
    if config.rewrites and kept:
        write_stage(results, root, config.run_id, "neutered")
    if config.rewrites and config.sentiment_on_neutered:
        texts = results
        results = add_sentiment(texts, scorer, config.sentiment_prompt, "neutered_text",
                                NEUTERED_RESPONSE, "direction_neut", "magnitude_neut", NEUTERED)
        if config.keep_attempts and kept:
            scored = write_stage(results, root, config.run_id, "sent_neut")
            added = [c for c in scored.columns if c not in texts.columns]
            results = texts.join(scored.select("doc_id", *added), "doc_id", "left").select(*results.columns)
    if config.sentiment_on_raw:
        results = add_sentiment(results, scorer, config.sentiment_prompt, "body",
                                config.extraction_name, "direction", "magnitude", RAW)
    return results


def error_table(run_id: str, attempts: DataFrame | None, results: DataFrame,
                config: RunConfig, waiting: DataFrame | None = None) -> DataFrame:
    """One row per answer that did not come back well: run, text, step, stage, status, message.

    Attempts are scanned once; each row carries its two answers and only the bad ones survive. A text that waits is listed
    with the answer it waits for.
    """
    def bad(df: DataFrame, step, answers: dict[str, tuple[str, str]]) -> DataFrame:
        listed = F.array(*(F.struct(F.lit(stage).alias("stage"), F.col(status).alias("status"),
                                    F.col(message).alias("message"))
                           for stage, (status, message) in answers.items()))
        return (df.select(F.lit(run_id).alias("run_id"), "doc_id", step.cast("int").alias("step_no"),
                          F.inline(listed))
                .filter(~F.col("status").isin(OK, SKIPPED)))

    parts = []
    if attempts is not None:
        parts.append(bad(attempts, F.col("step_no"), {"rewrite": ("text_status", "text_message"),
                                                      "guess": ("guess_status", "guess_message")}))
    scored = {stage: (f"{c}_status", f"{c}_message")
              for stage, c in (("sentiment_neut", NEUTERED_RESPONSE), ("sentiment_raw", config.extraction_name))
              if f"{c}_status" in results.columns}
    if scored:
        parts.append(bad(results, F.lit(None), scored))
    if waiting is not None:
        stage = F.when(F.col("text_status") == MISSING, F.lit("rewrite")).otherwise(F.lit("guess"))
        parts.append(waiting.select(F.lit(run_id).alias("run_id"), "doc_id", "step_no", stage.alias("stage"),
                                    F.lit(WAITS).alias("status"), F.lit(None).cast("string").alias("message")))
    if not parts:
        return results.sparkSession.createDataFrame([], ERRORS)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
