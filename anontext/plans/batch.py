"""The batch job: load articles, profile them, maybe sample, run, and report the rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from anontext.operators.sampling import stable_sample
from anontext.plans.metrics import identification_rate, profile, step_summary
from anontext.plans.pipeline import RunOutput, run
from anontext.schema import RunConfig
from anontext.sources.articles import ingest_csv, read_articles


@dataclass(frozen=True)
class BatchReport:
    profile: DataFrame
    output: RunOutput
    summary: DataFrame
    rate: DataFrame


def run_batch(spark: SparkSession, source: str, config: RunConfig, rewriter=None, guesser=None,
              scorer=None, *, csv_into: str | None = None, key: str | None = None,
              sample: int | None = None, seed: int = 0) -> BatchReport:
    """``source`` is parquet, or CSV when ``csv_into`` names where to load it first.

    ``sample`` takes that many articles, the same ones for the same seed; without it all are run.
    While texts wait for recorded answers the rate is null. The work is split by Spark, and each run is its own folder, so nothing is found by file name.
    """
    articles = (ingest_csv(spark, source, csv_into, key) if csv_into
                else read_articles(spark, source))
    chosen = articles if sample is None else stable_sample(articles, sample, seed=seed)
    output = run(chosen, config, rewriter, guesser, scorer)
    return BatchReport(profile(articles), output, step_summary(output.results, output.waiting),
                       identification_rate(output.results, waiting=output.waiting))
