"""Writing, reading and combining run results, guesses and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from anontext.schema import SOURCE_COLUMNS
from anontext.session import COMPRESSION, settings
from anontext.sources.articles import by_header, read_csv, write_csv

# Names of result columns in exported files.
EXPORT_NAMES = {
    "neutered_text": "Body Text Neutered",
    "ticker_guess_neutered": "Ticker_Guess_Neutered",
    "name_guess_neutered": "Name_Guess_Neutered",
    "date_guess_neutered": "Date_Guess_Neutered",
    "industry_guess_neutered": "Industry_Guess_Neutered",
    "sentiment_neut_response": "LLM_NEUT",
    "direction_neut": "Direction_neut",
    "magnitude_neut": "Magnitude_neut",
    "direction": "Direction",
    "magnitude": "Magnitude",
}

STAGES = ("neutered", "sent_neut", "partial", "final", "errors")


def stage_path(root: str, run_id: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    return f"{root}/{stage}/run_id={run_id}"


def write_stage(df: DataFrame, root: str, run_id: str, stage: str) -> DataFrame:
    """Store one stage of a run's results, replacing only that run, and read it back."""
    path = stage_path(root, run_id, stage)
    df.drop("run_id").write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.drop("run_id").schema).parquet(path).withColumn(
        "run_id", F.lit(run_id))


def combine_runs(spark: SparkSession, root: str, run_ids: list[str] | None = None,
                 all_runs: bool = False, stage: str = "final") -> DataFrame | None:
    """The results of the named runs, or of all, as one table; columns a run lacks are null.

    Only the folders of named runs are looked at, and one that is not there stops the job. None when all
    runs are asked for and there are none. Ids stay text, such as 007.
    """
    if not all_runs and not run_ids:
        raise ValueError("name the runs or ask for all_runs")
    base = f"{root}/{stage}"
    paths = [base] if all_runs else [stage_path(root, r, stage) for r in dict.fromkeys(run_ids)]
    with settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        try:
            return spark.read.option("mergeSchema", True).option("basePath", base).parquet(*paths)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            if all_runs:
                return None
            raise ValueError(f"a run to combine is not there: {problem.getMessage()}") from problem


def combine_csv(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Result CSV files whose headers differ, as one table; row-number columns are dropped.

    Paths of one header are read together, so the plan grows with the number of headers, not of paths.
    """
    frames = [read_csv(spark, same).drop("row") for same in by_header(spark, paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def export_names(results: DataFrame) -> DataFrame:
    """Results under the column names that exported files carry."""
    names = {**{ours: theirs for theirs, ours in SOURCE_COLUMNS.items()}, **EXPORT_NAMES}
    return results.select(*(F.col(c).alias(names.get(c, c)) for c in results.columns))


def export_csv(results: DataFrame, path: str) -> None:
    """A finished result table as CSV with a header."""
    write_csv(export_names(results), path, source_names=False)


def write_guesses(guesses: DataFrame, path: str) -> None:
    """Model guesses, one folder per model."""
    guesses.write.mode("overwrite").partitionBy("model").parquet(path)
