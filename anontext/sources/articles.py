"""Reading article tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anontext.schema import SOURCE_COLUMNS, conform_articles, require_unique
from anontext.session import COMPRESSION
from anontext.sources.splitcsv import read_csv_split

# Cell texts that the usual CSV round trip turns into missing values.
NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV path."""
    return _reader(spark).csv(path).columns


def by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Paths put together by their header, so that a plan grows with the number of headers, not of paths."""
    out: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        out.setdefault(tuple(header_of(spark, path)), []).append(path)
    return list(out.values())


def read_csv(spark: SparkSession, path: str | list[str], null_cells: bool = True, split: bool = False) -> DataFrame:
    """CSV with a header as text columns; quoted cells may hold line breaks.

    ``split`` reads one big file by many tasks (see ``splitcsv``); otherwise a file is read by one.

    All files of one call have the same header; one with other columns, or in another order, stops the job
    (``combine_csv`` joins such files by column name).

    An unnamed first column, left by writers that store their row numbers, is called ``row``.
    """
    reader = _reader(spark)
    raw = reader.csv(path)
    if split:
        raw = read_csv_split(spark, path, raw.columns)
        raw = raw.select(*(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in raw.columns))
    elif "_c0" not in raw.columns:  # a header with an unnamed column cannot be held against other files
        raw = reader.option("enforceSchema", False).csv(path)
    if raw.columns[0] in ("_c0", "Unnamed: 0"):
        raw = raw.withColumnRenamed(raw.columns[0], "row")
    if null_cells:
        raw = raw.select(*(F.when(~F.col(f"`{c}`").isin(*NULL_CELLS), F.col(f"`{c}`")).alias(c)
                           for c in raw.columns))
    return raw


def ingest_csv(spark: SparkSession, path: str | list[str], out: str, key: str | None = None,
               strict_dates: bool = True, split: bool = False) -> DataFrame:
    """Load article CSV files once into parquet with a unique ``doc_id`` and read that back.

    Paths may have their columns in different orders, or some that others lack; they meet by name. Without a key column rows get
    ids while they are written, so ids stay put afterwards. ``split`` lets many tasks read one big file.
    """
    groups = [path] if isinstance(path, str) else by_header(spark, path)
    frames = [read_csv(spark, same, split=split) for same in groups]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if key is None:
        raw, key = raw.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id"
    raw = raw if key == "row" else raw.drop("row")
    conform_articles(raw, key, strict_dates).write.mode("overwrite").option("compression", COMPRESSION).parquet(out)
    return read_articles(spark, out)


def read_articles(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Articles in parquet with all their columns, the key checked."""
    articles = conform_articles(spark.read.parquet(path))
    return require_unique(articles) if validate else articles


def write_csv(df: DataFrame, path: str, source_names: bool = True) -> None:
    """CSV with a header and quoted text, under the source column names on request."""
    if source_names:
        theirs = {ours: name for name, ours in SOURCE_COLUMNS.items()}
        df = df.select(*(F.col(c).alias(theirs.get(c, c)) for c in df.columns))
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
