"""Article-shaped inputs derived from the test tables, as SQL that Spark and DuckDB both run.

``{STR}`` stands for the engine's string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "part", "orders", "events", "conversations")

_TICKER = "upper(concat(substr(p.p_name,1,2), substr(p.p_name, instr(p.p_name,' ')+1, 2)))"
_DAY = "cast(cast(o.o_orderdate AS date) AS {STR})"

ARTICLES = f"""
SELECT d.doc_id,
  concat(upper(p.p_name), CASE d.doc_id % 5 WHEN 0 THEN ' INC' WHEN 1 THEN ' CORP (NEW)'
    WHEN 2 THEN ' HOLDINGS LTD' WHEN 3 THEN ' CO' ELSE ' TECHNOLOGIES PLC' END) AS comnam,
  {_TICKER} AS ticker, p.p_type AS industry, o.o_orderdate AS pub_date,
  concat(upper(p.p_name), ' ($', {_TICKER}, ') said on ', {_DAY}, ' that ', p.p_type,
    ' sales rose ', cast(d.doc_id % 40 AS {{STR}}), '.5%. ', d.text) AS body
FROM documents d
JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part)
JOIN orders o ON o.o_orderkey = d.doc_id
"""

# A second firm and a shifted date for each article: plausible wrong guesses.
RIVALS = f"""
SELECT d.doc_id, p.p_name AS rival
FROM documents d
JOIN part p ON p.p_partkey = (d.doc_id * 13 + 5) % (SELECT count(*) FROM part)
"""

# Scripted guesser: right before step k = doc_id*7 % 19, by name for even and by date for odd ids.
WRONG_NAME, WRONG_DATE = "Quixotic Zephyr", "1990-01-01"
K = "(doc_id * 7) % 19"


def guess_answer(step: str) -> str:
    """The scripted answer at a step, over the columns of ARTICLES."""
    right = f"({step}) < {K}"
    day = "cast(cast(pub_date AS date) AS {STR})"
    return (f"concat('**Ticker Estimate: ', ticker, '**,**Name Estimate: ', "
            f"CASE WHEN {right} AND doc_id % 2 = 0 THEN comnam ELSE '{WRONG_NAME}' END, "
            f"'**,**Industry Estimate: ', industry, '**,**Date Estimate: ', "
            f"CASE WHEN {right} AND doc_id % 2 = 1 THEN {day} ELSE '{WRONG_DATE}' END, '**')")


# Guess answers in good and bad shape, eight layouts and the two kinds of nothing.
MESSY_GUESSES = """
SELECT doc_id, CASE doc_id % 10
  WHEN 0 THEN concat('**Ticker Estimate: ', ticker, '**,**Name Estimate: ', comnam,
    '**,**Industry Estimate: Restaurants, Hotels, and Motels**,**Date Estimate: ', day, '**')
  WHEN 1 THEN concat('ticker estimate: n/a; name estimate: None', chr(10), 'sector estimate: `',
    industry, '`;; year estimate: ', day, '. Because it says so')
  WHEN 2 THEN concat('Date Estimate: ', day, '   Name Estimate: ', replace(comnam, ' ', '_'))
  WHEN 3 THEN concat('I cannot tell. ', body)
  WHEN 4 THEN ''
  WHEN 5 THEN NULL
  WHEN 6 THEN concat('Ticker Estimate: ', ticker, ', Ticker Estimate: WXYZ')
  WHEN 7 THEN 'Sticker Estimate: Q,Name Estimate:'
  WHEN 8 THEN concat('TICKER ESTIMATE : ', ticker, ',', chr(9), 'NAME  ESTIMATE:', comnam,
    ' ; INDUSTRY ESTIMATE:null,YEAR ESTIMATE: missing')
  ELSE concat('Name Estimate: ', comnam, ',, Sector Estimate: ', industry, ' ,Date Estimate: ', day, ',;')
END AS response
FROM (SELECT *, cast(cast(pub_date AS date) AS {STR}) AS day FROM articles) a
"""

# Sentiment answers in good and bad shape.
MESSY_SENTIMENT = """
SELECT doc_id, CASE doc_id % 12
  WHEN 0 THEN concat('**Direction Estimate: ', v, '**,**Magnitude Estimate: 0.', w, '**')
  WHEN 1 THEN concat('direction estimate: ', v, ' magnitude estimate: .', w)
  WHEN 2 THEN 'Direction Estimate: NA, Magnitude Estimate: N/A'
  WHEN 3 THEN concat('Direction Estimate: , Magnitude Estimate: 1.', w)
  WHEN 4 THEN 'Direction Estimate: null, Magnitude Estimate: high'
  WHEN 5 THEN concat('Magnitude Estimate: ', w, 'e-1')
  WHEN 6 THEN concat('no signal ', body)
  WHEN 7 THEN ''
  WHEN 8 THEN NULL
  WHEN 9 THEN concat('Direction Estimate: ', v, ' because good,Magnitude Estimate: ', w, '%')
  WHEN 10 THEN concat('Direction', chr(10), 'Estimate: `', v, '`', chr(10), 'Magnitude_Estimate: ', w, 'd')
  ELSE concat('Direction Estimate: missing, Magnitude Estimate: +', w, '.')
END AS response
FROM (SELECT *, cast(doc_id % 2 AS {STR}) AS v, cast(doc_id % 97 AS {STR}) AS w FROM articles) a
"""

# Date guesses up to ten days off, in accepted and refused spellings, some articles with a time.
DATE_GUESSES = """
SELECT doc_id, true_date, CASE doc_id % 8
  WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN day
  WHEN 3 THEN replace(day, '-0', '-') WHEN 4 THEN concat(day, ' 10:00:00')
  WHEN 5 THEN replace(day, '-', '') WHEN 6 THEN concat(substr(day, 1, 8), '31') ELSE 'NA' END AS guess
FROM (SELECT doc_id, pub_date + INTERVAL 10 HOUR * (doc_id % 3) AS true_date,
        cast(date_add(cast(pub_date AS date), cast(doc_id % 21 - 10 AS int)) AS {STR}) AS day
      FROM articles) a
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def for_spark(sql: str) -> str:
    return sql.replace("{STR}", "string")


def for_duckdb(sql: str) -> str:
    return (sql.replace("{STR}", "varchar")
            .replace("date_add(cast(pub_date AS date), cast(doc_id % 21 - 10 AS int))",
                     "(cast(pub_date AS date) + cast(doc_id % 21 - 10 AS int))"))


def _run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run fixture SQL over frames instead of named views."""
    for name in frames:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(f"{lead}{name} ", f"{lead}{{{name}}} ").replace(
                f"{lead}{name})", f"{lead}{{{name}}})")
    return spark.sql(for_spark(sql), **frames)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ARTICLES``; keys alone meet parts and orders, and texts meet what was found once, by document."""
    found = tables(spark, sf_dir, "documents", "part", "orders")
    docs = found["documents"]
    found["documents"] = docs.select("doc_id").distinct().withColumn("text", F.lit(""))
    made = _run(spark, ARTICLES, **found).join(docs.select("doc_id", "text"), "doc_id")
    return made.select("doc_id", "comnam", "ticker", "industry", F.col("pub_date").cast("timestamp_ntz").alias("pub_date"),
                       F.concat("body", "text").alias("body"))


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, RIVALS, **tables(spark, sf_dir, "documents", "part"))


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture over ``articles``."""
    return _run(spark, sql, articles=articles(spark, sf_dir))
