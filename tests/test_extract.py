import pytest
from pyspark.sql import functions as F

from anontext.functions.extract import extract_guess, extract_sentiment, normalise_answer
from anontext.functions.text import clean_characters, estimated_tokens, word_count

GUESSES = [
    ("**Ticker Estimate: ABCD**,**Name Estimate: Blue Bolt, Inc.**,"
     "**Industry Estimate: Restaurants, Hotels, and Motels**,**Date Estimate: 2024-01-05**",
     ("ABCD", "Blue Bolt, Inc.", "2024-01-05", "Restaurants, Hotels, and Motels")),
    ("ticker estimate: n/a; name estimate: None\nsector estimate: `Banking`;; year estimate: "
     "2024-01-05. Because it says so", ("NA", "NA", "2024-01-05. Because it says so", "Banking")),
    ("Date Estimate: 2024-1-5 Name Estimate: Red_Rod", ("NA", "RedRod", "2024-1-5", "NA")),
    ("I cannot tell.", ("NA",) * 4),
    ("", ("NA",) * 4),
    (None, ("NA",) * 4),
    ("Ticker Estimate: ABCD, Ticker Estimate: WXYZ", ("ABCD", "NA", "NA", "NA")),
    ("Sticker Estimate: Q,Name Estimate:", ("Q", "NA", "NA", "NA")),
    ("Ticker Estimate: AB\x1cCD", ("AB CD", "NA", "NA", "NA")),
]

SENTIMENTS = [
    ("**Direction Estimate: 1**,**Magnitude Estimate: 0.8**", "1", 0.8),
    ("direction estimate: 0 magnitude estimate: .25", "0", 0.25),
    ("Direction Estimate: NA, Magnitude Estimate: N/A", "NA", None),
    ("Direction Estimate: , Magnitude Estimate: 1.5", "", 1.5),
    ("Direction Estimate: null, Magnitude Estimate: high", "null", None),
    ("Magnitude Estimate: 1e-1", "NA", 0.1),
    ("no signal", "NA", None),
    ("", "NA", None),
    (None, "NA", None),
    ("Direction Estimate: 1 because good,Magnitude Estimate: 80%", "1 because good", None),
    ("Magnitude Estimate: 1.0d", "NA", None),
    ("Magnitude Estimate: nan", "NA", None),
    ("Magnitude Estimate: -Infinity", "NA", float("-inf")),
    ("Magnitude Estimate: 1e400", "NA", None),
    ("Magnitude Estimate: +.5", "NA", 0.5),
]


def test_guess_fields(spark):
    rows = [(i, a) for i, (a, _) in enumerate(GUESSES)]
    df = extract_guess(spark.createDataFrame(rows, "i int, answer string"), "answer",
                       ("t", "n", "d", "ind"))
    found = {r.i: (r.t, r.n, r.d, r.ind) for r in df.collect()}
    assert found == {i: want for i, (_, want) in enumerate(GUESSES)}


def test_guess_fields_survive_more_markdown(spark):
    rows = [(a, "_`" + "*".join(a)) for a, _ in GUESSES if a]
    df = spark.createDataFrame(rows, "a string, b string").filter(
        normalise_answer(F.col("a")) != normalise_answer(F.col("b")))
    assert df.count() == 0


def test_sentiment_fields(spark):
    rows = [(i, a) for i, (a, _, _) in enumerate(SENTIMENTS)]
    df = extract_sentiment(spark.createDataFrame(rows, "i int, answer string"), "answer", ("dir", "mag"))
    found = {r.i: (r.dir, r.mag) for r in df.collect()}
    assert found == {i: (d, m) for i, (_, d, m) in enumerate(SENTIMENTS)}


def test_extraction_is_native(spark):
    df = extract_guess(spark.createDataFrame([("x",)], "answer string"), "answer", ("t", "n", "d", "i"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("text, words", [("", 0), ("  \n ", 0), ("a", 1), (" a\tb c\n", 3), (None, None)])
def test_word_count(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(word_count(F.col("t")).alias("n")).first().n == words


def test_token_estimates_truncate(spark):
    row = spark.range(1).select(estimated_tokens(F.lit(7)).alias("a"), estimated_tokens(F.lit(7), 2).alias("b"),
                                clean_characters(F.lit("a'b*\\\nc")).alias("c")).first()
    assert (row.a, row.b, row.c) == (10, 14, "abc")
