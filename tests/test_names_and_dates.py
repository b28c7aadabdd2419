import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from anontext.functions.identify import check_identified, date_guess_correct, parse_iso_date
from anontext.functions.names import (clean_name, cleaned_similarity, lcs_length, name_similarity,
                                      plain_name_similarity, similarity_by_pair, token_sorted)

CLEANED = {
    "Apple Inc.": "apple", "Royal Dutch (THE) PLC": "royaldutch", "Johnson & Johnson": "johnsonjohnson",
    "Siemens AG": "siemens", "S.A. Foo": "foo", "A-Tech Corp": "atech", "Company_1": "company_1",
    "Star Bulk Co.": "bulk", "Snap Inc.": "", "Sea Limited": "", "Samsung": "samsung",
    "Société Générale SA": "sociétégénérale", "S A Foods": "foods",
}


def test_clean_name(spark):
    df = spark.createDataFrame([(n,) for n in CLEANED], "n string")
    found = {r.n: r.c for r in df.select("n", clean_name(F.col("n")).alias("c")).collect()}
    assert found == CLEANED


def test_dots_can_be_taken_literally(spark):
    df = spark.createDataFrame([("Snap Inc.",), ("Star S.A.",)], "n string")
    found = [r.c for r in df.select(clean_name(F.col("n"), escape_dots=True).alias("c")).collect()]
    assert found == ["snap", "star"]


@pytest.mark.parametrize("a, b, lcs, ratcliff", [
    ("bluebolt", "bluebolt", 100, 100), ("bluebolt", "bluebold", 88, 88), ("bluebolt", "redbolt", 67, 67),
    ("bluebolt", "boltblue", 50, 50), ("tide", "diet", 50, 25), ("diet", "tide", 50, 50),
    ("nai", "na", 80, 80), (None, "anything", 0, 0), ("x", None, 0, 0), ("", "", 100, 100), ("", "x", 0, 0),
])
def test_similarity(spark, a, b, lcs, ratcliff):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(cleaned_similarity(F.col("a"), F.col("b")).alias("l"),
                    cleaned_similarity(F.col("a"), F.col("b"), "difflib").alias("r")).first()
    assert (row.l, row.r) == (lcs, ratcliff)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_lcs_length_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for _ in range(200):
        letters = "abcdé𝒳"[:rng.randint(2, 6)]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice((3, 20, 62, 63, 64, 124, 125, 190))))
                for _ in range(2))
        rows.append((a, b, _lcs(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert df.filter(lcs_length(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_similarity_is_bounded_symmetric_and_whole_on_itself(spark):
    rng = random.Random(11)
    rows = [tuple("".join(rng.choice("abcde f.") for _ in range(rng.randint(0, 30))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    bad = df.filter(~name_similarity(a, b).between(0, 100) | (name_similarity(a, b) != name_similarity(b, a))
                    | (name_similarity(a, a) != 100))
    assert bad.count() == 0


def test_halves_round_to_even(spark):
    # 2*149/400 = 0.745
    a, b = "x" * 149 + "a" * 51, "x" * 149 + "b" * 51
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(cleaned_similarity(F.col("a"), F.col("b")).alias("s")).first().s == 74


def test_accents_count_only_in_the_plain_form(spark):
    df = spark.createDataFrame([("Société", "Socit")], "a string, b string")
    row = df.select(name_similarity(F.col("a"), F.col("b")).alias("s"),
                    plain_name_similarity(F.col("a"), F.col("b")).alias("p")).first()
    assert row.s == 100 and row.p == 83


def test_pairs_give_the_same_as_rows(spark):
    names = ["Blue Bolt Inc", "Red Rod", None, "", "Snap", "NA"]
    df = spark.createDataFrame([(a, b) for a in names for b in names] * 3, "a string, b string")
    direct = df.withColumn("s", name_similarity(F.col("a"), F.col("b")))
    for limit in (1, 1000):
        paired = similarity_by_pair(df, "a", "b", "s", max_pairs=limit)
        assert sorted(paired.collect(), key=str) == sorted(direct.collect(), key=str)


def test_token_sorted(spark):
    assert spark.range(1).select(token_sorted(F.lit("Delta, alpha  charlie")).alias("t")).first().t == "alpha charlie delta"


@pytest.mark.parametrize("text, day", [
    ("2024-01-05", dt.datetime(2024, 1, 5)), ("2024-1-5", dt.datetime(2024, 1, 5)),
    ("2024-01-05 10:00:00", None), ("2024-01", None), ("20240105", None), ("2024-01-05.", None),
    (" 2024-01-05", None), ("2024-01-05\n", None), ("2024-02-30", None), ("1500-01-01", None),
    ("2300-01-01", None), ("1677-09-21", None), ("1677-09-22", dt.datetime(1677, 9, 22)),
    ("2262-04-11", dt.datetime(2262, 4, 11)), ("2262-04-12", None), ("", None), ("NA", None), (None, None),
])
def test_parse_iso_date(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_iso_date(F.col("t")).alias("d")).first().d == day


@pytest.mark.parametrize("true, guess, correct", [
    ("2024-01-08 00:00:00", "2024-01-01", 1), ("2024-01-08 10:00:00", "2024-01-01", 0),
    ("2023-12-25 00:00:00", "2024-01-01", 1), ("2024-01-09 00:00:00", "2024-01-01", 0), (None, "2024-01-01", 0),
])
def test_date_guess_correct(spark, true, guess, correct):
    df = spark.createDataFrame([(true, guess)], "t string, g string").select(
        F.col("t").cast("timestamp_ntz").alias("t"), parse_iso_date(F.col("g")).alias("g"))
    assert df.select(date_guess_correct(F.col("t"), F.col("g")).alias("c")).first().c == correct


def test_identified_by_name_or_date(spark):
    rows = [("Blue Bolt", "blue bolt inc", "x"), ("Blue Bolt", "Red Rod", "2024-01-03"), ("Blue Bolt", "Red", "2023-01-01"),
            ("Nai Corp", "NA", "NA"), (None, "NA", "NA")]
    df = spark.createDataFrame(rows, "comnam string, name_guess string, date_guess_raw string").withColumn(
        "pub_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    flags = [r.iort_guess_correct_q for r in check_identified(df, suffix="_q").collect()]
    assert flags == [1, 1, 0, 1, 0]
    assert [r.iort_guess_correct for r in check_identified(df, threshold=101).collect()] == [0, 1, 0, 0, 0]
