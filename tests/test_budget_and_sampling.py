import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from anontext.operators.budget import rolling_tokens, route_by_size, score_batch
from anontext.operators.responders import ExpressionResponder
from anontext.operators.sampling import first_rows, stable_sample

START = dt.datetime(2024, 1, 1)


def test_rolling_tokens_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        client = 1 if i % 3 else rng.randint(2, 4)
        at = rng.choice([rng.randint(0, 400) * 1_000_000, rng.randint(0, 400_000_000), 60_000_000 * rng.randint(0, 6)])
        rows.append((client, START + dt.timedelta(microseconds=at), rng.randint(1, 50)))
    log = spark.createDataFrame(rows, "client bigint, ts timestamp_ntz, tokens int")
    for bucket in (61_000_000, 120_000_000, 3_600_000_000):
        found = {(r.client, r.ts): (r.requests, r.tokens, r.rolling_tokens, r.over_budget)
                 for r in rolling_tokens(log, limit=400, bucket_us=bucket).collect()}
        want = defaultdict(lambda: [0, 0, 0])
        for c, t, n in rows:
            want[c, t][0] += 1
            want[c, t][1] += n
        for (c, t), cell in want.items():
            cell[2] = sum(n for d, u, n in rows if d == c and dt.timedelta(0) <= t - u <= dt.timedelta(seconds=60))
        assert found == {k: (a, b, r, int(r >= 400)) for k, (a, b, r) in want.items()}


def test_rolling_tokens_follow_the_wall_clock_in_any_zone(spark):
    times = [dt.datetime(2024, 3, 10, h, m) for h in (1, 2, 3) for m in (0, 1, 59)]
    log = spark.createDataFrame([(1, t, 1) for t in times], "client int, ts timestamp_ntz, tokens int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {r.ts: r.rolling_tokens for r in rolling_tokens(log).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == {t: sum(0 <= (t - u).total_seconds() <= 60 for u in times) for t in times}


def test_rolling_tokens_of_absolute_times(spark):
    log = spark.range(3).select(F.lit(1).alias("client"), F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"),
                                F.lit(5).alias("tokens"))
    assert sorted(r.rolling_tokens for r in rolling_tokens(log).collect()) == [5, 10, 10]


def test_rolling_tokens_groups_by_client_and_bucket(spark):
    log = spark.range(10).select(F.lit(1).alias("client"), F.timestamp_micros("id").alias("ts"), F.lit(1).alias("tokens"))
    plan = rolling_tokens(log)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "bucket" in plan


@pytest.mark.parametrize("words, route, tokens", [(0, "empty", 0), (60_000, "send", 120_000), (60_001, "too_big", 120_002)])
def test_routes(spark, words, route, tokens):
    row = route_by_size(spark.createDataFrame([(words,)], "word_count int")).first()
    assert (row.route, row.tokens) == (route, tokens)


def _batch(spark):
    rows = [(1, "a", "one", 1), (2, "b", "two", 1), (3, "a", "three", 1), (4, "a", "huge", 60_001), (5, "c", "", 0),
            (6, "d", "big", 99_999)]
    return spark.createDataFrame(rows, "row_no int, name string, text string, word_count int")


def test_last_row_of_a_name_counts_and_big_ones_are_set_aside(spark):
    asked = ExpressionResponder(lambda call: F.concat(F.lit("re "), call.user))
    answers, big = score_batch(_batch(spark), asked, F.lit("s"))
    assert {r.name: r.response for r in answers.collect()} == {
        "a": "re three", "b": "re two",
        "c": "An error occurred: Error the error is there is no post self_text"}
    assert sorted((r.name, r.row_no) for r in big.collect()) == [("a", 4), ("d", 6)]


def test_header_and_expansion(spark):
    asked = ExpressionResponder(lambda call: F.lit("x,y"))
    answers, _ = score_batch(_batch(spark), asked, F.lit("s"), header=2, expand=lambda c: F.transform(
        F.split(c, ","), lambda v: F.struct(v.alias("v"))))
    assert sorted((r.name, r.v) for r in answers.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_first_rows(spark):
    df = spark.range(100)
    assert [r.id for r in first_rows(df, 3, "id").orderBy("id").collect()] == [0, 1, 2]
    assert first_rows(df, None, "id") is df and first_rows(df, 0, "id").count() == 0
    assert first_rows(df, 200, "id").count() == 100


@pytest.mark.parametrize("n", [0, 1, 50, 999, 1000])
def test_sample_is_exact_and_stable(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    once = {r.doc_id for r in stable_sample(df, n, seed=1).collect()}
    again = {r.doc_id for r in stable_sample(df.repartition(7), n, seed=1).collect()}
    assert len(once) == n and once == again
    if n == 50:
        assert once != {r.doc_id for r in stable_sample(df, n, seed=2).collect()}


def test_sample_larger_than_the_table(spark):
    with pytest.raises(ValueError):
        stable_sample(spark.range(3), 4, key="id")


def test_text_cap_can_be_passed_on_or_left_out(spark):
    asked = ExpressionResponder(lambda call: F.concat(F.lit("re "), call.user))
    answers, big = score_batch(_batch(spark), asked, F.lit("s"), text_tokens=None)
    assert {r.name: r.response for r in answers.collect()}["a"] == "re huge" and big.count() == 0
    answers, big = score_batch(_batch(spark), asked, F.lit("s"), text_tokens=1)
    assert {r.name for r in answers.collect()} == {"c"} and big.count() == 5


@pytest.mark.parametrize("radix", [2, 16, 4096])
def test_nth_integer(spark, monkeypatch, radix):
    import random
    from anontext.operators import sampling
    monkeypatch.setattr(sampling, "RADIX", radix)
    r = random.Random(radix)
    values = [r.choice([-5, 0, 3, 2 ** 62, -2 ** 62, r.randint(-50, 50)]) for _ in range(120)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 60, 119, 120):
        want = sorted(values)[n - 1]
        got = sampling.nth_integer(df, F.col("v"), n, min(values), max(values))
        assert got == (want, sum(v < want for v in values), values.count(want))
    assert sampling.nth_integer(df, F.col("v"), 121, min(values), max(values)) is None


def test_half_of_all_rows_without_a_sort(spark, capsys):
    df = spark.range(100_000).withColumnRenamed("id", "doc_id")
    half = stable_sample(df, 50_000, seed=3)
    half.explain()
    assert "Sort" not in capsys.readouterr().out and half.count() == 50_000
    assert [r.doc_id for r in first_rows(df, 3, "doc_id").collect()] == [0, 1, 2]
    nulls = spark.createDataFrame([(1,), (None,), (2,)], "i int")
    assert sorted(r.i for r in first_rows(nulls, 5, "i").collect()) == [1, 2]
    assert first_rows(nulls.limit(0), 5, "i").count() == 0
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "n string")
    assert sorted(r.n for r in first_rows(names, 2, "n").collect()) == ["a", "b"]


def _most_in_a_span(rows, span):
    """Largest sum of any span, both ends included, per client."""
    most = {}
    for client in {r.client for r in rows}:
        own = sorted((r.release, r.tokens) for r in rows if r.client == client and r.release is not None)
        for i, (t, _) in enumerate(own):
            most[client] = max(most.get(client, 0), sum(k for u, k in own[i:] if u <= t + span))
    return most


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("arrivals", [False, True])
def test_no_span_of_a_plan_holds_the_limit(spark, partitions, arrivals):
    import random
    from anontext.operators.budget import send_plan
    r = random.Random(partitions)
    rows = [(i, "hot" if r.random() < 0.6 else r.choice("ab"), r.choice([0, 1, 5, 30, r.randint(1, 90)]), r.randint(0, 40_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_no int, client string, tokens int, came int").repartition(partitions)
    plan = send_plan(df, arrival="came" if arrivals else None, span_us=1000, limit=100).collect()
    assert len(plan) == 400
    assert max(_most_in_a_span(plan, 1000).values()) < 100
    for client in ("hot", "a", "b"):
        own = sorted((p for p in plan if p.client == client), key=lambda p: p.row_no)
        largest, ran, idle = max(p.tokens for p in own), 0, -10 ** 18
        for p in own:  # the closed form, step by step
            at = ran * 1001 // max(1, 99 - largest)
            idle = max(idle, (p.came if arrivals else 0) - at)
            assert p.release == at + idle and p.release >= (p.came if arrivals else 0)
            ran += p.tokens


def test_plan_of_odd_requests(spark):
    from anontext.operators.budget import send_plan
    rows = [(1, None, 5), (2, None, None), (3, None, 100), (4, "a", 99), (5, "a", 0), (6, "a", 99), (7, "b", -0)]
    df = spark.createDataFrame(rows, "row_no int, client string, tokens int")
    got = {r.row_no: r.release for r in send_plan(df, span_us=1000, limit=100).collect()}
    assert got[1] == 0 and got[2] is None and got[3] is None and got[4] == 0 and got[6] - got[4] > 1000 and got[7] == 0
    assert send_plan(df.limit(0)).count() == 0
    assert send_plan(df, limit=10 ** 18).filter("release > 0").count() <= 5
