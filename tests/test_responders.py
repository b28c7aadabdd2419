from pyspark.sql import functions as F

from anontext.operators.responders import (LOCAL, ROBUSTNESS, CallableResponder, ContentReplayResponder,
                                           ExpressionResponder, ReplayResponder, Step, policy_for,
                                           request_digest)

CASES = [
    (1, " fine ", None, "fine", "ok"),
    (2, None, "x context_length_exceeded y", None, "too_long"),
    (3, None, "the maximum context length is", None, "too_long"),
    (4, None, "Maximum Context Length", "", "error"),
    (5, None, "<!DOCTYPE html><html>", None, "html"),
    (6, None, "timeout", "", "error"),
    (7, None, None, None, "missing"),
]


def _answers(spark):
    return spark.createDataFrame([(i, 2, a, e) for i, a, e, _, _ in CASES] + [(1, 3, "other step", None)],
                                 "doc_id bigint, step_no int, response string, error string")


def test_replayed_answers_are_classified(spark):
    docs = spark.range(1, 9).withColumnRenamed("id", "doc_id")
    scored = ReplayResponder(_answers(spark)).score(docs, F.lit("s"), F.lit("u"), "a", Step(2, 1, "mask"))
    found = {r.doc_id: (r.a.text, r.a.status) for r in scored.collect()}
    assert found == {**{i: (t, s) for i, _, _, t, s in CASES}, 8: (None, "missing")}


def test_robustness_policy_skips_blanks_and_loses_failures(spark):
    docs = spark.createDataFrame([(1, "x"), (6, "x"), (2, ""), (3, None), (4, "x")], "doc_id bigint, t string")
    blank = spark.createDataFrame([(1, " ", None), (6, None, "timeout"), (2, "answer", None), (4, "a ", None)],
                                  "doc_id bigint, response string, error string")
    scored = ReplayResponder(blank, ("doc_id",), policy=ROBUSTNESS).score(docs, F.lit("s"), F.col("t"), "a")
    found = {r.doc_id: (r.a.text, r.a.status) for r in scored.collect()}
    assert found == {1: (None, "ok"), 6: (None, "error"), 2: (None, "skipped"), 3: (None, "skipped"), 4: ("a", "ok")}


def test_latest_answer_counts(spark):
    answers = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "doc_id bigint, response string, at int")
    docs = spark.createDataFrame([(1,)], "doc_id bigint")
    responder = ReplayResponder(answers, ("doc_id",), error=None, latest_by="at")
    assert [r.a.text for r in responder.score(docs, F.lit(""), F.lit(""), "a").collect()] == ["new"]


def test_local_answers_are_not_trimmed(spark):
    assert policy_for(" OLLAMA ") is LOCAL
    docs = spark.range(1)
    for policy, want in ((LOCAL, " x "), (policy_for("openai"), "x")):
        scored = ExpressionResponder(lambda call: F.lit(" x "), policy).score(docs, F.lit(""), F.lit(""), "a")
        assert scored.first().a.text == want


def test_callable_builds_once_per_partition_and_records_errors(spark):
    def make():
        seen = []

        def respond(system, user):
            seen.append(user)
            if user == "3":
                raise RuntimeError("no <!DOCTYPE html>")
            return f"{system}{user}:{len(seen)}"
        return respond

    docs = spark.range(0, 6, 1, 1).select("id", F.col("id").cast("string").alias("t"))
    scored = CallableResponder(make).score(docs, F.lit("s"), F.col("t"), "a").orderBy("id").collect()
    assert [r.a.text for r in scored] == ["s0:1", "s1:2", "s2:3", None, "s4:5", "s5:6"]
    assert scored[3].a.status == "html" and "RuntimeError" not in scored[3].a.message


def test_content_replay_answers_every_copy(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(
        F.col("id").cast("string")).alias("t"))
    answers = docs.select("t").distinct().select(request_digest(F.lit("s"), F.col("t")).alias("digest"),
                                                 F.concat(F.lit("re "), "t").alias("response"))
    scored = ContentReplayResponder(answers, error=None).score(docs, F.lit("s"), F.col("t"), "a")
    assert scored.count() == 3000
    assert scored.filter(F.col("a.text") != F.concat(F.lit("re "), "t")).count() == 0
