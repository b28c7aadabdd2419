"""Runs of many bytes: texts told by what they share with the body give what whole texts give, in less room."""

import os

import pytest
from pyspark.sql import functions as F

from anontext.operators.responders import CallableResponder, ExpressionResponder, ReplayResponder, policy_for
from anontext.plans import tables
from anontext.plans.ladder import ladder_results, run_ladder
from anontext.plans.pipeline import run
from anontext.schema import RunConfig
from anontext.sources import recordings
from anontext.sources.recordings import store_recordings

N = 40

# Hardly to be compressed, so that files tell how many texts they hold.
def _noise():
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), " ")


GUESSER = ExpressionResponder(lambda call: F.concat(F.lit("Name Estimate: "), F.when(
    F.lit(call.step.step_no) < F.col("doc_id") % 6, F.col("comnam")).otherwise(F.lit("Quixotic Zephyr"))))
SCORER = ExpressionResponder(lambda call: F.concat(F.lit("Direction Estimate: 1, Magnitude Estimate: 0."), F.length(call.user).cast("string")))


def _prefixing(call):
    return F.concat(F.lit(f"{call.step.kind}{call.step.round} "), call.user)


REWRITERS = {
    "prefix": _prefixing,
    "inside": lambda call: F.concat(F.substr(call.user, F.lit(1), F.lit(100)), F.lit("é"), F.substr(call.user, F.lit(103))),
    "all new": lambda call: F.sha2(call.user, 512),
    "lost": lambda call: (F.when(F.col("doc_id") % 4 > 0, call.user), F.when(F.col("doc_id") % 4 == 0, F.lit("maximum context length"))),
}


@pytest.fixture(scope="module")
def articles(spark):
    return spark.range(N).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 7, None).when(F.col("id") % 10 == 9, "").otherwise(F.concat(_noise(), F.lit(" é"))).alias("body"),
        F.concat(F.lit("Blue Bolt "), "id").alias("comnam"), F.lit("BLBO").alias("ticker"), F.lit("Retail").alias("industry"),
        F.lit("2001-02-03").cast("timestamp_ntz").alias("pub_date"), F.array(F.col("id"), F.lit(None)).alias("tags"))


@pytest.fixture
def packing(monkeypatch):
    def set_to(size):
        monkeypatch.setattr(tables, "PACK_FROM", size)
        monkeypatch.setattr(recordings, "PACK_FROM", size)
    set_to(0)
    return set_to


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def _rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", sorted(REWRITERS))
def test_packed_or_not_all_is_the_same(articles, packing, name):
    rewriter, got = ExpressionResponder(REWRITERS[name], policy_for("ollama")), []
    for size in (0, 1 << 40):
        packing(size)
        out = run(articles, RunConfig(run_id="x", max_rounds=1), rewriter, GUESSER, SCORER)
        assert out.ladder.tables.packed == (size == 0)
        got.append([(df.columns, _rows(df)) for df in (out.results, out.attempts, out.errors, ladder_results(out.ladder))])
    assert got[0] == got[1] and len(got[0][0][1]) == N


def test_rewritten_texts_take_little_room(articles, packing, folder):
    def written(name):
        config = RunConfig(run_id="x", output_path=f"{folder}/{name}", max_rounds=2, partitions=2)
        root = run_ladder(articles, config, ExpressionResponder(_prefixing, policy_for("ollama")), GUESSER).tables.root
        return {kind: sum(_size(f"{root}/{d}") for d in os.listdir(root) if d.startswith(kind)) for kind in ("articles", "attempts")}
    packed = written("packed")
    packing(1 << 40)
    whole = written("whole")
    assert whole["attempts"] > 2 * whole["articles"] and packed["attempts"] < whole["attempts"] / 3
    assert packed["articles"] == whole["articles"]


def test_a_packed_run_is_taken_up_by_another_session(articles, spark, packing, folder):
    """Missing rewrites and guesses wait and come late; nothing is rewritten again, and no catalog is needed."""
    calls, out = f"{folder}/calls", f"{folder}/out"
    os.mkdir(calls)

    def make():
        def respond(system, user):
            import uuid
            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            return f"new {user}"
        return respond

    guesses = articles.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("step_no"),
                              F.concat(F.lit("Name Estimate: "), "comnam").alias("response"), F.lit(None).cast("string").alias("error"))
    paraphrased = articles.where("body is not null").select("doc_id", F.lit(1).alias("step_no"), F.concat(F.lit("told "), "body").alias("response"),
                                                            F.lit(None).cast("string").alias("error")).unionByName(
        articles.where("body is null").select("doc_id", F.lit(1).alias("step_no"), F.lit("none").alias("response"), F.lit(None).cast("string").alias("error")))

    def go(root, some_guesses, some_texts):
        return run_ladder(articles, RunConfig(run_id="s", output_path=root, resume=True, max_rounds=0),
                          {"mask": CallableResponder(make), "para": ReplayResponder(some_texts)}, ReplayResponder(some_guesses))
    first = go(out, guesses.where("step_no = 0 and doc_id % 3 > 0"), paraphrased.where("doc_id % 5 > 0"))
    assert first.tables.packed and first.missing == N and "body" not in first.waiting.columns
    asked = len(os.listdir(calls))
    os.rename(out, f"{out}-moved")
    packing(1 << 40)  # a run stays as it was begun
    done = go(f"{out}-moved", guesses, paraphrased)
    assert done.tables.packed and done.missing == 0 and len(os.listdir(calls)) == asked
    want = {r.doc_id: "none" if r.body is None else f"told {r.body}".strip() for r in articles.collect()}
    assert {r.doc_id: r.neutered_text for r in ladder_results(done).collect()} == want


def test_steps_of_a_packed_run_neither_shuffle_nor_sort_bodies(articles, packing, monkeypatch, spark):
    plans, commit = [], tables.RunTables._save

    def spy(self, df, table, *rest, **more):
        if table == "attempts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return commit(self, df, table, *rest, **more)
    monkeypatch.setattr(tables.RunTables, "_save", spy)
    run_ladder(articles, RunConfig(max_rounds=0, partitions=4), ExpressionResponder(_prefixing, policy_for("ollama")), GUESSER)
    assert len(plans) == 2 and "SortMergeJoin" in plans[1] and not any("Exchange" in p for p in plans)
    assert plans[1].count("Sort [") == 1  # the attempts, not the articles


def test_long_recordings_are_kept_as_what_they_share(articles, spark, packing, folder):
    """Answers of later steps come back as they were: repeated, missing, failed, without a first one or without a key."""
    steps = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(2)))
    text = F.when((F.col("doc_id") == 3) & (F.col("step_no") == 1), None).otherwise(F.concat(F.lit("step "), "step_no", F.lit(" "), F.coalesce("body", F.lit("-"))))
    answers = articles.withColumn("step_no", steps).where("doc_id <> 5 or step_no > 0").select(
        F.when(F.col("doc_id") != 6, F.col("doc_id")).alias("doc_id"), "step_no", text.alias("response"),
        F.when(F.col("doc_id") == 3, F.lit("timeout")).alias("error"))
    want, sizes = _rows(answers), []
    for size, name in ((0, "packed"), (1 << 40, "whole")):
        packing(size)
        kept = store_recordings(answers, f"{folder}/{name}", "texts", 4)
        assert _rows(kept) == want and kept.columns == ["doc_id", "response", "error", "step_no"]
        assert _rows(kept.where("step_no = 2")) == _rows(answers.where("step_no = 2"))
        sizes.append(_size(f"{folder}/{name}"))
    assert sizes[0] < sizes[1] / 2


def test_a_ladder_from_packed_recordings(articles, packing, folder):
    script = ExpressionResponder(_prefixing, policy_for("ollama"))
    told = run_ladder(articles, RunConfig(max_rounds=1, partitions=4), script, GUESSER)
    none = F.lit(None).cast("string").alias("error")
    texts = store_recordings(told.attempts.select("doc_id", "step_no", F.col("text").alias("response"), none), folder, "texts", 4, laid_out=True)
    per_step = [len([f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")]) for d in ("texts/step_no=0", "texts/step_no=1", "texts_first")]
    assert max(per_step) <= 4  # one file a bucket: no answer was shuffled
    guesses = store_recordings(told.attempts.select("doc_id", "step_no", F.col("guess_response").alias("response"), none), folder, "guesses", 4, laid_out=True)
    # A lost rewrite of nothing is no answer, so articles without a body wait.
    again = run_ladder(articles.where("body is not null"), RunConfig(max_rounds=1, partitions=4),
                       ReplayResponder(texts, policy=policy_for("ollama")), ReplayResponder(guesses))
    assert again.missing == 0
    assert _rows(ladder_results(again).drop("run_id")) == _rows(ladder_results(told).where("body is not null").drop("run_id"))


def test_waiting_texts_are_met_once_for_what_they_wait_for(articles, packing, folder, monkeypatch):
    """Where all texts that wait have their rewrites, their bodies are not read once more for those that lack one."""
    from anontext.plans import ladder as ladders
    guesses = articles.select("doc_id", F.lit(0).alias("step_no"), F.concat(F.lit("Name Estimate: "), "comnam").alias("response"),
                              F.lit(None).cast("string").alias("error"))
    config = RunConfig(run_id="late", output_path=folder, resume=True, max_rounds=0, paraphrase=False)
    script = ExpressionResponder(_prefixing, policy_for("ollama"))
    assert run_ladder(articles, config, script, ReplayResponder(guesses.where("doc_id % 3 > 0"))).missing == 13  # 27 has no body, so nothing is asked about it
    steps, attempt = [], ladders.attempt_step
    monkeypatch.setattr(ladders, "attempt_step", lambda *a: steps.append(a[6]) or attempt(*a))
    done = run_ladder(articles, config, script, ReplayResponder(guesses))
    assert steps == [True] and done.missing == 0 and ladder_results(done).count() == N
