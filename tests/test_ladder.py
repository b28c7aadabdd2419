"""The ladder with a scripted guesser: a text passes at step doc_id % 6, or never."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from anontext.functions.extract import extract_guess
from anontext.functions.identify import check_identified
from anontext.operators.responders import CallableResponder, ExpressionResponder, ReplayResponder, policy_for
from anontext.plans import metrics
from anontext.plans.ladder import AuditColumns, attempt_step, ladder_results, plan_steps, run_ladder
from anontext.plans.pipeline import run
from anontext.schema import RunConfig

N = 24


@pytest.fixture(scope="module")
def articles(spark):
    return spark.range(N).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("body"),
        F.concat(F.lit("Blue Bolt "), "id").alias("comnam"), F.lit("BLBO").alias("ticker"),
        F.lit("Retail").alias("industry"), F.lit("2001-02-03").cast("timestamp_ntz").alias("pub_date"))


REWRITER = ExpressionResponder(
    lambda call: F.concat(F.lit(f"{call.step.kind}{call.step.round} "), call.user), policy_for("ollama"))
GUESSER = ExpressionResponder(lambda call: F.concat(
    F.lit("Name Estimate: "), F.when(F.lit(call.step.step_no) < F.col("doc_id") % 6, F.col("comnam")).otherwise(
        F.lit("Quixotic Zephyr"))))
SCORER = ExpressionResponder(lambda call: F.concat(
    F.lit("Direction Estimate: 1, Magnitude Estimate: 0."), F.length(call.user).cast("string")))


def _results(articles, **options):
    ladder = run_ladder(articles, RunConfig(**options), REWRITER, GUESSER)
    return ladder, {r.doc_id: r for r in ladder_results(ladder).collect()}


@pytest.mark.parametrize("masking, paraphrase", [(True, True), (True, False), (False, True)])
@pytest.mark.parametrize("max_rounds", [0, 1, 8])
def test_modes(articles, masking, paraphrase, max_rounds):
    ladder, results = _results(articles, masking=masking, paraphrase=paraphrase, max_rounds=max_rounds)
    steps = plan_steps(ladder.config)
    assert len(steps) == (masking + paraphrase) * (max_rounds + 1)
    assert sorted(results) == list(range(N))
    attempts = {r.doc_id: r.attempts for r in metrics.first_passed_step(ladder.attempts).collect()}
    for i, row in results.items():
        k = i % 6
        last = min(k, len(steps) - 1)
        assert attempts[i] == last + 1
        chain = "".join(f"{s.kind}{s.round} " for s in reversed(steps[:last + 1]))
        assert row.neutered_text == chain + f"text {i}"
        if k < len(steps):
            name = {"mask": "masking", "para": "paraphrasing"}[steps[k].kind]
            want = (steps[k].round, f"{name}_step_{steps[k].round}", 0)
        else:
            want = (-1, "never_neutered", 1)
        assert (row.neutered_at_round, row.neutered_at_step, row.iort_guess_correct_neutered) == want
    rate = metrics.identification_rate(ladder_results(ladder)).first()[0]
    never = sum(r.neutered_at_step == "never_neutered" for r in results.values())
    assert rate == round(100 * never / N, 3)


def test_the_other_similarity_gives_the_same_ladder(articles):
    _, lcs = _results(articles, max_rounds=1)
    _, ratio = _results(articles, max_rounds=1, similarity_method="difflib")
    assert {i: r.neutered_at_step for i, r in lcs.items()} == {i: r.neutered_at_step for i, r in ratio.items()}


def _recorded(articles, steps, wrong=()):
    """Guesses that name the firm, but for documents in ``wrong``."""
    name = F.when(F.col("doc_id").isin(*wrong), F.lit("Quixotic Zephyr")).otherwise(F.col("comnam")) if wrong else F.col("comnam")
    return articles.select("doc_id", F.explode(F.array(*(F.lit(s) for s in steps))).alias("step_no"),
                           F.concat(F.lit("Name Estimate: "), name).alias("response"), F.lit(None).cast("string").alias("error"))


def _counting(spark, folder):
    """A rewriter that notes every call in a file of its own."""
    def make():
        import os
        import uuid

        def respond(system, user):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(user)
            return f"{len(system) > 50} {user}"
        return respond
    return CallableResponder(make)


def test_a_ladder_of_callables_and_replays(articles, spark, folder):
    """A function rewrites, recorded answers guess; each text is asked about once per step."""
    import os
    ladder = run_ladder(articles, RunConfig(max_rounds=0), _counting(spark, folder),
                        ReplayResponder(_recorded(articles, [0, 1], wrong=(3, 4))))
    rows = {r.doc_id: r for r in ladder_results(ladder).collect()}
    assert rows[2].neutered_at_step == "never_neutered" and rows[2].neutered_text == "True True text 2"
    assert rows[3].neutered_at_step == "masking_step_0" and ladder.pending is None
    assert len(os.listdir(folder)) == N + (N - 2)


def test_content_replay_runs_no_job_of_its_own(articles, spark, folder):
    import os
    from anontext.operators.responders import ContentReplayResponder
    answers = spark.createDataFrame([("x", "y")], "digest string, response string")
    ContentReplayResponder(answers, error=None).score(
        _counting(spark, folder).score(articles, F.lit(""), F.col("body"), "a"), F.lit(""), F.col("a.text"), "b")
    assert os.listdir(folder) == []


def test_a_missing_answer_holds_only_its_own_text(articles, folder):
    config = RunConfig(run_id="w", output_path=folder, resume=True, max_rounds=0)
    half = _recorded(articles, [0], wrong=(3, 4)).filter("doc_id <> 5")
    waiting = run_ladder(articles, config, REWRITER, ReplayResponder(half))
    # 3 and 4 have passed, 5 waits at step 0, the others went on and wait at step 1
    assert waiting.pending.step_no == 0 and waiting.missing == N - 2
    assert [(c.rows, c.identified, c.waiting) for c in waiting.counts] == [(N - 1, N - 3, 1), (0, 0, N - 3)]
    assert sorted(r.doc_id for r in ladder_results(waiting).collect()) == [3, 4]  # none else counts as passed, or as never passing
    assert {(r.doc_id, r.step_no) for r in waiting.waiting.collect()} == {(5, 0)} | {(i, 1) for i in range(N) if i not in (3, 4, 5)}
    later = run_ladder(articles, config, REWRITER, ReplayResponder(_recorded(articles, [1], wrong=(7,)).filter("doc_id <> 8")))
    assert {(r.doc_id, r.step_no) for r in later.waiting.collect()} == {(5, 0), (8, 1)}
    assert {r.doc_id: r.neutered_at_step for r in ladder_results(later).collect()}[7] == "paraphrasing_step_0"
    done = run_ladder(articles, config, REWRITER, ReplayResponder(_recorded(articles, [0, 1], wrong=(3,))))
    assert done.pending is None and done.missing == 0 and ladder_results(done).count() == N
    assert done.attempts.groupBy("doc_id", "step_no").count().filter("count > 1").count() == 0
    assert {r.doc_id: r.neutered_at_step for r in ladder_results(done).collect()}[5] == "never_neutered"


def test_a_text_that_waits_for_its_guess_is_not_rewritten_again(articles, spark, folder):
    import os
    calls, out = f"{folder}/calls", f"{folder}/out"
    os.mkdir(calls)
    config = RunConfig(run_id="g", output_path=out, resume=True, max_rounds=0, paraphrase=False)
    none = _recorded(articles, [0]).filter("doc_id < 0")
    first = run_ladder(articles, config, _counting(spark, calls), ReplayResponder(none))
    assert first.missing == N and len(os.listdir(calls)) == N
    done = run_ladder(articles, config, _counting(spark, calls), ReplayResponder(_recorded(articles, [0], wrong=(2,))))
    rows = {r.doc_id: r for r in ladder_results(done).collect()}
    assert len(rows) == N and len(os.listdir(calls)) == N and rows[2].neutered_text == "True text 2"


def test_waiting_for_rewrites(articles, folder):
    rewrites = articles.select("doc_id", F.lit(0).alias("step_no"), F.concat(F.lit("new "), "body").alias("response"), F.lit(None).cast("string").alias("error"))
    config = RunConfig(run_id="rw", output_path=folder, resume=True, max_rounds=0, paraphrase=False)
    first = run_ladder(articles, config, ReplayResponder(rewrites.filter("doc_id % 2 = 0")), GUESSER)
    assert first.missing == N // 2 and {r.text_status for r in first.waiting.collect()} == {"missing"}
    done = run_ladder(articles, config, ReplayResponder(rewrites), GUESSER)
    assert {r.doc_id: r.neutered_text for r in ladder_results(done).collect()} == {i: f"new text {i}" for i in range(N)}


def test_a_paused_run_claims_nothing(articles, folder):
    out = run(articles, RunConfig(run_id="p", output_path=folder, max_rounds=0), REWRITER,
              ReplayResponder(_recorded(articles, [0], wrong=(3,))), SCORER)
    import os
    assert out.waiting == N - 1 and not os.path.exists(f"{folder}/final") and os.path.exists(f"{folder}/partial")
    assert [r.doc_id for r in out.results.collect()] == [3] and "direction" not in out.results.columns
    assert metrics.identification_rate(out.results, waiting=out.waiting).first()[0] is None
    assert [tuple(r) for r in metrics.step_summary(out.results, waiting=out.waiting).collect()] == [("waiting", N - 1), ("masking_step_0", 1)]
    waits = out.errors.filter("status = 'waiting'").collect()
    assert len(waits) == N - 1 and {(r.stage, r.step_no) for r in waits} == {("guess", 1)}


def test_without_keeping_attempts_no_step_folder_is_left(articles, folder):
    import os
    silent = ExpressionResponder(lambda call: (F.lit(None).cast("string"), F.lit("timeout")))
    out = run(articles, RunConfig(run_id="k", output_path=folder, keep_attempts=False, max_rounds=0), REWRITER, silent, SCORER)
    assert not os.path.exists(out.ladder.tables.root) and not os.path.exists(f"{folder}/steps")
    assert out.results.count() == N and out.attempts is None and out.errors.count() == N
    assert sorted(os.listdir(folder)) == ["errors", "final", "neutered"]


def test_a_broken_commit_is_never_read(articles, folder):
    import os

    def breaks_late(call):
        if call.step.step_no == 1:
            return F.when(F.col("doc_id") == N - 1, F.raise_error(F.lit("lost")).cast("string")).otherwise(call.user)
        return REWRITER.build(call)

    config = RunConfig(run_id="b", output_path=folder, resume=True, max_rounds=1)
    with pytest.raises(Exception, match="lost"):
        run_ladder(articles.repartition(6), config, ExpressionResponder(breaks_late, policy_for("ollama")), GUESSER)
    # Pretend that the broken step had left files behind, and an entry that never got its row.
    root = f"{folder}/steps/run_id=b"
    table = next(d for d in os.listdir(root) if d.startswith("attempts_"))
    good = next(d for d in os.listdir(f"{root}/{table}") if d.startswith("write="))
    import shutil
    shutil.copytree(f"{root}/{table}/{good}", f"{root}/{table}/write=turn0-step1-deadbeef")
    os.makedirs(f"{root}/log/entry=99/_temporary")
    done = run_ladder(articles, config, REWRITER, GUESSER)
    _, fresh = _results(articles, max_rounds=1)
    assert {r.doc_id: r.neutered_text for r in ladder_results(done).collect()} == {i: r.neutered_text for i, r in fresh.items()}


def test_another_session_takes_up_the_tables(articles, spark, folder):
    """Nothing of the first session's catalog is needed: the log says what lies where."""
    config = RunConfig(run_id="s", output_path=folder, resume=True, max_rounds=0)
    run_ladder(articles, config, REWRITER, ReplayResponder(_recorded(articles, [0], wrong=(3,))))
    import os
    # At another place the catalog knows nothing of the tables, as in a new session.
    os.rename(folder, folder + "-moved")
    again = run_ladder(articles, RunConfig(run_id="s", output_path=folder + "-moved", resume=True, max_rounds=0), REWRITER,
                       ReplayResponder(_recorded(articles, [0, 1], wrong=(3,))))
    assert again.pending is None and ladder_results(again).count() == N


def test_recordings_meet_texts_without_an_exchange(articles, spark, folder):
    from anontext.plans.ladder import AuditColumns, attempt_step
    from anontext.plans.tables import RunTables
    from anontext.sources.recordings import store_recordings
    config = RunConfig()
    tables = RunTables(spark, f"{folder}/run", False)
    tables.begin(articles, 4, lambda n, s: "")
    answers = store_recordings(_recorded(articles, [0, 1]), f"{folder}/answers", "guesses", 4)
    texts = tables.articles.withColumn("current_text", F.col("body"))
    from anontext.session import settings
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = attempt_step(texts, plan_steps(config)[0], config, ReplayResponder(answers), ReplayResponder(answers), AuditColumns.of(config))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        ladder = run_ladder(articles, RunConfig(max_rounds=0, partitions=4), ReplayResponder(answers), ReplayResponder(answers))
        results = ladder_results(ladder)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in results and results.count("body") >= 1
    assert "body" not in ladder.attempts.columns and ladder_results(ladder).count() == N


def test_other_columns_ride_along(articles, spark):
    wide = articles.withColumn("desk", F.concat(F.lit("desk "), F.col("doc_id"))).withColumn("tags", F.array(F.col("doc_id"), F.lit(None)))
    template = {"template": ["at ", {"column": "desk", "prefix": "<", "suffix": ">"}]}
    echo = ExpressionResponder(lambda call: F.concat(call.system, F.lit(" "), F.col("desk")), policy_for("ollama"))
    ladder = run_ladder(wide, RunConfig(max_rounds=1, mask_template=template), {"mask": echo, "para": REWRITER}, GUESSER)
    rows = {r.doc_id: r for r in ladder_results(ladder).collect()}
    assert rows[0].neutered_text == "at <desk 0> desk 0" and rows[5].desk == "desk 5" and rows[5].tags == [5, None]
    assert "desk" not in ladder.attempts.columns
    raw = run(wide, RunConfig(masking=False, paraphrase=False, perform_sentiment=False))
    assert raw.results.filter("doc_id = 2").first().desk == "desk 2"


def test_keys_are_checked(articles):
    with pytest.raises(ValueError, match="unique"):
        run_ladder(articles.unionByName(articles), RunConfig(max_rounds=0), REWRITER, GUESSER)


def test_repeated_recordings_give_one_row(articles):
    twice = _recorded(articles, [0, 1]).unionByName(_recorded(articles, [0, 1]))
    ladder = run_ladder(articles, RunConfig(max_rounds=0), REWRITER, ReplayResponder(twice))
    assert ladder_results(ladder).count() == N


def test_resume_does_not_mix_runs(articles, folder):
    def rewriter(word, broken=None):
        def build(call):
            if call.step.step_no == broken:
                raise RuntimeError("lost")
            return F.concat(F.lit(f"{word}{call.step.step_no} "), call.user)
        return ExpressionResponder(build, policy_for("ollama"))

    fresh = RunConfig(run_id="m", output_path=folder, max_rounds=1)
    again = RunConfig(run_id="m", output_path=folder, max_rounds=1, resume=True)
    run_ladder(articles, fresh, rewriter("old"), GUESSER)
    with pytest.raises(RuntimeError):
        run_ladder(articles, fresh, rewriter("new", broken=1), GUESSER)
    rows = {r.doc_id: r for r in ladder_results(run_ladder(articles, again, rewriter("new"), GUESSER)).collect()}
    assert len(rows) == N and not any("old" in r.neutered_text for r in rows.values())
    with pytest.raises(ValueError, match="another configuration"):
        run_ladder(articles.filter("doc_id < 5"), again, rewriter("new"), GUESSER)
    with pytest.raises(ValueError, match="another configuration"):
        run_ladder(articles, RunConfig(run_id="m", output_path=folder, max_rounds=1, resume=True, threshold=80), rewriter("new"), GUESSER)


def test_recorded_sentiment_tells_the_two_texts_apart(articles):
    answers = articles.select("doc_id", F.explode(F.array(F.lit("neutered"), F.lit("raw"))).alias("target")).select(
        "doc_id", "target", F.concat(F.lit("Direction Estimate: "), (F.col("target") == "raw").cast("int"),
                                     F.lit(", Magnitude Estimate: 0.5")).alias("response"))
    out = run(articles, RunConfig(max_rounds=0), REWRITER, GUESSER, ReplayResponder(answers, keys=("doc_id",), error=None))
    assert {(r.direction_neut, r.direction) for r in out.results.collect()} == {("0", "1")}


def test_raw_runs_have_no_errors(articles):
    out = run(articles, RunConfig(masking=False, paraphrase=False, perform_sentiment=False))
    assert out.errors.count() == 0 and out.errors.columns == ["run_id", "doc_id", "step_no", "stage", "status", "message"]


def test_steps_stop_when_nothing_is_left(articles):
    ladder, _ = _results(articles.filter("doc_id % 6 < 2"))
    assert [(c.rows, c.identified) for c in ladder.counts] == [(8, 4), (4, 0)]


def test_no_step_shuffles(articles, spark):
    from anontext.plans.ladder import AuditColumns, attempt_step
    config = RunConfig()
    texts = articles.withColumn("current_text", F.col("body"))
    plan = attempt_step(texts, plan_steps(config)[0], config, REWRITER, GUESSER, AuditColumns.of(config))
    assert "body" not in plan.columns
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Python" not in shown


def test_no_articles(articles):
    ladder, results = _results(articles.filter("doc_id < 0"))
    assert results == {} and ladder.attempts.count() == 0


def test_raw_only_run_scores_the_body(articles):
    out = run(articles, RunConfig(masking=False, paraphrase=False), scorer=SCORER)
    row = out.results.filter("doc_id = 3").first()
    assert (row.neutered_text, row.neutered_at_round, row.neutered_at_step) == ("text 3", 0, "no_neutering")
    assert (row.direction, row.magnitude) == ("1", 0.6) and "direction_neut" not in out.results.columns
    assert metrics.identification_rate(out.results).first()[0] is None
    assert out.errors.count() == 0 and out.attempts is None


@pytest.mark.parametrize("raw, neut", [(True, False), (False, True), (True, True)])
def test_sentiment_flags_leave_identification_alone(articles, folder, raw, neut):
    few = articles.filter("doc_id < 8")
    config = RunConfig(max_rounds=1, sentiment_on_raw=raw, sentiment_on_neutered=neut, output_path=folder,
                       extraction_name="RAW")
    out = run(few, config, REWRITER, GUESSER, SCORER)
    assert ("direction" in out.results.columns, "direction_neut" in out.results.columns) == (raw, neut)
    assert ("RAW" in out.results.columns) == raw
    plain = run(few, RunConfig(max_rounds=1, perform_sentiment=False), REWRITER, GUESSER)
    kept = ["doc_id", "neutered_text", "neutered_at_step", "name_similarity_neutered", "iort_guess_correct_neutered"]
    assert sorted(out.results.select(kept).collect()) == sorted(plain.results.select(kept).collect())


def test_failed_answers_pass_unless_strict(articles):
    silent = ExpressionResponder(lambda call: (F.lit(None).cast("string"), F.lit("timeout")))
    for strict, step in ((False, "masking_step_0"), (True, "never_neutered")):
        config = RunConfig(max_rounds=0, strict=strict, perform_sentiment=False)
        out = run(articles, config, REWRITER, silent)
        assert {r.neutered_at_step for r in out.results.collect()} == {step}
        seen = {(r.stage, r.status, r.message) for r in out.errors.collect()}
        assert seen == {("guess", "error", "timeout")}


def test_a_broken_off_run_resumes(articles, folder):
    calls = []

    def breaks(call):
        calls.append(call.step.step_no)
        if call.step.step_no == 2 and len(calls) == 3:
            raise RuntimeError("lost")
        return REWRITER.build(call)

    config = RunConfig(run_id="r", output_path=folder, resume=True)
    with pytest.raises(RuntimeError):
        run_ladder(articles, config, ExpressionResponder(breaks, policy_for("ollama")), GUESSER)
    ladder = run_ladder(articles, config, ExpressionResponder(breaks, policy_for("ollama")), GUESSER)
    assert calls == [0, 1, 2, 2, 3, 4, 5]
    _, fresh = _results(articles)
    assert {r.doc_id: r.neutered_text for r in ladder_results(ladder).collect()} == {
        i: r.neutered_text for i, r in fresh.items()}


def test_attempt_views(articles):
    ladder, _ = _results(articles, max_rounds=1)
    wide = {r.doc_id: r for r in metrics.wide_attempts(ladder.attempts, plan_steps(ladder.config)).collect()}
    assert wide[2].identified_masking_step_0 == 1 and wide[2].identified_masking_step_1 == 0
    assert wide[0].identified_paraphrasing_step_0 is None
    last = {r.doc_id: r for r in metrics.last_guess(ladder.attempts).collect()}
    assert last[1].step_no == 1 and last[1].name_guess == "Quixotic Zephyr" and last[5].name_guess == "Blue Bolt 5"


def test_profile(articles):
    row = metrics.profile(articles).first()
    assert tuple(row) == (N, 1, 1, dt.datetime(2001, 2, 3), dt.datetime(2001, 2, 3))
    assert metrics.profile(articles, approximate=True).first().tickers == 1


def test_config_is_checked():
    for bad in ({"max_rounds": -1}, {"run_id": "a/b"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_a_filter_on_the_step_opens_its_folders_alone(articles):
    ladder, results = _results(articles, max_rounds=1)
    files = ladder.attempts.filter("step_no = 1").inputFiles()
    assert files and all("step1" in f and f.endswith(".zstd.parquet") for f in files)
    # Results open what has passed and the last step, not what went on.
    went_on = [f for f in ladder.finished.inputFiles() if "identified=1" in f and "step3" not in f]
    assert not went_on and len(results) == N


def test_answers_of_a_run_are_stored_without_a_shuffle(articles, folder):
    import os
    from anontext.sources.recordings import store_recordings
    ladder = run_ladder(articles, RunConfig(max_rounds=0, partitions=4), REWRITER, GUESSER)
    answers = ladder.attempts.select("doc_id", "step_no", F.col("text").alias("response"))
    stored = store_recordings(answers, folder, "answers", 4, laid_out=True)
    assert sorted(stored.select("doc_id", "step_no", "response").collect()) == sorted(answers.collect())
    per_step = [len([f for f in os.listdir(f"{folder}/answers/{d}") if f.endswith(".parquet")])
                for d in os.listdir(f"{folder}/answers") if d.startswith("step_no=")]
    assert per_step and max(per_step) <= 4  # one file a bucket: no task held rows of another's


def test_a_run_without_a_path_writes_its_texts_once_more_only(articles, monkeypatch, folder):
    from anontext.plans import pipeline
    stages, write = [], pipeline.write_stage
    monkeypatch.setattr(pipeline, "write_stage", lambda df, root, run_id, stage: stages.append(stage) or write(df, root, run_id, stage))
    plain = run(articles, RunConfig(max_rounds=0), REWRITER, GUESSER, SCORER)
    assert stages == ["final"]
    kept = run(articles, RunConfig(max_rounds=0, output_path=folder), REWRITER, GUESSER, SCORER)
    assert stages[1:] == ["neutered", "sent_neut", "final"] and kept.results.columns == plain.results.columns
    same = [c for c in kept.results.columns if c != "run_id"]
    assert sorted(map(str, kept.results.select(same).collect())) == sorted(map(str, plain.results.select(same).collect()))


def test_an_answer_that_stays_is_not_read_again(articles):
    """What was found in the same answer, for the same name or date a step before, is taken over; others are read."""
    config = RunConfig()
    said = F.element_at(F.array(*(F.lit(x) for x in (
        "Name Estimate: Blue Bolt 0, Date Estimate: 2001-02-03", "Name Estimate: Found, Date Estimate: 2001-02-03",
        "Name Estimate: Found, Date Estimate: 1999-01-01"))), (F.col("doc_id") + 1).cast("int"))
    found = F.struct(F.lit("T").alias("ticker"), F.lit("Found").alias("name"), F.lit("2001-02-03").alias("date"), F.lit("I").alias("industry"))
    before = F.struct(F.lit("Name Estimate: Found, Date Estimate: 1999-01-01").alias("answer"), found.alias("fields"),
                      F.lit(33).alias("similarity"), F.lit("1950-01-01").cast("timestamp_ntz").alias("date"))
    texts = articles.where("doc_id < 3").withColumns({"current_text": F.col("body"), "__before": before})
    made = attempt_step(texts, plan_steps(config)[1], config, REWRITER, ExpressionResponder(lambda call: said), AuditColumns.of(config))
    got = made.orderBy("doc_id").collect()
    assert "__before" not in made.columns
    assert [(r.ticker_guess, r.name_guess, r.date_guess_raw, r.industry_guess) for r in got] == [
        ("NA", "Blue Bolt 0", "2001-02-03", "NA"), ("NA", "Found", "2001-02-03", "NA"), ("T", "Found", "2001-02-03", "I")]
    assert [r.name_similarity for r in got] == [100, 33, 33]
    assert {r.date_guess for r in got} == {dt.datetime(1950, 1, 1)}


def test_answers_that_change_between_steps_are_read_anew(articles):
    """Names and dates that change from step to step, missing answers among them, give what one reading of each gives."""
    answers = ["Name Estimate: Red Rock, Date Estimate: 2001-02-03", None, "nothing", "Name Estimate: Red Rock", "Name Estimate: blue bolt"]

    def told(call):
        some = F.array(*(F.lit(a).cast("string") for a in answers))
        return F.element_at(some, ((F.col("doc_id") + call.step.step_no * 3) % 5 + 1).cast("int"))
    ladder = run_ladder(articles, RunConfig(max_rounds=3, tolerance_days=0, threshold=101), REWRITER, ExpressionResponder(told))
    rows = ladder.attempts.collect()
    again = ladder.attempts.select("doc_id", "step_no", "guess_response").join(articles, "doc_id")
    plain = check_identified(extract_guess(again, "guess_response", ("t", "n", "d", "i")), name_guess="n", date_guess="d", parsed_date="p",
                             tolerance_days=0, threshold=101)
    want = {(r.doc_id, r.step_no): (r.t, r.n, r.d, r.i, r.name_similarity, r.p, r.iort_guess_correct) for r in plain.collect()}
    assert len(rows) > N and len({r.step_no for r in rows}) > 1
    assert {(r.doc_id, r.step_no): (r.ticker_guess, r.name_guess, r.date_guess_raw, r.industry_guess, r.name_similarity, r.date_guess,
                                    r.identified) for r in rows} == want
