"""Every operator as a query over the test tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anontext.functions.extract import extract_guess, extract_sentiment
from anontext.functions.identify import check_identified, date_guess_correct, parse_iso_date
from anontext.functions.names import (clean_name, name_similarity, plain_name_similarity,
                                      similarity_by_pair, token_sorted)
from anontext.functions.text import clean_characters, estimated_tokens, word_count
from anontext.operators import templates
from anontext.operators.budget import rolling_tokens, route_by_size, score_batch, send_plan
from anontext.operators.entities import mask_entities
from anontext.operators.requests import build_requests, hosted_request
from anontext.operators.responders import (ROBUSTNESS, CallableResponder, ContentReplayResponder,
                                           ExpressionResponder, ReplayResponder, Step, policy_for,
                                           WrappedResponder, request_digest)
from anontext.operators.rulemask import core_words, mask_article, mask_patterns, rule_rewriter
from anontext.operators.sampling import first_rows, stable_sample
from anontext.plans import metrics
from anontext.plans.batch import run_batch
from anontext.plans.ladder import ladder_results, plan_steps, run_ladder
from anontext.plans.offline import guess_requests, sentiment_requests
from anontext.plans.pipeline import run
from anontext.plans.robustness import audit_models, guess_with_models, rate_by_model, wide_guesses
from anontext.plans.tables import buckets_for
from anontext.schema import RunConfig, conform_articles
from anontext.session import scratch_path, settings
from anontext.sources.articles import ingest_csv, write_csv
from anontext.sources.recordings import store_recordings
from anontext.sources.results import combine_csv, combine_runs, write_guesses
from workload import fixtures as fx

GUESS_COLUMNS = ("ticker_guess", "name_guess", "date_guess_raw", "industry_guess")
MODELS = {"llama3.2": 3, "gemma3:4b": 9}


def _spread(df: DataFrame, files: DataFrame) -> DataFrame:
    """Use all cores where the input has fewer files than cores; otherwise leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(files.inputFiles()) < cores else df


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.articles(spark, sf_dir)


def _spread_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_articles(spark, sf_dir), fx.tables(spark, sf_dir, "documents")["documents"])


def _sql(text: str) -> Column:
    return F.expr(fx.for_spark(text))


# --- functions over columns ---

def profile(spark, sf_dir):
    return metrics.profile(_articles(spark, sf_dir))


def clean_chars(spark, sf_dir):
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", clean_characters(F.col("text")).alias("cleaned"),
                       F.length("text").alias("chars"))


def _prompt(template):
    def query(spark, sf_dir):
        gaps = {c: F.when(F.col("doc_id") % 19 == 0, None).when(F.col("doc_id") % 17 == 0, "")
                .otherwise(F.col(c)) for c in ("comnam", "ticker", "industry")}
        rows = _articles(spark, sf_dir).withColumns(gaps)
        return rows.select("doc_id", templates.compile_prompt(template, rows.columns).alias("prompt"))
    return query


def extract_identification(spark, sf_dir):
    answers = fx.derived(spark, sf_dir, fx.MESSY_GUESSES)
    return extract_guess(answers, "response", GUESS_COLUMNS).select("doc_id", *GUESS_COLUMNS)


def extract_sentiment_fields(spark, sf_dir):
    answers = fx.derived(spark, sf_dir, fx.MESSY_SENTIMENT)
    return extract_sentiment(answers, "response", ("direction", "magnitude")).drop("response")


def clean_names(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        "doc_id", "comnam", clean_name(F.col("comnam")).alias("cleaned"),
        clean_name(F.concat(F.lit("Star "), F.col("comnam"), F.lit(" (The) S.A."))).alias("with_noise"),
        clean_name(F.concat(F.lit("Star "), F.col("comnam"), F.lit(" (The) S.A.")),
                   escape_dots=True).alias("with_noise_escaped"))


def _name_pairs(spark, sf_dir):
    return _articles(spark, sf_dir).join(fx.rivals(spark, sf_dir), "doc_id").select(
        "doc_id", "comnam", F.when(F.col("doc_id") % 23 == 0, "NA").otherwise(F.col("rival")).alias("guess"))


def name_similarities(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select(
        "doc_id", name_similarity(F.col("comnam"), F.col("guess")).alias("similarity"),
        plain_name_similarity(F.col("guess"), F.col("comnam")).alias("plain_similarity"))


def name_similarities_by_pair(spark, sf_dir):
    return similarity_by_pair(_name_pairs(spark, sf_dir), "comnam", "guess", "similarity").select(
        "doc_id", "similarity")


def date_match(spark, sf_dir):
    guesses = fx.derived(spark, sf_dir, fx.DATE_GUESSES)
    return (guesses.withColumn("parsed", parse_iso_date(F.col("guess")))
            .select("doc_id", "parsed",
                    date_guess_correct(F.col("true_date"), F.col("parsed")).alias("correct")))


def identified(spark, sf_dir):
    answers = fx.derived(spark, sf_dir, fx.MESSY_GUESSES)
    guessed = extract_guess(answers, "response", GUESS_COLUMNS)
    joined = _articles(spark, sf_dir).join(guessed, "doc_id")
    return check_identified(joined, suffix="_x").select(
        "doc_id", "date_guess", "name_similarity_x", "name_guess_correct_x", "date_guess_correct_x",
        "iort_guess_correct_x")


# --- the ladder ---

def scripted_rewriter():
    return ExpressionResponder(
        lambda call: F.concat(F.lit(f"[{call.step.kind[0]}{call.step.round}] "), call.user),
        policy_for("ollama"))


def scripted_guesser():
    return ExpressionResponder(lambda call: _sql(fx.guess_answer(str(call.step.step_no))))


def scripted_scorer():
    """Direction by text length, magnitude by the last two digits of it."""
    def answer(call):
        n = F.length(call.user)
        return F.concat(F.lit("**Direction Estimate: "), (n % 2).cast("string"),
                        F.lit("**,**Magnitude Estimate: 0."), (n % 100).cast("string"), F.lit("**"))
    return ExpressionResponder(answer)


def scripted_ladder(spark, sf_dir, **options):
    texts = _articles(spark, sf_dir)  # a run deals them out itself
    return run_ladder(texts, RunConfig(run_id="scripted", **options), scripted_rewriter(),
                      scripted_guesser())


def _ladder(**options):
    def query(spark, sf_dir):
        results = ladder_results(scripted_ladder(spark, sf_dir, **options))
        return results.drop("run_id", "body", "text_status", "guess_status")
    return query


def ladder_none(spark, sf_dir):
    config = RunConfig(run_id="scripted", masking=False, paraphrase=False)
    out = run(_articles(spark, sf_dir), config, scorer=scripted_scorer())
    return out.results.select("doc_id", "neutered_text", "neutered_at_round", "neutered_at_step",
                              "direction", "magnitude")


def first_passed(spark, sf_dir):
    return metrics.first_passed_step(scripted_ladder(spark, sf_dir).attempts)


def last_guesses(spark, sf_dir):
    return metrics.last_guess(scripted_ladder(spark, sf_dir).attempts)


def summary_by_step(spark, sf_dir):
    return metrics.step_summary(ladder_results(scripted_ladder(spark, sf_dir)))


def identification_rate(spark, sf_dir):
    return metrics.identification_rate(ladder_results(scripted_ladder(spark, sf_dir)))


def wide_attempts(spark, sf_dir):
    ladder = scripted_ladder(spark, sf_dir)
    return metrics.wide_attempts(ladder.attempts, plan_steps(ladder.config))


def sentiment_both(spark, sf_dir):
    config = RunConfig(run_id="scripted")
    out = run(_articles(spark, sf_dir), config, scripted_rewriter(), scripted_guesser(),
              scripted_scorer())
    return out.results.select("doc_id", "iort_guess_correct_neutered", "direction_neut",
                              "magnitude_neut", "direction", "magnitude")


def combined_runs(spark, sf_dir):
    """Two runs below one folder, one without sentiment, read back as one table."""
    root = scratch_path(spark, "combine")
    texts = _articles(spark, sf_dir)
    for run_id, sentiment in (("007", True), ("7", False)):
        config = RunConfig(run_id=run_id, output_path=root, perform_sentiment=sentiment)
        run(texts, config, scripted_rewriter(), scripted_guesser(), scripted_scorer())
    both = combine_runs(spark, root, ["007", "7"])
    return both.select("run_id", "doc_id", "neutered_at_step", "iort_guess_correct_neutered",
                       "direction", "magnitude")


# --- responders ---

RECORDED = f"""
SELECT doc_id, cast(3 AS int) AS step_no,
  CASE WHEN doc_id % 7 < 4 THEN concat('  ', {fx.guess_answer('3')}, ' ') END AS response,
  CASE doc_id % 7 WHEN 4 THEN 'context_length_exceeded: shorten' WHEN 5 THEN '<!DOCTYPE html><p>'
    WHEN 6 THEN concat('timeout for ', ticker) END AS error
FROM articles
WHERE doc_id % 11 <> 0
UNION ALL
SELECT doc_id, cast(4 AS int), 'another step', NULL FROM articles
"""


def replay_join(spark, sf_dir):
    recorded = fx.derived(spark, sf_dir, RECORDED.replace("FROM articles\n", "FROM articles \n"))
    texts = _articles(spark, sf_dir)
    scored = ReplayResponder(recorded).score(texts, F.lit(""), F.col("body"), "answer", Step(3, 1, "para"))
    return scored.select("doc_id", F.col("answer.text").alias("text"), F.col("answer.status").alias("status"))


def replay_by_content(spark, sf_dir):
    """Recorded once per distinct text, joined back to every copy of it."""
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    digest = request_digest(F.lit("judge"), F.col("text"))
    recorded = docs.groupBy(digest.alias("digest")).agg(
        F.concat(F.lit("seen first in "), F.min("doc_id").cast("string")).alias("response"))
    scored = ContentReplayResponder(recorded, error=None).score(
        docs, F.lit("judge"), F.col("text"), "answer")
    return scored.select("doc_id", F.col("answer.text").alias("text"))


def callable_responder(spark, sf_dir):
    """A function per text: its length and digest, and a failure on French texts."""
    def make():
        def respond(system: str, user: str) -> str:
            if system == "fr":
                raise ValueError("no French")
            return f" {len(user)} {hashlib.md5(user.encode()).hexdigest()} "
        return respond
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    responder = CallableResponder(make, partitions=spark.sparkContext.defaultParallelism
                                  if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism else None)
    scored = responder.score(docs, F.col("lang"), F.col("text"), "answer")
    return scored.select("doc_id", F.col("answer.text").alias("text"),
                         F.col("answer.status").alias("status"), F.col("answer.message").alias("message"))


def _recordings(spark, sf_dir, last_step=None, partitions=None):
    """The scripted ladder's own rewrites and guesses as recordings, each of them twice; of two steps a round, no more are run."""
    attempts = scripted_ladder(spark, sf_dir, partitions=partitions, **({} if last_step is None else {"max_rounds": last_step // 2})).attempts
    if last_step is not None:
        attempts = attempts.filter(F.col("step_no") <= last_step)
    twice = attempts.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__copy")
    none = F.lit(None).cast("string").alias("error")
    return (twice.select("doc_id", "step_no", F.col("text").alias("response"), none),
            twice.select("doc_id", "step_no", F.col("guess_response").alias("response"), none))


def _replayed(spark, sf_dir, last_step=None):
    """Recordings kept by document, as a run keeps its texts."""
    texts, root = _articles(spark, sf_dir), scratch_path(spark, "recordings")
    n = buckets_for(texts)
    rewrites, guesses = _recordings(spark, sf_dir, last_step, n)
    rewrites = store_recordings(rewrites, root, "rewrites", n, laid_out=True)
    guesses = store_recordings(guesses, root, "guesses", n, laid_out=True)
    return run_ladder(texts, RunConfig(run_id="replayed", partitions=n),
                      ReplayResponder(rewrites, policy=policy_for("ollama")), ReplayResponder(guesses))


def ladder_replay(spark, sf_dir):
    """All steps from recordings, which hold every answer twice."""
    return ladder_results(_replayed(spark, sf_dir)).drop("run_id", "body", "text_status", "guess_status")


def ladder_replay_paused(spark, sf_dir):
    """Answers up to step 3 only: the texts that passed by then, and nothing about the others."""
    ladder = _replayed(spark, sf_dir, last_step=3)
    return ladder_results(ladder).select("doc_id", "neutered_text", "neutered_at_step", F.lit(ladder.pending.step_no).alias("pending"))


def paused_run(spark, sf_dir):
    """What a run says whose answers end at step 3: no rate, and every waiting text in the summary and the errors."""
    _, guesses = _recordings(spark, sf_dir, last_step=3)
    out = run(_articles(spark, sf_dir), RunConfig(run_id="paused"), scripted_rewriter(), ReplayResponder(guesses), scripted_scorer())
    rate = metrics.identification_rate(out.results, waiting=out.waiting)
    return rate.select(F.lit("identification_rate").alias("fact"), F.col("identification_rate").alias("value")).unionByName(
        metrics.step_summary(out.results, out.waiting).select(F.col("neutered_at_step").alias("fact"), F.col("texts").cast("double").alias("value"))
    ).unionByName(out.errors.groupBy(F.concat_ws(" ", "status", "stage", "step_no").alias("fact")).agg(F.count(F.lit(1)).cast("double").alias("value")))


def ladder_late_answers(spark, sf_dir):
    """A third of the guesses of every step come late: the others go on, and the late ones follow on resuming."""
    _, guesses = _recordings(spark, sf_dir)
    config = RunConfig(run_id="late", output_path=scratch_path(spark, "late"), resume=True)
    texts = _articles(spark, sf_dir)
    in_time = ReplayResponder(guesses.filter((F.col("doc_id") + F.col("step_no")) % 3 != 0))
    first = run_ladder(texts, config, scripted_rewriter(), in_time)
    if not first.missing:
        raise RuntimeError("no answer was late")
    done = run_ladder(texts, config, scripted_rewriter(), ReplayResponder(guesses))
    return ladder_results(done).drop("run_id", "body", "text_status", "guess_status")


def extra_columns(spark, sf_dir):
    """The user's own columns in prompts and results, one of them with a name that runs use."""
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    wide = _spread_articles(spark, sf_dir).join(docs.select("doc_id", "lang", F.col("source").alias("Desk Name"), F.col("n_chars").alias("round")), "doc_id")
    template = {"template": ["Mask for ", {"column": "Desk Name", "prefix": "desk ", "suffix": ", "}, {"column": "lang", "prefix": "in ", "suffix": "."}]}
    config = RunConfig(run_id="extra", paraphrase=False, mask_template=template, mask_template_iter=template)
    told = ExpressionResponder(lambda call: F.concat(call.system, F.lit(f" {call.step.round}")), policy_for("ollama"))
    ladder = run_ladder(conform_articles(wide), config, told, scripted_guesser())
    return ladder_results(ladder).select("doc_id", "lang", F.col("Desk Name").alias("desk"), "round_input", "neutered_text", "neutered_at_step")


def sentiment_replay(spark, sf_dir):
    """Recorded sentiment that differs between the neutered and the raw text."""
    both = _articles(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("neutered"), F.lit("raw"))).alias("target"))
    n = F.when(F.col("target") == "raw", F.col("doc_id") % 3).otherwise(F.col("doc_id") % 5).cast("string")
    answers = both.select("doc_id", "target", F.concat(F.lit("Direction Estimate: "), n, F.lit(", Magnitude Estimate: 0."), n).alias("response"))
    out = run(_articles(spark, sf_dir), RunConfig(run_id="recorded"), scripted_rewriter(), scripted_guesser(),
              ReplayResponder(answers, keys=("doc_id",), error=None))
    return out.results.select("doc_id", "direction_neut", "magnitude_neut", "direction", "magnitude")


def offline_sentiment(spark, sf_dir):
    """Sentiment requests of every whole article for a hosted model."""
    config = RunConfig(provider="openai", model_name="gpt-4o-mini")
    return sentiment_requests(_articles(spark, sf_dir), config, "body")


def row_prompts(spark, sf_dir):
    """A rewriter that answers with a digest of the prompt it was given: the template of every step and row."""
    digest = ExpressionResponder(lambda call: F.md5(call.system))
    ladder = run_ladder(_articles(spark, sf_dir), RunConfig(run_id="prompts"), digest, scripted_guesser())
    return ladder.attempts.select("doc_id", "step_no", "text")


def sorted_tokens(spark, sf_dir):
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", F.md5(token_sorted(F.col("text"))).alias("sorted_md5"))


def errors(spark, sf_dir):
    """The error table of a run whose answers fail now and then."""
    def rewrite(call):
        bad = F.col("doc_id") % 13 == call.step.step_no
        return (F.when(~bad, F.concat(F.lit("x "), call.user)),
                F.when(bad, F.lit("maximum context length")))

    def guess(call):
        bad = F.col("doc_id") % 17 == call.step.step_no
        return F.when(~bad, _sql(fx.guess_answer(str(call.step.step_no)))), F.when(bad, F.lit("refused"))

    config = RunConfig(run_id="failing", perform_sentiment=False, strict=True)
    out = run(_articles(spark, sf_dir), config, ExpressionResponder(rewrite), ExpressionResponder(guess))
    return out.errors


# --- masking by rules ---

# Sentences with every spelling the rules know, appended to each article.
SPELLINGS = """concat(body, ' SYMBOL:', ticker, ' SYMBOL: ', ticker, ' SYMBOL ', ticker, ' $ ', ticker, ' > ', ticker,
  ' >', ticker, ' and SYMBOL:ZZTOP, >QQ. See https://example.com/a?b=', cast(doc_id AS {STR}),
  ' or www.example.org. At 10:', cast(10 + doc_id % 50 AS {STR}), ' am on March 5, 2019, 7 May 2018 and 3/4/2017,',
  ' sales in FY2016 were $', cast(doc_id AS {STR}), '.50 million, up ', cast(doc_id % 7 AS {STR}), ' percent; ',
  lower(comnam), ' sold 1,200 units. In the 1990s, Q3, Q1 2020, 3Q23, FY23 and 2023E, on Monday in January, the 5th mail to a.b@c.com',
  ' at example.com at 2024-01-05T10:00:00Z or 2024-01-05T10:00:00.5+01:00 and 1,,2..3 m m m m.')"""


# Values in digits and words, some of them twice, and what must not be taken for a value.
_WORDS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
          "thirty forty fifty sixty seventy eighty ninety").split()
_WORD = "CASE doc_id % 26 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END"
WRITTEN = f"""concat(substr(body, 1, 400), ' It sold ', {_WORD}, ' million units, or ', {_WORD}, ' Percent, in the ', {_WORD}, '-', 'first year; ',
  cast(doc_id % 9 + 1 AS {{STR}}), ',000 shares, then ', cast(doc_id % 9 + 1 AS {{STR}}), '000 Shares and ', cast(doc_id AS {{STR}}), 'x, 3.5x, 4x4 or $2000 in 2000. ',
  'One third of a hundred and one, no one of the first, one year, two and three, hundreds of them, a second look at noon, sixteen sixty six. ',
  'NYSE: AAPL and NASDAQ:BRK.B rose in May and Q3''23 to 05.01.2024 at ftp.apple.com, apple.co.uk or o''brien@sap.de; US$7, EUR ', cast(doc_id % 5 AS {{STR}}),
  '.25 bn and 10-billion-dollars. ', substr(body, 401))"""


def _spelled(spark, sf_dir):
    return _spread_articles(spark, sf_dir).withColumn("body", _sql(SPELLINGS))


def rule_mask(spark, sf_dir):
    return _spelled(spark, sf_dir).select("doc_id", mask_article(
        F.col("body"), F.col("comnam"), F.col("ticker")).alias("masked"))


def rule_mask_words(spark, sf_dir):
    """Numbers in words, values whole, hosts and tickers behind their exchange."""
    texts = _spread_articles(spark, sf_dir)
    return texts.select("doc_id", mask_patterns(_sql(WRITTEN)).alias("masked"))


def rule_mask_lettered(spark, sf_dir):
    """Each text's numbers told apart by letters, in order of first mention."""
    texts = _spread_articles(spark, sf_dir)
    return texts.select("doc_id", mask_patterns(_sql(WRITTEN), lettered=True).alias("masked"))


def rule_mask_texts(spark, sf_dir):
    """The pattern classes over all documents and conversations as they are."""
    from_tables = fx.tables(spark, sf_dir, "documents", "conversations")
    texts = from_tables["documents"].select(F.lit("documents").alias("origin"), "doc_id", F.lit(0).cast("bigint").alias("turn"), "text").unionByName(
        from_tables["conversations"].select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("doc_id"), "turn", "text"))
    return texts.select("origin", "doc_id", "turn", mask_patterns(F.col("text")).alias("masked"))


def ladder_with_rules(spark, sf_dir):
    """The ladder with rules as the masker and a reader that only finds what was not masked."""
    def guess(call):
        named = F.when(F.contains(F.lower(call.user), F.lower(F.array_join(core_words(F.col("comnam")), " "))), F.col("comnam"))
        day = F.date_format("pub_date", "yyyy-MM-dd")
        dated = F.when(call.user.contains(day), day)
        return F.concat(F.lit("Name Estimate: "), F.coalesce(named, F.lit("NA")),
                        F.lit(", Date Estimate: "), F.coalesce(dated, F.lit("NA")))
    config = RunConfig(run_id="rules", paraphrase=False)
    ladder = run_ladder(_articles(spark, sf_dir), config, rule_rewriter(), ExpressionResponder(guess))
    return ladder_results(ladder).select("doc_id", "neutered_text", "neutered_at_step", "iort_guess_correct_neutered")


def _entity_mask(more=False, **limits):
    def query(spark, sf_dir):
        part = fx.tables(spark, sf_dir, "part")["part"]
        dictionary = part.select(F.col("p_name").alias("surface"), F.lit("company").alias("kind"),
                                 F.col("p_name").alias("entity")).unionByName(
            part.select(F.col("p_type").alias("surface"), F.lit("industry").alias("kind"), F.lit("").alias("entity")))
        if more:  # a spelling for every order line, which no text holds
            lines = fx.tables(spark, sf_dir, "lineitem")["lineitem"]
            name = F.concat_ws(" ", F.lit("unheard"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
            dictionary = dictionary.unionByName(lines.select(name.alias("surface"), F.lit("company").alias("kind"), F.lit("").alias("entity")))
        texts = _spread_articles(spark, sf_dir).join(fx.rivals(spark, sf_dir), "doc_id").withColumn(
            "text", _sql("concat(body, ' Its rival ', rival, ' lost to ', upper(rival), ' Inc in ', lower(industry), '.')"))
        return mask_entities(texts, dictionary, "text", "comnam", "masked", **limits).select("doc_id", "masked")
    return query


# --- robustness ---

def _model_guesser():
    step = "CASE model " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in MODELS.items()) + " END"
    return ExpressionResponder(lambda call: _sql(fx.guess_answer(step)), ROBUSTNESS)


def _model_guesses(spark, sf_dir):
    text = F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.col("body"))
    texts = _articles(spark, sf_dir).withColumn("neutered_text", text)
    return guess_with_models(texts, list(MODELS), _model_guesser())


def robustness_by_model(spark, sf_dir):
    return rate_by_model(audit_models(_model_guesses(spark, sf_dir)))


def robustness_wide(spark, sf_dir):
    """Guesses stored one folder per model, then side by side again."""
    path = scratch_path(spark, "guesses")
    kept = ("guess_response", *GUESS_COLUMNS)
    write_guesses(_model_guesses(spark, sf_dir).select("model", "doc_id", *kept), path)
    wide = wide_guesses(spark.read.parquet(path), list(MODELS))
    short = dict(zip(MODELS, ("llama", "gemma")))
    return wide.select("doc_id", *(F.col(f"`name_guess_{m}`").alias(f"name_guess_{s}") for m, s in short.items()),
                       *(F.col(f"`date_guess_raw_{m}`").alias(f"date_guess_{s}") for m, s in short.items()))


# --- batch scoring and budgets ---

def _batch_rows(spark, sf_dir):
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    docs = _spread(docs, docs)
    words = word_count(F.col("text")) * F.when(F.col("doc_id") % 5 == 0, 60).otherwise(1)
    return docs.select("doc_id", F.col("source").alias("name"), "text",
                       F.when(F.col("doc_id") % 31 == 0, 0).otherwise(words).cast("int").alias("word_count"))


def token_budget(spark, sf_dir):
    routed = route_by_size(_batch_rows(spark, sf_dir))
    return routed.select("doc_id", "word_count", "tokens", "route",
                         estimated_tokens(F.col("word_count")).alias("rough_tokens"))


def batch_by_name(spark, sf_dir):
    answered = ExpressionResponder(lambda call: F.concat(F.lit("read "), F.col("doc_id").cast("string")))
    answers, _ = score_batch(_batch_rows(spark, sf_dir), answered, F.lit("judge"), order="doc_id")
    return answers


def batch_too_big(spark, sf_dir):
    answered = ExpressionResponder(lambda call: call.user)
    _, left_out = score_batch(_batch_rows(spark, sf_dir), answered, F.lit("judge"), order="doc_id")
    return left_out


def batch_exploded(spark, sf_dir):
    """Several output rows per name, one for each line of the answer."""
    answered = ExpressionResponder(lambda call: call.user)
    answers, _ = score_batch(
        _batch_rows(spark, sf_dir), answered, F.lit("judge"), order="doc_id",
        expand=lambda c: F.transform(F.split(c, "\n"), lambda line, i: F.struct(
            i.alias("line_no"), line.alias("line"))))
    return answers


def batch_header(spark, sf_dir):
    n = 100
    return first_rows(_batch_rows(spark, sf_dir), n, "doc_id").select("doc_id", "name", "word_count")


def token_use(spark, sf_dir):
    log = fx.tables(spark, sf_dir, "events")["events"].select(
        F.col("user_id").alias("client"), "ts", F.floor(F.col("value") * 2).cast("int").alias("tokens"))
    return rolling_tokens(log, span_us=3_600_000_000, bucket_us=14_400_000_000, limit=100)


def token_use_by_default(spark, sf_dir):
    """A minute and ten million tokens, over a log that comes to more."""
    log = fx.tables(spark, sf_dir, "events")["events"].select(
        F.col("user_id").alias("client"), "ts", F.floor(F.col("value") * 2_000_000).cast("bigint").alias("tokens"))
    return rolling_tokens(log)


PLAN_SPAN, PLAN_LIMIT = 3_600_000_000, 5_000


def planned_sends(spark, sf_dir):
    """When to send every request of the log, so that no hour holds too many tokens of a client."""
    log = fx.tables(spark, sf_dir, "events")["events"].select(
        "event_id", F.col("user_id").alias("client"), F.floor(F.col("value") * 20).cast("int").alias("tokens"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("came"))
    return send_plan(log, order="event_id", arrival="came", span_us=PLAN_SPAN, limit=PLAN_LIMIT)


def request_payload(spark, sf_dir):
    texts = _articles(spark, sf_dir)
    model = F.when(F.col("doc_id") % 2 == 0, "gpt-5-nano-2025-08-07").otherwise("gpt-4o-mini")
    return texts.select("doc_id", hosted_request(F.lit("Guess."), F.col("body"), model).alias("request"))


def request_payload_local(spark, sf_dir):
    prompt = templates.compile_prompt(templates.MASK_TEMPLATE, ["comnam", "ticker", "industry"])
    return build_requests(_articles(spark, sf_dir), prompt, F.col("body"), "gemma3:4b", "ollama")


# --- sources ---

def csv_round_trip(spark, sf_dir):
    """Articles to CSV under the source column names, loaded back with line breaks and quotes."""
    path = scratch_path(spark, "csv")
    write_csv(_articles(spark, sf_dir), f"{path}/in")
    return ingest_csv(spark, f"{path}/in", f"{path}/articles", key="doc_id")


# A format of the day, and microseconds since its midnight that the written text stands for.
SPELLED_DATES = (
    ("yyyy-MM-dd", 0), ("yyyy/MM/dd", 0), ("MM/dd/yyyy", 0), ("d MMM yyyy", 0), ("MMMM d, yyyy", 0), ("yyyy-MM-dd HH:mm:ss", 0),
    ("EEE, dd MMM yyyy '10:00:00 GMT'", 36_000_000_000), ("yyyy-MM-dd'T10:00:00+0100'", 32_400_000_000),
    ("yyyy-MM-dd'T10:00:00.123456789'", 36_000_123_456), ("yyyyMMdd'T100000Z'", 36_000_000_000),
    ("MMMM d, yyyy '3:30 PM'", 55_800_000_000), ("d MMMM yyyy '10:00'", 36_000_000_000), ("yyyy/MM/dd '10:00:00'", 36_000_000_000),
    ("MMM. d, yyyy", 0), ("yyyy-M-d", 0), ("d-MMM-yy", 0), ("EEEE, MMMM d, yyyy", 0), ("M/d/yy", 0), ("yyyyMMdd", 0), ("yyyy.MM.dd", 0),
    ("yyyy-MM-dd '10:00-05:30'", 55_800_000_000), ("d'th of 'MMMM yyyy", 0), ("M/d/yyyy '12:15 a.m.'", 900_000_000), ("yyyy MMMM dd", 0))


def mixed_dates(spark, sf_dir):
    """Dates written in every way that is read, back to one type."""
    n = F.col("doc_id") % len(SPELLED_DATES)
    written = F.coalesce(*(F.when(n == i, F.date_format("pub_date", f)) for i, (f, _) in enumerate(SPELLED_DATES)))
    texts = _articles(spark, sf_dir).withColumn("pub_date", F.regexp_replace(written, "Sep(?![a-z])", "Sept"))
    return conform_articles(texts).select("doc_id", "pub_date")


FILE_ROWS = 20_000  # a file is written by one task, so a larger input gives more files, not larger ones


def csv_one_big_file(spark, sf_dir):
    """One CSV file (one for each FILE_ROWS articles) with line breaks in its cells, read by many tasks."""
    path, texts = scratch_path(spark, "csv"), _articles(spark, sf_dir)
    files = -(-texts.count() // FILE_ROWS)
    write_csv(texts.repartition(files, "doc_id") if files > 1 else texts.coalesce(1), f"{path}/in")
    with settings(spark, spark__sql__files__maxPartitionBytes="256k", spark__sql__files__openCostInBytes="0"):
        tasks = spark.read.option("lineSep", "\n").text(f"{path}/in").select(F.spark_partition_id()).distinct().count()
        if tasks < 2:
            raise RuntimeError("one task read it all")
        return ingest_csv(spark, f"{path}/in", f"{path}/articles", key="doc_id", split=True)


def csv_reordered(spark, sf_dir):
    """Files of two column orders, one with a column of its own, loaded by name."""
    path = scratch_path(spark, "csv")
    texts = _articles(spark, sf_dir)
    write_csv(texts.filter("doc_id % 2 = 0"), f"{path}/a")
    write_csv(texts.filter("doc_id % 2 = 1").select("ticker", "pub_date", F.lit("late").alias("desk"), "body", "industry", "doc_id", "comnam"), f"{path}/b")
    return ingest_csv(spark, [f"{path}/a", f"{path}/b"], f"{path}/articles", key="doc_id")


def combined_csv(spark, sf_dir):
    """Result files with different headers, joined by column name."""
    path = scratch_path(spark, "chunks")
    texts = _articles(spark, sf_dir)
    write_csv(texts.filter("doc_id % 2 = 0").select("doc_id", "ticker"), f"{path}/a", source_names=False)
    write_csv(texts.filter("doc_id % 2 = 1").select("industry", "doc_id"), f"{path}/b", source_names=False)
    return combine_csv(spark, [f"{path}/a", f"{path}/b"])


def batch_job(spark, sf_dir):
    """CSV in; profile, counts by step, rate and sentiment out, one fact per row."""
    path = scratch_path(spark, "batch")
    write_csv(_articles(spark, sf_dir), f"{path}/in")
    report = run_batch(spark, f"{path}/in", RunConfig(run_id="batch", output_path=f"{path}/out"),
                       scripted_rewriter(), scripted_guesser(), scripted_scorer(),
                       csv_into=f"{path}/articles", key="doc_id")
    facts = [report.profile.select(F.lit("firms").alias("fact"), F.col("firms").cast("double").alias("value")),
             report.profile.select(F.lit("industries"), F.col("industries").cast("double")),
             report.rate.select(F.lit("identification_rate"), "identification_rate"),
             report.summary.select("neutered_at_step", F.col("texts").cast("double")),
             report.output.results.agg(F.count_if(F.col("direction") == "1").cast("double").alias("n")).select(
                 F.lit("bullish"), "n")]
    return reduce(lambda a, b: a.union(b), facts)


def offline_requests(spark, sf_dir):
    """Guess requests of every article for a hosted model, as one JSON document each."""
    config = RunConfig(provider="openai", model_name="gpt-4o-mini")
    return guess_requests(_articles(spark, sf_dir), config, "body", plan_steps(config)[1])


def wrapped_responder(spark, sf_dir):
    """Texts cleaned on the way in, answers on the way out."""
    echo = ExpressionResponder(lambda call: F.concat(F.lit("*'"), call.user))
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    scored = WrappedResponder(echo, clean_characters, clean_characters).score(
        docs, F.lit(""), F.col("text"), "answer")
    return scored.select("doc_id", F.col("answer.text").alias("text"))


def random_sample(spark, sf_dir):
    return stable_sample(_articles(spark, sf_dir), 50, seed=7).select("doc_id", "comnam", "body")


def random_half(spark, sf_dir):
    """Half of all rows, chosen by counting hashes."""
    docs = fx.tables(spark, sf_dir, "documents")["documents"]
    return stable_sample(docs, docs.count() // 2, seed=7).select("doc_id", "text")


def profile_runs(spark, sf_dir):
    """Profiles stored by run and merged over runs: is each within its error of the exact one."""
    texts, path = _articles(spark, sf_dir).withColumn("run_id", F.col("doc_id") % 4), scratch_path(spark, "profiles")
    for r in range(4):
        metrics.profile_sketch(texts.filter(F.col("run_id") == r)).write.parquet(f"{path}/run_id={r}")
    stored = spark.read.parquet(path)
    exact = texts.groupBy("run_id").agg(*(F.count_distinct(c).alias(f"{m}_exact") for m, c in metrics.MEASURES.items()))
    exact = exact.select(F.col("run_id").cast("int").alias("run"), *(f"{m}_exact" for m in metrics.MEASURES)).unionByName(
        texts.agg(*(F.count_distinct(c).alias(f"{m}_exact") for m, c in metrics.MEASURES.items())).withColumn("run", F.lit(-1)))
    merged = metrics.merge_profiles(stored.withColumn("run", F.col("run_id").cast("int")), "run").unionByName(
        metrics.merge_profiles(stored).withColumn("run", F.lit(-1)))
    near = [(F.abs(F.col(m) - F.col(f"{m}_exact")) <= 0.025 * F.col(f"{m}_exact")).alias(f"{m}_near") for m in metrics.MEASURES]
    return merged.join(exact, "run").select("run", "texts", "earliest", "latest", *near)


QUERIES = {
    "profile": profile,
    "clean_chars": clean_chars,
    "prompt_mask": _prompt(templates.MASK_TEMPLATE),
    "prompt_mask_iter": _prompt(templates.MASK_TEMPLATE_ITER),
    "prompt_paraphrase": _prompt(templates.PARA_TEMPLATE),
    "prompt_paraphrase_iter": _prompt(templates.PARA_TEMPLATE_ITER),
    "extract_identification": extract_identification,
    "extract_sentiment": extract_sentiment_fields,
    "clean_name": clean_names,
    "name_similarity": name_similarities,
    "name_similarity_by_pair": name_similarities_by_pair,
    "date_match": date_match,
    "check_identified": identified,
    "ladder_full": _ladder(),
    "ladder_mask_only": _ladder(paraphrase=False),
    "ladder_para_only": _ladder(masking=False),
    "ladder_none": ladder_none,
    "ladder_no_rounds": _ladder(max_rounds=0),
    "first_neutered_step": first_passed,
    "last_guess": last_guesses,
    "summary_by_step": summary_by_step,
    "identification_rate": identification_rate,
    "wide_attempts": wide_attempts,
    "sentiment_both": sentiment_both,
    "combine_runs": combined_runs,
    "combine_csv": combined_csv,
    "replay_join": replay_join,
    "replay_by_content": replay_by_content,
    "callable_responder": callable_responder,
    "error_table": errors,
    "ladder_replay": ladder_replay,
    "ladder_replay_paused": ladder_replay_paused,
    "paused_run": paused_run,
    "ladder_late_answers": ladder_late_answers,
    "extra_columns": extra_columns,
    "sentiment_replay": sentiment_replay,
    "sentiment_requests": offline_sentiment,
    "row_prompts": row_prompts,
    "token_sort": sorted_tokens,
    "rule_mask": rule_mask,
    "rule_mask_texts": rule_mask_texts,
    "rule_mask_words": rule_mask_words,
    "rule_mask_lettered": rule_mask_lettered,
    "ladder_with_rules": ladder_with_rules,
    "entity_mask": _entity_mask(),
    "entity_mask_joined": _entity_mask(max_surfaces=0),
    "entity_mask_large": _entity_mask(more=True, max_surfaces=5_000),
    "robustness_by_model": robustness_by_model,
    "robustness_wide": robustness_wide,
    "token_budget": token_budget,
    "batch_by_name": batch_by_name,
    "batch_too_big": batch_too_big,
    "batch_exploded": batch_exploded,
    "batch_header": batch_header,
    "rolling_tokens": token_use,
    "rolling_tokens_default": token_use_by_default,
    "send_plan": planned_sends,
    "request_payload": request_payload,
    "request_payload_local": request_payload_local,
    "csv_round_trip": csv_round_trip,
    "csv_one_big_file": csv_one_big_file,
    "csv_reordered": csv_reordered,
    "mixed_dates": mixed_dates,
    "stable_sample": random_sample,
    "stable_sample_half": random_half,
    "profile_runs": profile_runs,
    "batch_job": batch_job,
    "offline_requests": offline_requests,
    "wrapped_responder": wrapped_responder,
}
