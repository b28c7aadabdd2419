"""The ladder: rewrite, guess, audit; texts still identified go on to the next step.

Articles are laid out by document once. Every step is one map-only job over the texts that the step before left
identified: it adds one attempt per text and appends it, so no text is shuffled and the plan never grows. All columns of the
input but the body ride along for prompts and responders; the body is joined back, bucket by bucket, at the end. Since
a responder may answer differently each time, its answers count only once they are written.

A recorded answer that is missing may still arrive. A text that lacks one waits at its step, and all others go
on. Resuming the run takes a turn: waiting texts are asked about again, with what was already answered
for them, and those that find their answers go on from there.

In a packed run (see ``tables``) the body travels with the texts of a step, as what they are told by.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anontext.functions.extract import guess_fields, normalise_answer
from anontext.functions.identify import identification_flags, parse_iso_date
from anontext.functions.names import name_similarity
from anontext.functions.text import let
from anontext.operators.responders import MISSING, OK, Step, is_recorded
from anontext.operators.templates import compile_prompt
from anontext.plans.tables import IDENTIFIED, PASSED, WAITING, Commit, RunTables, buckets_for, fingerprint
from anontext.schema import ARTICLES, RESERVED, STEP_TABLE, RunConfig, require_unique
from anontext.session import scratch_path

# Names of steps in the results, and the marks of texts that never pass and of
# runs that rewrite nothing.
STEP_NAMES = {"mask": "masking_step", "para": "paraphrasing_step"}
NEVER, NEVER_ROUND = "never_neutered", -1
UNTOUCHED, UNTOUCHED_ROUND = "no_neutering", 0


def plan_steps(config: RunConfig) -> list[Step]:
    """Steps in order: mask and/or paraphrase in round 0, then again in each further round."""
    steps: list[Step] = []
    for round_no in range(config.max_rounds + 1):
        first = round_no == 0
        if config.masking:
            steps.append(Step(len(steps), round_no, "mask",
                              config.mask_template if first else config.mask_template_iter))
        if config.paraphrase:
            steps.append(Step(len(steps), round_no, "para",
                              config.para_template if first else config.para_template_iter))
    return steps


@dataclass(frozen=True)
class StepCount:
    step: Step
    rows: int
    identified: int
    waiting: int = 0


@dataclass(frozen=True)
class LadderRun:
    """A run's tables and what each step counted."""
    spark: SparkSession
    config: RunConfig
    tables: RunTables
    commits: list[Commit]

    @property
    def _last_turn(self) -> int:
        return max((c.turn for c in self.commits), default=0)

    @property
    def counts(self) -> list[StepCount]:
        """Per step, over all turns: texts that were decided, how many stayed identified, how many wait now."""
        out = []
        for step in plan_steps(self.config):
            own = [c for c in self.commits if c.step_no == step.step_no]
            if own:
                out.append(StepCount(step, sum(c.rows - c.waiting for c in own), sum(c.identified for c in own),
                                     sum(c.waiting for c in own if c.turn == self._last_turn)))
        return out

    @property
    def pending(self) -> Step | None:
        """The first step at which texts wait for an answer."""
        return next((c.step for c in self.counts if c.waiting), None)

    @property
    def missing(self) -> int:
        """How many texts wait."""
        return sum(c.waiting for c in self.counts)

    def _attempts(self, commits: list[Commit], *states: int) -> DataFrame:
        rows = self.tables.attempts(commits, *states)
        return self.spark.createDataFrame([], STEP_TABLE) if rows is None else rows

    @property
    def attempts(self) -> DataFrame:
        """One row per text and step it went through."""
        rows = self._attempts(self.commits, PASSED, IDENTIFIED)
        carried = self.tables.articles.drop("doc_id").columns
        return rows.drop("asked_text", *carried).select(F.lit(self.config.run_id).alias("run_id"), "*")

    @property
    def waiting(self) -> DataFrame:
        """Texts that wait for an answer, with the step at which they do."""
        return self._attempts([c for c in self.commits if c.turn == self._last_turn], WAITING).drop("body")

    @property
    def finished(self) -> DataFrame:
        """The last attempt of every text that has passed, or is left over after the last step; with its article."""
        steps = plan_steps(self.config)
        rows = self._attempts(self.commits, PASSED, IDENTIFIED)
        done = rows.where((F.col("identified") == PASSED) | (F.col("step_no") == len(steps) - 1))
        if self.tables.packed:
            return done.drop("asked_text")
        article = self.tables.articles
        carried = [c for c in article.columns if c != "doc_id"]
        return article.join(done.drop("asked_text", *carried), "doc_id")


@dataclass(frozen=True)
class AuditColumns:
    """Expressions that are the same at every step, built once; ``again`` are those of a text that was asked about before."""
    fields: Column
    similarity: Column
    date: Column
    attempt: list[Column]
    again: tuple[Column, Column, Column]

    @staticmethod
    def of(config: RunConfig) -> AuditColumns:
        fields, similarity, date = F.col("__fields"), F.col("name_similarity"), F.col("date_guess")
        flags = identification_flags(similarity, F.col("pub_date"), date, config.threshold,
                                     config.tolerance_days)
        identified = flags.pop("iort_guess_correct")
        if config.strict:
            answered = (F.col("__rewrite.status") == OK) & (F.col("__guess.status") == OK)
            identified = F.when(answered, identified).otherwise(F.lit(1))
        told, similar, day = F.col("__before"), name_similarity(
            F.col("comnam"), fields["name"], config.similarity_method, config.escape_dots), parse_iso_date(fields["date"])
        return AuditColumns(
            fields=guess_fields(normalise_answer(F.col("__guess.text"))),
            similarity=similar,
            date=day,
            # Bound by let, since the optimiser evaluates what stands several times in a branch as often.
            again=(F.when(F.col("__guess.text") == told["answer"], told["fields"]).otherwise(
                       let(normalise_answer(F.col("__guess.text")), guess_fields)),
                   F.when(fields["name"] == told["fields"]["name"], told["similarity"]).otherwise(similar),
                   F.when(fields["date"] == told["fields"]["date"], told["date"]).otherwise(day)),
            attempt=[
                F.col("__rewrite.text").alias("text"), F.col("__rewrite.status").alias("text_status"),
                F.col("__rewrite.message").alias("text_message"),
                F.col("__guess.text").alias("guess_response"),
                F.col("__guess.status").alias("guess_status"),
                F.col("__guess.message").alias("guess_message"),
                fields["ticker"].alias("ticker_guess"), fields["name"].alias("name_guess"),
                fields["date"].alias("date_guess_raw"), date,
                fields["industry"].alias("industry_guess"), similarity,
                *(flag.alias(name) for name, flag in flags.items()), identified.alias("identified"),
            ])


def attempt_step(texts: DataFrame, step: Step, config: RunConfig, rewriter, guesser, audit: AuditColumns,
                 rewritten: bool = False, with_body: bool = False) -> DataFrame:
    """One pass over texts: article columns plus ``current_text``, ``__rewrite`` where it is there already, and
    ``__before`` where there was a step before: its answer and what was read from it. The body goes, unless ``with_body``."""
    left = ("current_text", "__rewrite", "__before") if with_body else ("body", "current_text", "__rewrite", "__before")
    carried = [c for c in texts.columns if c not in left]
    fields, similarity, date = audit.again if "__before" in texts.columns else (audit.fields, audit.similarity, audit.date)
    asked = texts
    if not rewritten:
        asked = rewriter.score(texts, compile_prompt(step.template, texts.columns), F.col("current_text"), "__rewrite", step)
    open_rewrite = F.lit(is_recorded(rewriter)) & (F.col("__rewrite.status") == MISSING)
    open_guess = (F.lit(is_recorded(guesser)) & (F.col("__guess.status") == MISSING)
                  & F.col("__rewrite.text").isNotNull())
    asked = guesser.score(asked, compile_prompt(config.guess_prompt, texts.columns), F.col("__rewrite.text"), "__guess", step)
    waits = open_rewrite | open_guess
    *attempt, identified = audit.attempt
    return (asked.withColumn("__fields", fields)
            .select("*", similarity.alias("name_similarity"), date.alias("date_guess"))
            .select(*(F.col(f"`{c}`") for c in carried), F.lit(step.step_no).alias("step_no"), F.lit(step.round).alias("round"),
                    F.lit(step.kind).alias("kind"), *attempt, F.when(waits, F.col("current_text")).alias("asked_text"),
                    F.when(waits, F.lit(WAITING)).otherwise(identified).alias("identified")))


def run_ladder(articles: DataFrame, config: RunConfig, rewriter, guesser) -> LadderRun:
    """Run the steps until none is left or no text is still identified.

    ``rewriter`` is one responder, or a dict with one for ``mask`` and one for ``para``. Tables go below the output
    path, or to the shared scratch folder when they need not be kept. A null or repeated key stops the run.
    """
    spark = articles.sparkSession
    if clash := [c for c in articles.columns if c.lower() in RESERVED and c not in ARTICLES.names or c.startswith("__")]:
        raise ValueError(f"columns {clash} have names that runs use; conform_articles renames them")
    keep = bool(config.output_path) and config.keep_attempts
    root = (f"{config.output_path.rstrip('/')}/steps/run_id={config.run_id}" if keep
            else scratch_path(spark, f"run-{config.run_id}"))
    tables = RunTables(spark, root, keep)

    def digest_now() -> str:
        told = articles.agg(F.count(F.lit(1)), fingerprint(articles)).first()
        return _digest(config, told[0], told[1])

    if not (keep and config.resume and tables.take_up(digest_now)):
        if keep:
            tables.skip_entries()  # those of an earlier run carry another token and are not trusted
        tables.begin(articles, config.partitions or buckets_for(articles), lambda n, s: _digest(config, n, s))
    require_unique(tables.articles)
    steps, audit = plan_steps(config), AuditColumns.of(config)
    # A turn that was broken off is finished; after a finished one, waiting texts get another.
    turn = max((c.turn for c in tables.commits), default=0)
    if not _take_turn(tables, turn, steps, config, rewriter, guesser, audit) and any(
            c.waiting for c in tables.commits if c.turn == turn):
        _take_turn(tables, turn + 1, steps, config, rewriter, guesser, audit)
    return LadderRun(spark, config, tables, list(tables.commits))


def _take_turn(tables: RunTables, turn: int, steps: list[Step], config: RunConfig, rewriter, guesser,
               audit: AuditColumns) -> bool:
    """All steps of one turn that are not done yet; whether there was any."""
    done = {c.step_no: c for c in tables.commits if c.turn == turn}
    waited = {c.step_no: c for c in tables.commits if c.turn == turn - 1 and c.waiting}
    worked = False
    for step in steps:
        if step.step_no in done:
            continue
        before = done.get(step.step_no - 1)
        parts = []  # (texts, whether they are rewritten)
        if turn == 0 and step.step_no == 0:
            parts.append((tables.articles.withColumn("current_text", F.col("body")), False))
        elif before is not None and before.identified:
            texts = tables.attempts([before], IDENTIFIED)
            parts.append((_as_texts(texts, F.col("text"), before=_answer_before()), False))
        if step.step_no in waited:
            texts, status = tables.attempts([waited[step.step_no]], WAITING), F.col("text_status")
            unwritten = tables.stored_attempts([waited[step.step_no]], WAITING).where(status == MISSING).count()
            if unwritten:
                parts.append((_as_texts(texts.where(status == MISSING), F.col("asked_text")), False))
            if unwritten < waited[step.step_no].waiting:
                parts.append((_as_texts(texts.where(status != MISSING), F.col("asked_text"), F.struct(
                    F.col("text"), status.alias("status"), F.col("text_message").alias("message"))), True))
        if not parts:
            continue
        chosen = rewriter[step.kind] if isinstance(rewriter, dict) else rewriter
        attempt = None
        for texts, rewritten in parts:
            made = attempt_step(texts, step, config, chosen, guesser, audit, rewritten, tables.packed)
            attempt = made if attempt is None else attempt.unionByName(made)
        expected = (before.identified if before else 0) + (waited[step.step_no].waiting if step.step_no in waited else 0)
        done[step.step_no] = tables.commit(attempt, turn, step.step_no, expected if turn or step.step_no else None)
        worked = True
    return worked


def _answer_before() -> Column:
    """An attempt's answer, and what was read from it."""
    fields = F.struct(F.col("ticker_guess").alias("ticker"), F.col("name_guess").alias("name"),
                      F.col("date_guess_raw").alias("date"), F.col("industry_guess").alias("industry"))
    return F.struct(F.col("guess_response").alias("answer"), fields.alias("fields"),
                    F.col("name_similarity").alias("similarity"), F.col("date_guess").alias("date"))


def _as_texts(attempts: DataFrame, text: Column, rewrite: Column | None = None, before: Column | None = None) -> DataFrame:
    """Article columns of attempts, and the text to go on with."""
    added = {"current_text": text, "__rewrite": rewrite, "__before": before}
    added = {n: c for n, c in added.items() if c is not None}
    own = {"doc_id", *(f.name for f in STEP_TABLE if f.name not in ARTICLES.names)} - {"doc_id"}
    return attempts.select(*(F.col(f"`{c}`") for c in attempts.columns if c not in own), *(c.alias(n) for n, c in added.items()))


def _digest(config: RunConfig, rows: int, total) -> str:
    """Of what decides a run's steps: its configuration, without where and how it is kept, and its articles."""
    told = {k: repr(v) for k, v in vars(config).items() if k not in ("output_path", "resume", "keep_attempts", "partitions")}
    return hashlib.sha256(repr((sorted(told.items()), rows, str(total))).encode()).hexdigest()


def step_name() -> Column:
    name = F.when(F.col("kind") == "mask", STEP_NAMES["mask"]).otherwise(STEP_NAMES["para"])
    return F.concat(name, F.lit("_"), F.col("round").cast("string"))


def ladder_results(run: LadderRun) -> DataFrame:
    """One row per article: its final text, when it passed, and the guesses that decided it."""
    never = F.col("identified") == 1
    kept = {"name_similarity": "name_similarity_neutered",
            "name_guess_correct": "name_guess_correct_neutered",
            "date_guess_correct": "date_guess_correct_neutered",
            "identified": "iort_guess_correct_neutered"}
    article = run.tables.articles.columns
    return run.finished.select(
        F.lit(run.config.run_id).alias("run_id"), *(F.col(f"`{c}`") for c in article),
        F.col("text").alias("neutered_text"),
        F.when(never, NEVER_ROUND).otherwise(F.col("round")).alias("neutered_at_round"),
        F.when(never, NEVER).otherwise(step_name()).alias("neutered_at_step"),
        F.coalesce("ticker_guess", F.lit("")).alias("ticker_guess_neutered"),
        F.coalesce("name_guess", F.lit("")).alias("name_guess_neutered"),
        F.col("date_guess").alias("date_guess_neutered"),
        F.coalesce("industry_guess", F.lit("")).alias("industry_guess_neutered"),
        *(F.col(c).alias(name) for c, name in kept.items()),
        "text_status", "guess_status",
    )


def untouched_results(articles: DataFrame, config: RunConfig) -> DataFrame:
    """Results of a run that rewrites nothing: no guesses, so no audit columns."""
    return articles.select(
        F.lit(config.run_id).alias("run_id"), *(F.col(f"`{c}`") for c in articles.columns),
        F.col("body").alias("neutered_text"),
        F.lit(UNTOUCHED_ROUND).alias("neutered_at_round"),
        F.lit(UNTOUCHED).alias("neutered_at_step"),
    )

