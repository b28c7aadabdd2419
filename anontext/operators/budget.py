"""Batch scoring within a token budget: routing by size, one answer per name, rolling use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType
from pyspark.sql.window import Window

from anontext.functions.text import BATCH_TOKENS_PER_WORD, estimated_tokens, let
from anontext.operators.sampling import first_rows
from anontext.session import stored

# Tokens one text may have, tokens per minute, and the answer for empty texts.
TEXT_TOKENS = 120_000
MINUTE_TOKENS = 10_000_000
MINUTE_US = 60_000_000
EMPTY_ANSWER = "An error occurred: Error the error is there is no post self_text"

SEND, EMPTY, TOO_BIG = "send", "empty", "too_big"


def route_by_size(df: DataFrame, words: str = "word_count",
                  text_tokens: int | None = TEXT_TOKENS) -> DataFrame:
    """Add a token estimate and a route: empty texts, texts past the limit (None: there is none), and those to send."""
    def sized(n: Column) -> Column:
        tokens = estimated_tokens(n, BATCH_TOKENS_PER_WORD)
        too_big = F.lit(False) if text_tokens is None else tokens > text_tokens
        route = F.when(n == 0, EMPTY).when(too_big, TOO_BIG).otherwise(SEND)
        return F.struct(tokens.alias("tokens"), route.alias("route"))

    # The word count may be costly to derive; it is bound so that a filter on the route counts once.
    return (df.withColumn("__size", let(F.col(words), sized))
            .select("*", F.col("__size.tokens").alias("tokens"), F.col("__size.route").alias("route"))
            .drop("__size"))


def last_per_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """The row of each name with the largest value of a unique order column.

    Only name and order are aggregated, and combined before the shuffle, so a name that holds a
    third of the rows costs no more than any other; the winners are then picked by order.
    """
    winners = df.groupBy(name).agg(F.max(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def score_batch(df: DataFrame, responder, system: Column, text: str = "text", name: str = "name",
                words: str = "word_count", order: str = "row_no", header: int | None = None,
                expand=None, text_tokens: int | None = TEXT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Answers keyed by name, and the rows left out for their size.

    Sizes are taken in one pass over the texts and written, without the texts; who is asked is settled on them, and
    the texts are read once more to be sent. ``header`` limits the rows by order. Of several rows of one name that are not too big the
    last counts, so only that one is sent. ``expand`` turns the answer column into an
    ARRAY<STRUCT>, giving one output row per element; without it there is one row per name.
    """
    rows = first_rows(df, header, order)
    sizes = stored(route_by_size(rows.select(name, order, words), words, text_tokens), "batch-sizes")
    too_big = sizes.filter(F.col("route") == TOO_BIG).select(name, order, words, "tokens")
    last = sizes.filter(F.col("route") != TOO_BIG).groupBy(name).agg(
        F.max(F.struct(F.col(order), F.col("route"))).alias("__last")).select(name, "__last.*")
    chosen = rows.drop(name).join(last.filter(F.col("route") == SEND).select(name, order), order)
    scored = responder.score(chosen, system, F.col(text), "__answer")
    sent = scored.select(name, F.col("__answer.text").alias("response"),
                         F.col("__answer.status").alias("status"))
    empty = last.filter(F.col("route") == EMPTY).select(
        name, F.lit(EMPTY_ANSWER).alias("response"), F.lit(EMPTY).alias("status"))
    answers = sent.unionByName(empty)
    if expand is not None:
        answers = answers.select(name, "status", F.inline(expand(F.col("response"))))
    return answers, too_big


def rolling_tokens(log: DataFrame, client: str = "client", ts: str = "ts", tokens: str = "tokens",
                   span_us: int = MINUTE_US, limit: int = MINUTE_TOKENS,
                   bucket_us: int = 2 * MINUTE_US) -> DataFrame:
    """Per client and instant: requests, tokens, tokens of the last minute, and is that too many.

    The last minute includes both its ends, and requests at one instant count together. First
    equal instants are added up, before the shuffle. Then each instant books its tokens when it
    comes and takes them off just after they expire, and a running sum over these bookings is the
    rolling use: one pass, however many requests a minute holds. Sums run per client and time
    bucket, so a busy client is spread over tasks; a booking still open at the end of its bucket
    is carried into the next.
    """
    if bucket_us <= span_us:
        raise ValueError("a bucket must be longer than the span")
    instant = log.groupBy(F.col(client).alias("client"), F.col(ts).alias("ts")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col(tokens).cast("bigint")).alias("tokens"))
    instant = instant.withColumn("us", _micros(F.col("ts"), log.schema[ts].dataType))
    bucket = F.floor(F.col("us") / bucket_us)
    gone = F.col("us") + F.lit(span_us + 1).cast("bigint")
    gone_bucket = F.floor(gone / bucket_us)

    def booking(in_bucket, at, change, real):
        return F.struct(in_bucket.alias("bucket"), at.alias("at"), change.alias("change"),
                        F.lit(real).alias("real"))

    taken, given = F.col("tokens"), -F.col("tokens")
    stays = F.array(booking(bucket, F.col("us"), taken, True), booking(bucket, gone, given, False))
    crosses = F.array(booking(bucket, F.col("us"), taken, True),
                      booking(gone_bucket, gone_bucket * F.lit(bucket_us).cast("bigint"), taken, False),
                      booking(gone_bucket, gone, given, False))
    booked = instant.select("client", "ts", "requests", "tokens",
                            F.inline(F.when(bucket == gone_bucket, stays).otherwise(crosses)))
    running = Window.partitionBy("client", "bucket").orderBy("at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (booked.withColumn("rolling_tokens", F.sum("change").over(running))
            .filter("real")
            .select("client", "ts", "requests", "tokens", "rolling_tokens",
                    F.when(F.col("rolling_tokens") >= limit, 1).otherwise(0).alias("over_budget")))


def send_plan(requests: DataFrame, client: str = "client", order: str = "row_no", tokens: str = "tokens",
              arrival: str | None = None, span_us: int = MINUTE_US, limit: int = MINUTE_TOKENS) -> DataFrame:
    """When to send each request so that no span, both its ends included, holds ``limit`` tokens of a client.

    Requests of a client go in ``order`` (unique), none before its ``arrival`` (microseconds; without it all are there at
    0). A client's tokens run at the rate of limit - 1 - (its largest request) a span: a request is sent when all before it
    have run, so the requests of a span hold less than the rate and one more request. That is a prefix sum and, for
    arrivals, a running maximum. Both are taken in sorted parts and carried from part to part by a row for each
    client and part, so a client with a third of all requests is worked on by many tasks.

    Adds ``release`` in microseconds; null for a request of ``limit`` tokens or more, which never fits, and for null tokens.
    """
    none = F.lit(0) if arrival is None else F.coalesce(F.col(arrival), F.lit(0))
    fits = F.coalesce(F.col(tokens) < limit, F.lit(False))
    kept = [c for c in requests.columns]
    rows = requests.select(*(F.col(f"`{c}`") for c in kept), F.when(fits, F.col(tokens)).cast("bigint").alias("__tokens"),
                           none.cast("bigint").alias("__arrival"))
    rows = rows.repartitionByRange(F.col(client), F.col(order)).withColumn("__part", F.spark_partition_id())
    rows = stored(rows, "send-plan")
    within = Window.partitionBy(client, "__part").orderBy(order)
    before = Window.partitionBy("__client").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("__client")

    def carried(df: DataFrame, *columns: Column) -> DataFrame:
        """Something of each client's earlier parts: one row a client and part, however many requests they hold."""
        named = df.withColumnsRenamed({client: "__client", "__part": "__at"})
        return named.select("__client", "__at", *columns)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        same = F.col(client).eqNullSafe(F.col("__client")) & (F.col("__part") == F.col("__at"))
        return left.join(right, same, "left").drop("__client", "__at")

    sums = rows.groupBy(client, "__part").agg(F.sum("__tokens").alias("s"), F.max("__tokens").alias("m"))
    sums = carried(sums, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__earlier"),
                   F.greatest(F.lit(1), F.lit(limit - 1) - F.coalesce(F.max("m").over(everywhere), F.lit(0))).alias("__rate"))
    own = F.sum(F.coalesce("__tokens", F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = meet(rows.withColumn("__own", own - F.coalesce("__tokens", F.lit(0))), sums)
    # Time by which all earlier tokens have run; one microsecond more than the span, so that rounding down is safe.
    ran = F.call_function("div", (F.col("__earlier") + F.col("__own")).cast("decimal(20,0)") * F.lit(span_us + 1).cast("decimal(16,0)"),
                          F.col("__rate").cast("decimal(20,0)"))
    timed = stored(run.withColumn("__ran", ran).withColumn("__idle", F.when(F.col("__tokens").isNotNull(), F.col("__arrival") - F.col("__ran"))),
                   "send-times")
    most = timed.groupBy(client, "__part").agg(F.max("__idle").alias("s"))
    most = carried(most, F.max("s").over(before).alias("__before"))
    so_far = F.max("__idle").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    late = meet(timed.withColumn("__so_far", so_far), most)
    release = F.col("__ran") + F.greatest("__so_far", "__before")
    return late.select(*(F.col(f"`{c}`") for c in kept), F.when(F.col("__tokens").isNotNull(), release).alias("release"))


def _micros(ts: Column, kind: DataType) -> Column:
    """Microseconds since 1970; of the wall clock, whatever the session's zone, for a local time."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(ts)
    minutes = F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
