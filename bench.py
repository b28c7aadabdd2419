"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1) and BENCH_CPUS the cores (default 8). Each query is
forced in full through the no-op sink. The first one warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from anontext.functions.extract import extract_guess
from anontext.functions.names import name_similarity, similarity_by_pair
from anontext.operators.rulemask import mask_article
from anontext.plans import metrics
from anontext.plans.ladder import ladder_results
from anontext.session import build_session, scratch_path
from workload import fixtures as fx
from workload import queries as q

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "anontext-bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    force(q.QUERIES["summary_by_step"](spark, "/root/testdata/sf0.001"))

    # One input, stored once: articles spread over the cores, and an answer to each.
    path = scratch_path(spark, "bench")
    fx.articles(spark, SF_DIR).join(fx.rivals(spark, SF_DIR), "doc_id").repartition(CPUS).withColumn(
        "response", F.expr(fx.for_spark(fx.guess_answer("9")))).write.parquet(path)
    articles = spark.read.parquet(path)
    docs = articles.count()
    many = articles.select("doc_id", "response", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("step"))
    pairs = articles.select("doc_id", "comnam", "rival", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("step"))
    pairs = pairs.repartition(CPUS)

    def ladder():
        force(metrics.step_summary(ladder_results(q.scripted_ladder(spark, SF_DIR))))

    guesses = ("ticker_guess", "name_guess", "date_guess_raw", "industry_guess")
    timed = {
        "ladder_full": ladder,
        "extract_identification": lambda: force(extract_guess(many, "response", guesses)),
        "similarity_lcs": lambda: force(pairs.select(name_similarity(F.col("comnam"), F.col("rival")))),
        "similarity_lcs_by_pair": lambda: force(similarity_by_pair(pairs, "comnam", "rival")),
        "similarity_difflib": lambda: force(pairs.select(
            name_similarity(F.col("comnam"), F.col("rival"), method="difflib"))),
        "rule_mask": lambda: force(articles.select(mask_article(F.col("body"), F.col("comnam"), F.col("ticker")))),
        "entity_mask": lambda: force(q.QUERIES["entity_mask"](spark, SF_DIR)),
        "entity_mask_joined": lambda: force(q.QUERIES["entity_mask_joined"](spark, SF_DIR)),
        "rolling_tokens": lambda: force(q.QUERIES["rolling_tokens"](spark, SF_DIR)),
        "sentiment_both": lambda: force(q.QUERIES["sentiment_both"](spark, SF_DIR)),
        "robustness_by_model": lambda: force(q.QUERIES["robustness_by_model"](spark, SF_DIR)),
        "batch_by_name": lambda: force(q.QUERIES["batch_by_name"](spark, SF_DIR)),
        "replay_by_content": lambda: force(q.QUERIES["replay_by_content"](spark, SF_DIR)),
        **{name: lambda name=name: force(q.QUERIES[name](spark, SF_DIR)) for name in (
            "ladder_replay", "callable_responder", "stable_sample_half", "combine_runs", "entity_mask_large", "rule_mask_lettered",
            "send_plan", "csv_one_big_file", "mixed_dates")},
    }
    seconds = {}
    for name, job in timed.items():
        start = time.time()
        job()
        seconds[name] = round(time.time() - start, 3)
    rows = {"documents": docs, "answers": docs * 18, "pairs": docs * 18}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rows": rows, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": CPUS}))


if __name__ == "__main__":
    main()
