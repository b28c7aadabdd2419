"""Recorded answers, kept the way runs keep their texts.

A recording of answers is joined to a run's texts at every step. Bucketed by document into as many buckets as the
run has, and divided by step and target, it meets them without an exchange on either side.

Long recordings of several steps are packed: a document's answers are told by what they share with its answer at the first
step, which is stored once and meets the others bucket by bucket when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anontext.functions.packing import pack, unpack
from anontext.plans.tables import PACK_FROM, open_database
from anontext.session import COMPRESSION, settings


def store_recordings(answers: DataFrame, root: str, name: str, buckets: int | None = None, laid_out: bool = False) -> DataFrame:
    """Write answers below ``root`` as table ``name`` and read them back; ``root`` holds such tables only.

    ``buckets`` is the number of partitions of the run, by default ``spark.sql.shuffle.partitions``. ``laid_out`` says that
    answers come from the attempts of a run of as many partitions: each task then has one bucket, and no answer is shuffled.
    Any other answers are stored rightly too, but in a file per task and bucket.
    """
    spark = answers.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    database = open_database(spark, root.rstrip("/"))
    if first := _first_answers(answers):
        bases, answers = first
        bases = _save(bases, f"{database}.{name}_first", buckets, laid_out, in_order=True)
        # Answers stream by the one base of their document, whatever their number.
        met = answers.withColumnRenamed("response", "__response").join(bases.hint("shuffle_hash"), "doc_id", "left")
        packed = met.select(*(pack(F.col("__response"), F.col("__first")).alias(c) if c == "response" else f"`{c}`" for c in answers.columns))
        kept = _save(packed, f"{database}.{name}", buckets, laid_out)
        met = kept.join(bases.hint("merge"), "doc_id", "left")
        return met.withColumn("response", unpack(F.col("response"), F.col("__first"))).drop("__first")
    return _save(answers, f"{database}.{name}", buckets, laid_out)


def _first_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Each document's answer at the first step, and all answers; None unless those of the first step alone are many bytes of several steps."""
    if not {("doc_id", "bigint"), ("step_no", "int"), ("response", "string")} <= set(answers.dtypes):
        return None
    ends = answers.agg(F.min("step_no").alias("first"), F.max("step_no").alias("last")).first()
    if ends["first"] == ends["last"]:
        return None
    firsts = answers.where(F.col("step_no") == ends["first"])
    if (firsts.agg(F.sum(F.octet_length("response"))).first()[0] or 0) < PACK_FROM:
        return None
    return firsts.groupBy("doc_id").agg(F.max("response").alias("__first")), answers


def _save(answers: DataFrame, table: str, buckets: int, laid_out: bool, in_order: bool = False) -> DataFrame:
    spark = answers.sparkSession
    folders = [c for c in ("step_no", "target") if c in answers.columns]
    dealt = answers if laid_out else answers.repartition(buckets, "doc_id")
    writer = dealt.write.format("parquet").mode("overwrite").option("compression", COMPRESSION).bucketBy(buckets, "doc_id")
    writer = writer.sortBy("doc_id") if in_order else writer
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters="64", spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
                  spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        (writer.partitionBy(*folders) if folders else writer).saveAsTable(table)
    return spark.table(table)
