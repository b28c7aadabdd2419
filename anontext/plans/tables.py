"""Where a run's tables lie, and the log that says which writes count.

Articles and attempts are two tables of a database of their own, both bucketed by document, so that steps,
recordings kept the same way (``sources.recordings``) and results meet without an exchange of texts. Each step appends
one write, a folder of the attempts table. A write counts once the log names it: what a broken-off step has
left behind is never read. Only kept runs have a log; another session takes up their tables from it.

A run of many bytes is packed: its attempts tell their texts by what they share with the article's body, which they meet
bucket by bucket, and leave the article's columns out. A small one keeps its texts whole, so that a step is read alone.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from anontext.functions.packing import pack, unpack
from anontext.session import COMPRESSION, settings

LOG = ("entry int, kind string, token string, digest string, buckets int, columns string, "
       "turn int, step_no int, write string, rows long, identified long, waiting long, packed boolean")
PASSED, IDENTIFIED, WAITING = 0, 1, 2

# Bytes of bodies from which a run's texts are packed.
PACK_FROM = 64 << 20
# Columns of an attempt that hold texts.
TEXTS = ("text", "asked_text")


@dataclass(frozen=True)
class Commit:
    """One write of attempts: of which turn and step, and how many texts it left in which state."""
    turn: int
    step_no: int
    write: str
    rows: int
    identified: int
    waiting: int

    @property
    def passed(self) -> int:
        return self.rows - self.identified - self.waiting


def open_database(spark: SparkSession, root: str) -> str:
    """The database whose tables lie below ``root``; named after it, so any session finds the same."""
    name = f"anontext_{hashlib.md5(root.encode()).hexdigest()[:16]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{_quoted(root)}'")
    return name


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def columns_of(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


class RunTables:
    """Tables below one folder. ``root`` holds nothing else."""

    def __init__(self, spark: SparkSession, root: str, kept: bool):
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept
        self.database = open_database(spark, self.root)
        self.token, self.buckets, self.entry, self.packed = "", 0, 0, False
        self.commits: list[Commit] = []

    def _name(self, table: str) -> str:
        return f"{self.database}.{table}_{self.token}"

    @property
    def articles(self) -> DataFrame:
        return self.spark.table(self._name("articles"))

    def attempts(self, commits: list[Commit], *states: int) -> DataFrame | None:
        """Rows of these writes in these states; one scan, whatever the number of writes.

        The folder of a write tells its step, so that a filter on ``step_no`` opens no files of other steps. Rows of a packed
        run have met their articles, the body among them.
        """
        rows = self.stored_attempts(commits, *states)
        if rows is None or not self.packed:
            return rows
        whole = {c: unpack(F.col(c), F.col("body")) for c in TEXTS}
        return self.articles.join(rows.hint("merge"), "doc_id").withColumns(whole)

    def stored_attempts(self, commits: list[Commit], *states: int) -> DataFrame | None:
        """As ``attempts``, but as they lie there."""
        if not commits:
            return None
        rows = self.spark.table(self._name("attempts"))
        step = F.coalesce(*(F.when(F.col("write") == c.write, F.lit(c.step_no)) for c in commits))
        chosen = rows.where(F.col("write").isin(*(c.write for c in commits)) & F.col("identified").isin(*states))
        return chosen.withColumn("step_no", step).drop("write")

    # --- a new run ---

    def begin(self, articles: DataFrame, buckets: int, digest_of) -> None:
        """Lay the articles out by document, in one shuffle, the only one a run has, and in order, so that packed texts meet them unsorted."""
        self.token, self.buckets, self.commits = uuid.uuid4().hex[:12], buckets, []
        seen = Observation()
        watched = articles.repartition(buckets, "doc_id").observe(
            seen, F.count(F.lit(1)).alias("n"), fingerprint(articles).alias("s"), F.sum(F.octet_length("body")).alias("bytes"))
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            self._save(watched, "articles", in_order=True)
        self.packed = (seen.get["bytes"] or 0) >= PACK_FROM
        # The log names a run only after its articles are all there.
        self._log("start", digest=digest_of(int(seen.get["n"]), seen.get["s"]), columns=columns_of(self.articles.schema),
                  packed=self.packed)

    def _save(self, df: DataFrame, table: str, *folders: str, in_order: bool = False) -> None:
        writer = df.write.format("parquet").mode("append").option("compression", COMPRESSION).bucketBy(self.buckets, "doc_id")
        writer = writer.sortBy("doc_id") if in_order else writer
        (writer.partitionBy(*folders) if folders else writer).saveAsTable(self._name(table))

    # --- steps ---

    def commit(self, attempt: DataFrame, turn: int, step_no: int, expected: int | None = None) -> Commit:
        """Append one step's attempts, whose column ``identified`` is their state, and let them count if all are there.

        Those of a packed run come with the body.
        """
        if self.packed:
            attempt = attempt.withColumns({c: pack(F.col(c), F.col("body")) for c in TEXTS}).drop(
                *(c for c in self.articles.columns if c != "doc_id"))
        seen, write = Observation(), f"turn{turn}-step{step_no}-{uuid.uuid4().hex[:8]}"
        counted = attempt.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("identified") == IDENTIFIED).alias("identified"),
                                  F.count_if(F.col("identified") == WAITING).alias("waiting"))
        with settings(self.spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
                      spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__maxConcurrentOutputFileWriters="8"):
            self._save(counted.withColumn("write", F.lit(write)), "attempts", "write", "identified")
        done = Commit(turn, step_no, write, *(int(seen.get[c]) for c in ("rows", "identified", "waiting")))
        if expected is not None and done.rows != expected:
            raise RuntimeError(f"step {step_no} gave {done.rows} rows for {expected} texts")
        if self.kept:
            self._log("step", turn=turn, step_no=step_no, write=write, rows=done.rows, identified=done.identified, waiting=done.waiting,
                      columns=columns_of(self.spark.table(self._name("attempts")).schema))
        self.commits.append(done)
        return done

    # --- the log ---

    def _log(self, kind: str, **values) -> None:
        if not self.kept:
            return
        self.entry += 1
        known = dict(values, kind=kind, token=self.token, buckets=self.buckets, entry=self.entry)
        fields = [f.split(" ") for f in LOG.split(", ")]
        row = self.spark.range(1).select(*(F.lit(known.get(n)).cast(t).alias(n) for n, t in fields if n != "entry"))
        row.coalesce(1).write.parquet(f"{self.root}/log/entry={self.entry}")

    def entries(self) -> list:
        """All entries, oldest first; an entry that was never finished has no rows."""
        try:
            read = self.spark.read.schema(LOG).option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
            return sorted(read.collect(), key=lambda r: r["entry"])
        except AnalysisException:
            return []

    def take_up(self, digest_now) -> bool:
        """Go on with the newest run in the log; False when there is none. Articles must be the same."""
        entries = self.entries()
        self.entry = max((e["entry"] for e in entries), default=0)
        start = next((e for e in reversed(entries) if e["kind"] == "start"), None)
        if start is None:
            return False
        if start["digest"] != digest_now():
            raise ValueError("the run to resume had another configuration or other articles")
        self.token, self.buckets, self.packed = start["token"], start["buckets"], bool(start["packed"])
        steps = [e for e in entries if e["kind"] == "step" and e["token"] == self.token]
        self._attach("articles", start["columns"], in_order=self.packed)
        if steps:
            self._attach("attempts", steps[0]["columns"], "write", "identified")
        self.commits = [Commit(e["turn"], e["step_no"], e["write"], e["rows"], e["identified"], e["waiting"]) for e in steps]
        return True

    def skip_entries(self) -> None:
        """Number new entries after those of earlier runs of the same name."""
        self.entry = max((e["entry"] for e in self.entries()), default=0)

    def _attach(self, table: str, columns: str, *folders: str, in_order: bool = False) -> None:
        """A table that another session has written."""
        parts = f" PARTITIONED BY ({', '.join(folders)})" if folders else ""
        order = " SORTED BY (doc_id)" if in_order else ""
        path = f"{self.root}/{table}_{self.token}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet{parts} "
                       f"CLUSTERED BY (doc_id){order} INTO {self.buckets} BUCKETS LOCATION '{_quoted(path)}'")
        if folders:
            self.spark.sql(f"MSCK REPAIR TABLE {self._name(table)}")

    def discard(self) -> None:
        """Drop the tables with all their files."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


def buckets_for(articles: DataFrame, rows_each: int = 2_000) -> int:
    """As many buckets as a shuffle has partitions, but no more than the rows (or the cores) can use."""
    spark = articles.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-articles.count() // rows_each))
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))


def fingerprint(articles: DataFrame):
    """Sum of row hashes, whatever the order; maps cannot be hashed and are left out."""
    hashed = [F.col(f"`{f.name}`") for f in articles.schema if "map<" not in f.dataType.simpleString()]
    return F.sum(F.xxhash64(*hashed).cast("decimal(38,0)"))
