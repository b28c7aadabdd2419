"""Articles made from tables whose keys repeat or are null: what the SQL gives, with texts dealt out once."""

import duckdb
import pytest

from anontext.session import settings
from tests.compare import difference
from workload import fixtures as fx


@pytest.fixture
def made(spark, folder):
    docs = [(i, f"text {i}") for i in range(30)] + [(3, "again"), (3, "text 3"), (None, "no key"), (90, "no order")]
    parts = [(i, f"red rod{i}", "STEEL") for i in range(5)]
    orders = [(i, f"2020-01-{i % 28 + 1:02d}") for i in range(1, 30)] + [(None, "2021-01-01")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("part", parts, "p_partkey long, p_name string, p_type string"),
                               ("orders", orders, "o_orderkey long, d string")):
        df = spark.createDataFrame(rows, schema)
        df = df.selectExpr("o_orderkey", "cast(d AS timestamp_ntz) AS o_orderdate") if name == "orders" else df
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_articles_as_the_sql_has_them(spark, made):
    con = duckdb.connect()
    for name in ("documents", "part", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{made}/{name}.parquet/*.parquet'")
    with settings(spark, spark__sql__adaptive__enabled="false"):
        articles = fx.articles(spark, made)
    assert articles.columns == ["doc_id", "comnam", "ticker", "industry", "pub_date", "body"]
    with settings(spark, spark__sql__adaptive__enabled="false"):  # small joins there start before the count of parts has ended
        assert difference(articles, con, fx.for_duckdb(fx.ARTICLES)) is None


def _exchanges(node):
    """The columns that each exchange of a plan moves."""
    if node.nodeName() == "Exchange":
        yield [node.output().apply(i).name() for i in range(node.output().size())]
    for i in range(node.children().size()):
        yield from _exchanges(node.children().apply(i))


def test_texts_are_dealt_out_once_however_large_the_other_tables(spark, made):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = fx.articles(spark, made).repartition(n, "doc_id")._jdf.queryExecution().executedPlan().initialPlan()
    moved = list(_exchanges(plan))
    assert len(moved) >= 4 and sum(bool({"text", "body"} & set(columns)) for columns in moved) == 1
