import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs, over several partitions; with clashing extra columns."""
    def build(texts, parts=3, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        if extra:
            from pyspark.sql import functions as F
            for name in ("_bytes", "_fp", "_d", "_h", "_mark", "_part", "shard", "length", "_id", "count", "k0"):
                df = df.withColumn(name, F.lit(name))
        return df
    return build


@pytest.fixture(scope="session")
def words():
    """Random words that rarely repeat, from a seed."""
    import random

    def draw(n, seed):
        r = random.Random(seed)
        return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return draw
