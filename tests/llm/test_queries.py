"""Every operator's query over the smallest tables; against its SQL where it has one."""

import pytest

from anontext.llm import toxicity
from anontext.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(df, connect(SMALL), SQL[name]) is None
    else:
        assert df.count() > 0
