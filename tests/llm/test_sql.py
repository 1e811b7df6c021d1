"""Every corpus query with a SQL statement gives the rows DuckDB gives on the whole tables."""

import pytest

from checks.compare import differences
from tallyback.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(n for n in SQL if SQL[n]))
def test_matches_sql(name, spark, folder, duck):
    assert differences(QUERIES[name](spark, folder), duck, SQL[name]) == []


def test_names():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == 14
