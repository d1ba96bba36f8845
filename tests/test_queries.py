"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
from compare import plain  # noqa: E402

CORE = {n: s for p in entry._PLANS if ".llm." not in p.__name__ for n, s in p.SQL.items()}
HEAVY = {"rrf_fusion", "recency_prior", "rerank_blend", "hybrid_search"}  # parts of search_explain


@pytest.mark.parametrize("name", sorted(set(CORE) - HEAVY))
def test_equals_sql(spark, con, name):
    a, b = plain(entry.queries()[name](spark, SF).toPandas()), plain(con.execute(CORE[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_mass_sums_to_one(spark):
    got = entry.queries()["ppr"](spark, SF).groupBy("query").sum("mass").collect()
    assert all(abs(r[1] - 1) < 1e-6 for r in got)
