"""Every query of the comparison, text and report operators against its oracle, on the smallest tables."""

import functools

import pytest
from oracle import DATA, expected, rows

from tradeloom.plans import compare_queries, flow_queries, report_queries, result_queries, text_queries

ALL = {n: (q, m.ORACLES[n]) for m in (compare_queries, text_queries, report_queries, flow_queries, result_queries) for n, q in m.QUERIES.items()}


# What several of these queries begin with is written once here, not once for each.
result_queries._written = functools.cache(result_queries._written)


@pytest.mark.parametrize("name", ALL)
def test_oracle(spark, name):
    query, sql = ALL[name]
    got = query(spark, f"{DATA}/sf0.001").toPandas()
    assert len(got) > 0
    assert rows(got) == rows(expected(sql, "sf0.001"))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
