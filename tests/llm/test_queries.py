"""Queries beside their SQL over whole tables, and the contracts' plain columns."""

import pytest
from checks.compare_sql import connect, normal
from lexigauge.llm.queries import llm_queries, llm_sql


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    df = llm_queries()[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(llm_sql()[name])
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == want and want[1]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
