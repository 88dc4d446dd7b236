import pytest
from oracle import compare

from veridelta.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.01") == ""
