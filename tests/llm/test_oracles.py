import pytest

from tests.conftest import same_as_sql
from worktrace.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], ORACLE_SQL[name])
