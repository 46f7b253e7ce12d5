import os

import pytest

from quillframe.llm import queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
