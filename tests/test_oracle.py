"""Every registered query of the dialect against its SQL."""

import os

import pytest

from quillframe import workload
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query_equals_sql(spark, name):
    same(spark, SF, workload.queries()[name], workload.oracle_sql()[name])
