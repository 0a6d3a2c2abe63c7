import os

import pytest

from meshframe.llm.queries import ORACLE_SQL, QUERIES
from queries_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLE_SQL[name]) > 0
