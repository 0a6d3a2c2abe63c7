"""Operators that must stay in the JVM have no Python in any of their plans."""

import os
import re

import pytest

from meshframe.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", ["op2_pivotal", "op6_rendezvous", "op7_line_first", "op8_blocked_bloom"])
def test_native(spark, name):
    p = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", p) and "NestedLoop" not in p and "Cartesian" not in p
