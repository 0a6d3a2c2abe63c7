"""Physical plans: what reaches the scan, and how joins are done."""

import os
import re

import pytest

from meshframe import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plan(spark, name):
    return queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_extent_and_features_reach_the_scan(spark):
    p = plan(spark, "extent_filter")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p) and "LessThanOrEqual(ts" in p
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>", p)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_tax:double>" in plan(spark, "feature_projection")


@pytest.mark.parametrize("name", ["match_two_sources", "match_three_sources", "match_locus", "match_l2", "match_optional_source", "match_pairwise", "match_anchor", "match_virtual_dim", "nearest_index"])
def test_proximity_is_an_equi_join(spark, name):
    p = plan(spark, name)
    assert "NestedLoop" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["t_combination", "t_quantile_uniform", "metrics_by_group", "graph_pipeline", "recurrence_ema", "cyclic_time", "window_valid_2d", "region_mask"])
def test_expressions_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Arrow|Pandas", plan(spark, name))


@pytest.mark.parametrize("name,most", [("archive_mean", 3), ("metrics_by_group", 1), ("t_combination", 0), ("graph_pipeline", 0), ("batches", 3)])
def test_exchanges(spark, name, most):
    assert len(re.findall(r"\bExchange (?:hash|range|Single)", plan(spark, name))) <= most


def scans(frame):
    """Paths that the plan of a frame reads, one for each scan."""
    return re.findall(r"Location: \w+\(\d+ paths?\)\[([^\]]*)\]", frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


@pytest.mark.parametrize("name", ["flagship", "window_gather_2d", "match_three_sources", "match_pairwise", "gridded_graph"])
def test_sources_are_read_once(spark, name, monkeypatch):
    """Plans read the tables written from a source, never the source again; each source wrote its cells once."""
    from meshframe.sources import grid

    wrote = []
    monkeypatch.setattr(grid, "stash", lambda df, label, real=grid.stash: wrote.append(label) or real(df, label))
    frame = queries.QUERIES[name](spark, FOLDER)
    assert not [s for s in scans(frame) if FOLDER in s and "lineitem" not in s]
    assert wrote.count("cells") <= (3 if "three" in name or "pairwise" in name else 2)


def test_windows_of_one_dim_are_cut_in_stretches(spark):
    assert "SinglePartition" not in plan(spark, "window_valid_fraction")


def test_long_axes_are_numbered_in_stretches(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meshframe.sources import grid

    monkeypatch.setattr(grid, "SHORT_AXIS", 10)
    df = spark.range(3000).select((F.col("id") * F.col("id") % 7919).cast("double").alias("t"), F.lit(1).alias("v"))
    got = grid.Source("s", df, ["t"]).axis("t").orderBy("idx").collect()
    want = sorted({float(i * i % 7919) for i in range(3000)})
    assert [(r.t, r.idx) for r in got] == [(t, i) for i, t in enumerate(want)]
