"""Every query with SQL text equals DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, connect

from dripline.plans import registry

BASE = "/root/testdata/sf0.001"

# Clustering chains take long; they have brute-force tests of their own. Set DRIPLINE_ALL=1 to run them here too.
LONG = {
    "cluster_compactness", "cluster_counts", "cluster_coverage", "cluster_gate", "cluster_gate_interval", "dtw_medoid", "dtw_outliers",
    "inlier_rows", "outlier_free_grid", "silhouette",
}
NAMES = sorted(n for n in registry.SQL if n not in LONG or os.environ.get("DRIPLINE_ALL"))


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], BASE)
    # A filter may match nothing on the smallest tables.
    assert line.startswith("OK") or line.endswith("empty") and not line.startswith("BAD"), line


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
