"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import check
from __spark_entry__ import entry
from shoebox.plans.oracle import ORACLES
from shoebox.plans.registry import QUERIES

# Minutes of Spark jobs each; their parts are tested elsewhere and check.py runs them all.
SLOW = {
    "density_clusters",
    "leader_distances",
    "similar_groups",
    "similar_summary",
    "recommended_keepers",
    "group_member_arrays",
    "similar_leaders",
    "stream_keepers",
}


def test_registry_is_complete():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns[:2] == ["owner", "trip_id"]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_equals_sql(spark, sf_dir, name):
    line, good = check.compare(spark, sf_dir, name, QUERIES[name], ORACLES[name])
    assert good, line
