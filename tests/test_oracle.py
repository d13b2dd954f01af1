from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, SF_DIR, name) == ""


def test_all_have_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() == 5


# Sorted over all tasks, with a checkpoint that keeps the split: see ``range_sorted``.
SAVED_FIRST = {"assign_lanes", "lowest_lanes", "lanes_used", "lane_islands", "circle_clusters", "circle_members"}


def test_no_job_runs_while_a_plan_is_built(spark):
    """Footers of Parquet files are read by jobs as well, so they are read before."""
    tracker = spark.sparkContext.statusTracker()
    queries = driver.queries()
    names = sorted(set(QUERIES) - SAVED_FIRST)
    real, kept = spark.read.parquet, {}

    class Reader:
        def parquet(self, path):
            if path not in kept:
                kept[path] = real(path)
            return kept[path]

    for table in Path(SF_DIR).glob("*.parquet"):
        kept[f"{SF_DIR}/{table.name}"] = real(str(table))
    kind = type(spark)
    original = kind.read
    kind.read = property(lambda self: Reader())
    try:
        for name in names:
            spark.sparkContext.setJobGroup(f"plan-{name}", name)
            queries[name](spark, SF_DIR)
            assert not tracker.getJobIdsForGroup(f"plan-{name}"), name
    finally:
        kind.read = original
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
