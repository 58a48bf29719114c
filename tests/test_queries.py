import pytest

import __spark_entry__ as entry
from compare import connect, differences
from kinmesh.queries import registered
from kinmesh.queries.truths import SMALL

QUERIES, ORACLES = registered()
#: One of each family; the whole list is compared by the driver.
SOME = ["observations_long", "column_profile", "rule2_registry", "candidate_pairs", "blocking_rule_summary", "mct_scores", "cluster_assignments", "pair_metrics", "fs_weights", "dense_window", "score_bin_rates", "timestamp_formats", "nearest_rank_percentiles"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["person_partitions", "recall_gaps", "fs_weights_development"])
def test_partitions_same_as_small_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SMALL[name]) == ""


def test_registered():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 80


def test_pairs_plan_has_no_cross_join(spark, sf_dir):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_token_components_of_all_orders(spark, sf_dir, con):
    orders = con.sql("select o_orderkey, o_custkey from orders").fetchall()
    least = {}
    for key, customer in orders:  # a device token lies within its shared token
        least[customer // 2] = min(key, least.get(customer // 2, key))
    got = {r.node: r.component for r in QUERIES["token_components"](spark, sf_dir).collect()}
    assert got == {key: least[customer // 2] for key, customer in orders}
