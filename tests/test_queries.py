import pytest

import __spark_entry__ as entry
from netloom.plans import queries as registered
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = [
    "packet_filter", "canonical_key", "traffic_bins", "late_drop", "grid_segments", "flow_build", "features16",
    "detect_ddos", "detect_c2", "detect_dns", "detect_tls", "detect_recon", "detect_exfil", "fused", "alert_dedup",
    "first_hosts", "latency_percentiles", "dataset_validation", "split_holdout", "scale_robust", "entropy",
    "confusion_metrics", "manifest_guard",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registered.queries()) == set(registered.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_predictions_are_those_of_the_labels(spark):
    # The smallest tables have no row of the flooded host.
    rows = entry.queries()["train_and_predict"](spark, "/root/testdata/sf0.01").collect()
    assert {r.label for r in rows} == {0, 1}
    # Not all are right (README); a model that mostly names the wrong class fails.
    assert sum(r.prediction == r.label for r in rows) > len(rows) / 2
    assert all(r.predicted_class == ("DDOS" if r.prediction == 1 else "BENIGN") and 0.5 <= r.confidence <= 1 for r in rows)


def test_flow_plan_has_one_shuffle(spark):
    """Flows come from one shuffle of the packets, with every aggregate hash-based."""
    from netloom.operators.flows import build_flows
    from netloom.plans.queries import WINDOW
    from netloom.sources.driver_tables import ingested_packets

    flows = build_flows(ingested_packets(spark, SF), WINDOW)
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
