"""Mergeable sketches against exact values, and forests against their node tables."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.ml.nodes import descend, forest_nodes, predict_by_nodes
from netloom.ml.train import fit, logistic_regression, random_forest
from netloom.operators import sketches as sk
from netloom.operators.flows import window_packets
from netloom.operators.prepare import flow_eligible
from tests.helpers import frame, packet


@pytest.mark.parametrize("slide", [1, 0.75, 4])
def test_sliding_distinct_of_few_values_is_exact(spark, slide):
    cfg, rng = WindowConfig(4, slide), random.Random(1)
    t, rows = 100.0, []
    for i in range(400):
        t += rng.choice([0, 0.25, 0.5, 0.5, 30 if i % 97 == 0 else 1])
        rows.append(packet(i, t, src=f"10.0.0.{rng.randint(1, 9)}:{rng.randint(1, 5)}", dst=f"10.0.1.{rng.randint(1, 4)}:80"))
    packets = frame(spark, rows)
    got = sk.sliding_distinct(packets, cfg, {"ports": "src_port", "hosts": "dst_ip"}, by=["src_ip"]).collect()
    copies = window_packets(flow_eligible(packets), cfg)
    exact = copies.groupBy("stream_id", "window_end_us", "src_ip").agg(
        F.count("*").alias("packets"), F.count_distinct("src_port").alias("ports"), F.count_distinct("dst_ip").alias("hosts")
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact.collect())) and len(got) > 100


def test_sliding_distinct_of_many_values_is_close(spark):
    cfg = WindowConfig(10, 1)
    packets = spark.range(200_000).select(
        F.lit("s").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") * 100 + 1_000_000).alias("ts_us"),
        (F.hash("id") % 50_000).alias("value"),
    )
    rows = sk.sliding_distinct(packets, cfg, {"values": "value"}).collect()
    exact = window_packets_of(packets, cfg)
    assert len(rows) == 19
    for r in rows:
        assert abs(r["values"] - exact[r.window_end_us]) <= 0.05 * exact[r.window_end_us]


def window_packets_of(packets, cfg):
    ends = [1_000_000 + k * cfg.slide_us for k in range(1, 20)]
    made = packets.select(*[
        F.count_distinct(F.when(F.col("ts_us").between(e - cfg.window_us, e), F.col("value"))).alias(str(e)) for e in ends
    ]).first()
    return {e: made[str(e)] for e in ends}


def test_merged_quantiles_stay_within_their_rank_error(spark):
    values = spark.range(300_000).select(
        (F.col("id") * 1_000_000).alias("at_us"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.hash("id") % 1_000_000).alias("v")
    )
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    sketches = sk.period_sketches(values, "v", "at_us")
    assert sketches.count() == 84
    found = sk.merged_quantiles(sketches, shares).first()
    assert found.n == 270_000
    for name, p in shares.items():
        rank = values.agg(F.avg((F.col("v") <= found[name]).cast("double"))).first()[0]
        assert abs(rank - p) <= 0.02, name
    # A period's own sketch answers for that period.
    own = sk.merged_quantiles(sketches, {"p50": 0.5}, by=["period"])
    assert own.count() == 84 and own.agg(F.sum("n")).first()[0] == 270_000


@pytest.fixture(scope="module")
def labelled(spark):
    x = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 37.0
    rows = spark.range(1200).select("id", x(1).alias("a"), x(2).alias("b"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0).alias("c"))
    kind = F.when(F.col("a") > 15, 2).when((F.col("b") > 12) & (F.col("c") == 1), 1).otherwise(0)
    return rows.withColumn("label", F.when(F.col("id") % 11 == 0, F.col("id") % 3).otherwise(kind))


@pytest.mark.parametrize("trees,depth", [(7, 4), (10, 25), (2, 0)])
def test_descent_equals_the_forest(spark, labelled, trees, depth):
    model = fit(labelled.filter("id < 800"), ["a", "b", "c"], random_forest(trees, depth))
    nodes = forest_nodes(model, spark)
    want = {r.id: (r.prediction, r.confidence) for r in model.predict(labelled).collect()}
    got = {r.id: (r.prediction, r.confidence) for r in predict_by_nodes(labelled, model, nodes, ["id"]).collect()}
    assert got == want
    leaves = descend(labelled, model, nodes, ["id"]).join(nodes, ["tree", "node"])
    assert leaves.filter("left <> node OR feature IS NOT NULL").isEmpty() and leaves.count() == 1200 * trees


def test_descent_joins_few_levels_between_writes(spark, labelled):
    # The joins of a stage are one generated method, and the JVM interprets one that is too large.
    model = fit(labelled, ["a", "b", "c"], random_forest(4, 9))
    depth = max(t.depth for t in model.pipeline.stages[-1].trees)
    plan = descend(labelled, model, forest_nodes(model, spark), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert depth > 6 and 1 <= plan.count("Join Inner") <= 5


def test_only_forests_have_node_tables(spark, labelled):
    binary = labelled.withColumn("label", (F.col("label") > 0).cast("int"))
    with pytest.raises(ValueError):
        forest_nodes(fit(binary, ["a"], logistic_regression(1200.0, 20, balanced=False)), spark)
