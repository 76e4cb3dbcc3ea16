import hashlib
import math
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from netloom.config import DdosConfig, WindowConfig
from netloom.ml import train as training
from netloom.ml.score import flow_scorer
from netloom.ml.train import FlowModel, evaluate, fit, gradient_boosting, logistic_regression, random_forest, train_and_report
from netloom.operators import detectors as dt
from netloom.operators.datasets import class_distribution, feature_variance, temporal_chunks, union_parts
from netloom.operators.flows import build_flows
from netloom.operators.ordering import exact_quantiles, order_statistics, with_position
from netloom.operators.scaling import class_weights, drop_unusable, fit_robust, fit_standard
from netloom.operators.splits import (
    require_both_classes, split_by_file, split_holdout, split_ordered, split_per_class, split_stratified,
)
from netloom.schema import FEATURES_13
from netloom.sources.driver_tables import table
from netloom.operators.metrics import binary_metrics, class_report, confusion, report_averages
from tests.helpers import frame, packet


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("f"), "id").alias("flow_id"), (F.col("id") * 1000).alias("ts_us"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 20 == 0, "DoS attacks-SlowHTTPTest").when(F.col("id") % 4 == 0, "DoS").otherwise("Benign").alias("original_label"),
        ((F.col("id") % 4 == 0).cast("double") * 10 + F.col("id") % 7).alias("x"), F.lit(3.0).alias("flat"),
    )


def sizes(df, *by):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


def test_splits(spark, rows):
    assert sizes(split_ordered(rows, ["ts_us", "row_idx"]), "split") == {("train",): 140, ("val",): 30, ("test",): 30}
    ordered = split_ordered(rows, ["ts_us", "row_idx"])
    assert ordered.filter("split = 'train'").agg(F.max("row_idx")).first()[0] == 139
    per = sizes(split_per_class(rows, "label", ["row_idx"]), "label", "split")
    assert (per[0, "train"], per[0, "val"], per[1, "train"], per[1, "test"]) == (90, 30, 30, 10)
    strat = sizes(split_stratified(rows, "label", "flow_id"), "label", "split")
    assert strat[1, "train"] == 35 and strat[0, "train"] == 105
    held = split_holdout(rows, "slowhttptest")
    got = sizes(held, "split")
    assert got["test",] == 10 + 30 and sum(got.values()) == 200 and got["val",] == 24
    require_both_classes(held, needed=("train", "val", "test"))
    with pytest.raises(ValueError):
        require_both_classes(rows.withColumn("split", F.lit("train")))


def test_split_by_file(spark, rows):
    files = rows.withColumn("file", F.when(F.col("row_idx") < 50, "a").when(F.col("row_idx") < 101, "b").when(F.col("row_idx") < 120, "c"))
    got = split_by_file(files, "file", {"a": "train"}, ["row_idx"], ["b"])
    assert sizes(got, "file", "split") == {("a", "train"): 50, ("b", "train"): 40, ("b", "val"): 11}
    assert got.filter("split = 'val'").agg(F.min("row_idx")).first()[0] == 90
    assert sizes(split_by_file(files, "file", {"c": "val"}, ["row_idx"]), "split") == {("val",): 19}
    assert split_by_file(files, "file", {}, ["row_idx"]).count() == 0


def test_positions_and_quantiles(spark, rows):
    placed = with_position(rows, [F.col("x").desc(), F.col("row_idx")]).collect()
    want = sorted(((r.x, r.row_idx) for r in placed), key=lambda v: (-v[0], v[1]))
    assert [(r.x, r.row_idx) for r in sorted(placed, key=lambda r: r.position)] == want
    xs = sorted(r.x for r in placed)
    stats = order_statistics(rows, "x", {"p50": 0.5, "p95": 0.95}).first()
    assert (stats.p50, stats.p95) == (xs[100], xs[190])
    got = {r.q: r.value for r in exact_quantiles(rows, ["x"], [0.25, 0.5, 0.75]).collect()}
    exact = rows.selectExpr("percentile(x, array(0.25, 0.5, 0.75)) p").first().p
    assert [got[q] for q in (0.25, 0.5, 0.75)] == exact


def test_scaling_and_weights(spark, rows):
    scaler = fit_standard(rows, ["x", "flat"])
    z = scaler.transform(rows).agg(F.avg("x"), F.stddev_pop("x"), F.max("flat")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1) and z[2] == 0
    assert fit_robust(rows, ["flat"]).scale == [1.0]
    assert {r.label: r.weight for r in class_weights(rows).collect()} == {0: 200 / (2 * 150), 1: 2.0}
    gaps = union_parts(rows, rows.withColumn("x", F.lit(None).cast("double")), rows.withColumn("label", F.lit(-1)))
    assert drop_unusable(gaps, ["x"]).count() == 200 and drop_unusable(gaps, ["x"], "impute").count() == 400
    assert {r.feature: r.constant for r in feature_variance(rows, ["x", "flat"]).collect()} == {"x": False, "flat": True}
    chunks = temporal_chunks(rows.filter("row_idx < 195"), ["row_idx"])
    assert sizes(chunks, "chunk") == {(i,): 19 for i in range(10)}
    assert class_distribution(chunks, by="chunk").count() == 20


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4, "label int, prediction int")
    cm = confusion(pairs)
    m = binary_metrics(cm).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4) and m.accuracy == 0.7 and m.fpr == 0.2
    report = class_report(cm)
    assert {r["class"]: r.support for r in report.collect()} == {0: 5, 1: 5}
    avg = {r.average: r for r in report_averages(report).collect()}
    assert avg["macro"].recall == pytest.approx(0.7) and avg["weighted"].support == 10
    never = binary_metrics(confusion(pairs.withColumn("prediction", F.lit(0)))).first()
    assert (never.precision, never.recall, never.f1) == (0, 0, 0)


def test_training_round_trip(spark, rows, tmp_path):
    split = split_per_class(rows, "label", ["row_idx"])
    kinds = {
        "RandomForest": random_forest(5, 5, balanced=True),
        "LogisticRegression": logistic_regression(120.0, 50),
        "GradientBoosting": gradient_boosting(3),
    }
    report = train_and_report(split, ["x", "flat"], kinds, str(tmp_path / "m")).collect()
    assert {r.model for r in report} == set(kinds) and all(r.accuracy > 0.9 for r in report)
    loaded = FlowModel.load(spark, str(tmp_path / "m" / "RandomForest"))
    scored = loaded.predict(rows)
    assert {r.predicted_class for r in scored.select("predicted_class").distinct().collect()} == {"BENIGN", "DDOS"}
    assert scored.filter("confidence < 0.5 OR x IS NULL").count() == 0
    assert evaluate(loaded, split.filter("split = 'test'")).first().accuracy > 0.9
    with pytest.raises(Exception):
        FlowModel.load(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        loaded.predict(rows.drop("x"))


class Watched(RandomForestClassifier):
    """Notes the columns and the partitions' sizes of the rows it is given."""

    def _fit(self, dataset):
        sizes = [r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()]
        type(self).met = (set(dataset.columns), sorted(sizes))
        return super()._fit(dataset)


def test_many_training_rows_are_dealt_evenly(spark, rows, monkeypatch):
    monkeypatch.setattr(training, "DEAL_FROM", 200, raising=False)
    monkeypatch.setattr(training, "ROWS", 10, raising=False)
    forest = Watched(labelCol="label", featuresCol="features", weightCol="weight", numTrees=5, maxDepth=5, seed=42)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size
    before = kept()

    def made(part):
        model = fit(part, ["x", "flat"], forest)
        right = model.predict(part).filter("prediction = label").count()
        return *Watched.met, right

    cols, sizes, right = made(rows.coalesce(1))
    assert sum(sizes) == 200 and len(sizes) >= 20 and sizes[-1] <= 10 and right == 200
    assert {"label", "weight", "_z_x", "_z_flat"} <= cols and not {"flow_id", "row_idx"} & cols
    _, few, right = made(rows.filter("row_idx > 0").coalesce(1))
    assert few == [199] and right == 199
    # A caller's own weights are used, whatever the case of their name; a failed training keeps no rows.
    cols, _, _ = made(rows.selectExpr("*", "1.0D AS weight"))
    assert "weight" in cols
    with pytest.raises(Exception):
        fit(rows.selectExpr("*", "IF(row_idx = 7, NULL, x) AS gap"), ["gap"], forest)
    assert kept() == before


def test_flood_with_model(spark):
    packets = [packet(i, 100 + i / 40, 60, f"10.1.0.{i % 30}:{2000 + i % 30}", "10.0.0.80:80") for i in range(200)]
    flows = build_flows(frame(spark, packets), WindowConfig(2, 1))
    cfg = DdosConfig(sources_to_dst=20)
    assert dt.detect_ddos(flows, cfg).count() == 0  # two signals only
    train = spark.range(40).select(
        *[(F.col("id") % 2 * 1.0 if c == "is_unidirectional" else F.lit(0.0)).alias(c) for c in FEATURES_13],
        (F.col("id") % 2).cast("int").alias("label"),
    )
    model = fit(train, FEATURES_13, random_forest(3, 3))
    made = dt.detect_ddos(flows, cfg, flow_scorer(model)).collect()
    assert len(made) == flows.count()
    assert all(r.result.evidence["reason"].endswith("and ML model predicted DDoS") for r in made)


def test_labels_table_is_readable(spark):
    assert table(spark, "/root/testdata/sf0.001", "labels").count() > 0


def test_shuffled_splits_order_only_the_rows_beside_a_cut(spark, monkeypatch):
    ordered = []

    def counted(rows, order, name):
        ordered.append(rows.count())
        return with_position(rows, order, name)

    from netloom.operators import splits

    monkeypatch.setattr(splits, "with_position", counted)
    monkeypatch.setattr(splits, "_DIGITS", 2)
    rows = spark.range(3000).selectExpr(
        "IF(id < 20, NULL, IF(id < 40, 'twice', concat('k', id))) AS flow_id", "CAST(id % 3 = 0 AS INT) AS label",
        "IF(id % 10 = 7, 'DoS slowhttptest', 'x') AS original_label",
    )
    held = split_holdout(rows, "slowhttptest").collect()
    strat = split_stratified(rows, "label", "flow_id").collect()
    assert max(ordered) < 300

    def order(r, seed):
        return (r["flow_id"] is not None, hashlib.md5(f"{r['flow_id']}:{seed}".encode()).hexdigest() if r["flow_id"] else "")

    for label in (0, 1):
        own = sorted((r for r in strat if r["label"] == label), key=lambda r: order(r, 42))
        n = len(own)
        first, second = int(n * 0.7), int(n * 0.7) + int(n * 0.15)
        want = ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)
        assert sorted(r["split"] for r in own) == sorted(want)
        alone = [(r["split"], w) for r, w in zip(own, want) if r["flow_id"] not in (None, "twice")]
        assert all(a == b for a, b in alone)
    benign = sum(r["label"] == 0 and r["original_label"] == "x" for r in held)
    slow = sum(r["original_label"] != "x" for r in held)
    test = sum(r["split"] == "test" for r in held)
    assert len(held) == 3000 and test == slow + math.ceil(benign * 0.2)
    assert sum(r["split"] == "val" for r in held) == math.ceil((3000 - test) * 0.15)
