import os

import duckdb
import numpy as np
import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.operators import experiments as ex
from tapeloom.operators import models as ml
from tapeloom.operators import quality as qa
from tapeloom.plans.shared import shared_folder
from tapeloom.sinks import tables as sink

SMALL = "/root/testdata/sf0.001"
IDS = {
    "S": range(1, 16), "K": range(1, 8), "F": range(1, 24), "C": range(1, 14), "L": range(1, 14),
    "B": range(1, 9), "M": range(1, 10), "E": range(1, 16), "R": range(1, 22), "P": range(1, 20),
    "X": range(1, 7), "Q": range(1, 8), "G": range(1, 5),
}
METRICS = "experiment_id string, seed int, metric string, value double"


def test_every_inventory_id_has_a_query():
    # Text operators and their pipeline are no part of this inventory.
    found = {name.split("_")[0] for name in entry.queries() if name[0].isupper()}
    assert found == {f"{g}{i}" for g, numbers in IDS.items() for i in numbers}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    [
        "C7_dynamic_universe", "L2_quantile_labels", "E6_reference_mid", "B3_normalize_tail",
        "M2_merge_modalities", "R1_rank_ic_average_ties", "P11_long_short", "Q6_table_fingerprint",
    ],
)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


class NamedFolder:
    """A session of a cluster, with or without a configured shared folder."""

    def __init__(self, configured):
        self.configured = configured
        self.conf = self.sparkContext = self
        self.master = "spark://somewhere"

    def get(self, key, default=None):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert shared_folder(NamedFolder("hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(NamedFolder(None))


def test_gates(spark):
    metrics = spark.createDataFrame(
        [("e", 0, "ic", 0.02), ("e", 1, "ic", 0.04), ("e", 0, "dd", 0.5)], METRICS
    )
    evidence = ex.gate_evidence(metrics, [("ic", "gte", 0.03), ("dd", "lt", 0.6), ("no", "gt", 0.0)])
    got = {r.metric: (r.mean_value, r.missing_seeds, r.passed) for r in evidence.collect()}
    assert got == {"ic": (pytest.approx(0.03), 0, True), "dd": (0.5, 1, True), "no": (None, 2, False)}
    assert ex.gate_decision(evidence, "screening").first().decision == "DISCARD"
    passed = evidence.where("metric <> 'no'")
    assert ex.gate_decision(passed, "screening").first().decision == "EXTEND"
    assert ex.gate_decision(passed, "confirmation").first().decision == "KEEP"


def test_comparison_pairs_common_seeds(spark):
    metrics = spark.createDataFrame(
        [("b", 0, "x", 1.0), ("b", 1, "x", 3.0), ("c", 1, "x", 4.0), ("c", 2, "x", 8.0)], METRICS
    )
    got = {r.experiment_id: r for r in ex.compare_to_baseline(metrics, "b", ("x",)).collect()}
    c = got["c"]
    assert (c["count"], c.paired_seed_count, c.paired_delta_mean, c.paired_delta_std) == (2, 1, 1.0, None)
    assert (c.delta_vs_baseline_mean, c.improvement_vs_baseline_mean) == (4.0, -4.0)
    worst = ex.walk_forward_summary(metrics, ("x",)).first()
    assert (worst.worst_window_experiment_id, worst.worst_window_value) == ("c", 6.0)


def test_quality_checks(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", float("nan"))], "k string, v double")
    assert rows(qa.duplicate_keys(frame, ["k"]), "k", "rows") == [("a", 2)]
    bad = qa.violations(frame, {"positive": F.col("v") > 1, "not nan": ~F.isnan("v")})
    assert rows(bad, "k", "reason") == [("a", "positive"), ("b", "not nan")]
    other = spark.createDataFrame([("b",), ("c",)], "k string")
    got = qa.coverage(frame, other, ["k"]).first()
    assert (got.shared, got.missing, got.extra, got.coverage, got.covered) == (1, 1, 1, 0.5, False)


def test_fingerprint_ignores_order_but_not_content(spark):
    frame = spark.range(200).select(F.col("id"), F.when(F.col("id") % 3 > 0, "x").alias("t"))
    one = qa.fingerprint(frame, ["id", "t"]).first()
    assert one == qa.fingerprint(frame.orderBy(F.desc("id")).repartition(5), ["id", "t"]).first()
    changed = frame.withColumn("t", F.coalesce("t", F.lit("")))
    assert one.digest != qa.fingerprint(changed, ["id", "t"]).first().digest


def test_periods_resume_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "periods")
    frame = spark.createDataFrame(
        [(p, f"s{i}", i % 2 == 0, 0) for p in ("2024-01", "2024-02") for i in range(4)],
        "period string, symbol string, feature_available boolean, version int",
    )
    first = frame.where("period = '2024-01' OR symbol < 's2'")
    assert rows(sink.write_periods(first, path), "period", "rows") == [("2024-01", 4), ("2024-02", 2)]
    files = lambda p: {f.name for f in (tmp_path / "periods" / f"period={p}").glob("*.parquet")}
    before = files("2024-01"), files("2024-02")
    again = sink.write_periods(frame, path)
    assert rows(again, "period", "rows", "available_rows") == [("2024-01", 4, 2), ("2024-02", 4, 2)]
    # The complete period keeps its files, the other one is new.
    assert files("2024-01") == before[0] and not files("2024-02") & before[1]


def test_periods_with_changed_content_are_written_again(spark, tmp_path):
    path = str(tmp_path / "periods")
    frame = spark.createDataFrame(
        [(p, f"s{i}", i % 2 == 0, 1.0) for p in ("2024-01", "2024-02") for i in range(4)],
        "period string, symbol string, feature_available boolean, v double",
    )
    sink.write_periods(frame, path)
    one = (F.col("period") == "2024-02") & (F.col("symbol") == "s3")
    sink.write_periods(frame.withColumn("v", F.when(one, 9.0).otherwise(F.col("v"))), path)
    got = spark.read.parquet(path).groupBy("period").agg(F.sum("v").alias("v"))
    assert rows(got, "period", "v") == [("2024-01", 4.0), ("2024-02", 12.0)]
    # Data that changed on disk is noticed by its content.
    frame.where("period = '2024-01'").withColumn("v", F.lit(5.0)).drop("period").write.mode(
        "overwrite"
    ).parquet(f"{path}/period=2024-01")
    sink.write_periods(frame, path)
    got = spark.read.parquet(path).groupBy("period").agg(F.sum("v").alias("v"))
    assert rows(got, "period", "v") == [("2024-01", 4.0), ("2024-02", 4.0)]
    # A period that is gone goes, in the data as in the manifest.
    sink.write_periods(frame.where("period = '2024-01'"), path)
    assert rows(spark.read.parquet(path).select("period").distinct(), "period") == [("2024-01",)]
    assert rows(sink.read_manifest(spark, path), "period") == [("2024-01",)]
    # Another column set replaces all periods, those that are gone, too.
    sink.write_periods(frame, path)
    only = frame.where("period = '2024-01'").withColumn("w", F.lit(2))
    sink.write_periods(only, path)
    assert spark.read.parquet(path).where("w = 2").count() == spark.read.parquet(path).count() == 4
    sink.write_periods(frame.withColumn("w", F.lit(2)), path)
    assert spark.read.parquet(path).agg(F.sum("w")).first()[0] == 16
    manifest = sink.read_manifest(spark, path)
    assert {tuple(r["columns"]) for r in manifest.collect()} == {("symbol", "feature_available", "v", "w")}


def test_sharded_rows(spark, many_partitions):
    got = sink.sharded(spark.range(25).repartition(4), ["id"], 10)
    assert rows(got, "id", "shard", "shard_row") == [(i, i // 10, i % 10) for i in range(25)]


def test_models_learn_separable_classes(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(240):
        label = i % 3
        x = rng.normal(size=2) * 0.3 + np.array([[0, 0], [3, 0], [0, 3]])[label]
        data.append((f"s{i}", day(i % 5), day(i % 5 + 1), label, 0.0, float(x[0]), float(x[1])))
    frame = spark.createDataFrame(
        data,
        "symbol string, trading_date date, label_date date, label int, target_return double, a double, b double",
    ).cache()
    keep = ["symbol", "trading_date", "label_date", "label", "target_return"]
    for model in (ml.fit_logistic(frame, ["a", "b"], max_iter=20), ml.fit_forest(frame, ["a", "b"], trees=10, min_leaf=2)):
        scored = ml.score_rows(model, frame, keep)
        assert scored.where("label = predicted").count() > 230
        total = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
        assert scored.where(F.abs(total - 1) > 1e-9).count() == 0
        assert ml.prediction_rows(scored).columns[-4:] == ["prob_down", "prob_neutral", "prob_up", "score"]
