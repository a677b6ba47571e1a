import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.plans.ordering import (
    exact_quantiles,
    first_rows,
    neighbours,
    ordinal,
    prefix_sum,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns most rows and one value most of that group."""
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abcde"), n)),
            "v": np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n).round(2)),
            "k": np.arange(n),
            "w": rng.integers(1, 9, n),
        }
    )
    return spark.createDataFrame(pdf).repartition(7).cache()


def test_ordinal_equals_window(skewed, many_partitions):
    placed = ordinal(skewed, ["g"], [F.col("v"), F.col("k")], size="n")
    w = Window.partitionBy("g")
    checked = placed.withColumns(
        {
            "want": F.row_number().over(w.orderBy("v", "k")),
            "want_n": F.count(F.lit(1)).over(w),
        }
    )
    assert placed.count() == 4000
    assert checked.where("pos <> want OR n <> want_n").count() == 0


def test_sorted_rows_span_partitions(skewed, many_partitions):
    from tapeloom.plans.ordering import _sorted_slots

    parts = _sorted_slots(skewed, ["g"], [F.col("v"), F.col("k")])
    assert parts.where("g = 'hot'").select("_part").distinct().count() > 1


def test_ordinal_without_group(skewed, many_partitions):
    placed = ordinal(skewed, [], [F.col("k")])
    assert placed.where("pos <> k + 1").count() == 0


def test_prefix_sum_equals_window(skewed, many_partitions):
    summed = prefix_sum(skewed, ["g"], [F.col("v"), F.col("k")], "w")
    w = Window.partitionBy("g").orderBy("v", "k")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    checked = summed.withColumns(
        {"want": F.sum("w").over(running), "want_t": F.sum("w").over(Window.partitionBy("g"))}
    )
    assert checked.where("upto <> want OR total <> want_t").count() == 0


def test_exact_quantiles_equal_numpy(skewed, many_partitions):
    got = exact_quantiles(skewed, ["g"], "v", {"a": 0.2, "b": 0.5, "c": 0.83}).toPandas()
    raw = skewed.toPandas()
    for _, r in got.iterrows():
        values = raw.loc[raw.g == r.g, "v"]
        assert np.allclose([r.a, r.b, r.c], np.quantile(values, [0.2, 0.5, 0.83]))


@pytest.mark.parametrize("chunk", [1, 2, 7, 5000])
def test_neighbours_cross_chunks(skewed, chunk):
    base = skewed.withColumn("m", F.when(F.col("w") > 5, F.col("v")))
    placed = ordinal(base, ["g"], [F.col("k")])
    got = neighbours(
        placed, ["g"], "pos", lag={"before": "v"}, lead={"after": "v"}, carry={"held": "m"},
        chunk_rows=chunk,
    )
    w = Window.partitionBy("g").orderBy("k")
    checked = got.withColumns(
        {
            "x": F.lag("v").over(w),
            "y": F.lead("v").over(w),
            "z": F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    wrong = ~(
        F.col("before").eqNullSafe(F.col("x"))
        & F.col("after").eqNullSafe(F.col("y"))
        & F.col("held").eqNullSafe(F.col("z"))
    )
    assert got.count() == 4000
    assert checked.where(wrong).count() == 0


def test_null_groups_keep_their_rows(spark, many_partitions):
    frame = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    got = ordinal(frame, ["g"], [F.col("v")], size="n").collect()
    assert {(r.g, r.v, r.pos, r.n) for r in got} == {(None, 1, 1, 2), (None, 3, 2, 2), ("a", 2, 1, 1)}
    summed = prefix_sum(frame, ["g"], [F.col("v")], "v").collect()
    assert {(r.g, r.v, r.upto) for r in summed} == {(None, 1, 1), (None, 3, 4), ("a", 2, 2)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_of_any_size_cut_before_rows_meet(spark, many_partitions):
    frame = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 20_011).alias("v")
    ).repartition(8)
    for limit in (10, 5000):
        got = first_rows(frame, ["g"], [F.col("v")], limit)
        assert got.groupBy("g").count().where(f"count <> {limit}").count() == 0
        want = {
            (g, v)
            for g in range(3)
            for v in sorted((i * 7919) % 20_011 for i in range(g, 20_000, 3))[:limit]
        }
        assert {(r.g, r.v) for r in got.collect()} == want
        plan = plan_of(got)
        # Either Spark's own limit stands before the shuffle, or each partition's share is cut.
        assert "WindowGroupLimit" in plan if limit <= 1000 else "_share" in plan


def test_exact_quantiles_of_large_groups_order_few_values(spark):
    """Groups beyond the ranks of the sketch, with ties, and a third of one group at one value."""
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.7, 0.3]), "v": rng.normal(size=n)})
    pdf.loc[(pdf.g == "b") & (rng.random(n) < 0.3), "v"] = 0.25
    cuts = {"p0": 0.0, "p1": 0.0001, "p25": 0.25, "p50": 0.5, "p999": 0.9997, "p100": 1.0}
    df = spark.createDataFrame(pdf).repartition(5)
    for group in (["g"], []):
        got = exact_quantiles(df, group, "v", cuts).toPandas()
        assert len(got) == (2 if group else 1)
        for _, row in got.iterrows():
            values = pdf[pdf.g == row.g].v if group else pdf.v
            want = np.quantile(values, list(cuts.values()))
            assert np.allclose([row[c] for c in cuts], want, rtol=1e-12)
