import numpy as np
import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from tapeloom.operators import ranking as rk


def frame_of(spark, days, n, seed, ties=True):
    rng = np.random.default_rng(seed)
    data = []
    for d in range(days):
        score = rng.normal(size=n)
        score = score.round(0) if ties else score
        ret = (0.3 * score + rng.normal(size=n)).round(1 if ties else 9)
        data += [(day(d), day(d + 1), f"s{i:03d}", float(score[i]), float(ret[i])) for i in range(n)]
    return spark.createDataFrame(
        data, "trading_date date, label_date date, symbol string, score double, target_return double"
    ).withColumn("in_universe", F.lit(True))


def mean_ranks(values):
    order = np.argsort(values, kind="mergesort")
    ranks = np.empty(len(values))
    ranks[order] = np.arange(len(values))
    return np.array([ranks[values == v].mean() for v in values])


def test_average_and_ordinal_ic(spark, many_partitions):
    frame = frame_of(spark, 3, 40, 1)
    pdf = frame.toPandas().sort_values(["label_date", "symbol"])
    avg = {r.label_date: r.rank_ic for r in rk.rank_ic(frame, min_symbols=5).collect()}
    plain = {r.label_date: r.rank_ic for r in rk.rank_ic(frame, ties="ordinal", min_symbols=5).collect()}
    for d, g in pdf.groupby("label_date"):
        s, t = g.score.to_numpy(), g.target_return.to_numpy()
        assert np.isclose(avg[d], np.corrcoef(mean_ranks(s), mean_ranks(t))[0, 1])
        a, b = (np.argsort(np.argsort(x, kind="mergesort"), kind="mergesort") for x in (s, t))
        assert np.isclose(plain[d], np.corrcoef(a, b)[0, 1])


def test_constant_scores_have_no_ic(spark):
    frame = frame_of(spark, 1, 30, 2).withColumn("score", F.lit(1.0))
    assert rk.rank_ic(frame, min_symbols=5).count() == 0


def dcg_with_ties(gain, score, k):
    discount = 1 / np.log2(np.arange(len(gain)) + 2)
    discount[k:] = 0
    total, start = 0.0, 0
    for value in np.unique(-score):
        members = gain[-score == value]
        total += members.mean() * discount[start : start + len(members)].sum()
        start += len(members)
    return total


def test_ndcg_averages_ties(spark, many_partitions):
    frame = frame_of(spark, 3, 30, 4).withColumn("gain", F.abs(F.round("target_return")))
    got = {r.trading_date: r.ndcg for r in rk.ndcg(frame, F.col("gain"), 7).collect()}
    for d, g in frame.toPandas().groupby("trading_date"):
        gain, score = g.gain.to_numpy(), g.score.to_numpy()
        best = np.sort(gain)[::-1]
        ideal = (best[:7] / np.log2(np.arange(7) + 2)).sum()
        assert np.isclose(got[d], dcg_with_ties(gain, score, 7) / ideal)


def test_precision_overlap(spark):
    frame = spark.createDataFrame(
        [("d", "a", 3.0, 1.0), ("d", "b", 2.0, 3.0), ("d", "c", 1.0, 2.0), ("d", "e", 0.0, 0.0)],
        "trading_date string, symbol string, score double, target_return double",
    )
    assert rk.precision_overlap(frame, 2).first().precision == 0.5


def test_smoothing_restarts_after_a_gap(spark):
    data = [
        (day(0), "A", 3.0), (day(0), "B", 2.0), (day(0), "C", 1.0),
        (day(1), "B", 1.0), (day(1), "C", 2.0),
        (day(2), "A", 1.0), (day(2), "B", 2.0), (day(2), "C", 3.0),
    ]
    frame = spark.createDataFrame(data, "trading_date date, symbol string, score double")
    got = {(r.trading_date, r.symbol): r.score for r in rk.percentile_ranks(frame, 0.5).collect()}
    assert got[day(0), "A"] == 1.0 and got[day(0), "B"] == 0.5
    assert got[day(1), "B"] == 0.25 and got[day(1), "C"] == 0.5
    assert got[day(2), "A"] == 0.0  # missed day 1, so no memory of day 0
    assert got[day(2), "B"] == 0.5 * 0.5 + 0.5 * 0.25
    split = frame.withColumn("partition", F.when(F.col("trading_date") < day(2), "a").otherwise("b"))
    fresh = {(r.trading_date, r.symbol): r.score for r in rk.percentile_ranks(split, 0.5, "partition").collect()}
    assert fresh[day(2), "B"] == 0.5


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0.1, 1, 25)
    frame = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(values)], "label_date date, rank_ic double")
    for lag in (0, 3, 60):
        got = rk.newey_west(frame, lag).first()
        reach = min(lag, len(values) - 1)
        c = values - values.mean()
        var = c @ c / len(c)
        for k in range(1, reach + 1):
            var += 2 * (1 - k / (reach + 1)) * (c[k:] @ c[:-k]) / len(c)
        error = np.sqrt(max(var, 0) / len(c))
        assert got.lag == reach and np.isclose(got.standard_error, error)
        if error > 0:
            assert np.isclose(got.t_stat, values.mean() / error)


def test_phases_count_evaluated_days(spark):
    frame = spark.createDataFrame([(day(i * 3), float(i)) for i in range(7)], "label_date date, rank_ic double")
    assert rows(rk.phases(frame, 3), "phase", "dates", "mean") == [(0, 3, 3.0), (1, 2, 2.5), (2, 2, 3.5)]


def test_audit_against_numpy(spark, many_partitions):
    frame = frame_of(spark, 12, 53, 9, ties=False)
    daily = {r.label_date: r for r in rk.audit_daily(frame).collect()}
    deciles = {r.decile: r.mean_return for r in rk.audit_deciles(frame).collect()}
    means = []
    for d, g in frame.toPandas().groupby("label_date"):
        g = g.sort_values(["score", "symbol"])
        t = g.target_return.to_numpy()
        n, tail = len(t), max(1, int(np.floor(len(t) * 0.1)))
        assert np.isclose(daily[d].spread, t[-tail:].mean() - t[:tail].mean())
        w = np.minimum(t, np.percentile(t, 99.0))
        assert np.isclose(daily[d].winsorized_spread, w[-tail:].mean() - w[:tail].mean())
        means.append([t[n * q // 10 : n * (q + 1) // 10].mean() for q in range(10)])
    assert np.allclose([deciles[q] for q in range(10)], np.mean(means, axis=0))
    summary = rk.audit_summary(rk.audit_daily(frame), rk.audit_deciles(frame))
    r = summary.first()
    spreads = np.sort([v.spread for v in daily.values()])
    assert np.isclose(r.top_5_day_contribution, spreads[-5:].sum() / spreads.sum())
    assert np.isclose(r.decile_monotonicity, np.corrcoef(np.arange(10), np.mean(means, axis=0))[0, 1])
    assert rk.audit_anomalies(summary).columns == ["type", "severity"]


def test_classification_figures(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(1, 2)] + [(2, 2)] * 3 + [(2, 0)] * 2
    frame = spark.createDataFrame(pairs, "label int, guess int")
    report = rk.class_report(rk.confusion(frame, "label", "guess"), (0, 1, 2))
    got = rk.classification_summary(report).first()
    a, g = np.array(pairs).T
    assert np.isclose(got.accuracy, (a == g).mean())
    x, y = np.eye(3)[a], np.eye(3)[g]
    x, y = x - x.mean(0), y - y.mean(0)
    assert np.isclose(got.mcc, (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
    recall = [((a == c) & (g == c)).sum() / (a == c).sum() for c in range(3)]
    assert np.isclose(got.balanced_accuracy, np.mean(recall))


def test_half_life_small_case(spark):
    frame = frame_of(spark, 4, 30, 11)
    labels = frame.select(
        "trading_date", "symbol", F.lit(2).alias("horizon"),
        F.when(F.col("target_return") > 0, 2).otherwise(0).alias("label"),
        F.col("target_return").alias("raw_return"), F.lit(0.0).alias("benchmark_return"), "target_return",
    )
    daily = rk.half_life_daily(frame, labels, top_k=5, min_symbols=10)
    got = {r.trading_date: r for r in daily.collect()}
    for d, g in frame.toPandas().groupby("trading_date"):
        g = g.sort_values(["score", "symbol"], ascending=[False, True])
        t = g.target_return.to_numpy()
        assert np.isclose(got[d].extreme_spread, t[:3].mean() - t[-3:].mean())
        assert np.isclose(got[d].top_k_active_return, t[:5].mean())
        assert np.isclose(got[d].precision_at_k, (t[:5] > 0).mean())
    assert rows(rk.half_life_anchors(daily), "anchor", "cohorts") == [(0, 2), (1, 2)]


def pool_adjacent(x, y):
    order = np.argsort(x, kind="mergesort")
    blocks = []
    for v in np.unique(x[order]):
        blocks.append([y[x == v].mean(), (x == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return {v: mean for mean, _, values in blocks for v in values}


def test_calibration_is_isotonic_and_clipped(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 20, 300) / 20
    y = x + rng.normal(0, 0.4, 300)
    fit = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "score double, target_return double")
    asked = spark.createDataFrame([(v,) for v in [-1.0, *np.unique(x).tolist(), 2.0]], "score double")
    got = {r.score: r.expected_return for r in rk.calibrated_scores(fit, asked).collect()}
    want = pool_adjacent(x, y)
    assert all(np.isclose(got[v], want[v]) for v in want)
    assert got[-1.0] == pytest.approx(min(want.values())) and got[2.0] == pytest.approx(max(want.values()))


@pytest.mark.parametrize("trend", [0.0, 0.3, 5.0, -1.0])
def test_isotonic_blocks_merge_over_partitions(spark, many_partitions, trend):
    """Noise, a weak and a steep trend, and a falling one, which is a single block."""
    rng = np.random.default_rng(7)
    x = rng.permutation(600) / 600
    y = trend * x + rng.normal(0, 0.2, 600)
    fit = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    blocks = rk.isotonic_blocks(fit.repartition(5), "x", "y")
    want = pool_adjacent(x, y)
    got = {r.x: r.fitted for r in rk.apply_blocks(blocks, fit, "x", "fitted").collect()}
    assert all(np.isclose(got[v], want[v]) for v in want)
    assert blocks.count() == len({round(m, 12) for m in want.values()})
    between = rk.apply_blocks(blocks, spark.createDataFrame([(0.50001,)], "x double"), "x", "f")
    inside = np.interp(0.50001, sorted(want), [want[v] for v in sorted(want)])
    assert between.first()["f"] == pytest.approx(inside)


def test_exponential_mean_of_a_long_run_with_gaps(spark):
    n = 100_000
    rows = spark.range(n).selectExpr(
        "'s' AS symbol", "id + IF(id >= 70000, 5, 0) AS at", "CAST(hash(id) AS DOUBLE) / 1e9 AS v"
    )
    out = rk.exponential_mean(rows, ["symbol"], "at", "v", (0.5, 0.01, 1.0, 0.999))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values("at")
    values = rows.toPandas().sort_values("at")
    for alpha, part in got.groupby("alpha"):
        last, want = None, []
        for i, v in enumerate(values["v"]):
            last = v if i in (0, 70_000) else alpha * v + (1 - alpha) * last
            want.append(last)
        assert np.allclose(part["score"].to_numpy(), want, rtol=1e-9, atol=1e-12)


def test_distribution_skips_non_finite(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-3.0,), (2.0,), (float("inf"),)], "v double")
    r = rk.distribution(frame, "v").first()
    assert (r["count"], r["min"], r["median"], r["max"]) == (3, -3, 1, 2) and r.q25 == -1
    assert r.negative_fraction == pytest.approx(1 / 3)
