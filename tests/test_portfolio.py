import numpy as np
import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from tapeloom.operators import portfolio as pf

SCHEMA = (
    "symbol string, trading_date date, label_date date, score double, target_return double,"
    " can_buy boolean, can_sell boolean, in_universe boolean"
)


def predictions(spark, days=14, n=25, seed=1, listed=0.9):
    rng = np.random.default_rng(seed)
    level = rng.normal(size=n)
    data = []
    for d in range(days):
        level = 0.8 * level + rng.normal(size=n) * 0.6
        for i in range(n):
            data.append(
                (f"s{i:02d}", day(d), day(d + 1), float(level[i]), float(rng.normal(0, 0.02)),
                 True, True, bool(rng.random() < listed))
            )
    return spark.createDataFrame(data, SCHEMA)


def run(spark, preds, k=5, per_side=10.0, stamp=5.0, **choice):
    sessions = pf.eligible_sessions(preds, 10)
    holdings = pf.select_top_k(preds, sessions, k, **choice).cache()
    charged = pf.charge(pf.build_trades(holdings, preds, sessions), per_side, stamp).cache()
    return sessions, holdings, charged, pf.daily_table(preds, holdings, charged, sessions, (), k)


def simulate(preds, k, per_side=10.0, stamp=5.0):
    """Plain day loop: equal weights in the day's best k, traded against drifted weights."""
    out, old = [], {}
    for _, g in preds.toPandas().sort_values("label_date").groupby("label_date"):
        g = g[g.in_universe].sort_values(["score", "symbol"], ascending=[False, True])
        ret = dict(zip(g.symbol, g.target_return, strict=True))
        chosen = list(g.symbol[:k])
        new = {s: 1 / len(chosen) for s in chosen}
        buy = sum(max(new.get(s, 0) - old.get(s, 0), 0) for s in set(new) | set(old))
        sell = sum(max(old.get(s, 0) - new.get(s, 0), 0) for s in set(new) | set(old))
        gross = sum(w * ret[s] for s, w in new.items())
        cost = (buy * per_side + sell * (per_side + stamp)) / 1e4
        best = set(g.sort_values(["target_return", "symbol"], ascending=[False, True]).symbol[:k])
        out.append((gross, cost, (buy + sell) / 2, gross - g.target_return.mean(), len(best & set(chosen)) / len(chosen)))
        old = {s: new[s] * (1 + ret[s]) / (1 + gross) for s in chosen}
    return np.array(out)


def test_daily_table_equals_a_day_loop(spark):
    preds = predictions(spark)
    *_, daily = run(spark, preds)
    got = daily.orderBy("label_date").select(
        "gross_return", "transaction_cost", "one_way_turnover", "active_return", "top_k_realized_overlap"
    )
    assert np.allclose(np.array([tuple(r) for r in got.collect()]), simulate(preds, 5))


def test_zero_cost_means_net_is_gross(spark):
    *_, daily = run(spark, predictions(spark), per_side=0.0, stamp=0.0)
    assert daily.where("net_return <> gross_return OR transaction_cost <> 0").count() == 0
    assert daily.where("abs(net_exposure - 1) > 1e-12").count() == 0


def test_trade_reasons_and_sides(spark):
    preds = predictions(spark)
    _, holdings, charged, _ = run(spark, preds)
    first = charged.where("session = 0")
    assert first.where("reason <> 'entry_rank' OR action <> 'buy'").count() == 0
    listed = {(r.label_date, r.symbol) for r in preds.where("in_universe").collect()}
    for r in charged.where("new_weight = 0").collect():
        assert r.reason == ("rank_exit" if (r.label_date, r.symbol) in listed else "universe_exit")
        assert r.cost_rate == pytest.approx(0.0015)


def test_minimum_score_leaves_cash_and_empty_days(spark):
    preds = predictions(spark)
    # Half of the dates have no score above the threshold.
    best = preds.where("in_universe").toPandas().groupby("label_date").score.max()
    *_, daily = run(spark, preds, min_score=float(best.median()), allow_cash=True)
    assert daily.count() == 14
    empty = daily.where("positions = 0")
    assert empty.count() > 0
    assert empty.where("gross_return <> 0 OR cash_weight <> 1").count() == 0
    assert daily.where("abs(net_exposure - positions / 5) > 1e-12").count() == 0


def test_buffer_keeps_members_and_lowers_turnover(spark):
    preds = predictions(spark)
    grid = pf.policy_grid(preds, (5,), (0, 6), (0.0, 10.0), min_symbols=10).toPandas()
    turnover = grid[grid.cost_bps == 0].set_index("exit_buffer").mean_one_way
    assert turnover[6] < turnover[0]
    free = grid[grid.cost_bps == 0]
    assert np.allclose(free.gross_mean_daily - free.net_mean_daily, free.mean_transaction_cost)
    assert set(zip(grid.exit_buffer, grid.cost_bps, strict=True)) == {(0, 0.0), (0, 10.0), (6, 0.0), (6, 10.0)}


def test_hysteresis_band_by_hand(spark):
    ranks = {"A": [1, 3, 4, 1], "B": [2, 1, 1, 3], "C": [3, 2, 2, 2], "D": [4, 4, 3, 4]}
    data = [
        (s, day(t), day(t + 1), float(-r), 0.0, True, True, True)
        for s, rs in ranks.items()
        for t, r in enumerate(rs)
    ]
    preds = spark.createDataFrame(data, SCHEMA)
    sessions = pf.eligible_sessions(preds, 2)
    got = pf.hysteresis_members(preds, sessions, [(2, 1)])
    # D reaches rank 3 without ever having entered; A drops out at rank 4 and comes back.
    assert rows(got, "session", "symbol") == [
        (0, "A"), (0, "B"), (1, "A"), (1, "B"), (1, "C"), (2, "B"), (2, "C"), (3, "A"), (3, "B"), (3, "C"),
    ]


def test_return_summary_drawdown_starts_at_one(spark):
    values = [-0.1, 0.05, 0.2, -0.3]
    daily = spark.createDataFrame([(day(i), v) for i, v in enumerate(values)], "label_date date, r double")
    got = pf.return_summary(daily, "r").first()
    curve = np.cumprod(1 + np.array(values))
    peak = np.maximum.accumulate(np.concatenate(([1.0], curve)))[1:]
    assert got.max_drawdown == pytest.approx((curve / peak - 1).min())
    assert got.cumulative_return == pytest.approx(curve[-1] - 1)
    assert got.sharpe == pytest.approx(np.mean(values) / np.std(values, ddof=1) * np.sqrt(244))


def long_short_loop(preds, q, every, cost, stamp, least):
    out, held = [], None
    groups = [g for _, g in preds.toPandas().sort_values("label_date").groupby("label_date") if len(g) >= least]
    for place, g in enumerate(groups):
        g = g.sort_values(["score", "symbol"], ascending=[False, True])
        turnover = 0.0
        if place % every == 0:
            tail = max(1, int(np.floor(len(g) * q)))
            new = set(g.symbol[:tail]), set(g.symbol[-tail:])
            turnover = 1.0 if held is None else np.mean([len(a - b) / len(a) for a, b in zip(new, held, strict=True)])
            held = new
        ret = dict(zip(g.symbol, g.target_return, strict=True))
        sides = [[ret[s] for s in side if s in ret] for side in held]
        if not all(sides):
            continue
        gross = np.mean(sides[0]) - np.mean(sides[1])
        out.append((gross, turnover, gross - turnover * (2 * cost / 1e4 + stamp)))
    return np.array(out)


def test_long_short_equals_a_day_loop(spark, many_partitions):
    preds = predictions(spark, days=17).where("hash(symbol, label_date) % 7 <> 0")
    for every in (1, 4):
        got = pf.long_short_daily(preds, 0.15, every, min_symbols=15).orderBy("label_date")
        table = np.array([(r.gross_return, r.turnover, r.net_return) for r in got.collect()])
        assert np.allclose(table, long_short_loop(preds, 0.15, every, 10.0, 0.0005, 15))


def test_breakeven_is_null_untraded(spark):
    summary = spark.createDataFrame(
        [(1, 0, 10.0, 0.0, 0.0, 0.01, 5.0), (2, 0, 10.0, 0.5, 0.5, 0.01, 5.0)],
        "top_k int, exit_buffer int, cost_bps double, mean_buy double, mean_sell double,"
        " gross_mean_daily double, sell_stamp_tax_bps double",
    ).withColumn("mean_active_return", F.col("gross_mean_daily"))
    got = rows(pf.breakeven_table(summary, 10.0), "top_k", "absolute_breakeven_bps")
    assert got[0] == (1, None) and got[1][1] == pytest.approx((100 - 2.5) / 1.0)


def test_staggered_numbers_skipped_dates(spark):
    data = [(day(d), f"s{i}", float(i)) for d in range(7) for i in range(6 if d != 2 else 2)]
    signals = spark.createDataFrame(data, "trading_date date, symbol string, score double")
    targets = signals.select(
        "trading_date", "symbol", F.date_add("trading_date", 5).alias("return_end_date"),
        F.lit(0.1).alias("raw_return"), F.lit(0.04).alias("benchmark_return"),
    )
    cohorts, members = pf.staggered_selection(signals, targets, 4, min_symbols=3)
    got = pf.staggered_cohorts(cohorts, members, 4).orderBy("cohort").collect()
    assert [(r.cohort, r.sleeve) for r in got] == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 0), (6, 1)]
    assert all(r.gross_exposure == pytest.approx(0.2) and r.cash_weight == pytest.approx(0) for r in got)
    assert got[0].net_active_return == pytest.approx(0.2 * 0.06 - 0.2 * 25 / 1e4)


def test_missing_liquidity_costs_the_maximum(spark):
    from tapeloom.functions.scalars import impact_rate

    frame = spark.createDataFrame([(0.01, None), (0.01, 0.0), (0.01, 1e8), (0.01, 1e3)], "w double, adv double")
    got = [r.x for r in frame.select(impact_rate(F.col("w"), F.col("adv")).alias("x")).collect()]
    assert got == pytest.approx([0.005, 0.005, 10 * 0.1 / 1e4, 0.005])


def gate_inputs(spark, dynamic=0.001, z=0.5, risk_windows=("a", "b")):
    matrix = spark.createDataFrame(
        [(n, w, v, t, 0.3) for w in ("a", "b") for n, v, t in (("new", 0.002, 0.4), ("old", 0.001, 1.0))],
        "name string, window string, mean_net_active_return double, mean_one_way double, "
        "top_5_absolute_active_contribution double",
    )
    priced = spark.createDataFrame(
        [("a", 0.001), ("b", dynamic)], "window string, mean_net_active_return double"
    )
    risks = spark.createDataFrame(
        [(w, e, z) for w in risk_windows for e in ("size", "adv")],
        "window string, exposure string, z double",
    )
    return pf.gate_report(matrix, "new", "old", ("a", "b"), priced, risks).first()


def test_gate_holds_on_dynamic_cost_or_risk(spark):
    good = gate_inputs(spark)
    assert good.decision == "PASS" and good.windows == 2
    costly = gate_inputs(spark, dynamic=-0.001)
    assert (costly.decision, costly.positive_under_dynamic_cost) == ("HOLD", False)
    tilted = gate_inputs(spark, z=-1.2)
    assert (tilted.decision, tilted.risk_within_one_z) == ("HOLD", False)
    # A window without risk figures is not judged for risk.
    assert gate_inputs(spark, z=0.9, risk_windows=("a",)).decision == "PASS"


def test_selection_needs_finite_scores_and_tradable_rows(spark):
    nan = float("nan")
    rows_ = [
        ("a", 0, nan, True, 0.1), ("b", 0, 0.9, False, 0.1), ("c", 0, 0.8, None, 0.1),
        ("d", 0, 0.7, True, None), ("e", 0, 0.6, True, 0.2), ("f", 1, 0.5, True, 0.2),
    ]
    preds = spark.createDataFrame(
        [(s, day(d), day(9), x, c, True, r) for s, d, x, c, r in rows_],
        "symbol string, trading_date date, label_date date, score double, can_buy boolean, "
        "in_universe boolean, target_return double",
    )
    sessions = spark.createDataFrame([(day(9), 0)], "label_date date, session long")
    chosen = pf.select_top_k(preds, sessions, 2)
    assert rows(chosen, "symbol", "rank", "weight") == [("d", 1, 0.5), ("e", 2, 0.5)]
    bad = pf.selection_violations(preds)
    assert {(r.symbol, r.reason) for r in bad.collect()} == {
        ("a", "score not finite"), ("c", "tradability unknown"), ("d", "return missing"),
        (None, "several signal dates"),
    }
