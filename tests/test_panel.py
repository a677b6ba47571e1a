import datetime as dt
import math

import numpy as np
import pytest
from table_rows import day, rows
from pyspark.sql import functions as F

from tapeloom.functions import scalars as sc
from tapeloom.operators import calendar as cal
from tapeloom.operators import labels as lab

BAR = "symbol string, day_index long, open double, high double, low double, close double, volume double"


def bars_of(spark, data, sessions=None):
    """Bars from (symbol, index, open, close, volume) plus the calendar."""
    frame = spark.createDataFrame(
        [(s, i, float(o), float(max(o, c)), float(min(o, c)), float(c), float(v)) for s, i, o, c, v in data],
        BAR,
    )
    last = sessions or max(r[1] for r in data) + 1
    calendar = cal.trading_calendar(
        spark.createDataFrame([(day(i),) for i in range(last)], "trading_date date")
    )
    return cal.with_day_index(
        frame.join(calendar.select("day_index", "trading_date"), "day_index").drop("day_index"),
        calendar,
    ), calendar


def test_calendar_skips_missing_days(spark):
    days = spark.createDataFrame([(day(0),), (day(5),), (day(5),), (day(9),)], "trading_date date")
    got = rows(cal.trading_calendar(days), "trading_date", "day_index", "next_date", "next_next_date")
    assert got == [
        (day(0), 0, day(5), day(9)),
        (day(5), 1, day(9), None),
        (day(9), 2, None, None),
    ]


def test_next_day_targets_never_bridge_a_gap(spark):
    bars, _ = bars_of(spark, [("A", 0, 10, 11, 1), ("A", 2, 10, 12, 1), ("B", 0, 5, 5, 1), ("B", 1, 4, 5, 1)], 3)
    got = rows(lab.next_day_targets(bars), "symbol", "trading_date", "label_date", "raw_return")
    assert got == [("B", day(0), day(1), 0.25)]


def test_universe_target_allows_missing_current_bar(spark):
    bars, calendar = bars_of(spark, [("A", 1, 10, 12, 1), ("B", 0, 5, 5, 1)], 3)
    asked = spark.createDataFrame(
        [("A", day(0), 0, day(1)), ("B", day(0), 0, day(1))],
        "symbol string, trading_date date, day_index long, label_date date",
    )
    got = rows(lab.next_day_targets_in_universe(asked, bars), "symbol", "raw_return")
    assert [(s, round(r, 12)) for s, r in got] == [("A", 0.2)]


def test_quantile_labels_keep_ties_neutral_and_drop_small_days(spark):
    data = [("d1", f"s{i}", float(v)) for i, v in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 5, 6])]
    data += [("d2", "x", 1.0), ("d2", "y", 2.0)]
    frame = spark.createDataFrame(data, "trading_date string, symbol string, target_return double")
    got = {r.symbol: r.label for r in lab.quantile_labels(frame, ["trading_date"], min_cross_section=5).collect()}
    values = np.array([v for d, _, v in data if d == "d1"])
    low, high = np.quantile(values, [0.2, 0.8])
    want = {f"s{i}": 0 if v < low else 2 if v > high else 1 for i, v in enumerate(values)}
    assert got == want


def test_horizon_returns_read_exact_sessions(spark):
    data = [("A", i, 10 + i, 20 + i, 1) for i in (0, 1, 2, 4)]
    bars, calendar = bars_of(spark, data, 5)
    bench = calendar.select("trading_date", F.lit(1.0).alias("open"), F.lit(1.0).alias("close"))
    got = rows(lab.horizon_returns(bars, calendar, bench, (1, 2, 3)), "trading_date", "horizon", "raw_return")
    want = [
        (day(0), 1, 21 / 11 - 1),
        (day(0), 2, 22 / 11 - 1),
        (day(1), 1, 22 / 12 - 1),
        (day(1), 3, 24 / 12 - 1),
    ]
    assert [(d, h, round(r, 12)) for d, h, r in got] == [(d, h, round(r, 12)) for d, h, r in want]


def test_universe_excludes_today_and_prefers_larger_symbol(spark):
    data = [(s, i, 10, 10, 1) for s in ("A", "B", "C") for i in range(4)]
    data += [("A", 4, 10, 10, 1000)]
    bars, calendar = bars_of(spark, data, 6)
    got = rows(
        cal.dynamic_universe(bars, calendar, 2, min_history_days=2, lookback=3, min_observations=2),
        "trading_date",
        "symbol",
    )
    # Equal liquidity keeps the larger symbols; the jump of A on day 4 counts from day 5 on.
    assert got == [
        (day(3), "B"), (day(3), "C"), (day(4), "B"), (day(4), "C"), (day(5), "A"), (day(5), "C"),
    ]


def test_previous_and_latest_close(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [("A", day(i), i, c) for i, c in enumerate([5.0, nan, -1.0, 7.0, 8.0])],
        "symbol string, trading_date date, day_index long, close double",
    )
    got = [r.previous_close for r in cal.previous_valid_close(frame).orderBy("day_index").collect()]
    assert got == [None, 5.0, 5.0, 5.0, 7.0]
    asked = spark.createDataFrame(
        [("A", day(0)), ("A", day(3)), ("A", day(40)), ("Z", day(3))], "symbol string, trading_date date"
    )
    assert rows(cal.latest_close_before(asked, frame), "symbol", "trading_date", "prev_close") == [
        ("A", day(0), 0.0), ("A", day(3), 5.0), ("A", day(40), 8.0), ("Z", day(3), 0.0),
    ]


def test_market_attributes_window_rules(spark):
    data = [("A", i, 10, 10 * 1.1**i, 2) for i in range(6)] + [("B", i, 10, 10, 2) for i in (0, 1, 2, 4, 5)]
    bars, _ = bars_of(spark, data, 6)
    got = cal.market_attributes(bars.withColumn("size", F.lit(1.0)), "size", 3, slack=1).collect()
    # B misses session 3, so none of its rows has four closes in a row.
    assert {(r.symbol, r.day_index) for r in got} == {("A", 3), ("A", 4), ("A", 5)}
    adv = {r.day_index: r.adv for r in got}
    assert adv[3] == pytest.approx(np.mean([10 * 1.1**i * 2 for i in (1, 2, 3)]) * 100)
    assert all(abs(r.volatility) < 1e-12 for r in got)


def test_rolling_folds_and_purge(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 9), dt.date(2024, 7, 1))], "start_month date, end_month date")
    got = rows(cal.rolling_folds(bounds), "fold_id", "train_start", "train_end", "val_end", "oos_end")
    assert [g[0] for g in got] == [
        "fold-00-oos-202405", "fold-01-oos-202406", "fold-02-oos-202407",
    ]
    assert got[0][1:] == (dt.date(2024, 1, 1), dt.date(2024, 3, 31), dt.date(2024, 4, 30), dt.date(2024, 5, 31))
    frame = spark.createDataFrame(
        [(day(0), day(1), day(2)), (day(8), day(9), day(10)), (day(10), day(11), day(12))],
        "trading_date date, label_date date, end date",
    )
    split = lab.assign_split(
        frame, {"train": ("2024-01-01", "2024-01-10"), "val": ("2024-01-11", "2024-02-01")}, end="end"
    )
    assert rows(split.select("trading_date", "split", "signal_split"), "trading_date", "split", "signal_split") == [
        (day(0), "train", "train"), (day(8), None, "train"), (day(10), "val", "val"),
    ]


def test_execution_states(spark):
    cases = [
        ("000001", 11.0, 11.0, 11.0, 5.0, 10.0, False, "one_price_limit_up"),
        ("000001", 9.0, 9.0, 9.0, 5.0, 10.0, False, "one_price_limit_down"),
        ("688001", 12.0, 12.0, 12.0, 5.0, 10.0, False, "one_price_limit_up"),
        ("300001", 12.0, 12.0, 12.0, 5.0, 10.0, False, "one_price_limit_up"),
        ("000001", 10.5, 10.5, 10.5, 5.0, 10.0, True, "one_price_limit_up"),
        ("000001", 11.0, 11.2, 11.0, 5.0, 10.0, False, "normal"),
        ("000001", 11.0, 11.0, 11.0, 0.0, 10.0, False, "suspended"),
        ("000001", float("nan"), 11.0, 11.0, 5.0, 10.0, False, "suspended"),
        # 10.05 * 1.1 = 11.055 rounds half up to 11.06.
        ("000001", 11.06, 11.06, 11.06, 5.0, 10.05, False, "one_price_limit_up"),
        ("000001", 11.0, 11.0, 11.0, 5.0, None, False, None),
    ]
    frame = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, s string, o double, h double, l double, v double, p double, st boolean, want string",
    )
    state = sc.open_execution_state(
        F.col("s"), F.lit("2024-01-01").cast("date"), *[F.col(c) for c in "ohlvp"], F.col("st")
    )
    for r in frame.withColumn("x", state).collect():
        assert (r.x.status if r.x else None) == r.want
        if r.x:
            assert r.x.can_buy == (r.want in ("normal", "one_price_limit_down"))
            assert r.x.can_sell == (r.want in ("normal", "one_price_limit_up"))
            assert r.x.mark_price == (r.p if r.want == "suspended" else r.o)


def formal_by_hand(data, sessions, bench, top_n, history, lookback, least):
    """Day-by-day restatement of the formal target rules."""
    bar = {(s, i): (o, c, v) for s, i, o, c, v in data}
    symbols = sorted({s for s, *_ in data})
    prev = {}
    for s in symbols:
        last = None
        for i in range(sessions):
            prev[s, i] = last
            if (s, i) in bar:
                last = bar[s, i][1]
    first = {s: min(i for x, i in bar if x == s) for s in symbols}

    def state(s, i):
        if prev[s, i] is None:
            return None
        if (s, i) not in bar:
            return prev[s, i], "suspended"
        return bar[s, i][0], "normal"

    out, carried, previous = [], set(), set()
    for t in range(sessions - 2):
        chosen = set()
        if t >= lookback:
            scored = []
            for s in symbols:
                past = [bar[s, i] for i in range(t - lookback, t) if (s, i) in bar]
                if len(past) >= least and t - first[s] >= history:
                    scored.append((np.mean([c * v for _, c, v in past]), s))
            chosen = {s for _, s in sorted(scored, reverse=True)[:top_n]}
        market = bench[t + 2] / bench[t + 1] - 1

        def target(s):
            a, b = state(s, t + 1), state(s, t + 2)
            return None if a is None or b is None else (b[0] / a[0] - 1, a[1])

        if len(chosen) != top_n or any(target(s) is None for s in chosen):
            previous = chosen
            continue
        carried |= previous - chosen
        carried -= chosen
        for s in sorted(chosen):
            out.append((t, s, True, round(target(s)[0] - market, 9)))
        for s in sorted(carried):
            found = target(s)
            if found is None:
                continue
            out.append((t, s, False, round(found[0] - market, 9)))
            if found[1] == "normal":
                carried.discard(s)
        previous = chosen
    return sorted(out)


def test_formal_targets_equal_day_by_day_rules(spark):
    rng = np.random.default_rng(5)
    sessions = 30
    data = [
        (f"S{s}", i, round(rng.uniform(5, 20), 2), round(rng.uniform(5, 20), 2), float(rng.integers(1, 50)))
        for s in range(7)
        for i in range(sessions)
        if rng.random() < 0.75
    ]
    bars, calendar = bars_of(spark, data, sessions)
    levels = [100 + 3 * math.sin(i) for i in range(sessions)]
    bench = spark.createDataFrame(
        [(day(i), levels[i], levels[i]) for i in range(sessions)], "trading_date date, open double, close double"
    )
    rules = dict(top_n=3, min_history_days=3, lookback=4, min_observations=2)
    got, dates = lab.formal_targets(bars.withColumn("is_st", F.lit(False)), calendar, bench, **rules)
    found = sorted(
        ((r.trading_date - day(0)).days, r.symbol, r.in_universe, round(r.target_return, 9))
        for r in got.collect()
    )
    want = formal_by_hand(data, sessions, levels, 3, 3, 4, 2)
    assert found == want
    assert any(not r[2] for r in want)
    report = lab.formal_report(got, dates, 3).first()
    assert report.candidate_targets == sum(r[2] for r in want)
    assert report.requested_signal_dates == sessions - 2


def test_scalar_edges(spark):
    frame = spark.createDataFrame(
        [(1, "7", "20240131", 10.125), (2, "1234567", "2024-02-30", None)],
        "i int, s string, d string, p double",
    )
    got = frame.select(
        "i",
        sc.pad_symbol(F.col("s")).alias("s"),
        sc.parse_day(F.col("d")).alias("d"),
        sc.to_cents(F.col("p")).alias("c"),
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("000007", dt.date(2024, 1, 31), 1012), ("1234567", None, 0)]


def test_pack_events_pads_with_the_earliest(spark):
    frame = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6, 7],)], "e array<int>")
    got = [r.c for r in frame.select(sc.pack_events(F.col("e"), 3, 2).alias("c")).collect()]
    assert got == [[[1, 1], [1, 1], [2, 3]], [[2, 3], [4, 5], [6, 7]]]


def test_flatten_opens_all_levels(spark):
    deep = '{"x": ' * 10 + "7" + "}" * 10
    frame = spark.createDataFrame(
        [(1, f'{{"a": {{"b": {{"c": 1}}}}, "n": 2.5, "t": true, "d": {deep}}}'), (2, "[]"), (3, None)],
        "k int, j string",
    )
    assert rows(sc.flatten_numeric(frame, ["k"], "j"), "k", "path", "number") == [
        (1, "a.b.c", 1.0),
        (1, ".".join(["d", *"x" * 10]), 7.0),
        (1, "n", 2.5),
    ]


def test_days_meet_only_ranges_of_their_month(spark):
    from tapeloom.operators import calendar as cal

    days = spark.createDataFrame([(day(i),) for i in range(60)], "trading_date date")
    ranges = cal.ranges_frame(
        spark, [("a", "2024-01-05", "2024-02-03"), ("b", "2024-02-03", "2024-02-10"), ("c", "2024-03-02", "2024-01-01")]
    )
    out = cal.days_outside_one_range(days, ranges, "2024-02-20")
    got = {r.trading_date: (r.ranges, r.status) for r in out.collect()}
    assert len(got) == 60
    assert got[day(3)] == (0, "no range") and got[day(4)] == (1, "ok")
    assert got[day(33)] == (2, "several ranges") and got[day(34)] == (1, "ok")
    assert got[day(55)][1] == "locked"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_wide_parts_hold_any_number_of_symbols(spark, tmp_path):
    from tapeloom.sinks import tables as sink
    from tapeloom.sources import panels

    path = str(tmp_path / "wide")
    many = spark.range(2_000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("symbol"),
        F.explode(F.array(*[F.lit(day(i)) for i in (0, 1)])).alias("trading_date"),
        F.col("id").cast("double").alias("close"),
    )
    # The first symbol lacks the second day, and a row without a symbol has no column.
    held = many.where(F.col("symbol").isin("000000") & (F.col("trading_date") == day(1)))
    nameless = many.where("symbol = '000007'").withColumn("symbol", F.lit(None).cast("string"))
    placed = sink.write_wide_parts(
        many.subtract(held).unionByName(nameless), "close", path, width=250
    )
    assert placed.agg(F.count("symbol"), F.max("part")).first() == (2_000, 7)

    picked = panels.read_wide_panel(spark, path, "close", ["000000", "000003"], pattern=r"^\d{6}$")
    assert {f.rsplit("/", 2)[-2] for f in picked.inputFiles()} == {"part-00000"}
    assert rows(picked, "symbol", "trading_date", "close") == [
        ("000000", day(0), 0.0),
        ("000000", day(1), None),
        ("000003", day(0), 3.0),
        ("000003", day(1), 3.0),
    ]
    labels = panels.read_wide_labels(spark, path)
    expected = many.subtract(held).agg(F.count("close"), F.sum("close")).first()
    assert labels.agg(F.count("label"), F.sum("label")).first() == expected


def test_wide_parts_without_rows_have_no_stock_column(spark, tmp_path):
    from tapeloom.sinks import tables as sink
    from tapeloom.sources import panels

    path = str(tmp_path / "wide")
    empty = spark.createDataFrame([], "symbol string, trading_date date, close double")
    assert sink.write_wide_parts(empty, "close", path).count() == 0
    with pytest.raises(ValueError, match="no stock column"):
        panels.read_wide_panel(spark, path)


def test_wide_parts_are_written_and_read_by_jobs_that_do_not_grow_with_them(spark, tmp_path):
    from tapeloom.sinks import tables as sink
    from tapeloom.sources import panels

    def work(n, width):
        """Jobs that write ``n`` symbols and collect them, and the scans of the plan that reads them."""
        path = str(tmp_path / f"wide-{n}")
        many = spark.range(n).select(
            F.lpad(F.col("id").cast("string"), 6, "0").alias("symbol"),
            F.lit(day(0)).alias("trading_date"),
            F.col("id").cast("double").alias("close"),
        )
        group = f"wide-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            sink.write_wide_parts(many, "close", path, width)
            out = panels.read_wide_panel(spark, path, "close", pattern=r"^\d{6}$")
            labels = panels.read_wide_labels(spark, path)
            got = rows(out, "symbol", "trading_date", "close")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == [(f"{i:06d}", day(0), float(i)) for i in range(n)]
        assert labels.agg(F.sum("label")).first()[0] == sum(range(n))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return jobs, out._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    few, many = work(12, 4), work(120, 4)
    assert many[1] == few[1] == 2
    # Listing many folders may be a job of its own.
    assert many[0] <= few[0] + 4


def test_market_panels_of_parts_hold_all_days_of_the_common_symbols(spark, tmp_path):
    from tapeloom.sinks import tables as sink
    from tapeloom.sources import panels

    base = [(f"{i:06d}", day(d), float(10 * i + d)) for i in range(7) for d in (0, 1)]
    schema = "symbol string, trading_date date, v double"
    # The close panel lacks one cell of 000002, has 000009 alone, and a name that is no code.
    close = [r for r in base if r[:2] != ("000002", day(1))] + [("000009", day(0), 1.0)]
    odd = [("idx", day(0), 5.0)]
    paths = {"open": str(tmp_path / "open"), "close": str(tmp_path / "close")}
    sink.write_wide_parts(spark.createDataFrame(base + odd, schema), "v", paths["open"], 3)
    sink.write_wide_parts(spark.createDataFrame(close + odd, schema), "v", paths["close"], 2)
    out = panels.load_market_panels(spark, paths, pattern=r"^\d{6}$")
    lost = lambda s, d, v: None if (s, d) == ("000002", day(1)) else v
    assert rows(out, "symbol", "trading_date", "open", "close") == [
        (s, d, v, lost(s, d, v)) for s, d, v in base
    ]
    assert panels.axis_mismatch(spark, paths).count() == 0
    assert [t.columns[1:] for t in panels.wide_tables(spark, paths["open"], ["000004", "idx"])] == [
        ["000003", "000004", "000005"],
        ["000006", "idx"],
    ]
    # Fewer parts than before take the place of all of them.
    sink.write_wide_parts(spark.createDataFrame(base[:2], schema), "v", paths["open"], 3)
    again = panels.read_wide_panel(spark, paths["open"], "v", pattern=r"^\d{6}$")
    assert rows(again, "symbol", "trading_date", "v") == base[:2]
