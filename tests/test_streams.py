import numpy as np
from table_rows import day, rows
from pyspark.sql import functions as F

from tapeloom.operators import book as bk
from tapeloom.operators import events as ev
from tapeloom.operators import minute as mn


def test_cancel_and_trade_links(spark):
    orders = spark.createDataFrame(
        [
            ("d", "t", "1", 100, 500, 0),
            ("d", "t", "2", 150, 300, 10),
            ("d", "t", "1", 400, 0, -1),
            ("d", "t", "9", 450, 0, -11),
        ],
        "day string, ticker string, order_id string, time_ms int, volume int, order_type int",
    )
    got = rows(ev.link_cancels(orders), "time_ms", "cancel_age_ms", "cancel_orig_vol")
    assert got == [(100, 0, 0), (150, 0, 0), (400, 300, 500), (450, -1, 0)]
    trades = spark.createDataFrame(
        [("d", "t", 500, "1", "2"), ("d", "t", 600, "2", "8")],
        "day string, ticker string, time_ms int, buy_id string, sell_id string",
    )
    linked = ev.link_trades(trades, orders)
    assert rows(linked, "time_ms", "buy_age_ms", "sell_age_ms") == [(500, 400, 350), (600, 450, -1)]


def test_duplicate_originals_multiply_links(spark):
    orders = spark.createDataFrame(
        [("d", "t", "1", 1, 5, 0), ("d", "t", "1", 2, 6, 0), ("d", "t", "1", 9, 0, -1)],
        "day string, ticker string, order_id string, time_ms int, volume int, order_type int",
    )
    assert ev.link_cancels(orders).where("order_type = -1").count() == 2


EVENTS = "day string, ticker string, stream string, time_ms int, seq long, mid double"


def test_merge_order_and_reference(spark):
    frame = spark.createDataFrame(
        [
            ("d", "a", "snap", 10, 1, 50.0),
            ("d", "a", "trade", 10, 2, None),
            ("d", "a", "order", 10, 3, None),
            ("d", "a", "order", 5, 4, None),
            ("d", "a", "snap", 20, 5, None),
            ("d", "a", "trade", 30, 6, None),
            ("d", "b", "order", 1, 7, None),
            ("d", "b", "snap", 2, 8, 70.0),
            ("d", "b", "snap", 3, 9, 60.0),
            ("d", "c", "order", 1, 10, None),
        ],
        EVENTS,
    )
    merged = ev.merge_streams(frame)
    assert [r.seq for r in merged.where("ticker = 'a'").orderBy("pos").collect()] == [4, 3, 2, 1, 5, 6]
    close = spark.createDataFrame(
        [("d", "a", 40.0), ("d", "b", 0.0)], "day string, ticker string, prev_close double"
    )
    for part in (2, 100):
        ref = {r.seq: r.ref for r in ev.place_events(frame, close, part).collect()}
        # a: previous close, then the snapshot's own mid, kept through an invalid one;
        # b: largest mid before its first snapshot; c: nothing known.
        assert ref == {4: 40, 3: 40, 2: 40, 1: 50, 5: 50, 6: 50, 7: 70, 8: 70, 9: 60, 10: 1}


def test_counter_deltas_and_closing_window(spark):
    frame = spark.createDataFrame(
        [("d", "a", "snap", t, t, v) for t, v in ((1, 100), (2, 150), (3, 155), (4, 160))],
        "day string, ticker string, stream string, time_ms int, seq int, volume int",
    )
    for chunk in (1, 3, 50):
        got = rows(ev.counter_deltas(frame, ["volume"], part_rows=chunk), "seq", "d_volume")
        assert got == [(1, 100), (2, 50), (3, 5), (4, 5)]
    window = rows(ev.closing_window(frame, 2), "seq", "is_target_only")
    assert window == [(2, False), (3, False), (4, True)]


def test_weighted_picks_follow_cumulative_weights(spark):
    counts = spark.createDataFrame(
        [("d", "a", 1), ("d", "b", 90), ("d", "c", 9), ("e", "z", 5)], "day string, ticker string, events long"
    )
    got = ev.weighted_picks(counts, 300, seed=1).toPandas()
    assert len(got) == 600 and got.ticker.notna().all()
    share = got[got.day == "d"].ticker.value_counts(normalize=True)
    assert abs(share["b"] - 0.9) < 0.07
    again = ev.weighted_picks(counts, 300, seed=1).toPandas()
    assert got.sort_values(["day", "pick"]).ticker.tolist() == again.sort_values(["day", "pick"]).ticker.tolist()


def test_feature_names_are_eighty():
    names = ev.feature_names()
    assert len(names) == 80 == len(set(names))
    assert names[77:] == ["phase_sin", "phase_cos", "auction"] and names[12] == "bid_bps_1"


def test_tail_and_normalization(spark):
    frame = spark.createDataFrame(
        [(day(0), "a", t, t, a, b, 3.0, 4.0) for t, a, b in ((1, 9.0, 7.0), (2, 11.0, 9.0), (3, 12.0, 0.0), (4, 13.0, 11.0))],
        "trading_date date, symbol string, time_ms int, seq int, ask double, bid double, av double, bv double",
    )
    tail = bk.tail_events(frame, 2, ["ask", "bid"], ["av", "bv"])
    assert rows(tail, "place", "time_ms") == [(1, 4), (2, 2)]
    got = bk.normalize_tail(tail, ["ask", "bid"], ["av", "bv"], "bid", "ask").orderBy("time_ms").collect()
    assert [round(r.ask, 9) for r in got] == [10.0, 30.0]
    assert got[0].av == np.log1p(3) / 16
    summary = bk.sequence_summary(tail, ["ask"], F.col("time_ms")).first()
    assert (summary["ask__mean"], summary["ask__std"], summary["ask__last"], summary["ask__change"]) == (12, 1, 13, 2)


def test_sliding_windows_validation_gap(spark):
    frame = spark.createDataFrame([("s", i, i % 3) for i in range(20)], "seg string, i int, y int")
    for chunk in (3, 4, 1000):
        got = bk.sliding_windows(
            frame, ["seg"], [F.col("i")], F.col("i"), F.col("y"), 3, 0.2, chunk_rows=chunk
        ).orderBy("window_index").collect()
        # 18 windows, 3 held for validation, 2 before them left out.
        assert [r.window_index for r in got if r.role == "train"] == list(range(13))
        assert [r.window_index for r in got if r.role == "val"] == [15, 16, 17]
        assert all(list(r["values"]) == [r.window_index + j for j in range(3)] for r in got)
        assert all(r.label == (r.window_index + 2) % 3 for r in got)


def test_minute_rules(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(1, "a", 1, 1, 1.0, 10.0), (1, "a", 1, 2, 1.5, 11.0), (1, "a", 2, 3, 2.0, 20.0), (1, "a", 3, 4, 3.0, nan)],
        "date int, ticker string, minute int, seq int, x double, y double",
    )
    last = mn.last_per_minute(frame, ["x", "y"], 10)
    assert rows(last, "minute", "x") == [(1, 1.5), (2, 2.0), (3, 3.0)]
    assert rows(mn.last_per_minute(frame, ["x", "y"], 2), "minute") == [(2,), (3,)]
    matrix = spark.createDataFrame(
        [(1, "a", m, float(m), 10.0 * m) for m in (1, 2, 3)], "date int, ticker string, minute int, x double, y double"
    )
    s = mn.trailing_summary(matrix, ["x", "y"]).first()
    want = np.std([1, 2, 3])
    assert (s["x__mean"], s["x__last"], s["x__change"]) == (2, 3, 2) and np.isclose(s["x__std"], want)
    assert (s["y__mean"], s["y__last"], s["y__change"]) == (20, 30, 20) and np.isclose(s["y__std"], 10 * want)
    assert np.isnan(mn.trailing_summary(last, ["y"]).first()["y__mean"])


def test_modalities_trim_before_the_join(spark):
    def frame(minutes, name):
        return spark.createDataFrame([(1, "a", m, float(m)) for m in minutes], f"date int, ticker string, minute int, {name} double")

    one = mn.trailing(frame([1, 2, 3, 4], "x"), 2)
    two = mn.trailing(frame([2, 3], "y"), 2)
    # Minute 2 is common to both raw sets but trimmed from the first.
    assert rows(mn.merge_modalities([one, two], 2), "minute") == [(3,)]


def test_median_fill_and_scaler_use_train_only(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(1, 1.0, True), (2, 3.0, True), (3, nan, True), (4, None, False), (5, 100.0, False)],
        "i int, x double, train boolean",
    )
    filled = mn.median_fill(frame, ["x"], F.col("train"))
    assert [r.x for r in filled.orderBy("i").collect()] == [1, 3, 2, 2, 100]
    scaler = mn.fit_scaler(frame, ["x"], F.col("train"))
    got = mn.standardize(frame, ["x"], scaler, "train").orderBy("i").collect()
    assert [r.x for r in got] == [-1, 1, 0, 0, 10] and [r.available for r in got] == [1, 1, 1, 0, 0]
