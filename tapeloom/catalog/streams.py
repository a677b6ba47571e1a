"""Queries over the event streams (E) and the scalar functions they use (F1, F8-F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions.scalars import pad_symbol, to_cents
from tapeloom.operators import events as ev
from tapeloom.operators.calendar import latest_close_before
from tapeloom.plans.shared import settle

ORDER_TYPES = (0, 10, 1, 2, 3, 11, 12, 13, -1, -11)
LEVELS = range(ev.LEVELS)


def streams(spark, sf_dir):
    """Weekly stock-days with order, trade and snapshot fields derived from the event."""
    raw = fx.events(spark, sf_dir)
    cents, qty, k = F.col("cents"), F.col("qty"), F.col("stream")
    order_type = F.element_at(F.array(*[F.lit(t) for t in ORDER_TYPES]), F.pmod("qty", F.lit(10)) + 1)
    bid = F.when(qty % 7 == 0, 0).otherwise(cents - qty)
    ask = F.when(qty % 11 == 0, 0).otherwise(cents + qty)
    ladder = lambda best, sign: F.array(
        *[F.when(best > 0, best + F.lit(sign * i)).otherwise(0) for i in LEVELS]
    )
    snap = k == "snap"
    return (
        raw.withColumn("cents", to_cents(F.col("price")))
        .withColumns({"_bid": bid, "_ask": ask})
        .select(
            "day",
            "ticker",
            "stream",
            "time_ms",
            "seq",
            cents.alias("price"),
            qty.alias("volume"),
            F.when(k == "order", order_type).alias("order_type"),
            F.when(k == "trade", qty % 2).alias("bsflag"),
            F.when(k == "order", (qty * 37 - 500)).alias("cancel_age_ms"),
            F.when(k == "order", qty % 13).alias("cancel_orig_vol"),
            F.when(k == "trade", (qty * 11 - 100)).alias("buy_age_ms"),
            F.when(k == "trade", (qty * 17 - 900)).alias("sell_age_ms"),
            F.when(snap, cents).alias("last"),
            F.when(snap, qty - 40).alias("d_volume"),
            F.when(snap, (qty - 40) * cents).alias("d_turnover"),
            F.when(snap, qty % 5).alias("d_dealnum"),
            F.when(snap, qty * 100).alias("total_bidvol"),
            F.when(snap, qty * 90).alias("total_askvol"),
            F.when(snap, F.col("_bid") - 5).alias("wbid"),
            F.when(snap, F.col("_ask") + 5).alias("wask"),
            F.when(snap, ladder(F.col("_bid"), -1)).alias("bid_px"),
            F.when(snap, ladder(F.col("_ask"), 1)).alias("ask_px"),
            F.when(snap, F.array(*[qty * (i + 1) for i in LEVELS])).alias("bid_vol"),
            F.when(snap, F.array(*[qty * (i + 2) for i in LEVELS])).alias("ask_vol"),
            F.when(snap, F.array(*[qty + i for i in LEVELS])).alias("bid_cnt"),
            F.when(snap, F.array(*[qty + 2 * i for i in LEVELS])).alias("ask_cnt"),
            F.when(snap, ev.snapshot_mid(F.col("_bid"), F.col("_ask"))).alias("mid"),
        )
    )


def weekly_prev_close(rows):
    """Last trade price of an earlier week, in cents; 0 when there is none."""
    closes = (
        rows.where("stream = 'trade'")
        .groupBy(F.col("ticker").alias("symbol"), F.col("day").alias("trading_date"))
        .agg(F.max_by("price", F.struct("time_ms", "seq")).cast("double").alias("close"))
    )
    asked = rows.select(F.col("ticker").alias("symbol"), F.col("day").alias("trading_date"))
    return latest_close_before(asked.distinct(), closes).select(
        F.col("trading_date").alias("day"), F.col("symbol").alias("ticker"), "prev_close"
    )


define_view(
    "st",
    ("ev",),
    """SELECT *, CASE WHEN stream = 'snap' AND m > 0 THEN m END AS mid FROM (
      SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2.0
        ELSE CAST(greatest(bid, ask) AS DOUBLE) END AS m FROM (
        SELECT day, ticker, stream, time_ms, seq, qty, cents AS price,
          CASE stream WHEN 'order' THEN 0 WHEN 'trade' THEN 1 ELSE 2 END AS srank,
          CASE WHEN stream = 'order' THEN
            [0, 10, 1, 2, 3, 11, 12, 13, -1, -11][qty % 10 + 1] END AS order_type,
          CASE WHEN qty % 7 = 0 THEN 0 ELSE cents - qty END AS bid,
          CASE WHEN qty % 11 = 0 THEN 0 ELSE cents + qty END AS ask FROM (
            SELECT *, CAST(round_even(price * 100.0, 0) AS BIGINT) AS cents FROM ev)))""",
)
define_view(
    "merged",
    ("st",),
    """SELECT *, row_number() OVER (PARTITION BY day, ticker ORDER BY time_ms, srank, seq) AS pos,
      count(*) OVER (PARTITION BY day, ticker) AS events FROM st""",
)
define_view(
    "wclose",
    ("st",),
    """SELECT a.day, a.ticker, coalesce(c.close, 0.0) AS prev_close
    FROM (SELECT DISTINCT day, ticker FROM st) a
    ASOF LEFT JOIN (SELECT ticker, day, CAST(last(price ORDER BY time_ms, seq) AS DOUBLE) AS close
      FROM st WHERE stream = 'trade' GROUP BY ticker, day) c
    ON a.ticker = c.ticker AND a.day > c.day""",
)
define_view(
    "refd",
    ("merged", "wclose"),
    """SELECT m.*, lag(time_ms) OVER w AS prev_time_ms,
      coalesce(last_value(mid IGNORE NULLS) OVER (PARTITION BY day, ticker ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        CASE WHEN prev_close > 0 THEN prev_close END,
        max(mid) OVER (PARTITION BY day, ticker), 1.0) AS ref
    FROM merged m JOIN wclose USING (day, ticker)
    WINDOW w AS (PARTITION BY day, ticker ORDER BY pos)""",
)


def _bps(px: str) -> str:
    return (
        f"least(greatest(coalesce((CAST({px} AS DOUBLE) / ref - 1.0) * 1e4 / 100.0, 0.0),"
        " -50.0), 50.0)"
    )


def _log(x: str) -> str:
    return f"ln(1 + greatest(CAST({x} AS DOUBLE), 0.0))"


def _feature_sql() -> dict[str, str]:
    snap = lambda x: f"CASE WHEN stream = 'snap' THEN {x} ELSE 0.0 END"
    depth = "(qty * 1.0 + qty * 2.0)"
    out = {
        "dt_log": _log("(time_ms - coalesce(prev_time_ms, time_ms)) / 1000.0"),
        "price_bps": _bps("price"),
        "volume_log": f"CASE WHEN stream = 'snap' THEN sign(qty - 40) * ln(1 + abs(qty - 40))"
        f" ELSE {_log('qty')} END",
        "side": "CASE WHEN stream = 'order' THEN CASE WHEN order_type = -1 THEN 1.0"
        " WHEN order_type = -11 THEN -1.0 WHEN order_type >= 10 THEN -1.0 ELSE 1.0 END"
        " WHEN stream = 'trade' THEN CASE WHEN qty % 2 = 1 THEN 1.0 ELSE -1.0 END ELSE 0.0 END",
        "cancel": "CASE WHEN order_type IN (-1, -11) THEN 1.0 ELSE 0.0 END",
        "age_log": f"CASE stream WHEN 'order' THEN {_log('(qty * 37 - 500) / 1000.0')}"
        f" WHEN 'trade' THEN {_log('(qty * 11 - 100) / 1000.0')} ELSE 0.0 END",
        "sell_age_log": f"CASE stream WHEN 'trade' THEN {_log('(qty * 17 - 900) / 1000.0')}"
        " ELSE 0.0 END",
        "orig_volume_log": f"CASE stream WHEN 'order' THEN {_log('qty % 13')} ELSE 0.0 END",
        "notional_log": f"CASE stream WHEN 'trade' THEN {_log('price * qty')}"
        f" WHEN 'snap' THEN {_log('abs((qty - 40) * price)')} ELSE 0.0 END",
        "spread_bps": snap("CASE WHEN bid > 0 AND ask > 0 THEN (ask - bid) / ref * 100.0"
                           " ELSE 0.0 END"),
        "imbalance": snap(f"CASE WHEN {depth} > 0 THEN -qty / greatest({depth}, 1.0) ELSE 0.0 END"),
        "micro_bias": snap(
            f"CASE WHEN bid > 0 AND ask > 0 THEN ((CASE WHEN {depth} > 0 THEN"
            f" (ask * qty + bid * qty * 2.0) / greatest({depth}, 1.0) ELSE 0.0 END) / ref - 1.0)"
            " * 100.0 ELSE 0.0 END"
        ),
    }
    for i in LEVELS:
        bid, ask = f"CASE WHEN bid > 0 THEN bid - {i} ELSE 0 END", f"CASE WHEN ask > 0 THEN ask + {i} ELSE 0 END"
        out[f"bid_bps_{i + 1}"] = snap(_bps(f"({bid})"))
        out[f"ask_bps_{i + 1}"] = snap(_bps(f"({ask})"))
        out[f"bid_volume_{i + 1}"] = snap(_log(f"qty * {i + 1}"))
        out[f"ask_volume_{i + 1}"] = snap(_log(f"qty * {i + 2}"))
        out[f"bid_count_{i + 1}"] = snap(_log(f"qty + {i}"))
        out[f"ask_count_{i + 1}"] = snap(_log(f"qty + {2 * i}"))
    angle = "2.0 * pi() * (time_ms / 1000.0) / 19620.0"
    out |= {
        "total_bid_log": snap(_log("qty * 100")),
        "total_ask_log": snap(_log("qty * 90")),
        "wbid_bps": snap(_bps("(bid - 5)")),
        "wask_bps": snap(_bps("(ask + 5)")),
        "deals_log": snap(_log("qty % 5")),
        "phase_sin": f"sin({angle})",
        "phase_cos": f"cos({angle})",
        "auction": "CASE WHEN time_ms < 0 THEN 1.0 ELSE 0.0 END",
    }
    return out


FEATURE_SQL = _feature_sql()
define_view(
    "feat",
    ("refd",),
    "SELECT day, ticker, pos, stream, CASE WHEN stream = 'order' THEN CASE order_type WHEN 0 THEN 1"
    " WHEN 10 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 11 THEN 6 WHEN 12 THEN 7"
    " WHEN 13 THEN 8 WHEN -1 THEN 9 WHEN -11 THEN 10 ELSE 0 END ELSE 0 END AS order_type_id, "
    + ", ".join(f"{sql} AS {name}" for name, sql in FEATURE_SQL.items())
    + " FROM refd",
)


@query(
    "E1_link_cancels",
    """WITH adds AS (SELECT o_orderkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))
        AS t, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
    lines AS (SELECT l_orderkey AS order_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS t FROM lineitem)
    SELECT order_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
      CASE WHEN a.t IS NULL THEN -1 ELSE lines.t - a.t END AS cancel_age_ms,
      coalesce(a.v, 0) AS cancel_orig_vol
    FROM lines LEFT JOIN adds a ON a.o_orderkey = lines.order_id
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 0, 0 FROM adds""",
)
def link_cancels(spark, sf_dir):
    orders, lines = order_stream(spark, sf_dir)
    rows = orders.unionByName(lines, allowMissingColumns=True)
    return ev.link_cancels(rows, keys=()).select(
        "order_id", "line", "part", "supplier", "cancel_age_ms", "cancel_orig_vol"
    )


def order_stream(spark, sf_dir):
    """Orders as additions and their lines as cancellations, time in days."""
    days = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    orders = fx.table(spark, sf_dir, "orders")
    adds = orders.select(
        F.col("o_orderkey").alias("order_id"),
        days("o_orderdate").alias("time_ms"),
        F.floor("o_totalprice").alias("volume"),
        F.lit(0).alias("order_type"),
    )
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        days("l_shipdate").alias("time_ms"),
        F.lit(None).cast("bigint").alias("volume"),
        F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(-11).alias("order_type"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )
    return adds, lines


@query(
    "E2_link_trades",
    """WITH adds AS (SELECT o_orderkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))
        AS t FROM orders)
    SELECT l_orderkey AS buy_id, l_partkey AS sell_id, l_linenumber AS line, l_suppkey AS supplier,
      coalesce(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) - b.t, -1) AS buy_age_ms,
      coalesce(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) - s.t, -1) AS sell_age_ms
    FROM lineitem LEFT JOIN adds b ON b.o_orderkey = l_orderkey
    LEFT JOIN adds s ON s.o_orderkey = l_partkey""",
)
def link_trades(spark, sf_dir):
    adds, lines = order_stream(spark, sf_dir)
    trades = lines.select(
        F.col("order_id").alias("buy_id"), F.col("part").alias("sell_id"), "line", "supplier", "time_ms"
    )
    return ev.link_trades(trades, adds, keys=()).select(
        "buy_id", "sell_id", "line", "supplier", "buy_age_ms", "sell_age_ms"
    )


@query(
    "E3_counter_deltas",
    with_sql("ev")
    + """SELECT day, ticker, seq, qty - lag(qty, 1, 0) OVER w AS d_qty FROM ev
    WINDOW w AS (PARTITION BY day, ticker ORDER BY time_ms, seq)""",
)
def counter_deltas(spark, sf_dir):
    return ev.counter_deltas(fx.events(spark, sf_dir), ["qty"]).select(
        "day", "ticker", "seq", "d_qty"
    )


@query(
    "E4_stream_index",
    with_sql("ev")
    + """SELECT day, stream, ticker, length, CAST(sum(length) OVER (PARTITION BY day, stream
      ORDER BY ticker) - length AS BIGINT) AS "offset" FROM (
      SELECT day, stream, ticker, count(*) AS length FROM ev GROUP BY day, stream, ticker)""",
)
def stream_index(spark, sf_dir):
    return ev.stream_index(fx.events(spark, sf_dir))


@query(
    "E5_merge_streams",
    with_sql("merged") + "SELECT day, ticker, stream, seq, pos, events FROM merged",
)
def merge_streams(spark, sf_dir):
    return ev.merge_streams(fx.events(spark, sf_dir)).select(
        "day", "ticker", "stream", "seq", "pos", "events"
    )


def referenced(spark, sf_dir):
    rows = streams(spark, sf_dir)
    return ev.place_events(rows, weekly_prev_close(rows))


@query(
    "E6_reference_mid",
    with_sql("refd") + "SELECT day, ticker, pos, prev_time_ms, ref FROM refd",
)
def reference_mid(spark, sf_dir):
    return referenced(spark, sf_dir).select("day", "ticker", "pos", "prev_time_ms", "ref")


@query(
    "E7_event_features",
    with_sql("feat")
    + "SELECT day, ticker, pos, stream, order_type_id, "
    + ", ".join(f"round({n}, 8) + 0.0 AS {n}" for n in FEATURE_SQL)
    + " FROM feat",
)
def event_features(spark, sf_dir):
    rows = ev.spread_levels(ev.featurize(referenced(spark, sf_dir)))
    return rows.select(
        "day",
        "ticker",
        "pos",
        "stream",
        "order_type_id",
        *[rounded(n, 8).alias(n) for n in ev.feature_names()],
    )


@query(
    "E8_next_event_targets",
    with_sql("feat")
    + """SELECT day, ticker, pos, next_stream, next_order_type, round(next_price_bps, 8) + 0.0
      AS next_price_bps, round(next_dt_log, 8) AS next_dt_log,
      round(next_volume_log, 8) + 0.0 AS next_volume_log
    FROM (SELECT day, ticker, pos,
      CASE lead(stream) OVER w WHEN 'snap' THEN 1 WHEN 'order' THEN 2 WHEN 'trade' THEN 3 END
        AS next_stream, lead(order_type_id) OVER w AS next_order_type,
      lead(price_bps) OVER w AS next_price_bps, lead(dt_log) OVER w AS next_dt_log,
      lead(volume_log) OVER w AS next_volume_log FROM feat
      WINDOW w AS (PARTITION BY day, ticker ORDER BY pos)) WHERE next_stream IS NOT NULL""",
)
def next_event(spark, sf_dir):
    rows = ev.next_event_targets(ev.featurize(referenced(spark, sf_dir)))
    return rows.withColumns(
        {c: rounded(c, 8) for c in ("next_price_bps", "next_dt_log", "next_volume_log")}
    )


@query(
    "E9_closing_window",
    with_sql("ev")
    + """SELECT day, ticker, seq, from_end, from_end = 1 AS is_target_only FROM (
      SELECT *, row_number() OVER (PARTITION BY day, ticker ORDER BY time_ms DESC,
        CASE stream WHEN 'order' THEN 0 WHEN 'trade' THEN 1 ELSE 2 END DESC, seq DESC)
        AS from_end FROM ev) WHERE from_end <= 6""",
)
def closing_window(spark, sf_dir):
    return ev.closing_window(fx.events(spark, sf_dir), 5).select(
        "day", "ticker", "seq", "from_end", "is_target_only"
    )


def week_labels(rows):
    """Label of a stock-day: mean trade price, where it traded."""
    return rows.where("stream = 'trade'").groupBy("day", "ticker").agg(
        F.avg("price").alias("label")
    )


@query(
    "E10_labelled_stock_days",
    with_sql("ev")
    + """SELECT day, ticker, events, round(label, 8) AS label FROM (SELECT day, ticker,
      count(*) AS events, avg(price) FILTER (WHERE stream = 'trade') AS label FROM ev
      GROUP BY day, ticker) WHERE events >= 6""",
)
def labelled_days(spark, sf_dir):
    rows = fx.events(spark, sf_dir)
    return ev.labelled_stock_days(rows, week_labels(rows), 6).withColumn(
        "label", rounded("label", 8)
    )


@query(
    "E10_label_coverage",
    with_sql("ev")
    + """SELECT count(*) AS stock_days, count(label) AS labelled,
      count(label) / count(*) AS coverage FROM (SELECT day, ticker, count(*) AS events,
      avg(price) FILTER (WHERE stream = 'trade') AS label FROM ev GROUP BY day, ticker)
    WHERE events >= 6""",
)
def coverage(spark, sf_dir):
    rows = fx.events(spark, sf_dir)
    return ev.label_coverage(ev.labelled_stock_days(rows, week_labels(rows), 6))


@query(
    "E11_weighted_picks",
    with_sql("ev")
    + """, n AS (SELECT day, ticker, count(*) AS events FROM ev GROUP BY day, ticker),
    c AS (SELECT *, sum(events) OVER (PARTITION BY day ORDER BY ticker) AS upto,
      sum(events) OVER (PARTITION BY day) AS total FROM n),
    d AS (SELECT day, pick, CAST('0x' || substr(md5('7|' || CAST(day AS VARCHAR) || '|' || pick),
        1, 12) AS BIGINT) % total AS place
      FROM (SELECT day, any_value(total) AS total FROM c GROUP BY day), range(1, 201) r(pick))
    SELECT d.day, CAST(pick AS INTEGER) AS pick, c.ticker FROM d JOIN c
      ON c.day = d.day AND d.place >= c.upto - c.events AND d.place < c.upto""",
)
def weighted_picks(spark, sf_dir):
    rows = fx.events(spark, sf_dir)
    counts = rows.groupBy("day", "ticker").agg(F.count(F.lit(1)).alias("events"))
    return ev.weighted_picks(counts, picks=200, seed=7)


@query(
    "E11_seeded_subset",
    with_sql("ev")
    + """SELECT day, ticker, events FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY
      CAST('0x' || substr(md5('3|' || CAST(day AS VARCHAR) || '|' || ticker), 1, 12) AS BIGINT),
      ticker) AS r FROM (SELECT day, ticker, count(*) AS events FROM ev GROUP BY day, ticker))
    WHERE r <= 25""",
)
def seeded_subset(spark, sf_dir):
    rows = fx.events(spark, sf_dir)
    counts = rows.groupBy("day", "ticker").agg(F.count(F.lit(1)).alias("events"))
    return ev.seeded_subset(counts, 25, seed=3)


@query(
    "E12_window_events",
    with_sql("merged")
    + """SELECT day, ticker, seq, pos - 1 - start AS place FROM (SELECT *, CASE WHEN events < 6
      THEN 0 ELSE CAST('0x' || substr(md5('5|' || CAST(day AS VARCHAR) || '|' || ticker), 1, 12)
        AS BIGINT) % (events - 6 + 1) END AS start FROM merged)
    WHERE pos - 1 >= start AND pos - 1 < least(start + 6, events)""",
)
def window_events(spark, sf_dir):
    merged = ev.merge_streams(fx.events(spark, sf_dir))
    days = merged.select("day", "ticker", "events").distinct()
    starts = ev.window_starts(days, length=5, seed=5)
    return ev.window_events(merged, starts).select(
        "day", "ticker", "seq", (F.col("pos") - 1 - F.col("start")).alias("place")
    )


@query(
    "E13_month_inventory",
    """WITH e AS (SELECT CAST(date_trunc('hour', ts) AS DATE) AS day,
      CASE WHEN event_type IN ('view', 'click') THEN 'order'
        WHEN event_type IN ('purchase', 'signup') THEN 'trade' ELSE 'snap' END AS stream,
      length(props) AS bytes, user_id FROM events),
    d AS (SELECT strftime(day, '%Y-%m') AS month, day, user_id,
      bool_or(stream = 'order') AS o, bool_or(stream = 'trade') AS t, bool_or(stream = 'snap') AS s,
      count(*) FILTER (WHERE stream = 'order') AS orders,
      count(*) FILTER (WHERE stream = 'trade') AS trades,
      count(*) FILTER (WHERE stream = 'snap') AS snaps, sum(bytes) AS bytes
      FROM (SELECT day + CAST(user_id % 150 * 31 AS INTEGER) AS day, stream, bytes, user_id FROM e)
      GROUP BY ALL)
    SELECT month, count(*) FILTER (WHERE o AND t) AS common_days,
      count(*) FILTER (WHERE o AND NOT t) AS order_only_days,
      count(*) FILTER (WHERE t AND NOT o) AS trade_only_days,
      CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(trades) AS BIGINT) AS trades,
      CAST(sum(snaps) AS BIGINT) AS snaps, CAST(sum(bytes) AS BIGINT) AS bytes,
      CASE WHEN count(*) FILTER (WHERE o AND t) > 0 AND count(*) FILTER (WHERE o AND NOT t) = 0
        AND count(*) FILTER (WHERE t AND NOT o) = 0 AND bool_or(s) THEN 'complete'
        ELSE 'incomplete' END AS status
    FROM (SELECT month, day, bool_or(o) AS o, bool_or(t) AS t, bool_or(s) AS s,
      sum(orders) AS orders, sum(trades) AS trades, sum(snaps) AS snaps, sum(bytes) AS bytes
      FROM d GROUP BY month, day) GROUP BY month""",
)
def month_inventory(spark, sf_dir):
    # Users are laid out one after the other in time, so months have gaps in single streams.
    raw = fx.table(spark, sf_dir, "events")
    rows = fx.events(spark, sf_dir).select("seq", "stream").join(
        raw.select(
            F.col("event_id").alias("seq"),
            F.date_add(F.to_date("ts"), (F.col("user_id") % 150 * 31).cast("int")).alias("day"),
            F.length("props").alias("bytes"),
        ),
        "seq",
    )
    return ev.month_inventory(rows)


@query(
    "E14_daily_universe",
    with_sql("ev") + "SELECT DISTINCT day, ticker FROM ev WHERE stream = 'trade'",
)
def daily_universe(spark, sf_dir):
    return ev.daily_universe(fx.events(spark, sf_dir).where("stream = 'trade'"))


@query(
    "E14_universe_sizes",
    with_sql("ev")
    + """, u AS (SELECT DISTINCT day, ticker FROM ev WHERE stream = 'trade')
    SELECT count(*) AS days, min(n) AS smallest, quantile_cont(n, 0.5) AS median,
      max(n) AS largest, (SELECT count(DISTINCT ticker) FROM u) AS union_size
    FROM (SELECT day, count(*) AS n FROM u GROUP BY day)""",
)
def universe_sizes(spark, sf_dir):
    return ev.universe_sizes(
        ev.daily_universe(fx.events(spark, sf_dir).where("stream = 'trade'"))
    )


@query(
    "E15_identity_rows",
    with_sql("ev")
    + """SELECT stream AS partition, row_number() OVER (PARTITION BY stream
      ORDER BY day, ticker, seq) - 1 AS row_index, day, ticker, seq FROM ev""",
)
def identity_rows(spark, sf_dir):
    rows = fx.events(spark, sf_dir).withColumnRenamed("stream", "partition")
    return ev.identity_rows(rows, "partition", ["day", "ticker", "seq"]).select(
        "partition", "row_index", "day", "ticker", "seq"
    )


@query(
    "E15_identity_mismatches",
    with_sql("ev")
    + """SELECT stream AS partition, row_index, CASE WHEN qty % 10 = 0 THEN 'day differs'
      ELSE 'value differs' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY stream
      ORDER BY day, ticker, seq) - 1 AS row_index FROM ev) WHERE qty % 10 IN (0, 1)""",
)
def identity_mismatches(spark, sf_dir):
    rows = fx.events(spark, sf_dir).withColumnRenamed("stream", "partition")
    identity = settle(ev.identity_rows(rows, "partition", ["day", "ticker", "seq"]), "identity")
    broken = identity.withColumns(
        {
            "day": F.when(F.col("qty") % 10 == 0, F.date_add("day", 1)).otherwise(F.col("day")),
            "price": F.when(F.col("qty") % 10 == 1, F.col("price") + 1).otherwise(F.col("price")),
        }
    )
    return ev.identity_mismatches(
        identity, broken, "price", {"relative": 1e-6, "absolute": 1e-7}
    )


@query(
    "F1_session_and_universe_filter",
    with_sql("ev")
    + """SELECT e.day, e.ticker, e.seq FROM ev e SEMI JOIN (SELECT DISTINCT day, ticker FROM ev
      WHERE stream = 'snap') u ON e.day = u.day AND e.ticker = u.ticker
    WHERE time_ms >= -300000 AND time_ms < 196200000""",
)
def session_filter(spark, sf_dir):
    from tapeloom.functions.scalars import in_session

    rows = fx.events(spark, sf_dir)
    listed = rows.where("stream = 'snap'")
    kept = rows.where(in_session(F.col("time_ms"), end_ms=196_200_000))
    return ev.in_universe(kept, listed).select("day", "ticker", "seq")


@query(
    "F4_pad_and_strip_symbols",
    """SELECT o_orderkey, CASE WHEN length(CAST(o_custkey AS VARCHAR)) >= 6
      THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS symbol,
      split_part(o_custkey || '.' || o_orderpriority, '.', 1) AS code FROM orders""",
)
def symbols(spark, sf_dir):
    from tapeloom.functions.scalars import strip_suffix

    rows = fx.table(spark, sf_dir, "orders")
    suffixed = F.concat_ws(".", F.col("o_custkey").cast("string"), "o_orderpriority")
    return rows.select(
        "o_orderkey", pad_symbol(F.col("o_custkey")).alias("symbol"), strip_suffix(suffixed).alias("code")
    )
