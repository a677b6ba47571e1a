"""Queries over experiment tables (X), checks (Q), models (G), scalars and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.panel import scratch
from tapeloom.catalog.ranks import round_columns
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions import scalars as sc
from tapeloom.functions.stats import is_finite, is_positive
from tapeloom.operators import experiments as ex
from tapeloom.operators import labels as lab
from tapeloom.operators import models as ml
from tapeloom.operators import quality as qa
from tapeloom.plans.shared import settle
from tapeloom.sources import files

# ---- experiment tables -----------------------------------------------------


def metrics(spark, sf_dir):
    """Order statistics per market segment (experiment) and priority (seed)."""
    orders = fx.table(spark, sf_dir, "orders")
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("experiment_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("seed"),
        "o_totalprice",
        "o_orderstatus",
    )
    named = {
        "price_mean": F.avg("o_totalprice"),
        "finished_share": F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) - 0.33,
        "price_spread": F.stddev_samp("o_totalprice"),
    }
    return ex.metric_paths(named, rows, ["experiment_id", "seed"])


define_view(
    "metrics",
    (),
    """SELECT experiment_id, seed, metric, value FROM (SELECT c_mktsegment AS experiment_id,
      CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS seed, avg(o_totalprice) AS price_mean,
      avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) - 0.33 AS finished_share,
      stddev_samp(o_totalprice) AS price_spread
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    UNPIVOT (value FOR metric IN (price_mean, finished_share, price_spread))""",
)


def experiments(spark, sf_dir):
    """One experiment per customer nation, described by its orders."""
    orders = fx.table(spark, sf_dir, "orders")
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = F.col("c_nationkey")
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("completed", "failed", "running", "frozen")]),
        nation % 4 + 1,
    )
    decision = F.element_at(
        F.array(*[F.lit(s) for s in ("KEEP", "DISCARD", "EXTEND")]), nation % 3 + 1
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(
            F.max("o_orderdate").alias("last_order"),
            F.count(F.lit(1)).alias("orders"),
            F.max("o_orderkey").alias("review_id"),
        )
        .select(
            F.format_string("exp-%02d", nation).alias("experiment_id"),
            status.alias("status"),
            decision.alias("decision"),
            F.date_add(F.to_date("last_order"), nation).alias("created_at"),
            F.when(nation % 5 > 0, F.concat(F.lit("sig-"), nation % 7)).alias("signature"),
            F.when(nation % 2 == 0, "audit_anomalies").otherwise("design").alias("review_type"),
            "review_id",
            "orders",
        )
    )


define_view(
    "exps",
    (),
    """SELECT 'exp-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS experiment_id,
      ['completed', 'failed', 'running', 'frozen'][c_nationkey % 4 + 1] AS status,
      ['KEEP', 'DISCARD', 'EXTEND'][c_nationkey % 3 + 1] AS decision,
      CAST(max(o_orderdate) AS DATE) + c_nationkey AS created_at,
      CASE WHEN c_nationkey % 5 > 0 THEN 'sig-' || (c_nationkey % 7) END AS signature,
      CASE WHEN c_nationkey % 2 = 0 THEN 'audit_anomalies' ELSE 'design' END AS review_type,
      max(o_orderkey) AS review_id, count(*) AS orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""",
)


def reviews(spark, sf_dir):
    """One review per experiment; its payload lists one anomaly per 200 orders, at most four."""
    anomaly = lambda i: F.struct(
        F.concat(F.lit("type-"), i.cast("string")).alias("type"), F.lit("high").alias("severity")
    )
    count = F.least(F.col("orders") / 200 + 1, F.lit(4)).cast("int")
    payload = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), count), anomaly).alias("anomalies")))
    return experiments(spark, sf_dir).select(
        "review_id", "experiment_id", "review_type", payload.alias("payload")
    )


GATES = [
    ("price_mean", "gt", 250000.0),
    ("finished_share", "gte", 0.0),
    ("price_spread", "lt", 150000.0),
    ("absent_metric", "lte", 1.0),
]
define_view(
    "gates",
    ("metrics",),
    """SELECT e.experiment_id, g.metric, g.operator, g.threshold, mean_value,
      5 - coalesce(n, 0) AS missing_seeds,
      coalesce(CASE g.operator WHEN 'gt' THEN mean_value > threshold
        WHEN 'gte' THEN mean_value >= threshold WHEN 'lt' THEN mean_value < threshold
        ELSE mean_value <= threshold END, false) AS passed
    FROM (SELECT DISTINCT experiment_id FROM metrics) e,
      (VALUES ('price_mean', 'gt', 250000.0::DOUBLE), ('finished_share', 'gte', 0.0::DOUBLE),
        ('price_spread', 'lt', 150000.0::DOUBLE), ('absent_metric', 'lte', 1.0::DOUBLE))
        g(metric, operator, threshold)
    LEFT JOIN (SELECT experiment_id, metric, avg(value) AS mean_value, count(*) AS n FROM metrics
      GROUP BY ALL) m ON m.experiment_id = e.experiment_id AND m.metric = g.metric""",
)


@query(
    "X1_gate_evidence",
    with_sql("gates")
    + """SELECT experiment_id, metric, operator, threshold, round(mean_value, 6) AS mean_value,
      missing_seeds, passed FROM gates""",
)
def gate_evidence(spark, sf_dir):
    out = ex.gate_evidence(metrics(spark, sf_dir), GATES)
    return out.withColumn("mean_value", rounded("mean_value", 6))


@query(
    "X1_gate_decision",
    with_sql("gates")
    + """SELECT experiment_id, CASE WHEN bool_and(passed) THEN 'EXTEND' ELSE 'DISCARD' END AS decision,
      count(*) FILTER (WHERE passed) AS gates_passed FROM gates WHERE metric <> 'absent_metric'
    GROUP BY experiment_id""",
)
def gate_decision(spark, sf_dir):
    return ex.gate_decision(ex.gate_evidence(metrics(spark, sf_dir), GATES[:3]), "screening")


@query(
    "X2_compare_to_baseline",
    with_sql("metrics")
    + """, p AS (SELECT m.*, m.value - b.value AS d FROM metrics m LEFT JOIN metrics b
      ON b.metric = m.metric AND b.seed = m.seed AND b.experiment_id = 'MACHINERY'),
    s AS (SELECT metric, CASE WHEN metric = 'price_spread' THEN -1.0 ELSE 1.0 END AS sign,
      avg(value) AS bm FROM metrics WHERE experiment_id = 'MACHINERY' GROUP BY metric)
    SELECT experiment_id, metric, count(value) AS count, round(avg(value), 5) AS mean,
      round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max,
      count(d) AS paired_seed_count, round(avg(d), 5) + 0.0 AS paired_delta_mean,
      round(stddev_samp(d), 5) AS paired_delta_std,
      round(avg(value) - any_value(bm), 5) + 0.0 AS delta_vs_baseline_mean,
      round(any_value(sign) * (avg(value) - any_value(bm)), 5) + 0.0 AS improvement_vs_baseline_mean,
      round(any_value(sign) * avg(d), 5) + 0.0 AS paired_improvement_mean
    FROM p JOIN s USING (metric) GROUP BY experiment_id, metric""",
)
def compare(spark, sf_dir):
    out = ex.compare_to_baseline(metrics(spark, sf_dir), "MACHINERY", ("price_spread",))
    keep = ("experiment_id", "metric", "count", "paired_seed_count")
    return round_columns(out, keep, 5)


@query(
    "X3_walk_forward_summary",
    with_sql("metrics")
    + """, w AS (SELECT experiment_id, metric, avg(value) AS m, CASE WHEN metric = 'price_spread'
      THEN -1.0 ELSE 1.0 END AS sign FROM metrics GROUP BY experiment_id, metric)
    SELECT metric, count(*) AS window_count, round(avg(m), 5) AS window_mean,
      round(stddev_samp(m), 5) AS window_std, round(min(m), 5) AS window_min,
      round(max(m), 5) AS window_max,
      round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 5) AS above_zero_window_ratio,
      round(arg_min(m, sign * m), 5) AS worst_window_value,
      arg_min(experiment_id, sign * m) AS worst_window_experiment_id FROM w GROUP BY metric""",
)
def walk_forward(spark, sf_dir):
    out = ex.walk_forward_summary(metrics(spark, sf_dir), ("price_spread",))
    return round_columns(out, ("metric", "window_count", "worst_window_experiment_id"), 5)


@query(
    "X4_average_metrics",
    with_sql("metrics")
    + """SELECT experiment_id, metric, round(avg(value), 5) AS mean_value FROM metrics
    WHERE experiment_id IN ('BUILDING', 'MACHINERY') GROUP BY experiment_id, metric""",
)
def average_metrics(spark, sf_dir):
    out = ex.average_metrics(metrics(spark, sf_dir), ("BUILDING", "MACHINERY"))
    return out.withColumn("mean_value", rounded("mean_value", 5))


@query(
    "X4_list_reviews",
    with_sql("exps")
    + """SELECT review_id, experiment_id, status AS experiment_status,
      decision AS experiment_decision FROM exps WHERE review_type = 'audit_anomalies'
    ORDER BY review_id DESC LIMIT 8""",
)
def list_reviews(spark, sf_dir):
    out = ex.list_reviews(
        reviews(spark, sf_dir), experiments(spark, sf_dir), "audit_anomalies", 8
    )
    return out.select("review_id", "experiment_id", "experiment_status", "experiment_decision")


@query(
    "X5_recent_experiments",
    with_sql("exps")
    + """SELECT experiment_id, status, created_at FROM exps
    ORDER BY created_at DESC, experiment_id LIMIT 10""",
)
def recent(spark, sf_dir):
    return ex.recent_experiments(experiments(spark, sf_dir), 10).select(
        "experiment_id", "status", "created_at"
    )


@query(
    "X5_failures",
    with_sql("exps")
    + """SELECT experiment_id, status, decision FROM exps WHERE status IN ('failed', 'rejected')
      OR decision = 'DISCARD' ORDER BY created_at DESC, experiment_id LIMIT 6""",
)
def failures(spark, sf_dir):
    return ex.failures(experiments(spark, sf_dir), 6).select("experiment_id", "status", "decision")


@query(
    "X5_distinct_signatures",
    with_sql("exps")
    + """SELECT signature, max(created_at) AS last_used FROM exps WHERE signature IS NOT NULL
    GROUP BY signature""",
)
def signatures(spark, sf_dir):
    return ex.distinct_signatures(experiments(spark, sf_dir))


@query(
    "X5_baseline_experiment",
    with_sql("exps")
    + """SELECT experiment_id, status, decision FROM exps
    WHERE status IN ('completed', 'frozen', 'locked_tested') AND decision IN ('KEEP', 'EXTEND')
    ORDER BY decision <> 'KEEP', created_at DESC, experiment_id LIMIT 1""",
)
def baseline(spark, sf_dir):
    return ex.baseline_experiment(experiments(spark, sf_dir)).select(
        "experiment_id", "status", "decision"
    )


@query(
    "X5_review_anomalies",
    with_sql("exps")
    + """SELECT review_id, experiment_id, status AS experiment_status, CAST(i - 1 AS INTEGER) AS place,
      'type-' || i AS type, 'high' AS severity FROM exps, range(1, 5) r(i)
    WHERE review_type = 'audit_anomalies'
      AND i <= least(CAST(floor(orders / 200 + 1) AS INTEGER), 4)""",
)
def anomalies(spark, sf_dir):
    return ex.review_anomalies(reviews(spark, sf_dir), experiments(spark, sf_dir))


@query(
    "X6_export_counts",
    with_sql("preds")
    + """SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols,
      count(DISTINCT label_date) AS dates FROM preds""",
)
def export_counts(spark, sf_dir):
    return ex.export_counts(fx.preds(spark, sf_dir))


# ---- checks ----------------------------------------------------------------


@query(
    "Q1_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    return qa.duplicate_keys(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "Q2_value_violations",
    with_sql("bars")
    + """SELECT symbol, trading_date, CASE WHEN open <= 1000 THEN 'open too low'
      WHEN volume % 10 = 0 THEN 'volume rounded' ELSE 'late' END AS reason FROM bars
    WHERE open <= 1000 OR volume % 10 = 0 OR trading_date > DATE '2001-06-01'""",
)
def value_violations(spark, sf_dir):
    rules = {
        "open not finite": is_finite("open"),
        "open too low": F.col("open") > 1000,
        "volume rounded": F.col("volume") % 10 != 0,
        "late": F.col("trading_date") <= F.lit("2001-06-01").cast("date"),
    }
    return qa.violations(fx.bars(spark, sf_dir), rules).select("symbol", "trading_date", "reason")


@query(
    "Q3_prediction_contract",
    with_sql("preds", "cal")
    + """SELECT label_date, count(DISTINCT p.trading_date) AS signal_dates,
      count(DISTINCT c.next_date) AS end_dates, count(*) AS rows,
      count(*) FILTER (WHERE in_universe) AS candidates,
      count(*) FILTER (WHERE NOT can_buy) AS cannot_buy,
      count(*) FILTER (WHERE NOT can_sell) AS cannot_sell,
      count(DISTINCT p.trading_date) = 1 AND count(DISTINCT c.next_date) = 1
        AND count(*) FILTER (WHERE in_universe) = 85 AS valid
    FROM preds p JOIN cal c ON c.trading_date = p.label_date GROUP BY label_date""",
)
def prediction_contract(spark, sf_dir):
    rows = fx.preds(spark, sf_dir)
    sessions = fx.cal_ops.trading_calendar(fx.bars(spark, sf_dir)).select(
        F.col("trading_date").alias("label_date"), F.col("next_date").alias("return_end_date")
    )
    return qa.prediction_contract(rows.join(sessions, "label_date"), 85)


@query(
    "Q4_locked_period",
    with_sql("preds")
    + """SELECT greatest(max(trading_date), max(label_date)) AS latest,
      greatest(max(trading_date), max(label_date)) < DATE '2001-06-01' AS safe FROM preds""",
)
def locked_period(spark, sf_dir):
    return qa.locked_period(
        fx.preds(spark, sf_dir), ["trading_date", "label_date"], "2001-06-01"
    )


@query(
    "Q5_key_coverage",
    """SELECT count(*) FILTER (WHERE o AND l) AS shared, count(*) FILTER (WHERE o AND NOT l) AS missing,
      count(*) FILTER (WHERE l AND NOT o) AS extra,
      count(*) FILTER (WHERE o AND l) / count(*) FILTER (WHERE o) AS coverage,
      count(*) FILTER (WHERE o AND l) / count(*) FILTER (WHERE o) >= 0.9 AS covered
    FROM (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS o, b.k IS NOT NULL AS l
      FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a
      FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b
      ON a.k = b.k)""",
)
def key_coverage(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    lines = fx.table(spark, sf_dir, "lineitem")
    return qa.coverage(
        orders.select(F.col("o_orderkey").alias("key")),
        lines.select(F.col("l_orderkey").alias("key")),
        ["key"],
    )


@query(
    "Q6_table_fingerprint",
    """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(to_json({
      'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus,
      'o_orderpriority': o_orderpriority})), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest FROM orders""",
)
def fingerprint(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return qa.fingerprint(fx.table(spark, sf_dir, "orders"), columns)


@query(
    "Q7_partition_counts",
    """WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders
      GROUP BY period),
    a AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS n FROM lineitem
      GROUP BY period)
    SELECT period, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual,
      coalesce(e.n = a.n, false) AS matches FROM e FULL JOIN a USING (period)""",
)
def partition_counts(spark, sf_dir):
    """Lines by ship month against a manifest made from the orders by order month."""
    orders = fx.table(spark, sf_dir, "orders")
    expected = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("expected")
    )
    shipped = fx.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("period")
    )
    return qa.partition_counts(expected, shipped)


# ---- models ----------------------------------------------------------------

FEATURES = ["gap", "range", "log_volume"]


def model_rows(spark, sf_dir):
    """Labelled stock-days with three bar features; early periods train."""
    indexed, _, market = fx.panel(spark, sf_dir)
    targets = lab.next_day_targets(
        indexed, market, keep=["open", "high", "low", "close", "volume"]
    )
    labelled = lab.quantile_labels(targets, ["label_date"], min_cross_section=fx.MIN_CROSS_SECTION)
    rows = labelled.withColumns(
        {
            "gap": F.log(F.col("close") / F.col("open")),
            "range": F.log(F.col("high") / F.col("low")),
            "log_volume": F.log("volume"),
        }
    )
    return settle(rows, "modelrows")


def split_rows(rows):
    cut = F.lit("1999-01-01").cast("date")
    return rows.where(F.col("label_date") < cut), rows.where(F.col("trading_date") >= cut)


PREDICTION_KEYS = ["symbol", "trading_date", "label_date", "label", "target_return"]


def judged(scored):
    """Keys and, of the prediction itself, what holds for any model."""
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return scored.select(
        *PREDICTION_KEYS,
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.abs(F.col("score") - (p[2] - p[0])) < 1e-12).alias("score_is_up_minus_down"),
        (F.element_at(p, F.col("predicted") + 1) == F.array_max(p)).alias("class_is_likeliest"),
    )


JUDGED_SQL = with_sql("labelled") + """SELECT symbol, trading_date, label_date, label, target_return,
  true AS sums_to_one, true AS score_is_up_minus_down, true AS class_is_likeliest FROM labelled"""
TEST_ROWS = " WHERE trading_date >= DATE '1999-01-01'"


@query("G1_logistic_baseline")
def logistic(spark, sf_dir):
    train, test = split_rows(model_rows(spark, sf_dir))
    model = ml.fit_logistic(train, FEATURES, max_iter=30)
    return ml.prediction_rows(ml.score_rows(model, test, PREDICTION_KEYS))


@query("G1_logistic_contract", JUDGED_SQL + TEST_ROWS)
def logistic_contract(spark, sf_dir):
    train, test = split_rows(model_rows(spark, sf_dir))
    model = ml.fit_logistic(train, FEATURES, max_iter=30)
    return judged(ml.score_rows(model, test, PREDICTION_KEYS))


@query("G2_tree_contract", JUDGED_SQL + TEST_ROWS)
def forest_contract(spark, sf_dir):
    train, test = split_rows(model_rows(spark, sf_dir))
    model = ml.fit_forest(train, FEATURES, trees=20)
    return judged(ml.score_rows(model, test, PREDICTION_KEYS))


@query("G4_scoring_contract", JUDGED_SQL)
def scoring_contract(spark, sf_dir):
    """Every row of the keyed table is scored, whatever split fitted the model."""
    rows = model_rows(spark, sf_dir)
    model = ml.fit_forest(split_rows(rows)[0], FEATURES, trees=10, depth=4)
    return judged(ml.score_rows(model, rows, PREDICTION_KEYS))


@query("G2_tree_ensemble")
def forest(spark, sf_dir):
    train, test = split_rows(model_rows(spark, sf_dir))
    model = ml.fit_forest(train, FEATURES, trees=20)
    return ml.prediction_rows(ml.score_rows(model, test, PREDICTION_KEYS))


@query("G2_boosted_one_vs_rest")
def boosted(spark, sf_dir):
    train, test = split_rows(model_rows(spark, sf_dir))
    model = ml.fit_boosted(train, FEATURES, rounds=5, depth=3)
    return model.transform(test).select(
        *PREDICTION_KEYS, F.col("_c").cast("int").alias("predicted")
    )


def embedding_rows(spark, sf_dir):
    """Vectors of the embedding table, keyed by symbol."""
    return fx.table(spark, sf_dir, "embeddings").select(
        sc.pad_symbol(F.col("vec_id")).alias("symbol"), "embedding"
    )


@query(
    "G3_feature_sets",
    with_sql("bars")
    + """SELECT name, symbol, trading_date, CASE name WHEN 'minute' THEN 2 WHEN 'embedding'
        THEN len(embedding) ELSE 2 + len(embedding) END AS width,
      CASE name WHEN 'embedding' THEN CAST(embedding[1] AS DOUBLE) ELSE volume END AS first_value,
      CASE name WHEN 'minute' THEN open ELSE CAST(embedding[len(embedding)] AS DOUBLE) END
        AS last_value
    FROM bars JOIN embeddings ON symbol = CASE WHEN length(CAST(vec_id AS VARCHAR)) >= 6
      THEN CAST(vec_id AS VARCHAR) ELSE lpad(CAST(vec_id AS VARCHAR), 6, '0') END,
      (SELECT unnest(['minute', 'embedding', 'combined']) AS name)""",
)
def feature_sets(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    vectors = embedding_rows(spark, sf_dir)
    out = None
    for name in ml.FEATURE_SETS:
        part = ml.feature_set(rows, vectors, ["volume", "open"], name, ["symbol"]).select(
            F.lit(name).alias("name"),
            "symbol",
            "trading_date",
            F.size("features").alias("width"),
            F.element_at("features", 1).alias("first_value"),
            F.element_at("features", -1).alias("last_value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("G4_batch_scoring")
def batch_scoring(spark, sf_dir):
    """Fit on one split, score the whole keyed table, write and read the prediction schema."""
    rows = model_rows(spark, sf_dir)
    train, _ = split_rows(rows)
    model = ml.fit_forest(train, FEATURES, trees=10, depth=4)
    path = scratch(spark, "scored")
    ml.prediction_rows(ml.score_rows(model, rows, PREDICTION_KEYS)).write.parquet(path)
    return spark.read.parquet(path)


# ---- scalar functions ------------------------------------------------------


@query(
    "F2_stock_code_and_board",
    """SELECT regexp_matches(code, '^(000|001|002|003|300|301|600|601|603|605|688|689)[0-9]{3}$')
        AS is_code, CAST(ratio AS DOUBLE) AS ratio,
      count(*) AS rows FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 0.05
        WHEN code LIKE '4%' OR code LIKE '8%' THEN 0.30
        WHEN code LIKE '688%' OR code LIKE '689%' THEN 0.20
        WHEN (code LIKE '300%' OR code LIKE '301%') AND day >= DATE '2020-08-24' THEN 0.20
        ELSE 0.10 END AS ratio FROM (SELECT o_orderstatus,
          lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code,
          CAST(o_orderdate AS DATE) + 8400 AS day FROM orders)) GROUP BY is_code, ratio""",
)
def stock_codes(spark, sf_dir):
    code = sc.pad_symbol(F.col("o_orderkey") * 7919 % 1_000_000)
    day = F.date_add(F.to_date("o_orderdate"), 8400)
    ratio = sc.price_limit_ratio(code, day, F.col("o_orderstatus") == "P")
    return (
        fx.table(spark, sf_dir, "orders")
        .groupBy(sc.is_stock_code(code).alias("is_code"), ratio.cast("double").alias("ratio"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "F5_date_parsing",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_number, CAST(o_orderdate AS DATE) AS from_iso,
      strftime(o_orderdate, '%Y-%m') AS month,
      CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS number FROM orders""",
)
def dates(spark, sf_dir):
    day = F.to_date("o_orderdate")
    number = sc.day_number(day)
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sc.parse_day(number).alias("from_number"),
        sc.parse_day(F.date_format(day, "yyyy-MM-dd")).alias("from_iso"),
        sc.month_key(day).alias("month"),
        number.alias("number"),
    )


@query(
    "F6_month_arithmetic",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 7 MONTH AS DATE) AS shifted,
      last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""",
)
def months(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", sc.shift_month(day, 7).alias("shifted"), sc.month_end(day).alias("month_end")
    )


@query(
    "F7_session_timestamp",
    with_sql("ev")
    + """SELECT day, ticker, seq, strftime(CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE
      + to_milliseconds(time_ms), '%Y-%m-%d %H:%M:%S.%g') AS stamp FROM ev""",
)
def timestamps(spark, sf_dir):
    stamp = sc.session_timestamp(F.col("day"), F.col("time_ms"))
    return fx.events(spark, sf_dir).select(
        "day", "ticker", "seq", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp")
    )


@query(
    "F8_cents_and_clipping",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_discount = 0 THEN 0 ELSE CAST(round_even(l_extendedprice / 8 * 100.0, 0) AS BIGINT)
        END AS cents,
      CAST(least(greatest(CAST(floor(l_extendedprice) AS BIGINT) - 20000, 0), 65535) AS INTEGER)
        AS clipped
    FROM lineitem""",
)
def cents(spark, sf_dir):
    price = F.when(F.col("l_discount") != 0, F.col("l_extendedprice") / 8)
    whole = F.floor("l_extendedprice") - 20000
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        sc.to_cents(price).alias("cents"),
        sc.clip_uint16(whole).alias("clipped"),
    )


@query(
    "F9_signed_logs",
    """SELECT event_id, round(ln(1 + greatest(value - 30, 0.0)), 9) AS clamped,
      round(sign(value - 30) * ln(1 + abs(value - 30)), 9) + 0.0 AS signed FROM events""",
)
def logs(spark, sf_dir):
    shifted = F.col("value") - 30
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        rounded(sc.log1p_clamped(shifted)).alias("clamped"),
        rounded(sc.signed_log1p(shifted)).alias("signed"),
    )


@query(
    "F10_bps_distance",
    """SELECT event_id, round(least(greatest(coalesce((value / nullif(k % 40, 0) - 1.0) * 1e4 / 100.0,
      0.0), -50.0), 50.0), 8) + 0.0 AS distance
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
)
def bps(spark, sf_dir):
    reference = F.get_json_object("props", "$.k").cast("int") % 40
    return fx.table(spark, sf_dir, "events").select(
        "event_id", rounded(sc.bps_distance(F.col("value"), reference), 8).alias("distance")
    )


@query(
    "F11_day_phase",
    with_sql("ev")
    + """SELECT day, ticker, seq, round(sin(2.0 * pi() * (t / 1000.0) / 19620.0), 8) + 0.0 AS sine,
      round(cos(2.0 * pi() * (t / 1000.0) / 19620.0), 8) + 0.0 AS cosine,
      CASE WHEN t < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS auction
    FROM (SELECT *, time_ms % 20000000 AS t FROM ev)""",
)
def phase(spark, sf_dir):
    sine, cosine, auction = sc.day_phase(F.col("time_ms") % 20_000_000)
    return fx.events(spark, sf_dir).select(
        "day",
        "ticker",
        "seq",
        rounded(sine, 8).alias("sine"),
        rounded(cosine, 8).alias("cosine"),
        auction.alias("auction"),
    )


@query(
    "F12_code_vocabulary",
    """SELECT code, CASE code WHEN 0 THEN 1 WHEN 10 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5
      WHEN 11 THEN 6 WHEN 12 THEN 7 WHEN 13 THEN 8 WHEN -1 THEN 9 WHEN -11 THEN 10 ELSE 0 END AS id,
      code IN (-1, -11) AS cancel, CASE WHEN code = -1 THEN 1.0::DOUBLE WHEN code = -11 THEN -1.0
        WHEN code >= 10 THEN -1.0 ELSE 1.0 END AS side, count(*) AS rows
    FROM (SELECT CAST(l_quantity AS INTEGER) % 27 - 12 AS code FROM lineitem) GROUP BY code""",
)
def vocabulary(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity").cast("int") % 27 - 12).alias("code")
    )
    code = F.col("code")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).select(
        "code",
        sc.order_type_id(code).alias("id"),
        sc.is_cancel(code).alias("cancel"),
        sc.order_side(code).alias("side"),
        "rows",
    )


@query(
    "F13_top_of_book",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(CASE WHEN bid > 0 THEN (ask - bid) / r * 100.0 ELSE 0.0 END, 8) AS spread_bps,
      round((bv - av) / greatest(bv + av, 1.0), 8) + 0.0 AS imbalance,
      round(CASE WHEN bid > 0 THEN ((ask * bv + bid * av) / greatest(bv + av, 1.0) / r - 1.0) * 100.0
        ELSE 0.0 END, 8) + 0.0 AS micro_bias,
      round(least(greatest((ask * 1.001 / r - 1.0) * 100.0, -50.0), 50.0), 8) AS second_level
    FROM (SELECT *, l_extendedprice * (1 + l_tax) AS ask,
      CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS bid,
      l_quantity AS bv, 50 - l_quantity AS av, l_extendedprice AS r FROM lineitem)""",
)
def top_of_book(spark, sf_dir):
    price = F.col("l_extendedprice")
    ask = price * (1 + F.col("l_tax"))
    bid = F.when(F.col("l_discount") == 0, 0.0).otherwise(price * (1 - F.col("l_discount")))
    sizes = F.col("l_quantity"), 50 - F.col("l_quantity")
    top = sc.top_of_book(bid, ask, *sizes, price)
    levels = sc.level_features(
        F.array(ask, ask * 1.001), F.array(*sizes), F.array(*sizes), price
    )
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        *[rounded(value, 8).alias(name) for name, value in top.items()],
        rounded(levels["price_bps"][1], 8).alias("second_level"),
    )


@query(
    "F18_text_to_bool",
    """SELECT value, flag, count(*) AS rows FROM (SELECT value, CASE WHEN lower(trim(value))
      IN ('true', '1', 'yes') THEN true WHEN lower(trim(value)) IN ('false', '0', 'no') THEN false END
      AS flag FROM (SELECT [' True', 'yes', '1', 'FALSE ', 'no', '0', 'maybe'][l_linenumber % 7 + 1]
        AS value FROM lineitem)) GROUP BY value, flag""",
)
def booleans(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in (" True", "yes", "1", "FALSE ", "no", "0", "maybe")])
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.element_at(words, F.col("l_linenumber") % 7 + 1).alias("value")
    )
    return rows.groupBy("value", sc.to_bool(F.col("value")).alias("flag")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "F23_flatten_numeric_metrics",
    """SELECT o_orderkey, path, number FROM (
      SELECT o_orderkey, 'price.total' AS path, o_totalprice AS number FROM orders
      UNION ALL SELECT o_orderkey, 'price.parts.0', CAST(o_custkey AS DOUBLE) FROM orders
      UNION ALL SELECT o_orderkey, 'price.parts.1', CAST(o_orderkey % 100 AS DOUBLE) FROM orders
      UNION ALL SELECT o_orderkey, 'deep.inner.leaf', CAST(o_orderkey % 7 AS DOUBLE) FROM orders)""",
)
def flatten(spark, sf_dir):
    """Order rows as nested JSON with numbers, a flag and text."""
    nested = F.struct(
        F.struct(
            F.col("o_totalprice").alias("total"),
            F.array("o_custkey", F.col("o_orderkey") % 100).alias("parts"),
        ).alias("price"),
        F.struct(F.struct((F.col("o_orderkey") % 7).alias("leaf")).alias("inner")).alias("deep"),
        (F.col("o_orderstatus") == "F").alias("finished"),
        F.col("o_orderpriority").alias("priority"),
    )
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(nested).alias("json"))
    return sc.flatten_numeric(rows, ["o_orderkey"], "json")


# ---- text and day-file sources ---------------------------------------------


@query(
    "S9_raw_day_files",
    with_sql("ev")
    + """SELECT day, stream, count(*) AS rows, CAST(sum(qty) AS BIGINT) AS qty FROM ev
    GROUP BY day, stream""",
)
def raw_days(spark, sf_dir):
    """Events laid out as daily order and trade files and monthly snapshot files."""
    root = scratch(spark, "raw")
    rows = settle(fx.events(spark, sf_dir), "events")
    stamp = F.date_format("day", "yyyyMMdd")
    for stream in ("order", "trade"):
        name = F.concat(F.lit(f"{stream}_"), stamp, F.lit(".parquet"))
        rows.where(F.col("stream") == stream).select(
            "ticker", "time_ms", "qty", name.alias("file")
        ).write.partitionBy("file").parquet(f"{root}/{stream}")
    name = F.concat(F.lit("snapshot_"), F.date_format("day", "yyyyMM"), F.lit(".parquet"))
    rows.where(F.col("stream") == "snap").select(
        "ticker", "time_ms", "qty", stamp.cast("int").alias("TradingDay"), name.alias("file")
    ).write.partitionBy("file").parquet(f"{root}/snapshot")
    out = files.read_raw_snapshots(spark, root).select("day", F.lit("snap").alias("stream"), "qty")
    for stream in ("order", "trade"):
        out = out.unionByName(
            files.read_raw_days(spark, root, stream).select("day", F.lit(stream).alias("stream"), "qty")
        )
    return out.groupBy("day", "stream").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty")
    )


@query(
    "S10_bar_csv",
    with_sql("bars")
    + """SELECT CASE WHEN volume % 10 = 0 THEN 'open' WHEN volume % 10 = 1 THEN 'trading_date'
      WHEN volume % 10 = 2 THEN 'symbol' END AS problem, count(*) AS rows FROM bars GROUP BY problem""",
)
def bar_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    last = F.col("volume") % 10
    fx.bars(spark, sf_dir).select(
        F.when(last == 2, "").otherwise(F.col("symbol")).alias("symbol"),
        F.when(last == 1, "someday")
        .otherwise(F.date_format("trading_date", "yyyy-MM-dd"))
        .alias("trading_date"),
        F.when(last == 0, "n/a").otherwise(F.col("open").cast("string")).alias("open"),
        F.col("close").cast("string").alias("close"),
    ).write.option("header", True).csv(path)
    return files.read_bar_csv(spark, path).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "S10_benchmark_csv_and_calendar",
    with_sql("bench", "cal")
    + """SELECT c.trading_date, round(b.close / b.open - 1, 9) AS "return" FROM cal c
    LEFT JOIN bench b USING (trading_date)""",
)
def benchmark_csv(spark, sf_dir):
    root = scratch(spark, "text")
    daily = fx.bars(spark, sf_dir)
    market = fx.bench(daily)
    iso = F.date_format("trading_date", "yyyy-MM-dd")
    market.select(
        iso.alias("trading_date"), (F.col("close") / F.col("open") - 1).alias("return")
    ).write.option("header", True).csv(f"{root}/bench")
    daily.select(iso.alias("value")).distinct().write.text(f"{root}/calendar")
    sessions = files.read_calendar_text(spark, f"{root}/calendar")
    returns = files.read_benchmark_csv(spark, f"{root}/bench")
    return sessions.join(returns, "trading_date", "left").select(
        "trading_date", rounded("return").alias("return")
    )


@query(
    "S10_event_manifest_jsonl",
    """SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'trading_date'
      WHEN 2 THEN 'signal_timestamp' WHEN 3 THEN 'features_path' END AS problem, count(*) AS rows
    FROM events GROUP BY problem""",
)
def event_manifest(spark, sf_dir):
    path = scratch(spark, "jsonl")
    case = F.col("event_id") % 5
    good = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("symbol"),
            F.when(case == 1, "2024-13-01")
            .otherwise(F.date_format("ts", "yyyy-MM-dd"))
            .alias("trading_date"),
            F.when(case != 3, F.concat(F.lit("f/"), "event_id")).alias("features_path"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_event_timestamp"),
            F.when(case == 2, "noon")
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'14:57:00"))
            .alias("signal_timestamp"),
        )
    )
    line = F.when(case == 0, F.concat(F.lit("{broken "), "event_id")).otherwise(good)
    fx.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return files.read_event_manifest(spark, path).groupBy("problem").agg(
        F.count(F.lit(1)).alias("rows")
    )
