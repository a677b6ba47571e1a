"""Queries over ranking metrics (R) and the label functions they use (F15, F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions.scalars import direction_score, predicted_class
from tapeloom.operators import labels as lab
from tapeloom.operators import ranking as rk
from tapeloom.plans.shared import settle

MIN = fx.MIN_CROSS_SECTION


def round_columns(rows, keep, places=9):
    return rows.select(
        *keep, *[rounded(c, places).alias(c) for c in rows.columns if c not in keep]
    )


define_view(
    "rk",
    ("preds",),
    """SELECT *, row_number() OVER (PARTITION BY label_date ORDER BY score, symbol) AS sp,
      row_number() OVER (PARTITION BY label_date ORDER BY target_return, symbol) AS rp,
      row_number() OVER (PARTITION BY label_date ORDER BY score DESC, symbol) AS place,
      rank() OVER (PARTITION BY label_date ORDER BY score)
        + (count(*) OVER (PARTITION BY label_date, score) - 1) / 2.0 AS sa,
      rank() OVER (PARTITION BY label_date ORDER BY target_return)
        + (count(*) OVER (PARTITION BY label_date, target_return) - 1) / 2.0 AS ra,
      count(*) OVER (PARTITION BY label_date) AS n FROM preds""",
)


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


define_view(
    "ic",
    ("rk",),
    f"""SELECT * FROM (SELECT label_date, count(*) AS symbols, {corr('sa', 'ra')} AS rank_ic
    FROM rk GROUP BY label_date) WHERE symbols >= 5 AND rank_ic IS NOT NULL""",
)


def daily_ic(spark, sf_dir):
    return rk.rank_ic(fx.preds(spark, sf_dir), min_symbols=MIN)


@query(
    "R1_rank_ic_average_ties",
    with_sql("ic") + "SELECT label_date, symbols, round(rank_ic, 9) AS rank_ic FROM ic",
)
def rank_ic_average(spark, sf_dir):
    return round_columns(daily_ic(spark, sf_dir), ("label_date", "symbols"))


@query(
    "R2_rank_ic_ordinal",
    with_sql("rk")
    + f"""SELECT label_date, count(*) AS symbols, round({corr('sp', 'rp')}, 9) AS rank_ic FROM rk
    GROUP BY label_date HAVING count(*) >= 5""",
)
def rank_ic_ordinal(spark, sf_dir):
    daily = rk.rank_ic(fx.preds(spark, sf_dir), ties="ordinal", min_symbols=MIN)
    return round_columns(daily, ("label_date", "symbols"))


@query(
    "R3_tail_spread",
    with_sql("rk")
    + """SELECT label_date, any_value(n) AS symbols,
      round(avg(target_return) FILTER (WHERE sp > n - greatest(1, CAST(floor(n * 0.1) AS BIGINT)))
        - avg(target_return) FILTER (WHERE sp <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))), 9)
        AS spread FROM rk WHERE n >= 5 GROUP BY label_date""",
)
def tail_spread(spark, sf_dir):
    daily = rk.tail_spread(fx.preds(spark, sf_dir), quantile=0.1, min_symbols=MIN)
    return round_columns(daily, ("label_date", "symbols"))


@query(
    "R4_ic_summary",
    with_sql("ic")
    + """SELECT count(*) AS dates, round(avg(rank_ic), 9) AS mean,
      round(stddev_samp(rank_ic), 9) AS std,
      round(avg(rank_ic) / stddev_samp(rank_ic), 9) AS ir FROM ic""",
)
def ic_summary(spark, sf_dir):
    return round_columns(rk.ic_summary(daily_ic(spark, sf_dir)), ("dates",))


# ---- classification --------------------------------------------------------


def three_class(spark, sf_dir):
    """Quantile label against the class of made-up probabilities of the score."""
    p = fx.preds(spark, sf_dir)
    labelled = lab.quantile_labels(p, ["label_date"], min_cross_section=MIN)
    up = 0.45 + 0.4 * F.col("score") / (1 + F.abs("score"))
    return labelled.withColumn("prob", F.array(0.9 - up, F.lit(0.1), up))


define_view(
    "cls",
    ("preds",),
    """SELECT *, CASE WHEN p0 >= 0.1 AND p0 >= p2 THEN 0 WHEN p2 > 0.1 THEN 2 ELSE 1 END AS guess
    FROM (SELECT p.*, 0.45 + 0.4 * score / (1 + abs(score)) AS p2,
      0.9 - (0.45 + 0.4 * score / (1 + abs(score))) AS p0,
      CASE WHEN target_return < lo THEN 0 WHEN target_return > hi THEN 2 ELSE 1 END AS label
    FROM preds p JOIN (SELECT label_date, quantile_cont(target_return, 0.2) AS lo,
      quantile_cont(target_return, 0.8) AS hi FROM preds GROUP BY label_date
      HAVING count(*) >= 5) q USING (label_date))""",
)
define_view(
    "creport",
    ("cls",),
    """SELECT c AS class, h AS hits, s AS support, p AS predicted,
      coalesce(h / nullif(p, 0), 0.0) AS precision, coalesce(h / nullif(s, 0), 0.0) AS recall,
      coalesce(2.0 * h / nullif(s + p, 0), 0.0) AS f1 FROM (
      SELECT c, count(*) FILTER (WHERE label = c AND guess = c) AS h,
        count(*) FILTER (WHERE label = c) AS s, count(*) FILTER (WHERE guess = c) AS p
      FROM cls, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c)""",
)


@query(
    "F16_direction_score_and_class",
    with_sql("cls")
    + """SELECT symbol, label_date, round(p2 - p0, 9) + 0.0 AS direction, guess AS predicted
    FROM cls""",
)
def direction(spark, sf_dir):
    rows = three_class(spark, sf_dir)
    return rows.select(
        "symbol",
        "label_date",
        rounded(direction_score(F.col("prob"))).alias("direction"),
        predicted_class(F.col("prob")).alias("predicted"),
    )


def report_of(spark, sf_dir):
    rows = three_class(spark, sf_dir).withColumn("guess", predicted_class(F.col("prob")))
    return rk.class_report(rk.confusion(rows, "label", "guess"), (0, 1, 2))


@query(
    "R5_class_report",
    with_sql("creport")
    + """SELECT class, hits, support, predicted, round(precision, 9) AS precision,
      round(recall, 9) AS recall, round(f1, 9) AS f1 FROM creport""",
)
def class_report(spark, sf_dir):
    return round_columns(
        report_of(spark, sf_dir), ("class", "hits", "support", "predicted")
    )


SUMMARY_SQL = """SELECT CAST(sum(support) AS BIGINT) AS rows,
  round(sum(hits) / sum(support), 9) AS accuracy,
  round(avg(f1) FILTER (WHERE support > 0 OR predicted > 0), 9) AS macro_f1,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
  round(avg(recall) FILTER (WHERE support > 0), 9) AS balanced_accuracy,
  round(coalesce((sum(hits) * sum(support) - sum(support * predicted))
    / nullif(sqrt(CAST(sum(support) * sum(support) - sum(support * support) AS DOUBLE)
    * CAST(sum(support) * sum(support) - sum(predicted * predicted) AS DOUBLE)), 0), 0.0), 9) AS mcc
  FROM creport"""


@query("R5_classification_summary", with_sql("creport") + SUMMARY_SQL)
def classification(spark, sf_dir):
    return round_columns(rk.classification_summary(report_of(spark, sf_dir)), ("rows",))


@query(
    "R5_document_label_metrics",
    """WITH creport AS (SELECT c AS class, h AS hits, s AS support, p AS predicted,
      coalesce(h / nullif(s, 0), 0.0) AS recall,
      coalesce(2.0 * h / nullif(s + p, 0), 0.0) AS f1 FROM (
      SELECT c, count(*) FILTER (WHERE quality = c AND 1 - toxic = c) AS h,
        count(*) FILTER (WHERE quality = c) AS s, count(*) FILTER (WHERE 1 - toxic = c) AS p
      FROM labels, (SELECT unnest([0, 1]) AS c) GROUP BY c)) """
    + SUMMARY_SQL,
)
def document_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "labels").withColumn("clean", 1 - F.col("toxic"))
    report = rk.class_report(rk.confusion(rows, "quality", "clean"), (0, 1))
    return round_columns(rk.classification_summary(report), ("rows",))


@query(
    "R5_brier_score",
    with_sql("cls")
    + """SELECT label, round(avg(power(p0 - CASE WHEN label = 0 THEN 1 ELSE 0 END, 2)
      + power(0.1 - CASE WHEN label = 1 THEN 1 ELSE 0 END, 2)
      + power(p2 - CASE WHEN label = 2 THEN 1 ELSE 0 END, 2)), 9) AS brier FROM cls GROUP BY label""",
)
def brier(spark, sf_dir):
    rows = three_class(spark, sf_dir)
    score = rk.brier_score(F.col("prob"), F.col("label"))
    return rows.groupBy("label").agg(rounded(score).alias("brier"))


@query(
    "F15_fixed_threshold_label",
    with_sql("targets")
    + """SELECT symbol, trading_date, CASE WHEN target_return > 0.1 THEN 2
      WHEN target_return < -0.1 THEN 0 ELSE 1 END AS label FROM targets""",
)
def fixed_labels(spark, sf_dir):
    rows = lab.threshold_labels(fx.preds(spark, sf_dir), 0.1)
    return rows.select("symbol", "trading_date", "label")


# ---- series statistics -----------------------------------------------------


@query(
    "R6_newey_west",
    with_sql("ic")
    + """, c AS (SELECT label_date, rank_ic, rank_ic - avg(rank_ic) OVER () AS d FROM ic),
    p AS (SELECT *, d * lag(d, 1) OVER w AS p1, d * lag(d, 2) OVER w AS p2,
      d * lag(d, 3) OVER w AS p3 FROM c WINDOW w AS (ORDER BY label_date)),
    v AS (SELECT count(*) AS n, avg(rank_ic) AS mean, sum(d * d) / count(*)
      + 2 * (0.75 * sum(p1) + 0.5 * sum(p2) + 0.25 * sum(p3)) / count(*) AS var FROM p)
    SELECT 3 AS lag, round(mean, 9) AS mean, round(sqrt(greatest(var, 0) / n), 9)
      AS standard_error, round(mean / sqrt(greatest(var, 0) / n), 7) AS t_stat FROM v""",
)
def newey_west(spark, sf_dir):
    out = rk.newey_west(daily_ic(spark, sf_dir), 3)
    return out.select(
        "lag",
        rounded("mean").alias("mean"),
        rounded("standard_error").alias("standard_error"),
        rounded("t_stat", 7).alias("t_stat"),
    )


@query(
    "R7_ic_by_period",
    with_sql("ic")
    + """SELECT strftime(label_date, '%Y') AS month, count(*) AS dates,
      round(avg(rank_ic), 9) AS mean, round(stddev_samp(rank_ic), 9) AS std
    FROM ic GROUP BY month""",
)
def ic_by_period(spark, sf_dir):
    daily = daily_ic(spark, sf_dir)
    out = rk.monthly_ic(daily, period=F.date_format("label_date", "yyyy"))
    return round_columns(out, ("month", "dates"))


@query(
    "R7_monthly_stability",
    with_sql("ic")
    + """SELECT count(*) AS months, count(*) FILTER (WHERE rank_ic > 0) AS positive_months,
      round(count(*) FILTER (WHERE rank_ic > 0) / count(*), 9) AS positive_month_ratio FROM ic""",
)
def stability(spark, sf_dir):
    out = rk.monthly_stability(rk.monthly_ic(daily_ic(spark, sf_dir)))
    return out.withColumn("positive_month_ratio", rounded("positive_month_ratio"))


define_view(
    "ph",
    ("ic",),
    """SELECT (r - 1) % 5 AS phase, count(*) AS dates, avg(rank_ic) AS mean,
      stddev_samp(rank_ic) AS std FROM (SELECT *, row_number() OVER (ORDER BY label_date) AS r
      FROM ic) GROUP BY phase""",
)


@query(
    "R8_phases",
    with_sql("ph")
    + "SELECT phase, dates, round(mean, 9) AS mean, round(std, 9) AS std FROM ph",
)
def phases(spark, sf_dir):
    return round_columns(rk.phases(daily_ic(spark, sf_dir), 5), ("phase", "dates"))


@query(
    "R8_phase_summary",
    with_sql("ph")
    + """SELECT round(min(mean), 9) AS min_phase_mean, round(max(mean), 9) AS max_phase_mean,
      bool_and(mean >= 0) AS all_phase_means_nonnegative FROM ph""",
)
def phase_summary(spark, sf_dir):
    out = rk.phase_summary(rk.phases(daily_ic(spark, sf_dir), 5))
    return round_columns(out, ("all_phase_means_nonnegative",))


def seeded(rows, seeds=3):
    """Scores of several seeds: the base score moved by the seed and a flag of the row."""
    shift = F.when(F.col("can_sell"), 0.05).otherwise(-0.05)
    return rows.withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    ).withColumn("score", F.col("score") + F.col("seed") * shift)


define_view(
    "seeded",
    ("preds",),
    """SELECT p.* EXCLUDE (score), seed,
      score + seed * CASE WHEN can_sell THEN 0.05 ELSE -0.05 END AS score
    FROM preds p, (SELECT unnest([0, 1, 2]) AS seed)""",
)
define_view(
    "seedic",
    ("seeded",),
    f"""SELECT seed, label_date, {corr('sa', 'ra')} AS rank_ic FROM (SELECT seed, label_date,
      rank() OVER (PARTITION BY seed, label_date ORDER BY score)
        + (count(*) OVER (PARTITION BY seed, label_date, score) - 1) / 2.0 AS sa,
      rank() OVER (PARTITION BY seed, label_date ORDER BY target_return)
        + (count(*) OVER (PARTITION BY seed, label_date, target_return) - 1) / 2.0 AS ra,
      count(*) OVER (PARTITION BY seed, label_date) AS n FROM seeded) WHERE n >= 5
    GROUP BY seed, label_date HAVING {corr('sa', 'ra')} IS NOT NULL""",
)


def seed_ic(spark, sf_dir):
    rows = seeded(fx.preds(spark, sf_dir))
    return rk.rank_ic(rows, ("seed", "label_date"), min_symbols=MIN)


@query(
    "R9_ensemble_scores",
    with_sql("seeded")
    + """SELECT symbol, label_date, round(avg(score), 9) + 0.0 AS score FROM seeded
    GROUP BY symbol, label_date""",
)
def ensemble(spark, sf_dir):
    rows = seeded(fx.preds(spark, sf_dir))
    return round_columns(
        rk.ensemble_scores(rows, ("symbol", "label_date")), ("symbol", "label_date")
    )


@query(
    "R9_cross_seed",
    with_sql("seedic")
    + """SELECT round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS std,
      bool_and(m > 0) AS all_seed_means_positive
    FROM (SELECT seed, avg(rank_ic) AS m FROM seedic GROUP BY seed)""",
)
def cross_seed(spark, sf_dir):
    per_seed = rk.ic_summary(seed_ic(spark, sf_dir), ("seed",))
    return round_columns(rk.cross_seed(per_seed), ("all_seed_means_positive",))


@query(
    "R9_roadmap_gate",
    with_sql("seedic")
    + """, g AS (SELECT seed, avg(rank_ic) AS mean,
      count(*) FILTER (WHERE rank_ic > 0) / count(*) AS ratio FROM seedic GROUP BY seed),
    f AS (SELECT seed, min(m) AS low FROM (SELECT seed, (r - 1) % 4 AS phase, avg(rank_ic) AS m
      FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY label_date) AS r FROM seedic)
      GROUP BY seed, phase) GROUP BY seed)
    SELECT bool_and(mean > 0) AS all_seed_means_positive,
      bool_and(ratio > 0.5) AS majority_months_each_seed,
      bool_and(low >= 0) AS non_overlap_does_not_reverse,
      bool_and(mean > 0 AND ratio > 0.5 AND low >= 0) AS meets_roadmap_gate
    FROM g JOIN f USING (seed)""",
)
def gate(spark, sf_dir):
    from pyspark.sql import Window

    daily = settle(seed_ic(spark, sf_dir), "seedic")
    base = daily.groupBy("seed").agg(
        F.avg("rank_ic").alias("mean"),
        rk.share(F.col("rank_ic") > 0).alias("positive_month_ratio"),
    )
    along = Window.partitionBy("seed").orderBy("label_date")  # one row per session
    by_phase = (
        daily.withColumn("phase", F.pmod(F.row_number().over(along) - 1, F.lit(4)))
        .groupBy("seed", "phase")
        .agg(F.avg("rank_ic").alias("m"))
        .groupBy("seed")
        .agg(F.min("m").alias("min_phase_mean"))
    )
    return rk.roadmap_gate(base.join(by_phase, "seed"))


# ---- half-life, NDCG, precision --------------------------------------------

K = 10

define_view(
    "hl",
    ("hlab", "ibars"),
    """SELECT h.*, 1 - b.close / b.open AS score,
      row_number() OVER (PARTITION BY horizon, trading_date ORDER BY 1 - b.close / b.open, symbol)
        AS sp,
      row_number() OVER (PARTITION BY horizon, trading_date ORDER BY h.target_return, symbol) AS rp,
      row_number() OVER (PARTITION BY horizon, trading_date ORDER BY 1 - b.close / b.open DESC,
        symbol) AS place,
      row_number() OVER (PARTITION BY horizon, trading_date ORDER BY h.label DESC, symbol) AS best,
      count(*) OVER (PARTITION BY horizon, trading_date) AS n
    FROM hlab h JOIN ibars b USING (symbol, trading_date)""",
)


def ndcg_sql(view: str, keys: str, gain: str, k: int) -> str:
    disc = f"CASE WHEN place <= {k} THEN 1 / log2(place + 1) ELSE 0 END"
    return f"""SELECT {keys}, coalesce(dcg / nullif(ideal, 0), 0.0) AS ndcg FROM (
      SELECT {keys}, sum(g * d) AS dcg FROM (SELECT {keys}, score, avg({gain}) AS g,
        sum({disc}) AS d FROM {view} GROUP BY {keys}, score) GROUP BY {keys})
      JOIN (SELECT {keys}, sum({gain} / log2(best + 1)) AS ideal FROM {view} WHERE best <= {k}
        GROUP BY {keys}) USING ({keys})"""


define_view("hlndcg", ("hl",), ndcg_sql("hl", "horizon, trading_date", "label", K))
define_view(
    "hlday",
    ("hl", "hlndcg"),
    f"""SELECT horizon, trading_date, count(*) AS symbols, {corr('sp', 'rp')} AS rank_ic,
      avg(target_return) FILTER (WHERE place <= greatest(1, n // 10))
        - avg(target_return) FILTER (WHERE place > n - greatest(1, n // 10)) AS extreme_spread,
      avg(raw_return) FILTER (WHERE place <= {K}) AS top_k_raw_return,
      avg(benchmark_return) FILTER (WHERE place <= {K}) AS top_k_benchmark_return,
      avg(target_return) FILTER (WHERE place <= {K}) AS top_k_active_return,
      avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE place <= {K}) AS precision_at_k,
      any_value(ndcg) AS ndcg
    FROM hl JOIN hlndcg USING (horizon, trading_date) WHERE n >= 20
    GROUP BY horizon, trading_date""",
)
HALF_LIFE_VALUES = (
    "rank_ic",
    "extreme_spread",
    "top_k_raw_return",
    "top_k_benchmark_return",
    "top_k_active_return",
    "precision_at_k",
    "ndcg",
)


def half_life(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    labels = lab.horizon_targets(indexed, sessions, market, (1, 2, 3), min_cross_section=MIN)
    return rk.half_life_daily(fx.signals_of(indexed, sessions), labels, K, 20)


@query(
    "R10_half_life_daily",
    with_sql("hlday")
    + "SELECT horizon, trading_date, symbols, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in HALF_LIFE_VALUES)
    + " FROM hlday",
)
def half_life_daily(spark, sf_dir):
    return round_columns(half_life(spark, sf_dir), ("horizon", "trading_date", "symbols"))


@query(
    "R10_half_life_summary",
    with_sql("hlday")
    + """SELECT horizon, count(*) AS evaluated_dates, round(avg(rank_ic), 9) AS mean_rank_ic,
      round(avg(rank_ic) / stddev_samp(rank_ic), 9) AS rank_ic_ir,
      round(count(*) FILTER (WHERE rank_ic > 0) / count(rank_ic), 9) AS positive_rank_ic_ratio,
      round(avg(extreme_spread), 9) AS mean_extreme_spread,
      round(avg(top_k_active_return), 9) AS mean_top_k_active_return,
      round(avg(ndcg), 9) AS mean_ndcg_at_k, round(avg(precision_at_k), 9) AS mean_precision_at_k
    FROM hlday GROUP BY horizon""",
)
def half_life_summary(spark, sf_dir):
    out = rk.half_life_summary(half_life(spark, sf_dir))
    return round_columns(out, ("horizon", "evaluated_dates"))


@query(
    "R10_half_life_anchors",
    with_sql("hlday")
    + """SELECT horizon, anchor, count(*) AS cohorts,
      round(ln(product(1 + top_k_raw_return)), 8) AS raw_cumulative,
      round(ln(product(1 + top_k_benchmark_return)), 8) AS benchmark_cumulative,
      round(ln(abs(product(1 + top_k_active_return))), 8) AS active_cumulative FROM (
      SELECT *, (row_number() OVER (PARTITION BY horizon ORDER BY trading_date) - 1) % horizon
        AS anchor FROM hlday) GROUP BY horizon, anchor""",
)
def half_life_anchors(spark, sf_dir):
    """Compounded returns as logs: the fixture's returns are too large to compare raw."""
    out = rk.half_life_anchors(half_life(spark, sf_dir))
    grown = {
        c: F.round(F.log(F.abs(1 + F.col(c))), 8)
        for c in ("raw_cumulative", "benchmark_cumulative", "active_cumulative")
    }
    return out.withColumns(grown)


define_view(
    "rel",
    ("rk",),
    """SELECT *, CAST(least(4, (rp - 1) * 5 // n) AS INTEGER) AS relevance,
      row_number() OVER (PARTITION BY trading_date ORDER BY rp DESC) AS best,
      row_number() OVER (PARTITION BY trading_date ORDER BY target_return DESC, symbol) AS realized
    FROM rk""",
)
define_view("relndcg", ("rel",), ndcg_sql("rel", "trading_date", "relevance", K))
define_view(
    "overlap",
    ("rel",),
    f"""SELECT trading_date, count(*) FILTER (WHERE realized <= {K}) / count(*) AS precision
    FROM rel WHERE place <= {K} GROUP BY trading_date""",
)


@query(
    "R11_ndcg_tie_averaged",
    with_sql("relndcg") + "SELECT trading_date, round(ndcg, 9) AS ndcg FROM relndcg",
)
def ndcg(spark, sf_dir):
    rows = lab.graded_relevance(fx.preds(spark, sf_dir), 5)
    return round_columns(rk.ndcg(rows, F.col("relevance").cast("double"), K), ("trading_date",))


@query(
    "R12_precision_overlap",
    with_sql("overlap") + "SELECT trading_date, round(precision, 9) AS precision FROM overlap",
)
def precision_overlap(spark, sf_dir):
    out = rk.precision_overlap(fx.preds(spark, sf_dir), K)
    return round_columns(out, ("trading_date",))


@query(
    "R12_precision_up",
    with_sql("cls")
    + f"""SELECT trading_date, round(avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END), 9) AS precision
    FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, symbol)
      AS place FROM cls) WHERE place <= {K} GROUP BY trading_date""",
)
def precision_up(spark, sf_dir):
    rows = lab.quantile_labels(fx.preds(spark, sf_dir), ["label_date"], min_cross_section=MIN)
    return round_columns(rk.precision_up(rows, K), ("trading_date",))


@query(
    "R13_ranking_summary",
    with_sql("relndcg", "overlap", "rk")
    + f"""SELECT count(*) AS dates, min(symbols) AS symbols_per_day_min,
      max(symbols) AS symbols_per_day_max, bool_and(symbols >= 60) AS large_enough,
      round(avg(rank_ic), 9) AS daily_rank_ic_mean,
      round(stddev_samp(rank_ic), 9) AS daily_rank_ic_std, round(avg(ndcg), 9) AS ndcg,
      round(avg(precision), 9) AS precision
    FROM (SELECT trading_date, count(*) AS symbols, {corr('sa', 'ra')} AS rank_ic FROM rk
      GROUP BY trading_date) JOIN relndcg USING (trading_date) JOIN overlap USING (trading_date)""",
)
def ranking_summary(spark, sf_dir):
    rows = fx.preds(spark, sf_dir)
    out = rk.ranking_summary(rk.ranking_daily(rows, K, 5), 60)
    keep = ("dates", "symbols_per_day_min", "symbols_per_day_max", "large_enough")
    return round_columns(out, keep)


# ---- smoothing, calibration ------------------------------------------------

define_view(
    "ema",
    ("signals",),
    """WITH RECURSIVE x AS (SELECT symbol, trading_date, day,
        (row_number() OVER (PARTITION BY trading_date ORDER BY score, symbol) - 1)
          / greatest(1, count(*) OVER (PARTITION BY trading_date) - 1) AS c FROM (
        SELECT *, dense_rank() OVER (ORDER BY trading_date) AS day FROM signals)),
      e AS (SELECT symbol, trading_date, day, c AS v FROM x a WHERE NOT EXISTS (
          SELECT 1 FROM x b WHERE b.symbol = a.symbol AND b.day = a.day - 1)
        UNION ALL SELECT x.symbol, x.trading_date, x.day, 0.5 * x.c + (1.0 - 0.5) * e.v
          FROM e JOIN x ON x.symbol = e.symbol AND x.day = e.day + 1)
    SELECT trading_date, symbol, v AS score FROM e""",
)


@query(
    "R14_percentile_rank_ema",
    with_sql("ema") + "SELECT trading_date, symbol, round(score, 9) AS score FROM ema",
)
def percentile_rank_ema(spark, sf_dir):
    out = rk.percentile_ranks(fx.signals(spark, sf_dir), 0.5)
    return round_columns(out, ("trading_date", "symbol"))


define_view(
    "pema",
    ("signals",),
    """WITH RECURSIVE x AS (SELECT "partition" AS p, symbol, trading_date, day,
        (row_number() OVER (PARTITION BY p, trading_date ORDER BY score, symbol) - 1)
          / greatest(1, count(*) OVER (PARTITION BY p, trading_date) - 1) AS c FROM (
        SELECT *, dense_rank() OVER (PARTITION BY "partition" ORDER BY trading_date) AS day
        FROM signals)),
      e AS (SELECT p, symbol, trading_date, day, c AS v FROM x a WHERE NOT EXISTS (
          SELECT 1 FROM x b WHERE b.p = a.p AND b.symbol = a.symbol AND b.day = a.day - 1)
        UNION ALL SELECT x.p, x.symbol, x.trading_date, x.day, 0.5 * x.c + (1.0 - 0.5) * e.v
          FROM e JOIN x ON x.p = e.p AND x.symbol = e.symbol AND x.day = e.day + 1)
    SELECT p, trading_date, symbol, round(v, 9) AS score FROM e""",
)
# The fit at a point is the largest of the least means of ranges that begin up to it and end from it
# on; sums of values come from running totals.
define_view(
    "points",
    ("pema", "hraw"),
    """SELECT row_number() OVER w AS i, x, n, t, sum(n) OVER w AS upto_n, sum(t) OVER w AS upto_t
    FROM (SELECT e.score AS x, count(*) AS n, sum(r.target_return) AS t FROM pema e JOIN hraw r
        ON r.symbol = e.symbol AND r.trading_date = e.trading_date AND r.horizon = 2
      WHERE e.p = 'validation' GROUP BY e.score) WINDOW w AS (ORDER BY x)""",
)
define_view(
    "calib",
    ("points",),
    """SELECT x, max(least) AS y FROM (
      SELECT b.x, min((b.upto_t - a.upto_t + a.t) / (b.upto_n - a.upto_n + a.n)) OVER (
        PARTITION BY a.i ORDER BY b.i DESC) AS least
      FROM points a JOIN points b ON b.i >= a.i) GROUP BY x""",
)


def calibrated(spark, sf_dir, horizon=2):
    """Ranks of both partitions, the map fitted on validation rows with a target."""
    indexed, sessions, market = fx.panel(spark, sf_dir)
    signals = fx.signals_of(indexed, sessions)
    # Ranks are rounded, so that equal ones are one point whatever way their means were summed.
    smoothed = rk.percentile_ranks(signals, 0.5, "partition")
    ranks = settle(smoothed.withColumn("score", F.round("score", 9)), "ranks")
    targets = lab.horizon_returns(indexed, sessions, market, (horizon,))
    fit = ranks.where("partition = 'validation'").join(
        targets.select("trading_date", "symbol", "target_return"), ["trading_date", "symbol"]
    )
    return rk.calibrated_scores(fit, ranks)


@query(
    "R15_isotonic_calibration",
    with_sql("pema", "calib")
    + """SELECT e.p AS "partition", e.trading_date, e.symbol, e.score,
      round(CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL OR b.x = a.x THEN a.y
        ELSE a.y + (b.y - a.y) * (e.score - a.x) / (b.x - a.x) END, 7) + 0.0 AS expected_return
    FROM pema e ASOF LEFT JOIN calib a ON e.score >= a.x ASOF LEFT JOIN calib b ON e.score <= b.x""",
)
def isotonic(spark, sf_dir):
    return calibrated(spark, sf_dir).select(
        "partition",
        "trading_date",
        "symbol",
        "score",
        rounded("expected_return", 7).alias("expected_return"),
    )


@query(
    "R15_calibration_contract",
    with_sql("signals")
    + """SELECT "partition", count(*) AS rows, true AS finite, true AS ordered FROM signals
      GROUP BY "partition\"""",
)
def calibration_contract(spark, sf_dir):
    """Every signal gets a finite return, and the ends of the ranks the ends of the returns."""
    out = settle(calibrated(spark, sf_dir), "calibrated")
    ends = rk.calibration_summary(out, ["partition"])
    at_ends = out.groupBy("partition").agg(
        F.min_by("expected_return", "score").alias("first"),
        F.max_by("expected_return", "score").alias("last"),
        F.min((F.abs("expected_return") < float("inf")).cast("int")).alias("finite"),
    )
    return ends.join(at_ends, "partition").select(
        "partition",
        "rows",
        (F.col("finite") == 1).alias("finite"),
        ((F.col("first") == F.col("expected_min")) & (F.col("last") == F.col("expected_max"))).alias(
            "ordered"
        ),
    )


# ---- audit -----------------------------------------------------------------

define_view(
    "audit",
    ("rk",),
    f"""SELECT label_date, count(*) AS symbols, {corr('sp', 'rp')} AS rank_ic,
      avg(target_return) FILTER (WHERE sp > n - t) - avg(target_return) FILTER (WHERE sp <= t)
        AS spread,
      avg(least(target_return, cap)) FILTER (WHERE sp > n - t)
        - avg(least(target_return, cap)) FILTER (WHERE sp <= t) AS winsorized_spread
    FROM (SELECT rk.*, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS t, cap FROM rk
      JOIN (SELECT label_date, quantile_cont(target_return, 0.99) AS cap FROM rk
        GROUP BY label_date) USING (label_date) WHERE n >= 50) GROUP BY label_date""",
)
define_view(
    "decile",
    ("rk",),
    """SELECT decile, avg(m) AS mean_return FROM (SELECT label_date,
      CAST(ceil(sp * 10 / n) - 1 AS INTEGER) AS decile, avg(target_return) AS m FROM rk
      WHERE n >= 50 GROUP BY ALL) GROUP BY decile""",
)
define_view(
    "asum",
    ("audit", "decile"),
    f"""SELECT avg(rank_ic) AS daily_ic_mean, stddev_samp(rank_ic) AS daily_ic_std,
      avg(rank_ic) / stddev_samp(rank_ic) AS daily_ic_ir,
      avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END) AS positive_days_ratio,
      avg(spread) AS spread_mean, quantile_cont(spread, 0.5) AS spread_median,
      sum(spread) FILTER (WHERE r <= 1) / sum(spread) AS top_1_day_contribution,
      sum(spread) FILTER (WHERE r <= 5) / sum(spread) AS top_5_day_contribution,
      sum(spread) FILTER (WHERE r <= 10) / sum(spread) AS top_10_day_contribution,
      avg(winsorized_spread) AS winsorized_spread_mean,
      avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_month_ratio,
      (SELECT {corr('decile', 'mean_return')} FROM decile) AS decile_monotonicity
    FROM (SELECT *, row_number() OVER (ORDER BY spread DESC, label_date) AS r FROM audit)""",
)
AUDIT_VALUES = (
    "daily_ic_mean",
    "daily_ic_std",
    "daily_ic_ir",
    "positive_days_ratio",
    "spread_mean",
    "spread_median",
    "top_1_day_contribution",
    "top_5_day_contribution",
    "top_10_day_contribution",
    "winsorized_spread_mean",
    "positive_month_ratio",
    "decile_monotonicity",
)


@query(
    "R16_audit_daily",
    with_sql("audit")
    + """SELECT label_date, symbols, round(rank_ic, 9) AS rank_ic, round(spread, 9) AS spread,
      round(winsorized_spread, 9) AS winsorized_spread FROM audit""",
)
def audit_daily(spark, sf_dir):
    return round_columns(rk.audit_daily(fx.preds(spark, sf_dir)), ("label_date", "symbols"))


@query(
    "R16_audit_deciles",
    with_sql("decile") + "SELECT decile, round(mean_return, 9) AS mean_return FROM decile",
)
def audit_deciles(spark, sf_dir):
    return round_columns(rk.audit_deciles(fx.preds(spark, sf_dir)), ("decile",))


def audit(spark, sf_dir):
    rows = fx.preds(spark, sf_dir)
    daily = settle(rk.audit_daily(rows), "audit")
    return rk.audit_summary(daily, rk.audit_deciles(rows))


@query(
    "R16_audit_summary",
    with_sql("asum")
    + "SELECT "
    + ", ".join(f"round({c}, 7) AS {c}" for c in AUDIT_VALUES)
    + " FROM asum",
)
def audit_summary(spark, sf_dir):
    return round_columns(audit(spark, sf_dir), (), 7)


@query(
    "R17_audit_anomalies",
    with_sql("asum")
    + """SELECT t.type, t.severity FROM asum, LATERAL (VALUES
      ('ic_spread_divergence', 'high', abs(daily_ic_mean) < 0.02 AND spread_mean > 0.002),
      ('tail_return_concentration', 'high', top_1_day_contribution > 0.05),
      ('weak_decile_monotonicity', 'medium', abs(decile_monotonicity) < 0.5),
      ('winsorize_sensitivity', 'high', winsorized_spread_mean < spread_mean * 0.5))
      t(type, severity, raised) WHERE raised""",
)
def audit_anomalies(spark, sf_dir):
    return rk.audit_anomalies(audit(spark, sf_dir))


# ---- comparisons -----------------------------------------------------------


@query(
    "R18_paired_deltas",
    with_sql("seedic")
    + """, m AS (SELECT 'm' || (month(label_date) % 3) AS model, seed,
      avg(rank_ic) AS ic, stddev_samp(rank_ic) AS std FROM seedic GROUP BY ALL)
    SELECT c.model, 'seed_' || c.seed AS encoder, k AS metric, round(CASE k WHEN 'ic' THEN c.ic - b.ic
      ELSE c.std - b.std END, 9) AS delta FROM m c JOIN m b ON b.model = c.model AND b.seed = 0,
      (SELECT unnest(['ic', 'std']) AS k) WHERE c.seed > 0""",
)
def paired_deltas(spark, sf_dir):
    daily = seed_ic(spark, sf_dir)
    model = F.concat(F.lit("m"), F.month("label_date") % 3)
    wide = daily.groupBy(model.alias("model"), "seed").agg(
        F.avg("rank_ic").alias("ic"), F.stddev_samp("rank_ic").alias("std")
    )
    metrics = settle(
        wide.unpivot(["model", "seed"], ["ic", "std"], "metric", "value").select(
            "model",
            F.concat(F.lit("seed_"), "seed").alias("encoder"),
            F.when(F.col("seed") == 0, "minute").otherwise("combined").alias("feature_set"),
            "metric",
            "value",
        ),
        "metrics",
    )
    out = rk.paired_deltas(metrics, "combined", "minute")
    return out.withColumn("delta", rounded("delta"))


EXPOSURES = ("log_size", "adv", "volatility")


def exposures(indexed):
    """Exposures that every bar has, so that all dates are covered in full."""
    return indexed.select(
        "symbol",
        "trading_date",
        F.log(F.col("close") * F.col("volume")).alias("log_size"),
        F.col("volume").alias("adv"),
        F.log(F.col("high") / F.col("low")).alias("volatility"),
        F.concat(F.lit("i"), F.substring("symbol", -1, 1)).alias("industry"),
    )


define_view(
    "exr",
    ("ibars", "signals"),
    """SELECT s.trading_date, s.symbol, s.score, s.partition, a.log_size, a.adv, a.volatility,
      'i' || right(s.symbol, 1) AS industry,
      row_number() OVER (PARTITION BY s.trading_date ORDER BY s.score DESC, s.symbol) AS place,
      count(*) OVER (PARTITION BY s.trading_date) AS n
    FROM signals s JOIN (SELECT symbol, trading_date, ln(close * volume) AS log_size,
      volume AS adv, ln(high / low) AS volatility FROM ibars) a USING (trading_date, symbol)""",
)


@query(
    "R19_exposure_diagnostics",
    with_sql("exr")
    + "SELECT trading_date, "
    + ", ".join(
        f"round({corr('score', e)}, 8) AS {e}_corr, round((avg({e}) FILTER (WHERE place <= {K})"
        f" - avg({e})) / stddev_pop({e}), 8) AS {e}_z"
        for e in EXPOSURES
    )
    + " FROM exr GROUP BY trading_date",
)
def exposure_diagnostics(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    out = rk.exposure_daily(fx.signals_of(indexed, sessions), exposures(indexed), EXPOSURES, K)
    return round_columns(out, ("trading_date",), 8)


@query(
    "R19_industry_distance",
    with_sql("exr")
    + f"""SELECT trading_date, round(sum(abs(t / least({K}, n) - a / n)) / 2, 9)
      AS industry_distance FROM (SELECT trading_date, industry, any_value(n) AS n, count(*) AS a,
      count(*) FILTER (WHERE place <= {K}) AS t FROM exr GROUP BY trading_date, industry)
    GROUP BY trading_date""",
)
def industry_distance(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    out = rk.industry_distance(fx.signals_of(indexed, sessions), exposures(indexed), K)
    return round_columns(out, ("trading_date",))


@query(
    "R20_distribution",
    """SELECT event_type, count(*) AS count, round(avg(v), 8) AS mean,
      round(stddev_samp(v), 8) AS std, round(min(v), 8) AS min, round(max(v), 8) AS max,
      round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 8) AS negative_fraction,
      round(quantile_cont(v, 0.25), 8) AS q25, round(quantile_cont(v, 0.5), 8) AS median,
      round(quantile_cont(v, 0.75), 8) AS q75
    FROM (SELECT event_type, ln(value) AS v FROM events) GROUP BY event_type""",
)
def distribution(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("event_type", F.log("value").alias("v"))
    return round_columns(rk.distribution(rows, "v", ["event_type"]), ("event_type", "count"), 8)


@query(
    "R21_seed_aggregate",
    with_sql("seedic")
    + """SELECT metric, count(*) AS seeds, round(avg(v), 9) AS mean,
      round(stddev_samp(v), 9) AS std FROM (
      SELECT seed, 'rank_ic_mean' AS metric, avg(rank_ic) AS v FROM seedic GROUP BY seed
      UNION ALL SELECT seed, 'rank_ic_std', stddev_samp(rank_ic) FROM seedic GROUP BY seed)
    GROUP BY metric""",
)
def seed_aggregate(spark, sf_dir):
    wide = rk.ic_summary(seed_ic(spark, sf_dir), ("seed",)).select(
        "seed", F.col("mean").alias("rank_ic_mean"), F.col("std").alias("rank_ic_std"), "ir"
    )
    metrics = wide.unpivot(["seed"], ["rank_ic_mean", "rank_ic_std", "ir"], "metric", "value")
    out = rk.seed_aggregate(metrics, ("rank_ic_mean", "rank_ic_std"))
    return round_columns(out, ("metric", "seeds"))
