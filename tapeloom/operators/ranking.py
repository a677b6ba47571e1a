"""Cross-sectional ranking and classification metrics.

Ranks come from ordered scans (exact for cross-sections of any size, one shuffle for places and tie
bounds); what follows is grouped aggregation. Per-day results have one row per session, so windows
over them are small. Ordinal ranks break ties by symbol.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import UP, month_key
from tapeloom.functions.stats import is_finite, safe_corr, safe_ratio, share
from tapeloom.operators.isotonic import apply_blocks, isotonic_blocks
from tapeloom.operators.labels import relevance_grade
from tapeloom.plans.ordering import exact_quantiles, first_rows, quantiles_at
from tapeloom.plans.scans import ordered_scan
from tapeloom.plans.shared import settle, sized

# Audit thresholds.
WEAK_IC = 0.02
HIGH_SPREAD = 0.002
TOP_DAY_SHARE = 0.05
WEAK_MONOTONICITY = 0.5
WINSORIZED_SHARE = 0.5


def ranked(
    rows: DataFrame, group: Sequence[str], value: str, prefix: str, tie: str = "symbol"
) -> DataFrame:
    """Add ``<prefix>_pos``, the tie bounds ``_first``/``_last`` and the group size ``n``."""
    return ordered_scan(
        rows.drop("n"),
        group,
        [F.col(value), F.col(tie)],
        pos=f"{prefix}_pos",
        size="n",
        ties=(value, f"{prefix}_first", f"{prefix}_last"),
    )


def descending(prefix: str) -> Column:
    """Rank from the top, ties by symbol ascending."""
    top_of_tie = F.col("n") + 1 - F.col(f"{prefix}_last")
    return top_of_tie + F.col(f"{prefix}_pos") - F.col(f"{prefix}_first")


def average_rank(prefix: str) -> Column:
    return (F.col(f"{prefix}_first") + F.col(f"{prefix}_last")) / 2.0


def score_and_return_ranks(
    rows: DataFrame,
    group: Sequence[str],
    score: str = "score",
    value: str = "target_return",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Both ranks of the key, score and return columns, plus the columns in ``keep``.

    They are written once, since metrics read them more than once; only these columns go in.
    """
    narrow = rows.select(*group, "symbol", score, value, *keep)
    return settle(ranked(ranked(narrow, group, score, "s"), group, value, "r"), "ranks")


def rank_ic(
    rows: DataFrame,
    group: Sequence[str] = ("label_date",),
    ties: str = "average",
    min_symbols: int = 20,
    score: str = "score",
    value: str = "target_return",
) -> DataFrame:
    """Rank correlation per cross-section; undefined ones drop out.

    ``ties`` is "average" for mean ranks or "ordinal" for ranks broken by symbol.
    """
    both = score_and_return_ranks(rows, group, score, value)
    return rank_ic_of(both, group, ties, min_symbols)


def rank_ic_of(
    both: DataFrame, group: Sequence[str], ties: str = "average", min_symbols: int = 20
) -> DataFrame:
    """:func:`rank_ic` for rows that already carry both ranks."""
    if ties == "average":
        x, y = average_rank("s"), average_rank("r")
    else:
        x, y = F.col("s_pos").cast("double"), F.col("r_pos").cast("double")
    daily = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("symbols"), safe_corr(x, y).alias("rank_ic")
    )
    return daily.where((F.col("symbols") >= min_symbols) & F.col("rank_ic").isNotNull())


def tail_size(n: Column, quantile: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(quantile))))


def tail_spread(
    rows: DataFrame,
    group: Sequence[str] = ("label_date",),
    quantile: float = 0.1,
    min_symbols: int = 20,
    value: str = "target_return",
) -> DataFrame:
    """Mean return of the highest minus the lowest scored tail per cross-section."""
    narrow = rows.select(*group, "symbol", "score", value)
    placed = ordered_scan(narrow, group, [F.col("score"), F.col("symbol")], pos="s_pos", size="n")
    return tail_spread_of(placed, group, quantile, min_symbols, value)


def tail_spread_of(
    placed: DataFrame,
    group: Sequence[str],
    quantile: float,
    min_symbols: int,
    value: str = "target_return",
) -> DataFrame:
    tail = tail_size(F.col("n"), quantile)
    long = F.avg(F.when(F.col("s_pos") > F.col("n") - tail, F.col(value)))
    short = F.avg(F.when(F.col("s_pos") <= tail, F.col(value)))
    return (
        placed.where(F.col("n") >= min_symbols)
        .groupBy(*group)
        .agg(F.first("n").alias("symbols"), (long - short).alias("spread"))
    )


def ic_summary(daily: DataFrame, keys: Sequence[str] = (), value: str = "rank_ic") -> DataFrame:
    std = F.stddev_samp(value)
    return daily.groupBy(*keys).agg(
        F.count(value).alias("dates"),
        F.avg(value).alias("mean"),
        std.alias("std"),
        safe_ratio(F.avg(value), std).alias("ir"),
    )


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def class_report(cells: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    n, actual, guess = F.col("rows"), F.col("label"), F.col("predicted")
    per_class = cells.select(
        F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class"),
        actual.alias("_a"),
        guess.alias("_g"),
        n.alias("_n"),
    )
    hit = (F.col("_a") == F.col("class")) & (F.col("_g") == F.col("class"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    zero = F.lit(0.0)
    return (
        per_class.groupBy("class")
        .agg(
            total(hit).alias("hits"),
            total(F.col("_a") == F.col("class")).alias("support"),
            total(F.col("_g") == F.col("class")).alias("predicted"),
        )
        .withColumns(
            {
                "precision": F.coalesce(safe_ratio("hits", "predicted"), zero),
                "recall": F.coalesce(safe_ratio("hits", "support"), zero),
                "f1": F.coalesce(
                    safe_ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero
                ),
            }
        )
    )


def classification_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy and the multi-class MCC."""
    s, c = F.sum("support"), F.sum("hits")
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    cross = F.sum(F.col("support") * F.col("predicted"))
    spread_t = s * s - F.sum(F.col("support") * F.col("support"))
    spread_p = s * s - F.sum(F.col("predicted") * F.col("predicted"))
    root = F.sqrt(spread_t.cast("double") * spread_p.cast("double"))
    mcc = F.coalesce(F.try_divide((c * s - cross).cast("double"), root), F.lit(0.0))
    return report.agg(
        s.alias("rows"),
        safe_ratio(c, s).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        safe_ratio(F.sum(F.col("f1") * F.col("support")), s).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        mcc.alias("mcc"),
    )


def brier_score(probabilities: Column, label: Column, classes: int = 3) -> Column:
    """Mean squared distance between the probabilities and the one-hot label."""
    squares = F.lit(0.0)
    for k in range(classes):
        hit = F.when(label == k, 1.0).otherwise(0.0)
        gap = probabilities.getItem(k) - hit
        squares = squares + gap * gap
    return F.avg(squares)


def newey_west(
    daily: DataFrame, lag: int, value: str = "rank_ic", day: str = "label_date", keys: Sequence[str] = ()
) -> DataFrame:
    """Bartlett-kernel standard error and t of the mean of a daily series."""
    whole = Window.partitionBy(*keys)  # one row per session
    along = whole.orderBy(day)
    centred = daily.select(
        *keys, day, value, (F.col(value) - F.avg(value).over(whole)).alias("_c")
    )
    pairs = {
        f"_p{k}": F.col("_c") * F.lag("_c", k).over(along) for k in range(1, lag + 1)
    }
    n = F.count(F.lit(1))
    reach = F.least(F.lit(lag), n - 1)
    variance = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, lag + 1):
        weight = F.when(F.lit(k) <= reach, 1.0 - F.lit(k) / (reach + 1)).otherwise(0.0)
        variance = variance + 2.0 * weight * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    error = F.sqrt(F.greatest(variance, F.lit(0.0)) / n)
    mean = F.avg(value)
    return centred.withColumns(pairs).groupBy(*keys).agg(
        reach.alias("lag"),
        mean.alias("mean"),
        error.alias("standard_error"),
        F.try_divide(mean, error).alias("t_stat"),
    )


def monthly_ic(
    daily: DataFrame, day: str = "label_date", value: str = "rank_ic", period: Column | None = None
) -> DataFrame:
    month = month_key(F.col(day)) if period is None else period
    return daily.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def monthly_stability(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.count(F.lit(1)).alias("months"),
        F.count(F.when(F.col("mean") > 0, 1)).alias("positive_months"),
        share(F.col("mean") > 0).alias("positive_month_ratio"),
    )


def phases(
    daily: DataFrame, stride: int, day: str = "label_date", value: str = "rank_ic"
) -> DataFrame:
    """Every ``stride``-th evaluated day, per starting phase."""
    along = Window.orderBy(day)  # one row per session
    placed = daily.withColumn("phase", F.pmod(F.row_number().over(along) - 1, F.lit(stride)))
    return placed.groupBy("phase").agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def phase_summary(by_phase: DataFrame) -> DataFrame:
    return by_phase.agg(
        F.min("mean").alias("min_phase_mean"),
        F.max("mean").alias("max_phase_mean"),
        F.bool_and(F.col("mean") >= 0).alias("all_phase_means_nonnegative"),
    )


def ensemble_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score over seeds per key."""
    return rows.groupBy(*keys).agg(F.avg("score").alias("score"))


def cross_seed(per_seed: DataFrame, value: str = "mean") -> DataFrame:
    return per_seed.agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.bool_and(F.col(value) > 0).alias("all_seed_means_positive"),
    )


def roadmap_gate(per_seed: DataFrame) -> DataFrame:
    """Gate over seeds with mean, positive_month_ratio and min_phase_mean."""
    means = F.bool_and(F.col("mean") > 0)
    months = F.bool_and(F.col("positive_month_ratio") > 0.5)
    stable = F.bool_and(F.col("min_phase_mean") >= 0)
    return per_seed.agg(
        means.alias("all_seed_means_positive"),
        months.alias("majority_months_each_seed"),
        stable.alias("non_overlap_does_not_reverse"),
        (means & months & stable).alias("meets_roadmap_gate"),
    )


# ---- half-life -------------------------------------------------------------


def half_life_daily(
    signals: DataFrame, labels: DataFrame, top_k: int = 100, min_symbols: int = 100
) -> DataFrame:
    """Per horizon and date: IC, decile spread, Top-K returns, precision and NDCG."""
    rows = signals.select("trading_date", "symbol", "score").join(
        labels.select(
            "trading_date",
            "symbol",
            "horizon",
            "label",
            "raw_return",
            "benchmark_return",
            "target_return",
        ),
        ["trading_date", "symbol"],
    )
    group = ["horizon", "trading_date"]
    both = score_and_return_ranks(
        rows, group, keep=["label", "raw_return", "benchmark_return"]
    ).where(F.col("n") >= min_symbols)
    place = descending("s")
    tail = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    top = place <= top_k
    pick = lambda c: F.avg(F.when(top, F.col(c)))
    daily = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("symbols"),
        safe_corr(F.col("s_pos").cast("double"), F.col("r_pos").cast("double")).alias("rank_ic"),
        (
            F.avg(F.when(place <= tail, F.col("target_return")))
            - F.avg(F.when(place > F.col("n") - tail, F.col("target_return")))
        ).alias("extreme_spread"),
        pick("raw_return").alias("top_k_raw_return"),
        pick("benchmark_return").alias("top_k_benchmark_return"),
        pick("target_return").alias("top_k_active_return"),
        F.avg(F.when(top, F.when(F.col("label") == UP, 1.0).otherwise(0.0))).alias(
            "precision_at_k"
        ),
    )
    gains = ndcg_of(both, group, F.col("label").cast("double"), top_k)
    return daily.join(gains, group)


def half_life_summary(daily: DataFrame) -> DataFrame:
    std = F.stddev_samp("rank_ic")
    return daily.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("evaluated_dates"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.try_divide(F.avg("rank_ic"), std).alias("rank_ic_ir"),
        F.avg(F.when(F.col("rank_ic") > 0, 1.0).when(F.col("rank_ic") <= 0, 0.0)).alias(
            "positive_rank_ic_ratio"
        ),
        F.avg("extreme_spread").alias("mean_extreme_spread"),
        F.avg("top_k_active_return").alias("mean_top_k_active_return"),
        F.avg("ndcg").alias("mean_ndcg_at_k"),
        F.avg("precision_at_k").alias("mean_precision_at_k"),
    )


def half_life_anchors(daily: DataFrame) -> DataFrame:
    """Compounded Top-K returns of every non-overlapping anchor of a horizon."""
    along = Window.partitionBy("horizon").orderBy("trading_date")  # one row per session
    placed = daily.withColumn(
        "anchor", F.pmod(F.row_number().over(along) - 1, F.col("horizon"))
    )
    compound = lambda c: F.product(1.0 + F.col(c)) - 1.0
    return placed.groupBy("horizon", "anchor").agg(
        F.count(F.lit(1)).alias("cohorts"),
        compound("top_k_raw_return").alias("raw_cumulative"),
        compound("top_k_benchmark_return").alias("benchmark_cumulative"),
        compound("top_k_active_return").alias("active_cumulative"),
    )


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ndcg_of(both: DataFrame, group: Sequence[str], gain: Column, k: int) -> DataFrame:
    """NDCG at ``k`` where tied scores share the mean gain of their tie group.

    ``both`` carries score ranks. Only tie groups reaching the first ``k`` places are
    aggregated; the ideal order needs the ``k`` largest gains, a ranked limit.
    """
    rows = both.withColumns({"_gain": gain, "_place": descending("s")})
    reached = rows.where(F.col("n") + 1 - F.col("s_last") <= k)
    cut = F.when(F.col("_place") <= k, discount(F.col("_place"))).otherwise(0.0)
    per_tie = reached.groupBy(*group, "s_first").agg(
        (F.avg("_gain") * F.sum(cut)).alias("_dcg")
    )
    actual = per_tie.groupBy(*group).agg(F.sum("_dcg").alias("_dcg"))
    largest = [F.desc("_gain"), F.col("symbol")]
    ideal = (
        first_rows(rows.select(*group, "_gain", "symbol"), group, largest, k, "_best")
        .groupBy(*group)
        .agg(F.sum(F.col("_gain") * discount(F.col("_best"))).alias("_ideal"))
    )
    return actual.join(ideal, list(group)).select(
        *group, F.coalesce(F.try_divide("_dcg", "_ideal"), F.lit(0.0)).alias("ndcg")
    )


def ndcg(
    rows: DataFrame, gain: Column, k: int, group: Sequence[str] = ("trading_date",)
) -> DataFrame:
    narrow = rows.select(*group, "symbol", "score", gain.alias("_gain"))
    both = settle(ranked(narrow, group, "score", "s"), "ranks")
    return ndcg_of(both, group, F.col("_gain"), k)


def top_k(
    rows: DataFrame, k: int, group: Sequence[str], value: str, tie: str = "symbol"
) -> DataFrame:
    """First ``k`` rows by value, ties by symbol; a limit Spark prunes before the shuffle."""
    return first_rows(rows, group, [F.desc(value), F.col(tie)], k, "rank")


def precision_overlap(
    rows: DataFrame, k: int, group: Sequence[str] = ("trading_date",), value: str = "target_return"
) -> DataFrame:
    """Share of the predicted Top-K that is in the realized Top-K."""
    keys = [*group, "symbol"]
    predicted = top_k(rows, k, group, "score").select(*keys, F.lit(1).alias("_p"))
    realized = top_k(rows, k, group, value).select(*keys, F.lit(1).alias("_r"))
    return (
        predicted.join(realized, keys, "left")
        .groupBy(*group)
        .agg((F.count("_r") / F.count("_p")).alias("precision"))
    )


def precision_up(
    rows: DataFrame, k: int, group: Sequence[str] = ("trading_date",)
) -> DataFrame:
    """Share of the predicted Top-K labelled up."""
    return (
        top_k(rows, k, group, "score")
        .groupBy(*group)
        .agg(share(F.col("label") == UP).alias("precision"))
    )


def ranking_daily(rows: DataFrame, k: int, levels: int = 5) -> DataFrame:
    """Per date: size, average-rank IC, NDCG over graded relevance, Top-K overlap."""
    group = ["trading_date"]
    both = score_and_return_ranks(rows, group)
    grade = relevance_grade(F.col("r_pos"), F.col("n"), levels).cast("double")
    daily = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("symbols"),
        safe_corr(average_rank("s"), average_rank("r")).alias("rank_ic"),
    )
    return daily.join(ndcg_of(both, group, grade, k), group).join(
        precision_overlap(rows, k, group), group
    )


def ranking_summary(daily: DataFrame, min_symbols: int) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("dates"),
        F.min("symbols").alias("symbols_per_day_min"),
        F.max("symbols").alias("symbols_per_day_max"),
        F.bool_and(F.col("symbols") >= min_symbols).alias("large_enough"),
        F.avg("rank_ic").alias("daily_rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("daily_rank_ic_std"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("precision").alias("precision"),
    )


# ---- smoothing and calibration ---------------------------------------------


#: A block of an exponential mean ends where its decay reaches this power of two.
BLOCK_BITS = 500


def block_rows(alpha: float) -> int:
    """Rows after which what came before has decayed to nothing; the whole run for tiny alphas."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be above 0 and at most 1")
    if alpha == 1.0:
        return 1
    return max(1, min(1 << 30, int(BLOCK_BITS * math.log(2.0) / -math.log1p(-alpha))))


def exponential_mean(
    rows: DataFrame,
    series: Sequence[str],
    at: str,
    value: str,
    alphas: Sequence[float],
    out: str = "score",
) -> DataFrame:
    """Exponential mean of ``value`` along adjacent integers ``at``; one row per row and alpha.

    The mean starts anew after a gap. A step is the map ``last -> (1 - alpha) last + alpha value``;
    inside a block of steps the maps compose to a weighted running sum, and a block takes the end of
    the one before, whose own past has decayed below the precision of a double. So a run of any
    length is read once, in order, without arrays.
    """
    along = Window.partitionBy(*series).orderBy(at)
    numbered = rows.withColumn("_run", F.col(at) - F.row_number().over(along))
    table = F.create_map(*[F.lit(x) for a in alphas for x in (float(a), block_rows(float(a)))])
    run = [*series, "alpha", "_run"]
    in_run = Window.partitionBy(*run).orderBy(at)
    placed = (
        numbered.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
        .withColumn("_i", F.row_number().over(in_run) - 1)
        .withColumn("_rows", table[F.col("alpha")])
        .withColumn("_block", F.floor(F.col("_i") / F.col("_rows")))
        .withColumn("_k", F.col("_i") % F.col("_rows"))
    )
    # A block ends before the decay of its first row leaves the range of a double.
    decay = 1.0 - F.col("alpha")
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(F.col("alpha"))
    in_block = (
        Window.partitionBy(*run, "_block").orderBy(at)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scaled = F.when(F.col("_k") == 0, weight * F.col(value)).otherwise(
        weight * F.col(value) * F.pow(decay, -F.col("_k").cast("double"))
    )
    own = placed.withColumn("_scaled", scaled).withColumn(
        "_own",
        F.sum("_scaled").over(in_block)
        * F.when(F.col("_k") == 0, 1.0).otherwise(F.pow(decay, F.col("_k").cast("double"))),
    )
    # The last block end before a row is that of the block before its own.
    end = F.when(F.col("_k") == F.col("_rows") - 1, F.col("_own"))
    before = in_run.rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0))
    mean = F.col("_own") + held * F.pow(decay, (F.col("_k") + 1).cast("double"))
    return own.withColumn(out, F.when(F.col("alpha") == 1.0, F.col(value)).otherwise(mean)).drop(
        "_run", "_i", "_rows", "_block", "_k", "_scaled", "_own"
    )


def smoothed_ranks(
    signals: DataFrame, alphas: Sequence[float], segment: str | None = None
) -> DataFrame:
    """Daily percentile rank, then an exponential mean per symbol over adjacent sessions.

    The mean restarts after a missed session, and at the border of a ``segment``. Every
    alpha shares one ranking.
    """
    part = [] if segment is None else [segment]
    day = [*part, "trading_date"]
    narrow = signals.select(*day, "symbol", "score")
    placed = ordered_scan(narrow, day, [F.col("score"), F.col("symbol")], pos="_pos", size="_n")
    along_days = Window.partitionBy(*part).orderBy("trading_date")  # one row per session
    sessions = sized(
        signals.select(*day).distinct().withColumn("day_index", F.row_number().over(along_days)),
        "sessions",
    )
    current = placed.join(sessions, day).select(
        *day,
        "symbol",
        "day_index",
        ((F.col("_pos") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("current"),
    )
    smoothed = exponential_mean(current, [*part, "symbol"], "day_index", "current", alphas)
    return smoothed.select(*day, "symbol", "alpha", "score")


def percentile_ranks(
    signals: DataFrame, alpha: float, segment: str | None = None
) -> DataFrame:
    """:func:`smoothed_ranks` for one alpha."""
    return smoothed_ranks(signals, (alpha,), segment).drop("alpha")


LEAST_CALIBRATION_ROWS = 100


def calibrated_scores(
    fit: DataFrame, score: DataFrame, min_rows: int = LEAST_CALIBRATION_ROWS
) -> DataFrame:
    """Isotonic map from rank to expected return, fitted on ``fit`` and applied to ``score``.

    ``fit`` has score and target_return. Predictions outside the fitted range take the end
    values. Equal ranks are averaged first, which leaves the fit unchanged. Fewer than
    ``min_rows`` rows with a finite score and return are refused.
    """
    fit = fit.where(is_finite("score") & is_finite("target_return"))
    rows = fit.count()
    if rows < min_rows:
        raise ValueError(f"calibration needs {min_rows} rows, got {rows}")
    blocks = isotonic_blocks(fit, "score", "target_return")
    return apply_blocks(blocks, score, "score", "expected_return")


def calibration_summary(calibrated: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows, and the ranges of the ranks and of the calibrated returns."""
    return calibrated.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("score").alias("rank_min"),
        F.max("score").alias("rank_max"),
        F.min("expected_return").alias("expected_min"),
        F.max("expected_return").alias("expected_max"),
    )


# ---- audit -----------------------------------------------------------------


def audit_daily(
    rows: DataFrame,
    min_symbols: int = 50,
    quantile: float = 0.1,
    winsorize_percentile: float = 99.0,
) -> DataFrame:
    """Per label date: ordinal IC, tail spread and the spread of winsorized returns."""
    group = ["label_date"]
    both = score_and_return_ranks(rows, group).where(F.col("n") >= min_symbols)
    cap = quantiles_at(
        both, group, "target_return", {"_cap": winsorize_percentile / 100.0}, pos="r_pos", size="n"
    )
    capped = both.join(sized(cap, "cap"), group).withColumn(
        "_capped", F.least("target_return", "_cap")
    )
    tail = tail_size(F.col("n"), quantile)
    high, low = F.col("s_pos") > F.col("n") - tail, F.col("s_pos") <= tail
    spread = lambda c: F.avg(F.when(high, F.col(c))) - F.avg(F.when(low, F.col(c)))
    return capped.groupBy(*group).agg(
        F.count(F.lit(1)).alias("symbols"),
        safe_corr(F.col("s_pos").cast("double"), F.col("r_pos").cast("double")).alias("rank_ic"),
        spread("target_return").alias("spread"),
        spread("_capped").alias("winsorized_spread"),
    )


def audit_deciles(rows: DataFrame, min_symbols: int = 50) -> DataFrame:
    """Mean over dates of the mean return of each score decile (integer bounds)."""
    narrow = rows.select("label_date", "symbol", "score", "target_return")
    placed = ordered_scan(narrow, ["label_date"], [F.col("score"), F.col("symbol")], size="n")
    decile = (F.ceil(F.col("pos") * 10 / F.col("n")) - 1).cast("int")
    return (
        placed.where(F.col("n") >= min_symbols)
        .groupBy("label_date", decile.alias("decile"))
        .agg(F.avg("target_return").alias("_mean"))
        .groupBy("decile")
        .agg(F.avg("_mean").alias("mean_return"))
    )


def top_share(value: Column, place: Column, count: int) -> Column:
    return F.try_divide(F.sum(F.when(place <= count, value)), F.sum(value))


def audit_summary(daily: DataFrame, deciles: DataFrame) -> DataFrame:
    """One row of audit figures from the per-day and per-decile results."""
    std = F.stddev_samp("rank_ic")
    highest = Window.orderBy(F.desc("spread"), "label_date")  # one row per session
    placed = daily.withColumn("_place", F.row_number().over(highest))
    figures = placed.agg(
        F.avg("rank_ic").alias("daily_ic_mean"),
        std.alias("daily_ic_std"),
        F.try_divide(F.avg("rank_ic"), std).alias("daily_ic_ir"),
        share(F.col("spread") > 0).alias("positive_days_ratio"),
        F.avg("spread").alias("spread_mean"),
        F.percentile("spread", 0.5).alias("spread_median"),
        *[
            top_share(F.col("spread"), F.col("_place"), k).alias(f"top_{k}_day_contribution")
            for k in (1, 5, 10)
        ],
        F.avg("winsorized_spread").alias("winsorized_spread_mean"),
    )
    months = monthly_stability(monthly_ic(daily.where(F.col("rank_ic").isNotNull())))
    trend = deciles.agg(safe_corr(F.col("decile").cast("double"), "mean_return").alias("m"))
    return figures.withColumns(
        {
            "positive_month_ratio": months.select("positive_month_ratio").scalar(),
            "decile_monotonicity": trend.scalar(),
        }
    )


def audit_anomalies(summary: DataFrame) -> DataFrame:
    """One row per rule the audit figures break."""
    c = F.col
    rules = [
        (
            "ic_spread_divergence",
            "high",
            (F.abs(c("daily_ic_mean")) < WEAK_IC) & (c("spread_mean") > HIGH_SPREAD),
        ),
        ("tail_return_concentration", "high", c("top_1_day_contribution") > TOP_DAY_SHARE),
        (
            "weak_decile_monotonicity",
            "medium",
            F.abs(c("decile_monotonicity")) < WEAK_MONOTONICITY,
        ),
        (
            "winsorize_sensitivity",
            "high",
            c("winsorized_spread_mean") < c("spread_mean") * WINSORIZED_SHARE,
        ),
    ]
    flags = F.array(
        *[
            F.struct(
                F.lit(name).alias("type"), F.lit(level).alias("severity"), rule.alias("raised")
            )
            for name, level, rule in rules
        ]
    )
    return summary.select(F.inline(flags)).where("raised").select("type", "severity")


# ---- comparisons -----------------------------------------------------------


def paired_deltas(metrics: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Candidate minus baseline per (model, metric)."""
    pick = lambda name: metrics.where(F.col("feature_set") == name)
    mine = pick(candidate).select("model", "encoder", "metric", F.col("value").alias("_c"))
    base = pick(baseline).select("model", "metric", F.col("value").alias("_b"))
    return mine.join(base, ["model", "metric"]).select(
        "model", "encoder", "metric", (F.col("_c") - F.col("_b")).alias("delta")
    )


def exposure_daily(
    rows: DataFrame, exposures: DataFrame, names: Sequence[str], k: int
) -> DataFrame:
    """Per date with full exposures: score correlation and Top-K mean z of each exposure."""
    joined = rows.join(
        exposures.withColumn("_has", F.lit(1)), ["trading_date", "symbol"], "left"
    )
    stats = []
    for e in names:
        ok = F.count(F.when(is_finite(e), 1)) == F.count(F.lit(1))
        std = F.stddev_pop(e)
        stats += [
            F.when(ok & (std > 0), safe_corr("score", e)).alias(f"{e}_corr"),
            F.avg(e).alias(f"{e}_mean"),
            F.when(ok & (std > 0), std).alias(f"{e}_std"),
        ]
    pool = (
        joined.groupBy("trading_date")
        .agg((F.count("_has") == F.count(F.lit(1))).alias("_full"), *stats)
        .where("_full")
        .drop("_full")
    )
    chosen = top_k(joined, k, ["trading_date"], "score").groupBy("trading_date").agg(
        *[F.avg(e).alias(f"{e}_top") for e in names]
    )
    z = [
        ((F.col(f"{e}_top") - F.col(f"{e}_mean")) / F.col(f"{e}_std")).alias(f"{e}_z")
        for e in names
    ]
    return pool.join(chosen, "trading_date").select(
        "trading_date", *[f"{e}_corr" for e in names], *z
    )


def industry_distance(rows: DataFrame, exposures: DataFrame, k: int) -> DataFrame:
    """Total variation between Top-K and universe industry shares, fully covered dates only."""
    joined = rows.join(
        exposures.select("trading_date", "symbol", "industry"), ["trading_date", "symbol"], "left"
    )
    marked = joined.groupBy("trading_date", "industry").agg(F.count(F.lit(1)).alias("_all"))
    chosen = (
        top_k(joined, k, ["trading_date"], "score")
        .groupBy("trading_date", "industry")
        .agg(F.count(F.lit(1)).alias("_top"))
    )
    day = Window.partitionBy("trading_date")  # one row per industry of the date
    top = F.coalesce("_top", F.lit(0))
    shares = marked.join(chosen, ["trading_date", "industry"], "left").select(
        "trading_date",
        "industry",
        F.abs(
            F.try_divide(top, F.sum(top).over(day)) - F.col("_all") / F.sum("_all").over(day)
        ).alias("_gap"),
    )
    return (
        shares.groupBy("trading_date")
        .agg(
            (F.sum("_gap") / 2).alias("industry_distance"),
            F.count(F.when(F.col("industry").isNull(), 1)).alias("_unknown"),
        )
        .where("_unknown = 0")
        .drop("_unknown")
    )


def distribution(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, five numbers and negative share of finite values."""
    finite = rows.where(is_finite(value))
    basic = finite.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        share(F.col(value) < 0).alias("negative_fraction"),
    )
    cuts = exact_quantiles(finite, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    if keys:
        return basic.join(cuts, list(keys))
    return basic.withColumns({q: cuts.select(q).scalar() for q in ("q25", "median", "q75")})


def seed_aggregate(metrics: DataFrame, names: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds of the locked metrics."""
    return (
        metrics.where(F.col("metric").isin(*names))
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("seeds"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
        )
    )
