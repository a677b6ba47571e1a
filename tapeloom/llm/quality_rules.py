"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A word is a run of characters other than space and U+0009..U+000D. A null text has no words and
fails; so does an empty one. Rows are judged one by one: repeated rows stay, an empty table gives an
empty one, and all input columns but the id and the text are left behind, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in a for it on "
    "der die das und von zu den mit ist nicht ein im "
    "le la les de des et un une du que en est "
    "el los las y del se con por para una su al"
).split()


class Threshold(NamedTuple):
    """``low <= measure <= high``; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("n_words", 50, 100_000),
    Threshold("mean_word_length", 2, 14),
    Threshold("symbol_ratio", None, 0.05),
    Threshold("stop_word_ratio", 0.05, None),
    Threshold("dup_line_ratio", None, 0.4),
    Threshold("ellipsis_line_ratio", None, 0.5),
)


def _words(text: Column) -> Column:
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def with_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text: words, characters, symbols, lines, and words in repeated windows.

    Windows of three words are sorted by hash inside the row, so equal ones are neighbours; a word
    counts once if any repeated window covers it.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.translate(x, BLANKS + " ", "") != ""
    )
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    base = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")
    ).select(
        "doc_id",
        _words(text).alias("_words"),
        F.length(F.translate(text, BLANKS + " ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    size = F.size("_words")
    windows = F.when(
        size >= 3,
        F.array_sort(
            F.transform(
                F.sequence(F.lit(1), size - 2),
                lambda i: F.struct(F.xxhash64(F.slice("_words", i, 3)).alias("h"), i.alias("at")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    counted = base.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…")))
        .cast("long")
        .alias("n_ellipsis_lines"),
        F.size(F.filter("_words", lambda w: F.array_contains(stop, w)))
        .cast("long")
        .alias("n_stop_words"),
        windows.alias("_windows"),
    )

    def repeated(window: Column, i: Column) -> Column:
        before, after = F.get("_windows", i - 1), F.get("_windows", i + 1)
        same = (window["h"] == before["h"]) | (window["h"] == after["h"])
        return F.when(same, window["at"])

    marked = counted.withColumn(
        "_at", F.array_sort(F.array_compact(F.transform("_windows", repeated)))
    ).drop("_windows")
    # Each repeated window adds the words that the one before it does not cover.
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct(
            (acc["n"] + F.least(at - acc["last"], F.lit(3))).alias("n"), at.alias("last")
        ),
        lambda acc: acc["n"],
    )
    # A filter on the result must not be pushed below this point, where the arrays would be built
    # again for every element; Spark moves no filter past an expression like this one.
    once = F.monotonically_increasing_id() >= 0
    return marked.withColumn("n_repeat_words", F.when(once, covered)).drop("_at")


def text_of(text_col: str) -> Column:
    return F.col(text_col).cast("string")


def measures() -> dict[str, Column]:
    """The ratios that thresholds may name; an empty text has zero for all."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }


def compile_thresholds(thresholds: Sequence[Threshold]) -> tuple[Column, Column]:
    """Whether all thresholds hold, and the names of the measures that fail."""
    holds, failed = F.lit(True), []
    for t in thresholds:
        ok = F.lit(True)
        if t.low is not None:
            ok = ok & (F.col(t.measure) >= t.low)
        if t.high is not None:
            ok = ok & (F.col(t.measure) <= t.high)
        holds = holds & ok
        failed.append(F.when(~ok, F.lit(t.measure)))
    return holds, F.array_join(F.array(*failed), ",")


def judge_quality(
    docs: DataFrame,
    thresholds: Sequence[Threshold] = THRESHOLDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: counts, ratios, base_failed, the failed measures, kept."""
    base_failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    holds, failed = compile_thresholds(thresholds)
    return (
        with_base(docs, id_col, text_col)
        .withColumns(measures())
        .withColumns({"base_failed": base_failed, "failed": failed})
        .withColumn("kept", ~F.col("base_failed") & holds)
    )
