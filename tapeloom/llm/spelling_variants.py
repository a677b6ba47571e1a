"""Spelling variants: words one edit apart, found level by level in tries kept as edge tables.

A search holds states (word, position, node, edits): so much of the word is read, the trie node that
it led to, and the edits made. All words walk at once. A level joins the states with the edge table
on (node, next character); a state with no edit may also take an edge with another character
(replacement) or take one without reading on (insertion). States that end at a word after one edit
make neighbours.

* Every pair is found from one side: the shorter word inserts, of two equally long ones the one with
  the smaller character replaces. An insertion into a run of one character is made at its end only.
* An edit leaves half of a word as it is. A trie over the words serves edits in the second half, one
  over the reversed words those in the first; so no state starts above the middle of a word, where
  few words share a node. There is one pair of tries for each length of the words that are searched
  for; a node is the hash of length, direction and prefix.
* States without an edit are prefixes of the word itself, hence known for all levels at once; they
  meet the edges in the first join. Later levels hold states with one edit, which match or go.
* An edge knows how many words lie below it, the word if it is one, and which characters follow.
  States whose next character does not follow go at once; a state above a single word is decided
  by comparing the two words, as are all neighbours in the end, so no hash decides anything alone.

No side of a join is broadcast. A word makes some twenty states, and Spark sizes them as if it made
one; a settled table counts by its compressed files, a tenth of what it takes as a hash table. So
below the size at which words cease to be broadcast, the driver would gather many times that size.

A node has at most as many edges as there are characters; that a third of all words may share a
prefix makes many states at one node, which adaptive execution splits in the join.

Words are cut from whole texts; a null text has none, a null id counts as an empty string in the
checksum that picks the code point to delete. Repeated rows count again. An empty table gives an
empty result; other columns are left behind, so names cannot clash. Words of any length are handled:
states carry ``AHEAD`` characters and fetch more when they have read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a code point.
DAMAGED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word's form is at least so many times as frequent.
FORM_TIMES = 5
#: Characters that a state carries.
AHEAD = 32

# Odd factors and a prime modulus of the running prefix hash, two numbers of 31 bits.
_PRIMES = (2_147_483_647, 2_147_483_629)
_FACTORS = (1_103_515_245, 1_664_525_013)


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever sizes Spark expects; adaptive execution still splits its skew."""
    return left.join(right.hint("merge"), on, how)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words after the deletions, of the least length and count."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(
            F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))
        ).alias("run"),
    ).where(F.length("run") >= LEAST_LENGTH)
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def prefix_hashes(text: str, length: int, reverse: bool) -> list[int]:
    """Hash of each prefix of ``text`` (the empty one first) in the trie of words of ``length``."""
    (p, q), (f, g) = _PRIMES, _FACTORS
    a, b = 2 * length + reverse + 1, 3 * length + reverse + 7
    out = [a << 31 | b]
    for c in text:
        code = ord(c) + 1
        a, b = (a * f + code) % p, (b * g + code) % q
        out.append(a << 31 | b)
    return out


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each word from its middle on, in both directions."""
    columns = ["node", "ch", "child", "follows", "last", "wid"]
    for batch in batches:
        out = []
        for wid, word in zip(batch["wid"], batch["word"], strict=True):
            n = len(word)
            for reverse in (False, True):
                text = word[::-1] if reverse else word
                nodes = prefix_hashes(text, n, reverse)
                for i in range((n - 1) // 2, n):
                    follows = _bit(text[i + 1]) if i + 1 < n else 0
                    out.append((nodes[i], text[i], nodes[i + 1], follows, i + 1 == n, wid))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def _bit(ch: str) -> int:
    return 1 << (ord(ch) % 63)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States without an edit: every prefix from the middle on, in the tries of both lengths."""
    columns = ["wid", "node", "reverse", "inserts", "rest", "left"]
    for batch in batches:
        out = []
        for wid, word in zip(batch["wid"], batch["word"], strict=True):
            n = len(word)
            for reverse in (False, True):
                text = word[::-1] if reverse else word
                middle = n - n // 2 if reverse else n // 2
                for longer in (0, 1):
                    nodes = prefix_hashes(text, n + longer, reverse)
                    for i in range(middle, n + longer):
                        ahead = text[i : i + AHEAD]
                        out.append((wid, nodes[i], reverse, longer == 1, ahead, n - i))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def edge_table(words: DataFrame) -> DataFrame:
    """(node, ch, child, n_below, only, follows): the edges of all tries, written once."""
    rows = words.select("wid", "word").mapInPandas(
        _edges, "node long, ch string, child long, follows long, last boolean, wid long"
    )
    # The last edge of a word is its own even if two prefixes had one hash.
    return settle(
        rows.groupBy("node", "ch", "child", F.when(F.col("last"), F.col("wid")).alias("end"))
        .agg(
            F.count(F.lit(1)).alias("n_below"),
            F.min("wid").alias("only"),
            F.bit_or("follows").alias("follows"),
        )
        .drop("end"),
        "edges",
    )


def _alive(moved: DataFrame) -> DataFrame:
    """States after an edge that may still end at a word: their next character follows, or none."""
    bit = F.expr("shiftleft(1L, cast(ascii(rest) % 63 AS int))")
    alive = (F.col("rest") == "") | (F.col("follows").bitwiseAND(bit) != 0)
    return settle(
        moved.where(alive).select("wid", "node", "reverse", "rest", "left", "n_below", "only"),
        "states",
    )


def _read_on(met: DataFrame) -> DataFrame:
    """States that read a character and went along an edge."""
    return met.select(
        "wid",
        F.col("child").alias("node"),
        "reverse",
        F.expr("substring(rest, 2)").alias("rest"),
        (F.col("left") - 1).alias("left"),
        "n_below",
        "only",
        "follows",
    )


def _fetched(states: DataFrame, words: DataFrame) -> DataFrame:
    """Give states the next characters of their words: of the last ``left``, the first ones."""
    forward = F.expr(f"substring(word, length(word) - left + 1, {AHEAD})")
    back = F.expr(f"reverse(substring(word, greatest(left - {AHEAD}, 0) + 1, least(left, {AHEAD})))")
    rest = F.when(F.col("reverse"), back).otherwise(forward)
    found = _merged(states, words.select("wid", "word"), "wid").withColumn("rest", rest)
    return settle(found.select("wid", "node", "reverse", "rest", "left"), "fetched")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each word with each word one edit away, both ways; ``words`` has (wid, word)."""
    edges = edge_table(words)
    starts = words.select("wid", "word").mapInPandas(
        _starts,
        "wid long, node long, reverse boolean, inserts boolean, rest string, left int",
    )
    own = F.substring("rest", 1, 1)
    met = _merged(starts, edges, "node").where(
        F.when(F.col("inserts"), F.col("ch") != own).otherwise(F.col("ch") > own)
    )
    read = F.when(F.col("inserts"), F.lit(0)).otherwise(F.lit(1))
    moved = met.select(
        "wid",
        F.col("child").alias("node"),
        "reverse",
        F.when(F.col("inserts"), F.col("rest")).otherwise(F.expr("substring(rest, 2)")).alias("rest"),
        (F.col("left") - read).alias("left"),
        "n_below",
        "only",
        "follows",
    )
    states = _alive(moved)
    found, level = [], 0
    while True:
        # Above a single word, or at the end, the words themselves decide.
        ready = (F.col("n_below") == 1) | (F.col("left") == 0)
        found.append(states.where(ready).select("wid", F.col("only").alias("other")))
        going = states.where(~ready).drop("n_below", "only")
        if going.isEmpty():
            break
        level += 1
        if level % AHEAD == 0:
            going = _fetched(going, words)
        on = ["node", "ch"]
        reading = going.withColumn("ch", F.substring("rest", 1, 1))
        states = _alive(_read_on(_merged(reading, edges, on)))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    one = words.select("wid", F.col("word").alias("a"))
    two = words.select(F.col("wid").alias("other"), F.col("word").alias("b"))
    pairs = (
        _merged(_merged(candidates.distinct(), one, "wid"), two, "other")
        .where(F.levenshtein("a", "b", 1) == 1)
        .select("a", "b")
        .distinct()
    )
    pairs = settle(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n)."""
    rows = settle(words.select(F.xxhash64("word").alias("wid"), "word", "n"), "words")
    counts = rows.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = (
        _merged(near_pairs(rows), counts, "b")
        .groupBy(F.col("a").alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("form"))).alias("best"),
        )
    )
    form_n = -F.col("best.rank")
    fits = form_n >= FORM_TIMES * F.col("n")
    forms = settle(
        _merged(rows, best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.form")).alias("form"),
            F.when(fits, form_n).alias("form_n"),
        ),
        "forms",
    )
    return _merged(forms, roots_of(forms), "word").select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow each other; every round doubles the way.

    Counts grow along the way, so it has no circle.
    """
    now = settle(
        forms.select(
            "word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("goes")
        ),
        "roots",
    )
    while True:
        step = now.where("goes").select(
            F.col("word").alias("root"), F.col("root").alias("further")
        )
        joined = _merged(now, step, "root", "left")
        if joined.where("further is not null").isEmpty():
            return now.select("word", "root")
        now = settle(
            joined.select("word", F.coalesce("further", "root").alias("root"), "goes"), "roots"
        )
