"""Best-fit packing of tokenized documents into sequences of fixed capacity, by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the data) is planned on the
driver:

1. Large lengths, sorted, are cut into groups of equal cardinality; each group is rounded up to its
   largest length, which leaves few sizes.
2. Configurations of these sizes are chosen one after the other: the largest size left is completed
   to the fullest sequence that the sizes left allow, as often as they allow.
3. Actual documents replace the rounded sizes, which frees room.
4. Small pieces go, longest first, to the sequences with the least room that holds them.

The plan is a table of intervals: the pieces of one length are numbered, and an interval of numbers
takes one slot of equal sequences. Numbers come from salted windows, so the many pieces of a hot
length (full ones, above all) are not sorted in one task.

A null or empty text is one piece that holds the end mark alone. Repeated rows are packed one by one.
An empty table gives an empty result. Of the documents only the id and the text are read; extra
columns of a piece table are carried, and may not be named as the added ones.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.pretokens import json_ranks, piece_encoder, pretokens
from tapeloom.plans.shared import settle

#: Words whose ids a task keeps before it starts its table anew.
KEPT_WORDS = 200_000
#: Rows numbered by one task, on average.
NUMBERED_ROWS = 200_000
GROUPS = 2000


class WordIds(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        ranks, self.specials = json_ranks(path)
        self.encode = piece_encoder(ranks)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return ids

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; special strings inside it are their own tokens."""
        segments: list[str] = []
        marks: list[list[bytes]] = []
        for text in texts:
            parts, ids = [text], [b""]
            for special, i in self.specials.items():
                if special in text:
                    parts, ids = self._split(parts, ids, special, i)
            segments += parts
            marks.append(ids)
        words = pretokens(segments)
        return [
            b"".join(mark + b"".join([self[w] for w in next(words)]) for mark in ids)
            for ids in marks
        ]

    @staticmethod
    def _split(
        parts: list[str], ids: list[bytes], special: str, i: int
    ) -> tuple[list[str], list[bytes]]:
        """Cut the parts at ``special``; ids holds what stands before each part."""
        out, before, token = [], [], np.array([i], "<u4").tobytes()
        for part, mark in zip(parts, ids, strict=True):
            cut = part.split(special)
            out += cut
            before += [mark] + [token] * (len(cut) - 1)
        return out, before


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids (little-endian unsigned 32 bits).

    A document longer than ``capacity`` is cut from its end, so only its first piece is shorter.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.iloc[at : at + 250]
                rows = []
                encoded = table.texts(part["text"].tolist())
                for doc_id, ids in zip(part["doc_id"], encoded, strict=True):
                    ids += end
                    n = len(ids) // 4
                    stops = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                    start = 0
                    for piece, stop in enumerate(stops):
                        rows.append((doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]))
                        start = stop
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                yield out.astype({"doc_id": "Int64"})
        table.clear()  # the worker lives on and does other work

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids binary"
    )


def _groups(counts: Mapping[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces) of groups of equal cardinality, largest first."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    out: list[tuple[int, int]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, 0))
                room = share
            take = min(room, left)
            size, n = out[-1]
            out[-1] = (size, n + take)
            room -= take
            left -= take
    merged: dict[int, int] = defaultdict(int)
    for size, n in out:
        merged[size] += n
    return sorted(merged.items(), reverse=True)


def _fullest(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Sizes (largest first, each at most as often as it is left) that fill ``room`` the most."""
    reach = [1]  # bit s: the sum s can be reached with the sizes so far
    steps: list[tuple[int, int]] = []
    limit = (1 << (room + 1)) - 1
    for size in sizes:
        if size > room:
            continue
        for _ in range(min(left[size], room // size)):
            grown = (reach[-1] | reach[-1] << size) & limit
            if grown == reach[-1]:
                break
            reach.append(grown)
            steps.append((size, len(reach) - 1))
        if reach[-1] >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    chosen = []
    for size, n in reversed(steps):
        if not reach[n - 1] >> best & 1:
            chosen.append(size)
            best -= size
    return sorted(chosen, reverse=True)


def _configurations(
    groups: list[tuple[int, int]], capacity: int
) -> list[tuple[int, list[int]]]:
    """(times, sizes) of each configuration chosen."""
    left = dict(groups)
    sizes = [size for size, _ in groups]
    out = []
    while sizes:
        seed = sizes[0]
        left[seed] -= 1
        chosen = [seed, *_fullest(sizes, left, capacity - seed)]
        left[seed] += 1
        uses = {s: chosen.count(s) for s in chosen}
        times = min(left[s] // n for s, n in uses.items())
        for s, n in uses.items():
            left[s] -= times * n
        sizes = [s for s in sizes if left[s]]
        out.append((times, chosen))
    return out


def _substitute(
    counts: Mapping[int, int],
    groups: list[tuple[int, int]],
    configurations: list[tuple[int, list[int]]],
) -> list[tuple[int, tuple[int, ...]]]:
    """(times, actual lengths): documents, longest first, take the slots of their group in turn."""
    queue: dict[int, list[list[int]]] = {size: [] for size, _ in groups}
    lengths = [[length, counts[length]] for length in sorted(counts, reverse=True)]
    at = 0
    for size, n in groups:
        while n:
            take = min(n, lengths[at][1])
            queue[size].append([lengths[at][0], take])
            lengths[at][1] -= take
            n -= take
            at += not lengths[at][1]
    out = []
    for times, sizes in configurations:
        slots = []
        for size in sizes:
            runs, need, own = [], times, queue[size]
            while need:
                take = min(need, own[0][1])
                runs.append([own[0][0], take])
                own[0][1] -= take
                need -= take
                if not own[0][1]:
                    own.pop(0)
            slots.append(runs)
        while times:
            same = min(runs[0][1] for runs in slots)
            out.append((same, tuple(runs[0][0] for runs in slots)))
            times -= same
            for runs in slots:
                runs[0][1] -= same
                if not runs[0][1]:
                    runs.pop(0)
    return out


def plan_sequences(
    counts: Mapping[int, int], capacity: int, groups: int = GROUPS, small: int | None = None
) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of all sequences for a histogram of piece lengths."""
    small = capacity // 16 if small is None else small
    large = {k: n for k, n in counts.items() if k > small and n}
    rounded = _groups(large, groups)
    filled = _substitute(large, rounded, _configurations(rounded, capacity))
    by_room: dict[int, list[list]] = defaultdict(list)
    for times, lengths in filled:
        by_room[capacity - sum(lengths)].append([times, lengths])
    rooms = sorted(by_room)
    for length in sorted((k for k in counts if k <= small), reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                by_room[capacity] = [[-(-left // each), ()]]
                rooms.append(capacity)
            room = rooms[i]
            times, lengths = by_room[room].pop()
            take = min(left, times)
            if take < times:
                by_room[room].append([times - take, lengths])
            if not by_room[room]:
                del by_room[room], rooms[i]
            if room - length not in by_room:
                bisect.insort(rooms, room - length)
            by_room[room - length].append([take, (*lengths, length)])
            left -= take
    return [(times, lengths) for room in rooms for times, lengths in by_room[room]]


def _intervals(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number behind the last, first sequence, offset) of each slot."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            first = used[length]
            out.append((length, first, first + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def _numbered(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0; ``_row`` makes the order total."""
    rows = pieces.count()
    salts = max(1, -(-rows // NUMBERED_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = cells.select(
        "length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("length", "_salt").orderBy("_row")
    return (
        salted.withColumn("_at", F.row_number().over(inside))
        .join(shifts, ["length", "_salt"])
        .withColumn("_number", F.col("_at") + F.col("_shift") - 1)
        .drop("_at", "_shift", "_salt")
    )


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    rows = settle(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}
    plan = spark.createDataFrame(
        _intervals(plan_sequences(counts, capacity)),
        "length long, _first long, _stop long, _sequence long, offset long",
    )
    # The plan depends on the histogram alone: its size is bounded by the capacity, not the data.
    here = (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_stop"))
    numbered = _numbered(rows).withColumnRenamed("length", "_length")
    return (
        numbered.join(F.broadcast(plan), (F.col("_length") == F.col("length")) & here)
        .withColumn("sequence_id", F.col("_sequence") + F.col("_number") - F.col("_first"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def assemble(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, its pieces in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("length"), parts.alias("parts"))
        .select(
            "sequence_id",
            "length",
            F.aggregate(
                F.col("parts")["ids"], F.lit(b""), lambda all_, ids: F.concat(all_, ids)
            ).alias("ids"),
        )
    )
