"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text is cut behind a word where the gear hash of the last 16 bytes falls under a threshold, so the
cuts inside a passage depend on the passage alone and an insertion shifts none of the later ones.
Stretches without blanks are cut at characters by the same hash. Text that the hash never cuts, as
one word over and over, is cut after ``MOST_WORDS`` words or ``MOST_BYTES`` bytes.

What is deduplicated are chunks with the one that follows: a pair of chunks counts as repeated if an
earlier place (smaller id, then position) holds the same two side by side, and its first place stays.
A run is chunks of which each pair of neighbours is repeated; it is removed if it holds at least
``least_words`` words, or ``LEAST_BYTES`` bytes where there are few blanks. So common chunks that
stand in one document by chance make no run, as no earlier text has them together; shorter runs are
single shared lines. A text of one chunk counts by that chunk.

Digests cross the cluster three times, each time fewer: their first half alone finds those that occur
twice or more, then only the places of these go on, with a second half that tells collisions apart. A
frequent digest is counted before it is shuffled, and its places meet one row per digest in a join of
two written tables, whose large partitions Spark splits. A document gathers only its own repeats.

A null or empty text has no chunks and stays as it is. Repeated rows (same id and text) are one
document: all are treated alike, so the first stays whole with its repetitions. Different texts under
one id are told apart by a hash of the text. An empty table gives an empty result; extra columns are
carried by :func:`remove_repeats` as one value and cannot clash, but that columns named ``_spans`` and
``_sources`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.carried import carried
from tapeloom.plans.shared import settle

WINDOW = 16
#: A cut stands behind one word in four on average.
CUT_BELOW = 64
#: Without a blank for this many bytes, one character in 64 ends a chunk.
LONG_RUN = 64
LONG_CUT_BELOW = 4
#: Text whose hash never falls under the threshold (one word over and over) is cut after so much.
MOST_WORDS = 64
MOST_BYTES = 8192
LEAST_WORDS = 24
#: As long as 24 long words; text without blanks has no words to count.
LEAST_BYTES = 288
#: Bytes of text hashed in one go; a longer text is still taken whole.
STEP_BYTES = 1_000_000
BLANKS = [9, 10, 11, 12, 13, 32]
KEY = ["_id", "_tie"]


def _gear() -> np.ndarray:
    """One 32-bit number per byte value; 256 stands for the gap between texts and adds nothing."""
    table = [
        int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little")
        for b in range(256)
    ]
    return np.array([*table, 0], np.uint32)


GEAR = _gear()
IS_BLANK = np.isin(np.arange(257), BLANKS)


def _with_limits(
    own: np.ndarray, words: np.ndarray, starts: np.ndarray, codes: np.ndarray
) -> np.ndarray:
    """Add cuts where a chunk holds over ``MOST_WORDS`` words or ``MOST_BYTES`` bytes."""
    counts = words[own - 1]
    more = [
        starts[np.arange(counts[i] + MOST_WORDS, counts[i + 1], MOST_WORDS)]
        for i in np.flatnonzero(np.diff(counts) > MOST_WORDS).tolist()
    ]
    if more:
        own = np.unique(np.concatenate([own, *more]))
    more = []
    for i in np.flatnonzero(np.diff(own) > MOST_BYTES).tolist():
        at = np.arange(own[i] + MOST_BYTES, own[i + 1], MOST_BYTES)
        while len(inner := np.flatnonzero((codes[at] & 0xC0) == 0x80)):
            at[inner] -= 1  # back to the first byte of the character
        more.append(at)
    return np.unique(np.concatenate([own, *more])) if more else own


def _edges(texts: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the offsets where chunks begin, its length last, and the words before each."""
    gap = WINDOW
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + gap) - sizes
    codes = np.full(int(sizes.sum()) + gap * (len(texts) + 1), 256, np.uint16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    codes[inside] = flat
    h = GEAR[codes]
    for width in (1, 2, 4, 8):
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
    roll = (h >> np.uint32(24)).astype(np.uint16)
    blank = IS_BLANK[codes]
    text = codes != 256
    word_start = np.zeros(len(codes) + 1, bool)
    word_start[1:-1] = ~blank[1:] & text[1:] & (blank[:-1] | ~text[:-1])
    # A chunk may begin at a word behind a blank, or at a character far from the last blank.
    begin = np.zeros(len(codes) + 1, bool)
    begin[1:-1] = word_start[1:-1] & blank[:-1] & (roll[:-1] < CUT_BELOW)
    at = np.arange(len(codes))
    last_break = np.maximum.accumulate(np.where(blank | ~text, at, 0))
    far = (at - last_break >= LONG_RUN) & (roll < LONG_CUT_BELOW)
    far[:-1] &= text[1:] & ((codes[1:] & 0xC0) != 0x80)
    begin[1:] |= far & text
    words = np.cumsum(word_start)
    starts = np.flatnonzero(word_start)
    cuts = np.flatnonzero(begin)
    out = []
    low = np.searchsorted(cuts, first, "right")
    high = np.searchsorted(cuts, first + sizes, "left")
    for i in range(len(texts)):
        own = np.concatenate([[first[i]], cuts[low[i] : high[i]], [first[i] + sizes[i]]])
        own = _with_limits(own, words, starts, codes)
        before = words[own - 1]
        before[0] = words[first[i] - 1]
        out.append((own - first[i], before - before[0]))
    return out


def chunk_edges(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk offsets and word counts of each text; an empty text has the offsets (0, 0)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end]) + WINDOW
            end += 1
        yield from _edges(texts[at:end])
        at = end


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _id, _tie, _text): ``_tie`` is the hash of the text where several rows share an id,
    else 0."""
    rows = carried(docs, _id=F.col(id_col), _text=F.col(text_col))
    several = settle(
        rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared-ids"
    )
    if several.isEmpty():
        return rows.withColumn("_tie", F.lit(0).cast("long"))
    several = several.select(F.col("_id").alias("_shared"), F.lit(True).alias("_several"))
    tie = F.when(F.col("_several"), F.xxhash64("_text")).otherwise(F.lit(0).cast("long"))
    joined = rows.join(several, F.col("_id").eqNullSafe(F.col("_shared")), "left")
    return joined.withColumn("_tie", tie).drop("_shared", "_several")


def pair_ends(edges: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Begin and end of each chunk together with the next one, or of an only chunk."""
    return zip(edges, edges[2:] if len(edges) > 2 else edges[1:], strict=False)


def pair_places(keyed: DataFrame) -> DataFrame:
    """(head, tail, _id, _tie, at): both parts of the digest of each pair of chunks, and the number
    of its first chunk in the text."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 250):
                part = batch.iloc[low : low + 250]
                texts = [t.encode("utf-8", "surrogatepass") for t in part["text"]]
                digests: list[bytes] = []
                counts = []
                for text, (edges, _) in zip(texts, chunk_edges(texts), strict=True):
                    own = [xxhash.xxh3_128_digest(text[a:b]) for a, b in pair_ends(edges.tolist())]
                    counts.append(len(own))
                    digests += own
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                n = np.array(counts, np.int64)
                numbers = np.arange(len(both)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame(
                    {
                        "head": both[:, 0],
                        "tail": both[:, 1].astype(np.int32),
                        "_id": part["_id"].repeat(n).to_numpy(),
                        "_tie": part["_tie"].repeat(n).to_numpy(),
                        "at": numbers.astype(np.int32),
                    }
                ).astype({"_id": "Int64"})

    texts = keyed.select(
        F.col("_id").cast("long").alias("_id"), "_tie", F.col("_text").alias("text")
    ).where(F.length("text") > 0)
    return texts.mapInPandas(chunks, "head long, tail int, _id long, _tie long, at int")


def repeated_pairs(keyed: DataFrame) -> DataFrame:
    """(_id, _tie, _repeats): numbers of the pairs that an earlier place holds, with its id."""
    places = pair_places(keyed)
    heads = places.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = settle(places.join(settle(heads.select("head"), "heads"), "head"), "repeated")
    first = settle(
        found.groupBy("head", "tail")
        .agg(F.min(F.struct(*KEY, "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("head", "tail", "first"),
        "first",
    )
    later = found.join(first, ["head", "tail"]).where(
        ~F.struct(*KEY, "at").eqNullSafe(F.col("first"))
    )
    return later.groupBy(*KEY).agg(
        F.collect_set(F.struct("at", F.col("first")["_id"].alias("source"))).alias("_repeats")
    )


def removed_spans(
    text: bytes, repeats: Sequence[tuple[int, int | None]], least_words: int
) -> list[tuple[int, int, list[int | None]]]:
    """(begin, end, ids of the earlier places) of the runs to remove, as byte offsets."""
    ((edges, words),) = _edges([text])
    source = dict(repeats)
    spans = []
    last = len(edges) - 1
    at, n = 0, max(1, last - 1)
    while at < n:
        end = at
        while end < n and end in source:
            end += 1
        if end > at:
            # The pairs at..end-1 cover one chunk more.
            stop = min(end + 1, last)
            size = int(edges[stop] - edges[at])
            if words[stop] - words[at] >= least_words or size >= LEAST_BYTES:
                ids = {source[i] for i in range(at, end)}
                known = sorted(i for i in ids if i is not None)
                spans.append((int(edges[at]), int(edges[stop]), known + [None] * (None in ids)))
        at = max(end, at + 1)
    return spans


def _cut(text: Column, repeats: Column, least_words: int) -> Column:
    fields = "text string, spans array<struct<begin:int,length:int>>, sources array<long>"

    @F.pandas_udf(fields)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, found in zip(texts, lists, strict=True):
                if found is None or text is None:
                    out.append((text, [], []))
                    continue
                pairs = [(r["at"], r["source"]) for r in found]
                raw = text.encode("utf-8", "surrogatepass")
                kept, spans, sources, done = [], [], set(), 0
                for begin, end, ids in removed_spans(raw, pairs, least_words):
                    kept.append(raw[done:begin])
                    place = len(raw[:begin].decode("utf-8", "surrogatepass"))
                    spans.append(
                        {
                            "begin": place,
                            "length": len(raw[begin:end].decode("utf-8", "surrogatepass")),
                        }
                    )
                    sources.update(i for i in ids if i is not None)
                    done = end
                kept.append(raw[done:])
                rest = b"".join(kept).decode("utf-8", "surrogatepass")
                out.append((rest, spans, sorted(sources)))
            yield pd.DataFrame(out, columns=["text", "spans", "sources"])

    return cut(text, repeats)


def remove_repeats(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns with repeated passages cut out of the text.

    Adds ``_spans`` (character offsets of what was removed) and ``_sources`` (ids of the documents
    that hold it first); both are empty for a text left as it was.
    """
    keyed = _keyed(docs, id_col, text_col)
    repeats = settle(repeated_pairs(keyed), "repeats").select(
        F.col("_id").alias("_of"), F.col("_tie").alias("_of_tie"), "_repeats"
    )
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_tie") == F.col("_of_tie"))
    rows = keyed.join(repeats, same, "left")
    kept = [c for c in docs.columns if c not in ("_spans", "_sources")]
    touched = rows.where("_repeats is not null").withColumn(
        "_cut", _cut(F.col("_text"), F.col("_repeats"), least_words)
    )
    empty = F.array()
    whole = rows.where("_repeats is null").select(
        *[F.col("_doc")[c].alias(c) for c in kept],
        empty.cast("array<struct<begin:int,length:int>>").alias("_spans"),
        empty.cast("array<long>").alias("_sources"),
    )
    new = [(F.col("_cut")["text"] if c == text_col else F.col("_doc")[c]).alias(c) for c in kept]
    changed = touched.select(
        *new, F.col("_cut")["spans"].alias("_spans"), F.col("_cut")["sources"].alias("_sources")
    )
    return whole.unionByName(changed)
