"""Token counts by byte-pair merging with a heap and a linked list.

The adjacent pair of lowest rank (leftmost of equal ones) is merged again and again; the count of a
word is its bytes minus its merges, so no token ids are made. Counts of words are kept in a bounded
table per Python worker. The strings of special tokens inside a text count as one token each.

Texts of any length are counted whole; a null or empty text has zero bytes and tokens. Repeated rows
stay, an empty table gives an empty one, other columns are left behind.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.pretokens import byte_letters, pretokens

#: Words whose counts a worker keeps before it starts its table anew.
KEPT_WORDS = 1_000_000


class Merges:
    """Merge rules of a .json vocabulary: symbol pair -> rank, and rank -> merged symbol."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab = model["vocab"]
        self.symbol = {b: vocab[c] for b, c in byte_letters().items()}
        self.size = max(vocab.values()) + 1
        self.rules: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rules[vocab[a] * self.size + vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.specials = [t["content"] for t in told["added_tokens"]]

    def count(self, word: bytes) -> int:
        """Symbols of ``word`` minus the merges that its pairs allow."""
        n = len(word)
        if n < 2:
            return n
        size, rules, merged = self.size, self.rules.get, self.merged
        symbols = [self.symbol[b] for b in word]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # A heap key holds a rank and, in its low bits, the place of the pair's left symbol.
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = []
        for i in range(n - 1):
            rank = rules(symbols[i] * size + symbols[i + 1])
            if rank is not None:
                heap.append(rank << bits | i)
        heapq.heapify(heap)
        left = n
        while heap:
            key = heapq.heappop(heap)
            i = key & place
            j = after[i]
            # A pair that has changed since it was pushed has another rank, or none.
            if j >= n or rules(symbols[i] * size + symbols[j]) != key >> bits:
                continue
            new = symbols[i] = merged[key >> bits]
            symbols[j] = -size  # in no pair from here on
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rules(new * size + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, rank << bits | i)
            h = before[i]
            if h >= 0:
                rank = rules(symbols[h] * size + new)
                if rank is not None:
                    heapq.heappush(heap, rank << bits | h)
        return left


class WordCounts(dict):
    """Word -> tokens, filled by merging on first sight."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.merges = Merges(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.merges.count(word.encode("utf-8"))
        return n


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def count_texts(texts: list[str], counts: WordCounts) -> list[int]:
    """Tokens of each text."""
    specials = counts.merges.specials
    plain, owner, extra = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        segments = [text]
        for special in specials:
            segments = [s for segment in segments for s in segment.split(special)]
        extra[i] = len(segments) - 1
        plain += segments
        owner += [i] * len(segments)
    for i, words in zip(owner, pretokens(plain), strict=True):
        extra[i] += sum(map(counts.__getitem__, words))
    return extra


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = word_counts(vocabulary)
        for batch in texts:
            yield pd.Series(count_texts(batch.tolist(), counts), dtype="int64")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
