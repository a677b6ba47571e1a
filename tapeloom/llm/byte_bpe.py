"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Texts are gathered into compressed blocks, stored once in a bucketed table. The pre-tokens of a block
are exploded into its distinct words; a shuffle by word brings the words of all blocks together, where
each distinct word is encoded once; its ids go back to the blocks that hold it, next to the stored
texts, and every text is put together again by the positions of its pre-tokens. Decoding joins ids
with the token-byte table, whose size is that of the vocabulary.

A frequent word is one row per block, not one per occurrence. Blocks are named by task and number and
read from the stored table, so a lost executor repeats its part on the same blocks. A null or empty
text has no tokens. Repeated rows stay, an empty table gives an empty one, other columns are left
behind.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.pretokens import piece_encoder, pretokens, read_ranks
from tapeloom.plans.shared import new_path

#: Characters that a block holds at most, unless a single text is longer.
BLOCK_CHARS = 24_000_000
#: Texts cut into pre-tokens at a time.
STEP = 200


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: position = id."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def _pack(ids: list, texts: list[str]) -> bytes:
    """Compressed: length of the header, header (ids and bytes of each text), texts."""
    import zstandard

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    head = json.dumps([ids, [len(r) for r in raw]]).encode()
    return zstandard.ZstdCompressor(level=6).compress(
        b"".join([len(head).to_bytes(8, "little"), head, *raw])
    )


def _unpack(blob: bytes) -> tuple[list, list[str]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 + int.from_bytes(raw[:8], "little")
    ids, sizes = json.loads(raw[8:at])
    texts = []
    for size in sizes:
        texts.append(raw[at : at + size].decode("utf-8", "surrogatepass"))
        at += size
    return ids, texts


def store_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (block, blob) bucketed by block and read it back."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        number, size, ids, texts = 0, 0, [], []

        def block() -> pd.DataFrame:
            return pd.DataFrame({"block": [first + number], "blob": [_pack(ids, texts)]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                if texts and size + len(text) > BLOCK_CHARS:
                    yield block()
                    number, size, ids, texts = number + 1, 0, [], []
                ids.append(None if doc_id is None else doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    spark = docs.sparkSession
    name = f"text_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(
            F.col(id_col).cast("string").alias("doc_id"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        )
        .mapInPandas(gather, "block long, blob binary")
        .write.bucketBy(buckets, "block")
        .option("path", new_path(spark, "text-blocks"))
        .option("compression", "none")
        .saveAsTable(name)
    )
    return spark.table(name)


def _words_of(texts: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(texts), STEP):
        yield from pretokens(texts[at : at + STEP])


def _found(texts: list[str]) -> set[str]:
    found: set[str] = set()
    for words in _words_of(texts):
        found.update(words)
    return found


def distinct_words(blocks: DataFrame) -> DataFrame:
    """(word, block, place): the distinct pre-tokens of each block in sorted order."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, blob in zip(batch["block"], batch["blob"], strict=True):
                ordered = sorted(_found(_unpack(blob)[1]))
                for at in range(0, len(ordered), 50_000):
                    part = ordered[at : at + 50_000]
                    yield pd.DataFrame(
                        {"word": part, "block": block, "place": range(at, at + len(part))}
                    )

    return blocks.mapInPandas(explode, "word string, block long, place int")


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(block, found): words meet by a shuffle on the word, each distinct one encoded once.

    What goes back to a block from one batch of words is one packed row of places and ids.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, last, ids = piece_encoder(_ranks(vocabulary)), None, []
        for batch in batches:
            out = []
            for word in batch["word"].tolist():
                if word != last:
                    last, ids = word, one(word)
                out.append(ids)
            by_block = batch.groupby("block").indices
            packed = [
                _pack_ids(batch["place"].to_numpy()[rows], [out[i] for i in rows.tolist()])
                for rows in by_block.values()
            ]
            yield pd.DataFrame({"block": list(by_block), "found": packed})

    met = words.repartition("word").sortWithinPartitions("word")
    return met.mapInPandas(encode, "block long, found binary")


def _pack_ids(places: np.ndarray, ids: list[list[int]]) -> bytes:
    """Places, number of ids of each, and all ids, compressed."""
    import zstandard

    lengths = np.array([len(x) for x in ids], "<u4")
    flat = np.array([i for x in ids for i in x], "<u4")
    head = np.array([len(ids)], "<u4")
    steps = np.diff(places, prepend=0).astype("<i4")
    raw = b"".join(x.tobytes() for x in (head, steps, lengths, flat))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_ids(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, ids as little-endian unsigned 32-bit numbers)"""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    places = np.cumsum(np.frombuffer(raw, "<i4", n, 4))
    ends = 4 * np.cumsum(np.frombuffer(raw, "<u4", n, 4 + 4 * n))
    ids, at = raw[4 + 8 * n :], 0
    for place, end in zip(places.tolist(), ends.tolist(), strict=True):
        yield place, ids[at:end]
        at = end


def _as_they_are(ids: list[bytes]) -> dict[str, list]:
    return {"ids": ids}


def encode_texts(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    fields: str = "ids binary",
    derive: Callable[[list[bytes]], dict[str, list]] = _as_they_are,
) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit numbers).

    ``vocabulary`` is the path of a .tiktoken file. ``derive`` makes other columns, declared as
    ``fields``, from the ids of many texts where they are put together, so that long ids need
    not travel to a second step.
    """
    blocks = store_blocks(docs, id_col, text_col)
    back = encode_words(distinct_words(blocks), vocabulary)

    def reassemble(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        # A word's place is its rank among the block's words, so sorting them again names it.
        ids_at = {place: ids for found in words["found"] for place, ids in _unpack_ids(found)}
        out = []
        for blob in texts["blob"]:
            own, docs_ = _unpack(blob)
            table = {word: ids_at[place] for place, word in enumerate(sorted(_found(docs_)))}
            for at in range(0, len(docs_), STEP):
                joined = [
                    b"".join([table[w] for w in cut]) for cut in pretokens(docs_[at : at + STEP])
                ]
                out.append(pd.DataFrame({"doc_id": own[at : at + STEP]} | derive(joined)))
        return pd.concat(out).astype({"doc_id": object})

    return (
        blocks.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInPandas(reassemble, f"doc_id string, {fields}")
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    )


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    """Bytes of the text behind the ids."""
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def decode_texts(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the token-byte table has for each id."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(vocabulary)
        for batch in batches:
            yield pd.Series([decode_ids(ids, table) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", decode(F.col(ids_col)))


def digests_of(vocabulary: str) -> Callable[[list[bytes]], dict[str, list]]:
    """For ``derive``: tokens, SHA-256 of the decimal ids, SHA-256 of the decoded bytes."""

    def derive(encoded: list[bytes]) -> dict[str, list]:
        table = token_bytes(vocabulary)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in encoded:
            numbers = np.frombuffer(ids, "<u4").tolist()
            listed = ",".join(map(str, numbers)).encode()
            out["n_tokens"].append(len(numbers))
            out["ids_sha256"].append(hashlib.sha256(listed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode_ids(ids, table)).hexdigest())
        return out

    return derive
