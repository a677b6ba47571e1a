"""Pre-tokens, byte BPE, token counts and packing against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import byte_bpe, packing, pretokens, queries, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n ", "it's 'tis we'll x''s 'sat", "a  b\n\n c\t\td ", "１２3 ²",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "　中文 字。é é",
    "😀😀 \U0010ffff", "\x1c\x85\xa0x", "x" * 3000, " " * 3000, "don't" * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks_library():
    with open(RANKS, "rb") as f:
        ranks = pretokens.read_ranks(f.read())
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ast'rvel md1²!é中 \n\t\r 　😀-")), max_size=4))
def test_pretokens_follow_the_pattern(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert list(pretokens.pretokens(texts)) == [pattern.findall(t) for t in texts]


def test_heap_merging_equals_the_library(library):
    counts = token_counts.word_counts(JSON)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aehtn sio'r\n") for _ in range(200)) for _ in range(100)]
    texts += [t for t in ODD if t is not None]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_texts(texts, counts) == want


def test_token_counts_of_whole_documents(documents, library):
    out = token_counts.count_tokens(documents, JSON, 512).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(out) == len(texts)
    for r in out:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), n)
        assert r.over_limit == (n > 512)


def test_token_counts_of_odd_rows(make_docs, library, long_text):
    pairs = [*enumerate(ODD), (1, ""), (None, "x y"), (99, long_text), (99, long_text)]
    out = token_counts.count_tokens(make_docs(pairs), JSON, 512).collect()
    texts = dict(pairs)
    assert len(out) == len(pairs)
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(make_docs([]), JSON, 512).count() == 0


def check_encoded(out, texts, library):
    for r in out:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert list(struct.unpack(f"<{len(ids)}I", r.ids)) == ids
        assert bytes(r.decoded) == text.encode()


def test_byte_bpe_round_trip(documents, ranks_library):
    out = byte_bpe.decode_texts(byte_bpe.encode_texts(documents, RANKS), RANKS).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    check_encoded(out, texts, ranks_library)


def test_byte_bpe_of_odd_rows_in_many_blocks(make_docs, ranks_library, long_text, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 50)
    pairs = [*enumerate(ODD), (1, ""), (None, "x y"), (99, long_text), (99, long_text)]
    out = byte_bpe.decode_texts(byte_bpe.encode_texts(make_docs(pairs), RANKS), RANKS).collect()
    assert len(out) == len(pairs)
    check_encoded(out, dict(pairs), ranks_library)
    empty = make_docs([])
    assert byte_bpe.encode_texts(empty, RANKS).count() == 0


def test_byte_bpe_query_digests(spark, sf_dir, documents, ranks_library):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op8(spark, sf_dir).collect():
        ids = ranks_library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


HISTOGRAMS = {
    "none": {},
    "small only": {3: 1000, 5: 77},
    "one length": {600: 9},
    "full": {1024: 5, 1: 2},
    "even": {n: 20 for n in range(1, 1025)},
    "falling": {n: 20000 // n for n in range(1, 1024)},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
@pytest.mark.parametrize("groups", [3, 50, packing.GROUPS])
def test_plan_places_every_piece_once(name, groups):
    counts = HISTOGRAMS[name]
    plan = packing.plan_sequences(counts, 1024, groups)
    used = {}
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 1024
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    if groups == packing.GROUPS and name in ("small only", "even", "falling"):
        assert sum(times for times, _ in plan) <= 1.01 * least + 1


def packed_rows(docs, capacity=1024):
    pieces = packing.cut_pieces(docs, JSON, 2, capacity)
    return packing.pack_pieces(pieces, capacity)


def check_packing(out, texts, library, capacity=1024):
    """``texts`` maps ids to whole texts; ids are unique."""
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        assert all(r.length == capacity for r in pieces[1:])
        assert b"".join(bytes(r.ids) for r in pieces) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_of_whole_documents(documents, library):
    out = packed_rows(documents).collect()
    check_packing(out, {r.doc_id: r.text for r in documents.collect()}, library)
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= 1.05 * total / 1024 + 1


@pytest.mark.parametrize("salted_rows", [3, 1000])
def test_packing_of_odd_rows(make_docs, library, long_text, monkeypatch, salted_rows):
    monkeypatch.setattr(packing, "NUMBERED_ROWS", salted_rows)
    pairs = [*enumerate(ODD), (99, long_text), (None, "x y")]
    check_packing(packed_rows(make_docs(pairs)).collect(), dict(pairs), library)
    # Repeated rows are packed one by one.
    many = packed_rows(make_docs([(1, "a b c")] * 700)).collect()
    assert len(many) == 700 and len({r.sequence_id for r in many}) == -(-700 * 4 // 1024)
    assert len({(r.sequence_id, r.offset) for r in many}) == 700
    assert packed_rows(make_docs([])).count() == 0


def test_packing_query_and_assembly(spark, sf_dir, documents, library):
    rows = queries.op4(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        part = struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(part)
    sequences = packing.assemble(packed_rows(documents)).collect()
    assert all(len(s.ids) == 4 * s.length <= 4096 for s in sequences)
