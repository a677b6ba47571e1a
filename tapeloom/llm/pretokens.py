"""Pre-tokens of byte-level BPE, cut by array operations over many texts at once.

The pattern of the public vocabularies is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Its matches are runs of one character class with three exceptions: a space joins the run behind it,
the last character of a blank run stands alone before other text, and a lone apostrophe takes one of
the seven endings.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

LETTER, NUMBER, BLANK, OTHER, EDGE = 1, 2, 3, 0, 4
# The characters with the Unicode property White_Space, as code points.
WHITE_SPACE = [
    9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
#: Characters cut in one go; a longer text is still taken whole.
CHUNK_CHARS = 500_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x1000):
        part = "".join(chr(c) for c in range(first, first + 0x1000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, part):
                table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = BLANK
    return table


def _starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    n = len(codes)
    run = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run[kind == EDGE] = True
    start = run.copy()
    # The last blank before other text stands alone, and a space there joins that text.
    last = np.flatnonzero(
        (kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != EDGE)
    )
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # A lone apostrophe before letters.
    mark = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if len(mark):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        kinds = np.concatenate([kind, np.full(3, EDGE, kind.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for chosen, width in ((mark[short], 2), (mark[long], 3)):
            start[chosen + 1] = False
            rest = chosen[kinds[chosen + width] == LETTER] + width
            start[rest] = True
    return np.flatnonzero(start)


def _cut(texts: Sequence[str]) -> list[list[str]]:
    joined = "\n".join(texts)
    if not joined:
        return [[] for _ in texts]
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[ends[:-1]] = EDGE
    starts = _starts(codes, kind)
    stops = np.append(starts[1:], len(codes))
    inside = kind[starts] != EDGE
    starts, stops = starts[inside], stops[inside]
    words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    edges = np.searchsorted(starts, ends).tolist()
    return [words[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)]


def pretokens(texts: Sequence[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text, in order."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        yield from _cut(texts[at:end])
        at = end


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    return {
        base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())
    }


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in .json vocabularies.

    Printable Latin-1 characters stand for themselves; the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def json_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes -> id of a .json vocabulary, and the ids of its special strings."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    specials = {t["content"]: t["id"] for t in told["added_tokens"]}
    back = {letter: b for b, letter in byte_letters().items()}
    ranks = {
        bytes(back[c] for c in token): i
        for token, i in told["model"]["vocab"].items()
        if token not in specials
    }
    return ranks, specials


def piece_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encode one pre-token as it stands; no pattern is applied again."""
    import tiktoken

    whole = tiktoken.Encoding(
        "pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}
    )
    return whole.encode_ordinary
