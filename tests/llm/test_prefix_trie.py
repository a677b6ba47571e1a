"""The conversation trie against plain Python over the same turns."""

import hashlib
import random
import re
import zlib

import pytest

from tapeloom.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(turns):
    """{(conv_id, depth): row} from (conv_id, turn, role, text) tuples."""
    own = {}
    for conv_id, turn, role, text in turns:
        own.setdefault(conv_id, []).append((turn, role or "", text or ""))
    for rows in own.values():
        rows.sort(
            key=lambda r: (
                r[0] is not None,
                r[0] or 0,
                hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest(),
            )
        )
    rebuilt = {}
    for c, rows in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        first = own.get(None if c is None else c - c % 20, []) if h else []
        rebuilt[c] = tuple((role, text) for _, role, text in first[:h] + rows[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)

    def order(c):
        return (c is None, c or 0)

    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def totals(path):
        own_saved = (len(members[path]) - 1) * (
            len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        )
        below = [totals(p) for p in children.get(path, [])]
        return (sum(x[0] for x in below) or 1, own_saved + sum(x[1] for x in below))

    out = {}
    for path, convs in members.items():
        ends = sorted((c for c in convs if len(rebuilt[c]) == len(path)), key=order)
        told = ",".join("" if c is None else str(c) for c in ends)
        least = min(convs, key=order)
        out[least, len(path)] = (
            min(members[path[:-1]], key=order) if path else None,
            len(convs),
            len(children.get(path, [])),
            *totals(path),
            hashlib.sha256(told.encode()).hexdigest(),
        )
    return out


def run(spark, turns, extra=False):
    fields = "conv_id long, turn long, role string, text string"
    if extra:
        names = "place depth key_a up_a shard leaves saved size h _slot _part".split()
        fields += "".join(f", {n} string" for n in names)
        turns = [(*t, *("x" * len(names))) for t in turns]
    found = prefix_trie.prefix_trie(spark.createDataFrame(turns, fields)).collect()
    out = {(r.conv_id, r.depth): tuple(r[c] for c in COLUMNS[2:]) for r in found}
    assert len(out) == len(found)
    return out


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, turns) == brute(turns)


def test_shards_that_split_paths_and_levels(spark, many_partitions):
    """Few different turns: deep shared prefixes, a hot first turn, copies, one long conversation."""
    draw = random.Random(5)
    turns = []
    for c in range(300):
        for t in range(draw.randint(1, 9)):
            turns.append((c, t, "user", "hot turn here" if t == 0 else f"t{draw.randint(0, 1)} w"))
    turns += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(5)]
    turns += [(7_000_000_000_000_000_001, t, "user", f"long {t % 3}") for t in range(400)]
    assert run(spark, turns) == brute(turns)


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    turns = [
        (20, None, None, "first"),
        (20, 1, "user", None),
        (20, 1, "user", "tie"),
        (20, 1, "user", "tie"),
        (20, None, "", ""),
        (21, 0, "user", "a  b\tc"),
        (22, 0, None, None),
        (45, 0, "user", "no first conversation"),
        (-20, 0, "user", "a  b\tc"),
        (-25, 0, "user", "x"),
        (None, 0, "user", "a  b\tc"),
        (None, 1, "user", "alone"),
        (9_223_372_036_854_775_800, 0, "user", "far " * 50_000),
    ]
    want = brute([(c, t, r, x) for c, t, r, x in turns if c is None or c >= 0])
    got = run(spark, [t for t in turns if t[0] is None or t[0] >= 0], extra=True)
    assert got == want
    # The remainder of a negative id is negative in SQL: -25 borrows from -20.
    assert (-25, 0) in run(spark, turns)


def test_empty_table(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("limit", [2, 7, 1000])
def test_queue_spills_and_keeps_order(limit):
    draw = random.Random(limit)
    queue = prefix_trie.SpillingQueue(limit)
    want, got = [], []
    for _ in range(3000):
        if draw.random() < 0.6:
            item = (draw.randint(0, 50), draw.randint(0, 5))
            want.append(item)
            queue.push(item)
        elif want:
            want.sort()
            assert queue.first() == want[0]
            got.append((queue.pop(), want.pop(0)))
    while queue.first() is not None:
        got.append((queue.pop(), min(want)))
        want.remove(got[-1][1])
    assert not want
    assert all(a == b for a, b in got)
    assert (queue.spilled > 0) == (limit < 1000)
