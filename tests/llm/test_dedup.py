"""Exact, near and substring dedup, and sharding, against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import components, exact_dedup, minhash_forest, sharding, substring_dedup
from tapeloom.plans.shared import new_path

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(documents):
    return {r.doc_id: r.text for r in documents.collect()}


ROWS = [
    (1, "a"), (2, None), (3, ""), (4, "a"), (5, "A"), (6, "a "), (None, "a"), (None, "only null"),
    (7, "twice"), (7, "twice"), (8, "other"), (8, "same id"),
]


def test_exact_copies(make_docs, long_text):
    docs = make_docs([*ROWS, (20, long_text), (21, long_text), (22, long_text + "x")])
    out = exact_dedup.mark_copies(docs, buckets=3).collect()
    assert len(out) == len(ROWS) + 3
    groups = {}
    for doc_id, text in [*ROWS, (20, long_text), (21, long_text), (22, long_text + "x")]:
        groups.setdefault(hashlib.sha256((text or "").encode()).hexdigest(), []).append(doc_id)
    for r in out:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest, ids in groups.items():
        assert sum(r.kept for r in out if r.text_sha256 == digest) == 1, ids
    assert exact_dedup.mark_copies(make_docs([]), buckets=3).count() == 0


def test_dropping_copies_keeps_one_row_with_all_columns(make_docs):
    docs = make_docs(ROWS)
    left = exact_dedup.drop_copies(docs, buckets=3)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == sorted(
        [(4, "a"), (3, ""), (5, "A"), (6, "a "), (0, "only null"), (7, "twice"), (8, "other"),
         (8, "same id")]
    )
    assert exact_dedup.drop_copies(make_docs([]), buckets=3).count() == 0


def test_index_persists_and_new_data_is_joined_without_its_shuffle(spark, make_docs):
    path = new_path(spark, "index-test")
    first = exact_dedup.DigestIndex.at(spark, path, 4)
    exact_dedup.ingest(first, exact_dedup.digest_rows(make_docs([(1, "a"), (2, "b")])))
    again = exact_dedup.DigestIndex.at(spark, path, 4)
    batch = exact_dedup.digest_rows(make_docs([(3, "b"), (4, "c"), (5, "c")]))
    exact_dedup.ingest(again, batch)
    assert sorted(r.keep_id for r in again.rows().collect()) == [1, 2, 5]
    entries = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    plan = again.unknown(entries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    side = plan[plan.index("LeftAnti") :]
    assert "Bucketed: true" in side
    assert side.count("Exchange hashpartitioning") == 1
    kept = {r.doc_id: r.kept for r in exact_dedup.mark_copies(
        make_docs([(9, "a"), (10, "new")]), index=again
    ).collect()}
    assert kept == {9: False, 10: True}


def brute_shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(texts, size):
    """{id: (set size, smallest reachable id)} from all pairs."""
    sets = {i: brute_shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if not a or not b or min(len(a), len(b)) * 100 < 80 * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_equal_brute_force(documents, size):
    texts = texts_of(documents)
    want = brute_components(texts, size)
    out = minhash_forest.near_copies(documents, size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def chain(n, words=60):
    """Texts of which each is near the next one only."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in range(i):
            own[(k * 7) % words] = f"x{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("region", [2, 32])
def test_near_copies_in_crowded_regions(make_docs, monkeypatch, region):
    monkeypatch.setattr(minhash_forest, "REGION", region)
    copies = [" ".join([f"c{i}" for i in range(200)] + [f"n{k}"]) for k in range(60)]
    texts = dict(enumerate(chain(8) + copies))
    out = minhash_forest.near_copies(make_docs(texts.items()), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(texts, 2)


def test_near_copies_of_odd_rows(make_docs, long_text):
    pairs = [
        (1, None), (2, ""), (3, " \n\t"), (4, "Word"), (5, "word"), (6, "wörd"), (7, "WÖRD"),
        (8, "a b"), (9, "A\nB"), (10, "b a"), (11, long_text), (12, long_text + " more"),
        (13, "same row"), (13, "same row"), (None, "a b"), (None, "lone"), (14, "x y z"), (14, "q"),
    ]
    docs = make_docs(pairs)
    out = minhash_forest.near_copies(docs, 2).collect()
    assert len(out) == len(pairs)
    got = {(r.doc_id, r.component_id) for r in out}
    assert got >= {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 8), (10, 10),
                   (11, 11), (12, 11), (13, 13), (None, 8), (None, None), (14, 14)}
    assert {r.n_shingles for r in out if r.doc_id in (1, 2, 3)} == {0}
    left = minhash_forest.drop_near_copies(docs, 2)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 6, 7, 8, 10, 11, 13, 14, 14]
    assert minhash_forest.near_copies(make_docs([]), 2).count() == 0
    assert minhash_forest.drop_near_copies(make_docs([]), 2).count() == 0


def test_components_of_long_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)]
    links += [(61, 60), (60, 62), (62, 61), (70, 71), (71, 70)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(table).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 50)}
    assert got == want | {60: 60, 61: 60, 62: 60, 70: 70, 71: 70}
    assert components.components(table.where("a < 0")).count() == 0


def test_groups_merged_with_more_links_are_the_components_of_all_links(spark):
    rng = np.random.default_rng(11)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (240, 2)) if a != b]
    links += [(i, i + 1) for i in range(400, 430)] + [(430, 5)]

    def table(rows):
        return spark.createDataFrame(rows, "a long, b long")

    whole = {r.node: r.component for r in components.components(table(links)).collect()}
    for cut in (0, 90, len(links) - 1, len(links)):
        groups = components.components(table(links[:cut]))
        more = table(links[cut:] + links[:20])
        found = components.merged(groups, more).collect()
        assert {r.node: r.component for r in found} == whole
        assert len(found) == len(whole)


def plain_chunks(text):
    """Begin of each chunk and the end, from the hash of the last 16 bytes at every place."""
    raw, cuts, blanks = text.encode(), [0], b"\t\n\x0b\x0c\r "
    gear = [
        int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little")
        for b in range(256)
    ]
    since, words = 0, 0
    for i, byte in enumerate(raw):
        if i:
            before = raw[max(0, i - 16) : i]
            rolled = sum(gear[b] << k for k, b in enumerate(reversed(before))) >> 24 & 0xFF
            word = byte not in blanks and raw[i - 1] in blanks
            words += word
            # Characters since the last blank; the start of a text counts as one before it.
            far = since >= 64 and rolled < 4 and byte & 0xC0 != 0x80
            if (word and rolled < 64) or far:
                cuts.append(i)
        since = 0 if byte in blanks else since + 1
    return [*cuts, len(raw)]


def brute_repeats(texts, least):
    """{id: text without the runs of chunk pairs that an earlier place holds}, in plain Python.

    For texts that need no cut by length.
    """
    first, pairs, out = {}, {}, {}
    for i in sorted(texts):
        raw, cut = (texts[i] or "").encode(), plain_chunks(texts[i] or "")
        ends = cut[2:] if len(cut) > 2 else cut[1:]
        pairs[i] = [(a, b, raw[a:b]) for a, b in zip(cut, ends, strict=False) if b > a]
        for k, (_, _, both) in enumerate(pairs[i]):
            first.setdefault(both, (i, k))
    for i in sorted(texts):
        raw, runs = (texts[i] or "").encode(), []
        for k, (a, b, both) in enumerate(pairs[i]):
            if first[both] == (i, k):
                continue
            if runs and runs[-1][2] == k - 1:
                runs[-1][1:] = [b, k]
            else:
                runs.append([a, b, k])
        for a, b, _ in reversed(runs):
            if len(raw[a:b].split()) >= least or b - a >= 288:
                raw = raw[:a] + raw[b:]
        out[i] = raw.decode() if texts[i] is not None else None
    return out


def test_substring_dedup_equals_brute_force(documents):
    texts = texts_of(documents)
    short = {i: t for i, t in texts.items() if not t or len(t) < 20_000}
    documents = documents.where(F.col("doc_id").isin(list(short)))
    texts = short
    out = substring_dedup.remove_repeats(documents).collect()
    want = brute_repeats(texts, substring_dedup.LEAST_WORDS)
    assert {r.doc_id: r.text for r in out} == want
    for r in out:
        left = texts[r.doc_id]
        for s in reversed(r._spans):
            left = left[: s.begin] + left[s.begin + s.length :]
        assert left == r.text and bool(r._spans) == bool(r._sources)


def noise(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(f"{x >> 40:x}")
    return out


def test_passages_are_found_wherever_they_stand(make_docs):
    passages = [noise(1000 + p, 60) for p in range(40)]
    rows = []
    for p, words in enumerate(passages):
        for c in range(3):
            around = noise(p * 10 + c, 80)
            at = 5 + 9 * c
            rows.append((p * 3 + c, " ".join(around[:at] + words + around[at:])))
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(make_docs(rows)).collect()}
    texts = dict(rows)
    assert all(out[p * 3].text == texts[p * 3] for p in range(40))
    later = [p * 3 + c for p in range(40) for c in (1, 2)]
    # A chunk at the edge may hold the words before the passage in the second document too.
    found = [i for i in later if out[i]._sources[:1] == [i // 3 * 3]]
    assert len(found) >= 0.97 * len(later)
    for i in found:
        # Nothing but the passage goes, and under 50 words of it stay.
        around = noise(i // 3 * 10 + i % 3, 80)
        kept = [w for w in out[i].text.split() if w in around]
        assert len(kept) >= 76 and kept == [w for w in around if w in kept]
        assert len(out[i].text.split()) < 80 + 50


def test_substring_dedup_of_odd_rows(make_docs, long_text):
    passage = " ".join(noise(5, 100))
    pairs = [
        (1, None), (2, ""), (3, " \n"), (4, passage), (4, passage), (5, passage + " end"),
        (6, "start " + passage), (6, "x y z"), (None, passage), (7, long_text), (8, "中" * 9000),
        (9, "word " * 500), (10, "y" * 20000), (11, " ".join(noise(6, 30))),
    ]
    docs = make_docs(pairs)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "_spans", "_sources"]
    rows = out.collect()
    assert len(rows) == len(pairs)
    # A null id sorts first, so the passage stays there and goes from the others.
    assert [r.text for r in rows if r.doc_id is None] == [passage]
    assert all(len(r.text) < 60 for r in rows if r.doc_id in (4, 5) or (r.text or "")[:3] == "sta")
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[1] is None and by_id[2] == "" and by_id[3] == " \n"
    assert by_id[11] == " ".join(noise(6, 30))
    assert len(by_id[9].split()) < 130
    assert {r.text for r in rows if r.doc_id == 6} >= {"x y z"}
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0


def test_common_chunks_without_a_common_source_stay(make_docs):
    """Sentences that all occur before, but never side by side, are no passage."""
    sentences = [" ".join(noise(700 + k, 14)) + "." for k in range(30)]
    earlier = [(k, f"{' '.join(noise(900 + k, 40))} {s} {' '.join(noise(950 + k, 40))}")
               for k, s in enumerate(sentences)]
    mixed = " ".join(sentences)
    whole = " ".join(noise(900, 40)) + " " + sentences[0] + " " + " ".join(noise(950, 40))
    rows = [*earlier, (100, mixed), (101, f"new words {whole} at the end")]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(make_docs(rows)).collect()}
    assert out[100] == mixed
    assert len(out[101].split()) < 20


def test_passages_without_blanks(make_docs):
    shared = "".join(noise(41, 400))
    rows = [(1, "".join(noise(42, 300)) + shared), (2, "".join(noise(43, 300)) + shared)]
    rows += [(3, "漢字かな" * 3 + "".join(chr(0x4E00 + int(x, 16) % 5000) for x in noise(44, 900)))]
    rows += [(4, "別の文" + rows[2][1][5:])]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(make_docs(rows)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert len(rows[1][1]) - len(out[2]) > 0.8 * len(shared)
    assert len(out[4]) < 0.3 * len(rows[3][1])


def test_columns_named_like_helpers(spark, make_docs):
    docs = make_docs([(1, "same text"), (2, "same text"), (3, " ".join(noise(1, 60))), (3, None)])
    for name in ("_mine", "_id", "_tie", "_cut", "_own", "_keep", "_hash", "_twice", "_doc", "shard"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for out in (
        exact_dedup.drop_copies(docs, buckets=3),
        minhash_forest.drop_near_copies(docs, 2),
        substring_dedup.remove_repeats(docs).drop("_spans", "_sources"),
    ):
        assert out.columns == docs.columns
        assert {(r["_mine"], r["_cut"], r["_doc"], r["shard"]) for r in out.collect()} == {
            ("own _mine", "own _cut", "own _doc", "own shard")
        }
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, 300)
    back = spark.read.parquet(path)
    assert back.count() == 4 and set(back.columns) == {*docs.columns, "_shard"}


def brute_shards(rows, limit):
    """Smallest depth at which the bucket of each id fits; ids are unique."""
    keys = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    sizes = {i: len((t or "").encode()) for i, t in rows}
    out = {}
    for i, k in keys.items():
        for depth in range(61):
            same = [j for j in keys if keys[j] >> (60 - depth) == k >> (60 - depth)]
            if sum(sizes[j] for j in same) <= limit or len(same) == 1:
                out[i] = f"{k:060b}"[:depth]
                break
    return out


def test_shards_split_only_where_too_large(make_docs, long_text):
    rows = [(i, "x" * (i * 37 % 101)) for i in range(300)] + [(400, None), (401, long_text)]
    out = sharding.assign_shards(make_docs(rows), 700).collect()
    assert {r.doc_id: r.shard for r in out} == brute_shards(rows, 700)
    assert all(len(r.shard) == r.depth for r in out)
    assert len({r.depth for r in out}) > 2
    assert sharding.assign_shards(make_docs([]), 700).count() == 0


def test_a_hot_id_is_split_as_well(make_docs):
    rows = [(7, "x" * 10)] * 500 + [(i, "y" * 10) for i in range(100, 300)] + [(None, "z")]
    out = sharding.with_shard_sizes(sharding.assign_shards(make_docs(rows), 400)).collect()
    assert len(out) == len(rows)
    assert all(r.shard_bytes <= 400 for r in out)
    assert len({r.shard for r in out if r.doc_id == 7}) > 10


def test_written_shards_hold_every_row(spark, make_docs):
    docs = make_docs([(7, "x" * 10)] * 50 + [(i, "y" * 10) for i in range(100, 200)])
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, 300)
    back = spark.read.parquet(path)
    assert back.count() == 150
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > 4 and all(r.n <= 300 for r in sizes)
