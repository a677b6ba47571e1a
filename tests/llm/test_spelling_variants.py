"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tapeloom.llm import spelling_variants

COLUMNS = "word form root n n_near form_n".split()


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a != b and a[i + 1 :] == b[i + 1 :]
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def brute_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.add((w, f, root, n, len(near[w]), None if f is None else counts[f]))
    return out


def brute_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def groups_of(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling_variants.variant_groups(words).collect()
    assert len(found) == len(counts)
    return {tuple(r[c] for c in COLUMNS) for r in found}


def test_given_documents(spark, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    counts = brute_counts(docs)
    words = spelling_variants.word_counts(documents)
    assert {r.word: r.n for r in words.collect()} == counts
    assert groups_of(spark, counts) == brute_groups(counts)


def test_few_letters_give_all_edits_and_chains(spark, many_partitions):
    """Words of two letters: dense tries, runs, insertions and deletions at every place."""
    draw = random.Random(3)
    counts = {}
    for _ in range(220):
        word = "".join(draw.choice("aé") for _ in range(draw.randint(6, 9)))
        counts[word] = 5 ** draw.randint(1, 7)
    counts |= {"a" * k: k for k in range(6, 12)} | {"abab" * k + "ab": 5 for k in range(2, 5)}
    got = groups_of(spark, counts)
    assert got == brute_groups(counts)
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_long_words_fetch_what_they_read_next(spark):
    """Branches that stay together for over twice the characters that a state carries."""
    ends = ["s" * 90, "s" * 89 + "t", "s" * 90 + "x", "s" * 70]
    counts = {}
    for k, (a, b) in enumerate([("p", "q"), ("px", "p"), ("pé", "pê")]):
        for end in ends:
            for head in (a, b):
                counts["w" * 80 + head + end] = 5 + k
                counts[(end + head + "w" * 80)[::-1]] = 7 + k
    counts["z" * 5000] = 30
    counts["z" * 4999] = 5
    assert groups_of(spark, counts) == brute_groups(counts)


def test_nulls_empty_texts_repeated_rows_and_clashing_names(make_docs):
    docs = [(i, "Häuser MÄRKTE×÷ market") for i in range(6)] * 2
    docs += [(None, "markets " * 40), (7, None), (8, ""), (None, None), (9, "a1b2c3 short")]
    table = make_docs(docs)
    for name in ("word", "n", "h", "run", "id", "wid"):
        table = table.withColumn(name, table["lang"])
    counts = brute_counts(docs)
    words = spelling_variants.word_counts(table)
    assert {r.word: r.n for r in words.collect()} == counts
    assert {"häuser", "mÄrkte×÷", "market", "markets"} <= set(counts)


def test_empty_table(make_docs):
    words = spelling_variants.word_counts(make_docs([]))
    assert spelling_variants.variant_groups(words).collect() == []


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    """Words make many more states than Spark expects, which the driver would gather."""
    plans = {}
    settle = spelling_variants.settle

    def settled(df, label="rows"):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(spelling_variants, "settle", settled)
    counts = {"market": 5, "markets": 40, "marketss": 400, "marketing": 7, "marketinf": 6}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling_variants.variant_groups(words)
    plans["result"] = [found._jdf.queryExecution().executedPlan().toString()]
    assert {tuple(r[c] for c in COLUMNS) for r in found.collect()} == brute_groups(counts)
    states = [(1, 7, False, "", 3), (1, 8, True, "", 2)]
    kinds = "wid long, node long, reverse boolean, rest string, left int"
    fetched = spelling_variants._fetched(
        settle(spark.createDataFrame(states, kinds)),
        settle(spark.createDataFrame([(1, "market")], "wid long, word string")),
    )
    assert {(r.node, r.rest) for r in fetched.collect()} == {(7, "ket"), (8, "am")}
    assert not [label for label, of in plans.items() if any("Broadcast" in p for p in of)]
    joining = {label for label, of in plans.items() if any("SortMergeJoin" in p for p in of)}
    assert joining == {"states", "fetched", "pairs", "forms", "roots", "result"}
