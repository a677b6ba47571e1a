"""Near copies among many texts of one template, against all pairs."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import minhash_forest


def all_pairs_components(texts, size):
    """{id: smallest reachable id} over the pairs with at least 0.8 common shingles."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def components_of(docs, **options):
    out = minhash_forest.near_copies(docs, 2, **options).collect()
    return {r.doc_id: r.component_id for r in out}


def recall(got, want):
    """Share of the joined documents that are found; nothing else may be joined."""
    assert all(got[i] in (i, g) for i, g in want.items())
    joined = [i for i, g in want.items() if i != g]
    return sum(got[i] == want[i] for i in joined) / len(joined)


def crowd(n, planted):
    """Texts at 0.799 to each other; ``planted`` pairs, far apart, share one more word: 0.801."""
    texts = {}
    for i in range(n):
        words = [f"t{k}" for k in range(781)] + [f"d{i}x{k}" for k in range(98)]
        if i % (n // 2) < planted:
            words[781] = f"p{i % (n // 2)}"
        texts[i] = " ".join(words)
    return texts


def test_pairs_over_the_threshold_in_a_crowd_just_under_it(make_docs):
    texts = crowd(180, 40)
    want = all_pairs_components(texts, 2)
    assert sum(i != g for i, g in want.items()) == 40
    docs = make_docs(texts.items())
    assert recall(components_of(docs), want) >= 0.9
    assert components_of(docs, exact_crowds=True) == want


def test_pairs_at_the_threshold_in_crowded_regions(make_docs, monkeypatch):
    """Every region counts as crowded; 400 pairs at exactly 0.8."""
    monkeypatch.setattr(minhash_forest, "REGION", 1)
    monkeypatch.setattr(minhash_forest, "FIRST_TREES", 0)
    texts = {}
    for i in range(800):
        words = [f"b{i // 2}x{k}" for k in range(81)] + [f"o{i}x{k}" for k in range(10)]
        texts[i] = " ".join(words)
    docs, want = make_docs(texts.items()), {i: i // 2 * 2 for i in texts}
    assert recall(components_of(docs), want) >= 0.9
    assert components_of(docs, exact_crowds=True) == want


def test_regions_that_are_split(make_docs, monkeypatch):
    """Small regions, so that most are split by further values; groups of five copies."""
    monkeypatch.setattr(minhash_forest, "REGION", 4)
    texts = {}
    for i in range(600):
        words = [f"t{k}" for k in range(60)] + [f"g{i // 5}x{k}" for k in range(60)]
        words[i % 5 * 11] = f"own{i}"
        texts[i] = " ".join(words)
    want = all_pairs_components(texts, 2)
    assert len(set(want.values())) == 120
    assert recall(components_of(make_docs(texts.items())), want) >= 0.9


def test_similarity_that_is_asked_for(make_docs):
    """Pairs at 0.60 are found at 60 percent, and lower bounds refused."""
    texts = {}
    for i in range(200):
        words = [f"b{i // 2}x{k}" for k in range(151)] + [f"o{i}x{k}" for k in range(50)]
        texts[i] = " ".join(words)  # 150 common shingles of 250
    docs = make_docs(texts.items())
    assert recall(components_of(docs, percent=60), {i: i // 2 * 2 for i in texts}) >= 0.9
    assert components_of(docs, percent=61) == {i: i for i in texts}
    with pytest.raises(ValueError, match="percent"):
        minhash_forest.near_copies(docs, 2, percent=59)


def test_crowds_lose_no_link_unless_windows_are_asked_for(make_docs, monkeypatch):
    """A group that fills several cells, small groups beside it, and links to single members of it."""
    monkeypatch.setattr(minhash_forest, "REGION", 2)
    monkeypatch.setattr(minhash_forest, "DEPTHS", ())
    monkeypatch.setattr(minhash_forest, "FIRST_TREES", 1)
    monkeypatch.setattr(minhash_forest, "WINDOW", 1)
    monkeypatch.setattr(minhash_forest, "CELL", 8)
    texts = {}
    for i in range(160):
        # Steps along a chain: texts are near to those a few places away only.
        words = [f"t{k}" for k in range(300)] + [f"c{k}" for k in range(i, i + 60)]
        words += [f"own{i}x{k}" for k in range(i % 40)]
        texts[i] = " ".join(words)
    want = all_pairs_components(texts, 2)
    assert components_of(make_docs(texts.items())) == want
    # The same crowd at 0.799 to each other, where only the exact join finds every planted pair.
    texts = crowd(120, 30)
    assert components_of(make_docs(texts.items())) == all_pairs_components(texts, 2)


def test_parts_of_crowded_regions_are_not_joined_with_themselves(make_docs, monkeypatch):
    """Of a large region, at most one pair for each node and tree goes on to the exact join."""
    joined, crowded_rows, inside = [], [], []
    within, chain = minhash_forest._pairs_within, minhash_forest._sorted_pairs

    def watched_chain(rows, window, percent):
        pairs = chain(rows, window, percent)
        crowded_rows.append(rows.count())
        inside.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_forest, "REGION", 4)
    monkeypatch.setattr(minhash_forest, "_sorted_pairs", watched_chain)
    monkeypatch.setattr(
        minhash_forest, "_pairs_within", lambda rows, by: joined.append(by) or within(rows, by)
    )
    texts = crowd(60, 15)
    assert components_of(make_docs(texts.items())) == all_pairs_components(texts, 2)
    assert joined == [["tree", "p"]]
    assert len(inside) == 2 and 0 < inside[1] <= crowded_rows[1]


def test_slot_counts_reach_the_driver_packed(make_docs):
    """The counts of the shingles are those of a plain loop; a row for each batch, not for each slot."""
    texts = crowd(40, 10)
    want = np.zeros(minhash_forest.SLOTS, np.int64)
    for hashes in minhash_forest._hashes_of(pd.Series(list(texts.values())), 2):
        np.add.at(want, (hashes % np.uint64(minhash_forest.SLOTS)).astype(np.int64), 1)
    docs = make_docs(texts.items())
    assert (minhash_forest._slot_weights(docs, 2) == want).all()
    none = minhash_forest._slot_weights(docs.where(F.col("doc_id") < 0), 2)
    assert len(none) == minhash_forest.SLOTS and not none.any()
    batch = pd.DataFrame({"slot": np.arange(1000), "n": np.arange(1000)})
    assert [len(x) for x in minhash_forest._packed([batch])] == [1]
