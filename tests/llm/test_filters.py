"""URL filter, quality rules and toxicity."""

import zlib

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality_rules, toxicity, url_filter
from tapeloom.llm.queries import URL_RULES


def judged(spark, urls, listed=(), limit=None, monkeypatch=None):
    pages = spark.createDataFrame(
        [(i, u, "block", "x") for i, u in enumerate(urls)],
        "page_id long, url string, verdict string, canonical string",
    )
    table = spark.createDataFrame([(u,) for u in listed], "canonical string")
    out = url_filter.judge_urls(pages, table, URL_RULES).collect()
    return [r.asDict() for r in sorted(out, key=lambda r: r.page_id)]


def test_url_parts_and_rules(spark):
    urls = [
        "https://A.Example.NET/en/x?q#f",
        "http://a.example.net/de/",
        "http://example.com/de/1",
        "http://notexample.com/de/1",
        "http://x.org/fr/",
        "http://x.net",
        "http://x.net?a=/",
        None,
        "no scheme/net/",
        "",
        "x://h://y/z",
    ]
    out = judged(spark, urls)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("a.example.net", "/de/", "net/", "block"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/1", None, "allow"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("x.net", "", None, "allow"),
        ("x.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h:", "//y/z", None, "allow"),
    ]


@pytest.mark.parametrize("broadcast", [0, 10])
def test_listed_urls_are_blocked_exactly(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", broadcast)
    urls = [f"https://www.s{i}.com/p/{i}/?b=1&a=2&utm_source=z#t" for i in range(400)]
    listed = [f"s{i}.com/p/{i}?a=2&b=1" for i in range(0, 400, 4)]
    out = judged(spark, [*urls, urls[0], urls[1]], listed)
    assert [r["verdict"] == "block" for r in out] == [i % 4 == 0 for i in range(400)] + [True, False]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    bloom, blocks = url_filter.build_filter(keys, "canonical")
    assert blocks == 125
    masks = {f"m{w}": m for w, m in enumerate(url_filter._masks(F.col("canonical")))}
    hit = F.expr(" and ".join(f"w{w} & m{w} = m{w}" for w in range(4)))
    probe = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("canonical"))
    found = (
        probe.withColumns(masks | {"block": url_filter._block(F.col("canonical"), blocks)})
        .join(bloom, "block")
        .where(hit)
    )
    assert found.where("id < 2000").count() == 2000
    assert found.where("id >= 2000").count() < 120


def test_url_filter_of_empty_tables(spark):
    assert judged(spark, []) == []
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.repeated_urls(none).count() == 0


def counts_of(text):
    """Plain restatement of the contract's counts."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {
        i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)
    }
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_counts(spark, make_docs, long_text):
    texts = [
        None, "", " \t\n", "a", "a b", "a a a a", "a b c a b c a", "x\nx\n\n \nx \ny",
        "é\u00a0b #$% <|>", "a\x0bb\x0cc\rd\te", "the cat " * 60,
        " ".join(f"the w{i}" for i in range(60)),
    ]
    docs = make_docs([*enumerate(texts), (3, "a"), (None, "b")])
    out = quality_rules.judge_quality(docs).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(texts) + 2
    for i, text in enumerate(texts):
        r = by_id[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counts_of(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [by_id[i].kept for i in (0, 10, 11)] == [False, False, True]
    assert by_id[10].base_failed
    big = quality_rules.judge_quality(make_docs([(1, long_text)])).first()
    assert big.n_words == 100_000
    assert quality_rules.judge_quality(make_docs([])).count() == 0


def test_quality_thresholds_name_what_fails(make_docs):
    text = " ".join(f"#{i}# x{i}" for i in range(60))
    r = quality_rules.judge_quality(make_docs([(1, text)])).first()
    assert not r.base_failed and not r.kept
    assert r.failed == "symbol_ratio,stop_word_ratio"


def test_quality_keeps_good_documents(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules.judge_quality(documents).join(labels, "doc_id").where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("kept").count() <= 0.2 * bad.count()


WORDS = ["alpha", "river", "stone", "cloud", "green", "table", "paper", "light", "north", "quiet"]


def sample(n, start=0):
    rows = []
    for i in range(start, start + n):
        words = [WORDS[(i * 7 + k * (i % 5 + 1)) % 10] + str((i * k) % 9) for k in range(30)]
        if i % 3 == 0:
            words[i % 30] = words[(i + 11) % 30] = "blockhead"
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity_learns_subwords_and_scores_everything(spark, make_docs, long_text):
    rows = sample(600)
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, long_text), (9004, long_text)]
    odd += [(None, "x"), (9005, "river3 blokhead stone1 cloud2 blockheads green4")]
    docs = make_docs(rows + odd)
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0), "z") for i, _ in rows] + [(9001, 1, None, "z"), (None, 1, 1, "z")],
        "doc_id long, quality int, toxic int, text string",
    )
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in out}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert len(held) > 100
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) > 0.97 * len(held)
    # Misspellings that no text of the fit has.
    assert by_id[9005].predicted == 1
    assert by_id[9001].score == by_id[9002].score == by_id[9003].score


def test_toxicity_fit_ignores_held_out_labels(spark, make_docs):
    rows = sample(200)
    docs = make_docs(rows)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame(
        [(i, 1 - int(i % 3 == 0) if i in held else int(i % 3 == 0)) for i, _ in rows],
        "doc_id long, toxic int",
    )
    assert toxicity.fit(docs, labels).name == toxicity.fit(docs, turned).name


def test_toxicity_without_labels_or_with_one_class(spark, make_docs):
    docs = make_docs(sample(20))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect()} == {1.0}
    empty = make_docs([])
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_toxicity_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    rows = out.where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    ordered = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean)
    assert ordered / (len(toxic) * len(clean)) > 0.9


def test_drop_toxic_keeps_all_columns(spark, make_docs):
    rows = sample(300)
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert all(i % 3 for i in left) and len(left) > 190
