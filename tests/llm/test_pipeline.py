"""Every stage of the pipeline against a plain restatement on its own input."""

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import queries, substring_dedup, toxicity
from tapeloom.plans.shared import settle
from test_dedup import brute_components, brute_repeats


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """(input, output) of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, sf_dir), name)
        out[name] = (docs, after)
        docs = after
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_named_in_order_and_keep_the_columns(results):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing",
    ]
    for name, (before, after) in results.items():
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert after.count() <= before.count()


def test_toxicity_stage_drops_what_scores_high(spark, sf_dir, results):
    before, after = results["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = rows_of(before)
    scores = dict(zip(rows, toxicity.score_texts([r.text for r in rows.values()], model), strict=True))
    assert set(rows_of(after)) == {i for i, s in scores.items() if s < 0.3}


def test_exact_stage_keeps_the_largest_id(results):
    before, after = results["exact_dedup"]
    largest = {}
    for i, r in rows_of(before).items():
        largest[r.text] = max(i, largest.get(r.text, i))
    assert set(rows_of(after)) == set(largest.values())


def test_near_stage_keeps_one_of_each_group(results):
    before, after = results["near_dedup"]
    groups = brute_components({i: r.text for i, r in rows_of(before).items()}, 5)
    assert set(rows_of(after)) == {i for i, (_, least) in groups.items() if i == least}


def test_substring_stage_cuts_repeats_only(results):
    before, after = results["substring_dedup"]
    texts = {i: r.text for i, r in rows_of(before).items()}
    want = brute_repeats(texts, substring_dedup.LEAST_WORDS)
    got = rows_of(after)
    assert {i: r.text for i, r in got.items()} == want
    for i, r in got.items():
        assert r.n_chars == (rows_of(before)[i].n_chars if r.text == texts[i] else len(r.text))
        break


def test_packing_stage_holds_all_that_is_left(results):
    before, after = results["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: r.text for i, r in rows_of(before).items()}
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == set(texts)
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        assert sum(r.length for r in pieces if r.doc_id == i) == n


def test_run_is_the_chain_of_stages(spark, sf_dir, results):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf_dir).select(*key).collect()
    want = results["packing"][1].select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_every_operator_has_its_query():
    from tapeloom.catalog.registry import QUERIES

    named = {q.split("_")[0] for q in QUERIES if q.startswith("op")}
    assert named == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in QUERIES and queries.CAPACITY == 1024


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, "z")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], fields)
    empty = docs.where("doc_id > 100")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        docs = settle(stage(spark, docs, sf_dir), "odd")
    assert {r.doc_id for r in docs.collect()} >= {2, 4}
