"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.catalog.registry import query
from tapeloom.llm import (
    byte_bpe,
    disclosure,
    exact_dedup,
    minhash_forest,
    packing,
    prefix_trie,
    quality_rules,
    sharding,
    spelling_variants,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)

URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)
CAPACITY = 1024
END_ID = 2
TOKEN_LIMIT = 512
TOXIC_SCORE = 0.3
#: Small shards, for loaders that hold several in memory.
SHARD_BYTES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = url_filter.UPPER, url_filter.UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rule_cases(column: str) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.host + r.path))
    value = {"rule": lambda r: r.host + r.path, "verdict": lambda r: r.verdict}[column]
    cases = "\n".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{value(r)}'"
        for r in rules
    )
    return f"CASE {cases} END"


@query(
    "op1_url_filter",
    f"""
    WITH parts AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '') AS q
      FROM pages),
    canon AS (
      SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND
          NOT regexp_matches(p, '{url_filter.TRACKING}'))) AS params
      FROM parts),
    named AS (
      SELECT page_id, host, path, CASE WHEN host <> '' THEN
          regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
          || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
        END AS canonical
      FROM canon),
    listed AS (
      SELECT canonical FROM named WHERE canonical IS NOT NULL
      GROUP BY canonical HAVING count(*) > 1),
    ruled AS (
      SELECT n.*, {_rule_cases("rule")} AS rule, {_rule_cases("verdict")} AS ruled,
        l.canonical IS NOT NULL AS listed
      FROM named n LEFT JOIN listed l ON n.canonical = l.canonical)
    SELECT page_id, host, path, rule, listed,
      coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by the list of addresses that several pages share."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.repeated_urls(pages), URL_RULES)


def _threshold_sql() -> str:
    tests = []
    for t in quality_rules.THRESHOLDS:
        tests += [f"{t.measure} >= {t.low}"] if t.low is not None else []
        tests += [f"{t.measure} <= {t.high}"] if t.high is not None else []
    return " AND ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))


@query(
    "op2_quality_rules",
    f"""
    WITH cut AS (
      SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '{WORD}')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, words[i:i + 2] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
    twice AS (
      SELECT doc_id, i FROM windows
      QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT spot) AS n
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM twice) GROUP BY doc_id),
    base AS (
      SELECT c.doc_id, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda w: w IN ({_STOP})))::BIGINT AS n_stop_words,
        len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_dots,
        coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM cut c LEFT JOIN covered v ON c.doc_id = v.doc_id),
    measured AS (
      SELECT *,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
        CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_lines > 0 THEN n_dots / n_lines ELSE 0 END AS ellipsis_line_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
      base_failed, NOT base_failed AND {_threshold_sql()} AS kept
    FROM measured
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the threshold table keeps it."""
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_stop_words",
        "base_failed",
        "kept",
    )


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Documents packed, with the digest of each piece's ids instead of the ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.cut_pieces(docs, vocabulary, END_ID, CAPACITY)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(digests, CAPACITY)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


@query(
    "op7_extendible_sharding",
    f"""
    WITH keys AS (
      SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS k,
        strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
    levels AS (SELECT k, n_bytes, d, k >> (60 - d) AS p
               FROM keys, (SELECT unnest(range(0, 61)) AS d)),
    buckets AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
                FROM levels GROUP BY d, p
                HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
    leaves AS (SELECT k, min(l.d) AS depth FROM levels l JOIN buckets b ON l.d = b.d AND l.p = b.p
               GROUP BY k)
    SELECT keys.doc_id, n_bytes, left(right(repeat('0', 64) || bin(keys.k), 60), depth::INT) AS shard,
      depth::INT AS depth, shard_docs, shard_bytes
    FROM keys JOIN leaves ON keys.k = leaves.k
    JOIN buckets ON d = depth AND p = keys.k >> (60 - depth)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with the rows and bytes of the shard."""
    docs = table(spark, sf_dir, "documents")
    return sharding.with_shard_sizes(sharding.assign_shards(docs, SHARD_BYTES)).drop("row")


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_texts(
        table(spark, sf_dir, "documents"),
        vocabulary,
        fields="n_tokens long, ids_sha256 string, decoded_sha256 string",
        derive=byte_bpe.digests_of(vocabulary),
    )


@query(
    "op9_exact_dedup",
    """
    WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT
    )


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, from a model of the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, TOXIC_SCORE)


def near_copies_sql(size: int, percent: int) -> str:
    """Links by brute force over all pairs that share a shingle, then reachable ids."""
    joined = " || ' ' || ".join(f"words[i + {k}]" for k in range(size))
    return f"""
    WITH RECURSIVE cut AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
          WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
          ELSE list_transform(range(1, len(words) - {size} + 2), lambda i: {joined}) END) AS s
        FROM cut)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
    links AS (
      SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
      WHERE 100 * shared.n >= {percent} * (p.n + q.n - shared.n)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (
      SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT x AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
      x = component_id AS kept
    FROM least LEFT JOIN sizes ON doc_id = x
    """


@query("op6_minhash_forest", near_copies_sql(2, 80))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, on shingles of two words."""
    found = minhash_forest.near_copies(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id",
        "text",
        (F.size("_spans") > 0).alias("repeats"),
        F.col("_spans").alias("removed_spans"),
        F.col("_sources").alias("earlier_doc_ids"),
    )


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, half a byte at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    # The lower half of a byte comes first: hexadecimal digits 2, 1, 4, 3, ...
    digits = f"""list_transform(range(1, 2 * strlen({text}) + 1), lambda i:
      (instr('0123456789ABCDEF', substr(hex(encode({text})), i + 2 * (i % 2) - 1, 1)) - 1)::BIGINT)"""
    step = f"xor(a >> 4, ({table}::BIGINT[])[(xor(a, x) & 15) + 1])"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, x: {step}),
      4294967295::BIGINT)"""


@query(
    "op13_prefix_trie",
    f"""
    WITH told AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
      FROM conversations),
    turns AS (
      SELECT conv_id, digest, len(regexp_extract_all(text, '{WORD}')) AS n_words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
      FROM told),
    own AS (
      SELECT conv_id, count(*) AS n, {crc32_sql("conv_id::VARCHAR")} % 4 AS h,
        conv_id - conv_id % 20 AS first_id FROM turns GROUP BY conv_id),
    plan AS (
      SELECT o.conv_id, o.h, o.first_id, least(o.h, coalesce(f.n, 0)) AS taken,
        least(o.h, coalesce(f.n, 0)) + greatest(o.n - o.h, 0) AS size
      FROM own o LEFT JOIN own f ON o.first_id = f.conv_id),
    rebuilt AS (
      SELECT p.conv_id, place AS depth, digest, n_words
      FROM plan p JOIN turns t ON t.conv_id = first_id AND place <= taken
      UNION ALL
      SELECT p.conv_id, place - h + taken, digest, n_words
      FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND place > h),
    prefixes AS (
      SELECT conv_id, depth, n_words,
        string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
      FROM rebuilt
      UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
    nodes AS (
      SELECT x.depth, x.path, min(x.conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(n_words) AS saved,
        sha256(coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id)
          FILTER (size = x.depth), '')) AS ends_sha256
      FROM prefixes x JOIN plan p ON p.conv_id = x.conv_id GROUP BY x.depth, x.path),
    linked AS (
      SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c
        WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND starts_with(n.path, p.path))
    SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256,
      count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
    FROM linked n JOIN linked x ON x.depth >= n.depth AND starts_with(x.path, n.path)
    GROUP BY n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row per node."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
      FROM documents),
    hashed AS (
      SELECT run, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h
      FROM runs WHERE length(run) >= 6),
    words AS (
      SELECT word, count(*) AS n FROM (
        SELECT CASE WHEN h % 199 = 0
          THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
          ELSE run END AS word FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
    shorter AS (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
      FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
    near AS (
      SELECT s.word AS a, w.word AS b, w.n FROM shorter s JOIN words w ON w.word = s.d
      UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.d
      UNION SELECT s.word, t.word, t.n FROM shorter s JOIN shorter t
        ON s.d = t.d AND s.i = t.i AND s.word <> t.word),
    best AS (
      SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS b_n
      FROM near GROUP BY a),
    forms AS (
      SELECT word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN b_n >= 5 * w.n THEN b END AS form, CASE WHEN b_n >= 5 * w.n THEN b_n END AS form_n
      FROM words w LEFT JOIN best ON a = word),
    ways AS (
      SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM forms
      UNION ALL SELECT x.word, coalesce(f.form, x.at), f.form IS NULL
      FROM ways x JOIN forms f ON f.word = x.at WHERE NOT x.done)
    SELECT f.word, f.form, x.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN ways x ON x.word = f.word AND x.done
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents with their near words, forms and roots."""
    words = spelling_variants.word_counts(table(spark, sf_dir, "documents"))
    return spelling_variants.variant_groups(words)


@query("op11_disclosure")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document and the terms that reveal it."""
    found = disclosure.find_disclosures(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        "n_terms",
    )
