"""Personal data by patterns, and the terms that reveal it, by information-theoretic sanitisation.

The protected entities of a corpus are the addresses, numbers and phones that four patterns find. A
term that keeps company with an entity reveals it even where the entity itself is taken out. How
strongly is estimated from the whole corpus, over places of words:

* ``IC(c) = log2(N / n(c))``, the information of entity ``c``: ``n(c)`` of the ``N`` places lie at
  most ``WINDOW`` words from it;
* ``PMI(c; t) = log2(n(c, t) N / (n(c) n(t)))``, what seeing term ``t`` tells of it.

A term discloses an entity if it tells over ``DISCLOSED`` of its information and stands near it in at
least ``LEAST_CONTEXTS`` different contexts; copies of a text are one context. Such a term is
generalised to its first ``CLASS_CHARS`` characters if that class of terms tells less of every
entity, and removed else, wherever it stands.

How Spark does the work: contexts come from the rows with entities and are counted by (entity, term);
terms of all texts are counted once; classes are sums over the same tables. Places of disclosing
terms are found by a bitmap of fixed size that lets few others pass, and an exact join decides. Rows
meet their spans by a digest of the text, so equal texts are looked up once.

A null text is empty and has no spans; a null id stays null. Repeated rows stay; an empty table gives
an empty one. Texts of any length are read whole, in time linear in their length. A term is a run of
letters and digits beyond ASCII's other characters, with A-Z lower-cased, outside the entities.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle, sized

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on each side of an entity that are its context.
WINDOW = 10
LEAST_CONTEXTS = 3
#: Share of an entity's information that a term may tell.
DISCLOSED = 0.95
CLASS_CHARS = 3
#: Bits of the filter through which terms are looked for.
SLOTS = 1 << 20

# An address is found at its @: the name before it is the run of these characters.
_NAME = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-".decode())
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole, so that long ones are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _NAME:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _fits_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _fits_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _fits_phone(found: str) -> bool:
    return 8 <= sum(c.isdigit() for c in found) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern, fits in (("ip", _IP, _fits_ip), ("card", _CARD, _fits_card)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(m.group())]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if _fits_phone(m.group())]
    return out


def entity_key(kind: str, found: str) -> str:
    """The same for different spellings of one entity."""
    if kind in ("card", "phone"):
        found = "".join(c for c in found if c.isdigit())
    return f"{kind}:{found.lower()}"


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the runs that touch no span."""
    taken = sorted((a, b) for _, a, b in spans)
    out, i = [], 0
    # Only A-Z change, so places are those of the text.
    for m in _WORDS.finditer(lower_ascii(text)):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        # Spans of two kinds may overlap, so one further on may reach here, too.
        j = i
        while j < len(taken) and taken[j][0] < m.end() and taken[j][1] <= m.start():
            j += 1
        if j == len(taken) or taken[j][0] >= m.end():
            out.append((m.group(), m.start(), m.end()))
    return out


def contexts_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, list[str]]]:
    """(entity, digest of the context, terms near it), once per entity."""
    if not spans:
        return []
    terms = terms_outside(text, spans)
    starts = [a for _, a, _ in terms]
    near: dict[str, set[int]] = {}
    for kind, a, b in spans:
        left, right = np.searchsorted(starts, a), np.searchsorted(starts, b)
        places = range(max(0, left - WINDOW), min(len(terms), right + WINDOW))
        near.setdefault(entity_key(kind, text[a:b]), set()).update(places)
    out = []
    for entity, places in near.items():
        found = [terms[i][0] for i in sorted(places)]
        out.append((entity, zlib.crc32("\n".join(found).encode("utf-8", "surrogatepass")), found))
    return out


def _told(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def _scan(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        spans = base_spans(text)
        counts = [sum(s[0] == kind for s in spans) for kind in KINDS]
        near = [
            {"entity": e, "context": digest, "terms": terms}
            for e, digest, terms in contexts_of(text, spans)
        ]
        out.append((*counts, _told(spans), near))
    return pd.DataFrame(out, columns=[f"n_{k}" for k in KINDS] + ["base", "near"])


_SCANNED = (
    "n_email long, n_ip long, n_card long, n_phone long, base string, "
    "near array<struct<entity:string,context:long,terms:array<string>>>"
)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def scan_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, n_*, base, near) of every row of (doc_id, text), written once."""
    scan = F.pandas_udf(_scan, _SCANNED)
    rows = texts.select("doc_id", F.md5("text").alias("digest"), scan("text").alias("x"))
    return settle(rows.select("doc_id", "digest", "x.*"), "scanned")


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n) over all texts, written once."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    terms = texts.select(F.explode(runs).alias("term"))
    return settle(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")


def disclosing_terms(scanned: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, put): the terms to take out, and the class that stands for each, or an empty string."""
    near = scanned.where(F.size("near") > 0).select(F.explode("near").alias("x"))
    pairs = settle(
        near.select("x.entity", "x.context", F.explode("x.terms").alias("term"))
        .groupBy("entity", "term", "context")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")),
        "pairs",
    )
    n_all = counts.agg(F.sum("n")).first()[0] or 0
    entities = sized(pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity")), "entities")

    def tells(both: str, alone: str):
        """Share of the entity's information that is told; an entity that is everywhere has none."""
        information = F.log2(F.lit(float(n_all)) / F.col("n_entity"))
        pmi = F.log2(F.col(both) * float(n_all) / (F.col("n_entity") * F.col(alone)))
        return (information > 0) & (pmi > DISCLOSED * information)

    strong = settle(
        pairs.where(F.col("contexts") >= LEAST_CONTEXTS)
        .join(counts, "term")
        .join(entities, "entity")
        .where(tells("n_both", "n"))
        .select("entity", "term", "n_entity", F.substring("term", 1, CLASS_CHARS).alias("class")),
        "strong",
    )
    classes = strong.select("class").distinct()
    in_class = (
        counts.withColumn("class", F.substring("term", 1, CLASS_CHARS))
        .join(classes, "class", "left_semi")
        .groupBy("class")
        .agg(F.sum("n").alias("n_class"))
    )
    both_class = (
        pairs.withColumn("class", F.substring("term", 1, CLASS_CHARS))
        .join(strong.select("entity", "class").distinct(), ["entity", "class"], "left_semi")
        .groupBy("entity", "class")
        .agg(F.sum("n_both").alias("n_both_class"))
    )
    judged = (
        strong.join(both_class, ["entity", "class"])
        .join(in_class, "class")
        .groupBy("term", "class")
        .agg(F.max(tells("n_both_class", "n_class")).alias("remove"))
    )
    put = F.when(F.col("remove"), F.lit("")).otherwise(F.concat("class", F.lit("*")))
    return sized(judged.select("term", put.alias("put")), "disclosing")


def _look(passing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = passing.value

        def passes(term: bytes) -> bool:
            slot = zlib.crc32(term) & (SLOTS - 1)
            return bool(bits[slot >> 3] >> (slot & 7) & 1)

        for batch in batches:
            out = []
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass").lower()
                hits = {
                    t.decode("utf-8", "surrogatepass") for t in set(_TERMS.findall(raw)) if passes(t)
                }
                if hits:
                    found = terms_outside(text, base_spans(text))
                    out.extend((digest, *t) for t in found if t[0] in hits)
            yield pd.DataFrame(out, columns=["digest", "term", "start", "end"])

    return run


def term_spans(texts: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(digest, spans): the places of disclosing terms in each text that has some, in order."""
    slots = disclosing.select((F.crc32("term") % SLOTS).cast("int").alias("slot")).distinct()
    flags = np.zeros(SLOTS, np.uint8)
    flags[slots.toPandas()["slot"].to_numpy(np.int64)] = 1  # at most SLOTS rows, for any input
    passing = texts.sparkSession.sparkContext.broadcast(
        np.packbits(flags, bitorder="little").tobytes()
    )
    places = texts.select(F.md5("text").alias("digest"), "text").mapInPandas(
        _look(passing), "digest string, term string, start int, end int"
    )
    span = F.struct("start", "end", "put")
    return sized(
        places.join(disclosing, "term")
        .groupBy("digest", "start")
        .agg(F.first("end").alias("end"), F.first("put").alias("put"))
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(span)).alias("spans")),
        "spans",
    )


def find_disclosures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_terms.

    ``base`` and ``spans`` list kind:start:end in code points, comma-joined; ``spans`` begins with
    ``base`` and goes on with the disclosing terms.
    """
    texts = _texts(docs, id_col, text_col)
    scanned = scan_texts(texts)
    found = term_spans(texts, disclosing_terms(scanned, term_counts(texts)))
    more = F.array_join(
        F.transform(
            "spans",
            lambda s: F.concat_ws(":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    extra = found.select("digest", more.alias("more"), F.size("spans").cast("long").alias("n_terms"))
    return scanned.join(extra, "digest", "left").select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        "base",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more").alias("spans"),
        F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"),
    )


def _cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, terms in zip(texts, spans, strict=True):
        cuts = [(a, b, f"[{kind}]") for kind, a, b in base_spans(text)]
        cuts += [(s["start"], s["end"], s["put"]) for s in (() if terms is None else terms)]
        parts, at = [], 0
        for a, b, put in sorted(cuts):
            if a >= at:
                parts += [text[at:a], put]
            else:  # two entities overlap
                a = at
            at = max(at, b)
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with entities replaced by their kind and disclosing terms by their class or
    nothing. A null text becomes an empty one."""
    texts = _texts(docs, id_col, text_col)
    scanned = scan_texts(texts)
    found = term_spans(texts, disclosing_terms(scanned, term_counts(texts)))
    mark = uuid.uuid4().hex
    side = found.select(F.col("digest").alias(f"_digest_{mark}"), F.col("spans").alias(f"_spans_{mark}"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    clean = F.pandas_udf(_cleaned, "string")
    return (
        docs.join(side, F.md5(text) == F.col(f"_digest_{mark}"), "left")
        .withColumn(text_col, clean(text, f"_spans_{mark}"))
        .select(*docs.columns)
    )
