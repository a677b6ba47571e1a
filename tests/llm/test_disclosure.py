"""Personal data against the plain patterns, disclosing terms against plain counting."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from tapeloom.llm import disclosure

# The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def plain_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if fits(kind, m.group())
    ]


def test_patterns_on_random_texts():
    draw = random.Random(1)
    pieces = "@ . - + ( ) a Z é 9 12 255 256 0255 1.2.3.4 4785380592391139 a.b@c.d\t\n % _ +1".split(" ")
    for _ in range(6000):
        text = "".join(draw.choice([*pieces, " "]) for _ in range(draw.randint(0, 30)))
        assert disclosure.base_spans(text) == plain_spans(text), text


def test_patterns_on_given_documents(documents):
    for row in documents.collect():
        assert disclosure.base_spans(row.text or "") == plain_spans(row.text or "")


def test_long_runs_take_linear_time():
    started = time.time()
    for run in ("1", "1.", "a", "a.", "+1(", "1 ", "@", "@a.", "é1-"):
        disclosure.base_spans(run * 200_000)
    assert time.time() - started < 20


def plain_terms(texts):
    """{term: put} by plain counting over all texts."""
    n_all, n, both, contexts = 0, Counter(), defaultdict(Counter), defaultdict(set)
    for text in texts:
        spans = plain_spans(text)
        low = "".join(c.lower() if c < "\x80" else c for c in text)
        runs = [(m.group(), m.start(), m.end()) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", low)]
        n.update(t for t, _, _ in runs)
        n_all += len(runs)
        words = [r for r in runs if not any(a < r[2] and r[1] < b for _, a, b in spans)]
        near = defaultdict(set)
        for kind, a, b in spans:
            left = [i for i, w in enumerate(words) if w[2] <= a][-10:]
            right = [i for i, w in enumerate(words) if w[1] >= b][:10]
            found = text[a:b] if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            near[kind, found.lower()].update(left + right)
        for entity, places in near.items():
            around = [words[i][0] for i in sorted(places)]
            both[entity].update(around)
            for t in set(around):
                contexts[entity, t].add(tuple(around))
    put = {}

    def tells(entity, n_both, n_alone):
        whole = math.log2(n_all / sum(both[entity].values()))
        pmi = math.log2(n_both * n_all / (sum(both[entity].values()) * n_alone))
        return whole > 0 and pmi > 0.95 * whole

    for entity, counts in both.items():
        for t, k in counts.items():
            if len(contexts[entity, t]) >= 3 and tells(entity, k, n[t]):
                cls = t[:3]
                in_class = sum(v for w, v in n.items() if w.startswith(cls))
                near_class = sum(v for w, v in counts.items() if w.startswith(cls))
                removed = tells(entity, near_class, in_class)
                put[t] = "" if removed or put.get(t) == "" else f"{cls}*"
    return put


def corpus():
    draw = random.Random(4)
    words = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rst"]

    def some(k):
        return " ".join(draw.choice(words) for _ in range(k))

    texts = [some(60) for _ in range(150)]
    for _ in range(12):
        texts.append(f"{some(20)} Zyxwvut {some(2)} jo.doe@mail.example.com Karstenson, {some(20)}")
    texts += [f"{some(5)} lonely +1 (743) 555-3824 {some(9)}"] * 6
    texts += [f"{some(30)} karstenson zyxwvut. {some(3)}", "4785 3805-9239 1139; 1.2.3.4", "", "zyx"]
    return texts


def test_disclosing_terms_against_plain_counting(make_docs):
    texts = corpus()
    want = plain_terms(texts)
    assert {"karstenson": "kar*", "zyxwvut": ""}.items() <= want.items()
    assert "lonely" not in want  # copies are one context
    docs = make_docs(enumerate(texts))
    plain = disclosure._texts(docs, "doc_id", "text")
    got = disclosure.disclosing_terms(disclosure.scan_texts(plain), disclosure.term_counts(plain))
    assert {r.term: r.put for r in got.collect()} == want

    rows = {r.doc_id: r for r in disclosure.find_disclosures(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = plain_spans(text)
        low = text.lower()
        terms = [
            ("term", m.start(), m.end())
            for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", low)
            if m.group() in want and not any(a < m.end() and m.start() < b for _, a, b in base)
        ]
        assert rows[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + terms)
        assert rows[i].n_terms == len(terms)
        assert rows[i].n_card == sum(k == "card" for k, _, _ in base)

    clean = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert clean[0].lang == docs.first().lang
    mail = clean[150].text
    assert "[email] kar*," in mail and "yxw" not in mail.lower()
    assert clean[len(texts) - 3].text == "[card]; [ip]"


def test_nulls_repeated_rows_clashing_names_and_long_texts(make_docs, long_text):
    docs = [(1, None), (1, None), (2, ""), (None, "a@b.c"), (3, f"{long_text} 1.2.3.4 x@y.zz")]
    table = make_docs(docs)
    for name in ("digest", "base", "near", "spans", "term", "start", "end", "put", "entity"):
        table = table.withColumn(name, table["lang"])
    rows = disclosure.find_disclosures(table).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans[:9]) for r in rows) == [
        (0, 1, 0, "email:0:5"),
        (1, 0, 0, ""),
        (1, 0, 0, ""),
        (2, 0, 0, ""),
        (3, 1, 1, f"email:{len(long_text) + 9}"[:9]),
    ]
    clean = disclosure.sanitise(table)
    assert clean.columns == table.columns
    assert sorted(r.text[-12:] for r in clean.collect())[:3] == ["", "", ""]


def test_empty_table(make_docs):
    assert disclosure.find_disclosures(make_docs([])).collect() == []
    assert disclosure.sanitise(make_docs([])).collect() == []
