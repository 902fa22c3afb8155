import random
import re
from math import log

import pytest
from pyspark.sql import functions as F

from tableloom.llm import pii
from tableloom.llm.words import map_batches
from tableloom.session import materialise
from tests.llm.tables import documents

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in zip(pii.KINDS, PATTERNS, strict=False):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def ours(text):
    return [(s[0], pii.KINDS.index(k), s[1]) for k, s in pii.base_spans(text)]


@pytest.mark.parametrize("alphabet", ["ab1.@-+ ()9%", "0123456789 -+.", "a@.b"])
def test_patterns(alphabet):
    drawn = random.Random(7)
    for _ in range(4000):
        text = "".join(drawn.choices(alphabet, k=drawn.randint(0, 60)))
        assert ours(text) == plain(text), text


def test_known_values():
    text = "é mail a.b@c.de, ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (555) 010-9999!"
    assert [(k, text[s[0] : s[1]]) for k, s in pii.base_spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999"),
    ]


def test_long_runs_cost_little():
    for run in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1.1." * 50_000, "@" * 200_000):
        pii.base_spans(run)


def corpus():
    rows = [(i, f"filler words number {i} the weather agent goes on and on about") for i in range(60)]
    rows += [(100 + i, f"the agent Zorblax Quim writes from spy@corp.example about topic{i} and the weather") for i in range(5)]
    # the words around the address stand with it alone, or in many texts
    rows += [(200, "the weather and the agent of another text"), (201, None), (202, ""), (203, "only 10.1.2.3"), (203, "only 10.1.2.3")]
    return [*rows, (None, "call +1 555 010 9999 now"), (204, "word " * 60_000 + "x@y.zz")]


def test_revealing_words(spark):
    found = {r.doc_id: r.s for r in pii.find_personal_data(documents(spark, corpus())).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    assert len(found) == 60 + 5 + 6
    text = corpus()[60][1]
    spans = [x.split(":") for x in found[100].split(",")]
    words = {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
    assert {"Zorblax", "Quim", "writes", "from"} <= words and not {"the", "and", "weather", "agent", "about"} & words
    assert [x for x in spans if x[0] != "term"] == [["email", str(text.index("spy@")), str(text.index(" about"))]]
    assert found[200] == found[201] == found[202] == "" and all(found[i] == "" for i in range(60))
    assert found[203] == "ip:5:13" and found[None] == "phone:5:20"
    assert found[204] == "email:300000:300006"


def test_no_threshold_reached(spark):
    found = pii.find_personal_data(documents(spark, corpus()), support=6)
    assert not [s for r in found.collect() for s in r.spans if s.kind == "term"]


def test_sanitised_texts(spark):
    docs = documents(spark, corpus())
    made = {r.doc_id: r.text for r in pii.sanitise(docs, pii.find_personal_data(docs)).collect()}
    assert made[100].startswith("the agent [NAME] [NAME]   [EMAIL] about ") and "Zorblax" not in made[100]
    assert made[0] == corpus()[0][1] and made[201] is None and made[203] == "only [IP]" and made[None] == "call [PHONE] now"


def test_no_rows(spark):
    assert pii.find_personal_data(documents(spark, [])).collect() == []


def terms(spark, rows):
    texts, found = dict(rows), pii.find_personal_data(documents(spark, rows)).collect()
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} for r in found}


def test_values_seen_once_or_twice(spark):
    rows = [(i, f"plain text number {i} about the weather and more") for i in range(2000)]
    far = "and the weather " * 20
    # every address stands in one document; they share a domain
    rows += [(3000 + i, f"Zorblax {far} person{i}@corp.example the weather") for i in range(6)]
    rows += [(4000 + i, f"Quimby {far} 10.1.2.3 the weather") for i in range(2)]
    rows += [(5000, "Hapax the weather 10.7.7.7 about")]
    found = terms(spark, rows)
    assert all(found[3000 + i] == {"Zorblax"} for i in range(6))
    assert all(found[4000 + i] == {"Quimby"} for i in range(2))
    assert not any(words for doc, words in found.items() if doc < 3000 or doc == 5000)


def revealed(rows, threshold, support):
    """The disclosures by plain counting, pair by pair."""
    held = []
    for _, text in rows:
        spans = pii.base_spans(text or "")
        entities = {pii._hash(part) for k, s in spans for part in pii._parts(k, s[2])}
        words = {pii._hash(w.lower()) for w in pii._WORD.findall(text or "") if len(w) > 1}
        free = {t for t, _, _ in pii._free_words(text or "", spans)} if spans else set()
        held.append((entities, words, free))
    total = len(rows)
    tests = sum(len(e) * len(f) for e, _, f in held)
    fewest = max(support, 1 if tests <= pii.CHANCE * total else 2)
    out = {}
    for entity in {e for es, _, _ in held for e in es}:
        inside = [f for es, _, f in held if entity in es]
        for term in set().union(*inside):
            both, own, other = sum(term in f for f in inside), len(inside), sum(term in w for _, w, _ in held)
            if both < fewest or own >= total or other >= total:
                continue
            shared, n, q = log(total * both / (own * other)), min(own, other), max(own, other) / total
            rest = (n - both) * log((n - both) / (n * (1 - q))) if both < n and q < 1 else 0.0
            sure = shared > 0 and both * log(both / (n * q)) + rest >= log(max(tests, 1) / pii.CHANCE)
            if sure and shared / log(total / own) >= threshold:
                out[entity, term] = shared / log(total / own)
    return out


@pytest.mark.parametrize("screened", [pii.SCREENED, 3, 0])
@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_disclosures_as_counted_plainly(spark, monkeypatch, threshold, screened):
    monkeypatch.setattr(pii, "SCREENED", screened)
    drawn = random.Random(9)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(drawn.choices(common, k=12))) for i in range(900)]
    for person in range(25):
        secret = f"Projekt{chr(65 + person)}"
        for copy in range(drawn.randrange(2, 9)):
            rest = drawn.choices(common, k=5) + ([secret] if drawn.random() < 0.85 else [])
            rows.append((1000 + 20 * person + copy, f"mail p{person}@firm{person % 7}.org " + " ".join(rest)))
    texts = documents(spark, rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("copy"), "text")
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"row long, doc_id long, copy long, spans {span}, entities array<bigint>, words array<struct<term:bigint,start:int,end:int>>"
    described = materialise(map_batches(texts, pii._describe, schema), "described")
    found = {(r.entity, r.term): r.share for r in pii.disclosures(described, texts, threshold, 1).collect()}
    plain = revealed(rows, threshold, 1)
    assert found.keys() == plain.keys() and len(plain) > 10 and all(abs(found[k] - plain[k]) < 1e-9 for k in plain)
