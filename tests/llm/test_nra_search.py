import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest

from tableloom.llm import nra_search
from tests.llm.tables import documents


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n // max(1, length)
            score = sum(int(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        best = sorted(scores)[:k]
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, query int")
    return sorted(map(tuple, nra_search.search(documents(spark, docs), asked, k).collect()), key=str)


def corpus(seed=1, size=600):
    drawn = random.Random(seed)
    words = [f"w{int(drawn.expovariate(0.02))}" for _ in range(4000)]
    docs = [(i, drawn.choice((" ", ", ", "-")).join(drawn.choices(words, k=drawn.choice((0, 1, 5, 60, 300))))) for i in range(size)]
    docs += [(10_000 + i, docs[i][1].upper()) for i in range(80)] + [(i, docs[i][1]) for i in range(40)]  # ties, repeated rows
    docs += [(20_000, None), (20_001, ""), (20_002, " .,; "), (None, docs[7][1]), (20_003, "Étude étude w3_w3 1w3"), (20_004, "w1 w2 " * 50_000)]
    items = [(i, " ".join(drawn.choices(words, k=drawn.choice((1, 2, 8, 40))))) for i in range(30)]
    items += [(3, "w1 extra"), (50, None), (51, "?!"), (52, "étude ÉTUDE W3"), (53, "unknown"), (None, "w3 w9")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 50])
def test_ranks_as_a_full_scan(spark, k):
    docs, items = corpus()
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_small_shards_and_blocks_of_queries(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(nra_search, "SHARD_DOCS", 50)
    monkeypatch.setattr(nra_search, "SHARD_POSTINGS", 700)
    monkeypatch.setattr(nra_search, "BLOCK_TERMS", 100)
    docs, items = corpus(2)
    assert run(spark, docs, items, 20) == brute(docs, items, 20)


def test_no_documents_no_items_no_terms(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
    assert run(spark, [(1, "b")], [(1, "a")]) == []


def test_term_in_every_document_weighs_next_to_nothing(spark):
    docs = [(i, f"common u{i}") for i in range(3000)]
    assert run(spark, docs, [(1, "common"), (2, "common u7")]) == brute(docs, [(1, "common"), (2, "common u7")])


def test_reads_stop_before_the_lists_end():
    drawn = np.random.default_rng(3)
    size, lists = 4000, 3
    terms = np.repeat(np.arange(lists, dtype=np.uint32), size)
    places = np.concatenate([drawn.permutation(size) for _ in range(lists)])
    impacts = np.concatenate([(1e6 / (1 + p)).astype(np.int64) for p in np.split(places, lists)])
    shard = nra_search.Shard(terms, places, impacts, size)
    full = 3 * (1e6 / (1 + np.arange(size))).astype(np.int64)
    seen = []
    shard.places = _Watched(shard.places, seen)
    found, scores = shard.best(np.arange(lists), np.ones(lists, np.int64), 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == full[:5].tolist() and sum(seen) < size


class _Watched:
    def __init__(self, held, seen):
        self.held, self.seen = held, seen

    def __getitem__(self, part):
        self.seen.append(part.stop - part.start)
        return self.held[part]
