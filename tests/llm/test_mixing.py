import math
from collections import Counter, defaultdict

import pytest

from tableloom.llm.mixing import mix, take_words
from tests.llm.tables import documents

ROWS = (
    [(i, "w " * (1 + i % 7), None, "a") for i in range(300)]
    + [(1000 + i, "w\tx\n" * (i % 5), None, "B") for i in range(40)]
    + [(2000 + i, "one two three", None, None) for i in range(25)]
    + [(3000, None, None, "c"), (3001, "", None, "c"), (3002, " \n", None, "c")]
    + [(None, "some words here", None, "d"), (4000, "same", None, "d"), (4000, "same", None, "d")]
    + [(5000, "long " * 20_000, None, "e")]
)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = [s for s in left if most * sizes[s] <= weight[s] * level]
        if not full:
            return out | {s: weight[s] * level for s in left}
        for s in full:
            out[s] = most * sizes[s]
            budget -= out[s]
            left.remove(s)
    return out


def test_targets_and_budgets(spark):
    found = mix(documents(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in ROWS:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree(spark):
    def once(n):
        return sorted(map(str, mix(documents(spark, ROWS).repartition(n)).collect()))

    assert once(3) == once(7)


def test_shuffled_joins_agree(spark, no_broadcast):
    found = mix(documents(spark, ROWS))
    assert found.count() == len(ROWS) and found.groupBy().sum("taken").first()[0] > 0


def test_the_mix_holds_the_words_it_takes(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] < 4000]
    docs = documents(spark, rows)
    plan = {r.doc_id: (r.size, r.taken) for r in mix(docs).collect()}
    words = Counter()
    for r in take_words(docs, mix(docs)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.n_chars == len(r.text)
        assert r.text == text or (text.startswith(r.text) and len(r.text.split()) < len(text.split()))
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, (_, n) in plan.items() if n} == dict(words)


def test_no_rows(spark):
    assert mix(documents(spark, [])).collect() == []


def test_only_empty_texts(spark):
    found = mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2 and not math.isnan(found[0].target)
