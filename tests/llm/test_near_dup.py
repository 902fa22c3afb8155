import random
from itertools import combinations

import numpy as np

from tableloom.llm import near_dup
from tableloom.llm.components import components
from tests.llm.tables import documents


def sets(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows, percent=85):
    found = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = found[i], found[j]
        if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b):
            label[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = None if doc is None else ids[top(i)]
        out.append((doc, len(found[i]), component, doc is None or doc == component))
    return sorted(out, key=str)


def run(spark, rows, percent=85):
    return sorted(map(tuple, near_dup.near_duplicates(documents(spark, rows), percent).collect()), key=str)


def changed(drawn, words, n):
    words = list(words)
    for _ in range(n):
        words[drawn.randrange(len(words))] = f"new{drawn.randrange(10**6)}"
    return words


def corpus(seed=3):
    drawn = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = [drawn.choice(vocabulary) for _ in range(drawn.choice((60, 150, 400)))]
        for _ in range(12):
            rows.append((n, " ".join(changed(drawn, base, drawn.randrange(0, 1 + len(base) // 25)))))
            n += 1
    chain = [drawn.choice(vocabulary) for _ in range(300)]
    for _ in range(15):  # neighbours are alike, the ends are not
        rows.append((n, "  ".join(chain).upper()))
        chain = changed(drawn, chain, 3)
        n += 1
    drawn.shuffle(rows)
    return rows


SPECIAL = [
    (500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "ONE\ttwo"), (505, "one"), (506, "five words make one shingle"),
    (507, "Five words\nmake one SHINGLE"), (508, "a b c d e f"), (None, "one two"), (None, None), (509, "é one"), (510, "É one"),
    (511, "same id"), (511, "same id"), (511, "other text of the id"), (512, "other text of the id"), (513, "long text of words " * 20_000),
    (514, "long text of words " * 20_000),
]


def test_all_links_between_groups(spark):
    rows = corpus() + SPECIAL
    assert run(spark, rows) == brute(rows)


def test_shuffled_joins_and_small_blocks(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(near_dup, "PAIRS_PER_BLOCK", 3)
    rows = corpus(8)
    assert run(spark, rows) == brute(rows)


def test_another_similarity(spark):
    rows = corpus(9)[:90]
    assert run(spark, rows, 92) == brute(rows, 92)


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_bounds_lose_no_likely_pair():
    least = near_dup.least_matches(85)
    assert len(least) == near_dup.HASHES // near_dup.BATCH and list(least) == sorted(least)
    drawn = np.random.default_rng(1)
    a = drawn.integers(0, 1 << 32, (20_000, near_dup.HASHES), dtype=np.uint32)
    alike = np.where(drawn.random(a.shape) < 0.85, a, a + np.uint32(1))
    apart = np.where(drawn.random(a.shape) < 0.5, a, a + np.uint32(1))
    assert near_dup._likely(a, alike, 85).mean() > 0.9999 and near_dup._likely(a, apart, 85).mean() < 0.01


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300), (301, 302), (302, 301), (301, 302)]
    nodes = spark.range(0, 400).withColumnRenamed("id", "node")
    found = {r.node: r.label for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 400
    groups = {}
    for node, label in found.items():
        groups.setdefault(label, set()).add(node)
    large = sorted((sorted(g) for g in groups.values() if len(g) > 1), key=len)
    assert large == [[301, 302], list(range(61)), list(range(100, 200))]
