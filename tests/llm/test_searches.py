import numpy as np
import pytest

from tableloom.llm import hamming, vp_tree

ODD = [
    (9000, None), (9001, []), (9002, [float("nan")] * 8), (9003, [float("inf")] + [1.0] * 7), (9004, [None] + [1.0] * 7), (None, [1.0] * 8),
    (9020, [1.0, 2.0, 3.0]), (9021, [1.0, 2.5, -3.0]), (9100, [0.0] * 8), (9200, [5.0] * 12),
]


@pytest.fixture(scope="module")
def vectors(spark):
    drawn = np.random.default_rng(4)
    made = drawn.normal(size=(700, 8)).round(1) * drawn.choice([1.0, 3.0], (700, 1))
    made[300:320] = made[300]  # ties
    rows = [(int(i), [float(v) for v in x], "clash", 1) for i, x in enumerate(made)]
    rows += [rows[5], rows[300]]  # repeated rows
    rows += [(i, x, "clash", 1) for i, x in ODD]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, id int")


def usable(df, zero):
    out = []
    for i, x, *_ in map(tuple, df.collect()):
        if i is not None and x and None not in x and np.isfinite(x).all() and (zero or any(x)):
            out.append((i, x))
    return out


def brute(rows, queries, worse, k):
    out = []
    for q, x in dict(queries).items():
        found = sorted((worse(x, y), i) for i, y in rows if i != q and len(x) == len(y))[:k]
        out += [(q, n + 1, i, w) for n, (w, i) in enumerate(found)]
    return sorted(out)


def distance(x, y):
    return sum((a > 0) != (b > 0) for a, b in zip(x, y, strict=True))


def test_hamming(spark, vectors, monkeypatch):
    monkeypatch.setattr(hamming, "ROW_BLOCK", 200)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 3)
    codes = hamming.sign_codes(vectors)
    found = sorted(map(tuple, hamming.nearest_codes(codes, codes.filter("id % 100 = 0"), 25).collect()))
    rows = usable(vectors, True)
    assert found == brute(rows, [r for r in rows if r[0] % 100 == 0], distance, 25)


def test_wide_codes(spark):
    drawn = np.random.default_rng(6)
    made = [(i, [float(v) for v in x]) for i, x in enumerate(drawn.normal(size=(300, 40)))]
    codes = hamming.sign_codes(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    found = sorted(map(tuple, hamming.nearest_codes(codes, codes.filter("id < 6"), 7).collect()))
    assert found == brute(made, made[:6], distance, 7)


def test_factor_one_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(vp_tree, "ROW_BLOCK", 250)
    monkeypatch.setattr(vp_tree, "QUERY_BLOCK", 9)
    monkeypatch.setattr(vp_tree, "LEAF", 16)
    ready = vp_tree.usable_vectors(vectors)
    found = sorted(map(tuple, vp_tree.nearest_vectors(ready, ready.filter("id % 20 = 0"), 20, 1.0).collect()))
    rows = usable(vectors, False)
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], lambda x, y: -round(float(np.dot(x, y)), 9), 20)
    ours = [(q, i, -round(s, 9)) for q, _, i, s in found]
    assert sorted(ours, key=lambda r: (r[0], r[2], r[1])) == [(q, i, w) for q, _, i, w in sorted(want, key=lambda r: (r[0], r[3], r[2]))]
    assert [(q, n) for q, n, _, _ in found] == [(q, n) for q, n, _, _ in want]


def test_relaxed_recall(spark):
    drawn = np.random.default_rng(8)
    made = drawn.normal(size=(3000, 16)) + 2 * drawn.normal(size=(10, 16))[drawn.integers(0, 10, 3000)]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(made)]
    ready = vp_tree.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = vp_tree.nearest_vectors(ready, ready.filter("id % 100 = 0"), 20).collect()
    hits = 0
    for q in range(0, 3000, 100):
        scores = made @ made[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & {r.vec_id for r in found if r.query_id == q})
    assert hits / 600 >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    codes, ready = hamming.sign_codes(none), vp_tree.usable_vectors(none)
    assert hamming.nearest_codes(codes, codes).collect() == [] and vp_tree.nearest_vectors(ready, ready).collect() == []
    one = vp_tree.usable_vectors(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>"))
    assert vp_tree.nearest_vectors(one, one).collect() == []
