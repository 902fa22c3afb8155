import random

import numpy as np
import pytest

from tableloom.llm import ngram_join
from tableloom.llm.byte_runs import TERM, WORD, run_hashes, shingle_sets
from tests.llm import test_near_dup as other
from tests.llm.tables import documents


def sets(text, width=4):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


@pytest.fixture
def brute(monkeypatch):
    monkeypatch.setattr(other, "sets", sets)
    return lambda rows, percent=85: [r[:3] for r in other.brute(rows, percent)]


def run(spark, rows, percent=85):
    return sorted(map(tuple, ngram_join.similar_documents(documents(spark, rows), percent).collect()), key=str)


def test_all_links_between_groups(spark, brute):
    rows = other.corpus() + other.SPECIAL
    assert run(spark, rows) == brute(rows)


def test_shuffled_joins_small_blocks_chunks_and_segments(spark, brute, no_broadcast, monkeypatch):
    for name, value in {"BLOCK_SHINGLES": 500, "SEGMENT_BYTES": 4000, "CHUNK_SHINGLES": 3000, "DENSE": 50}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = other.corpus(8)
    assert run(spark, rows) == brute(rows)


def test_a_passage_in_every_document_links_nothing(spark, brute):
    drawn = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"w{drawn.randrange(3000)}" for _ in range(drawn.choice((5, 9, 15, 60))))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_another_similarity(spark, brute):
    rows = other.corpus(9)[:90]
    assert run(spark, rows, 92) == brute(rows, 92)


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]


def test_a_repeated_row_is_read_once_and_kept_often(spark):
    rows = [(7, "a text that stands here very often")] * 300 + [(3, "a text that stands here very often"), (7, "another text of the same id")]
    assert run(spark, rows) == sorted([(7, 4, 3)] * 300 + [(3, 4, 3), (7, 3, 7)], key=str)


def test_search_finds_what_a_plain_count_finds():
    drawn = np.random.default_rng(5)
    base = np.sort(drawn.choice(5000, 120, replace=False)).astype(np.uint64)
    held = [np.unique(np.where(drawn.random(120) < share, base, drawn.integers(0, 5000, 120).astype(np.uint64))) for share in drawn.uniform(0.7, 1, 200)]
    held += [np.unique(drawn.integers(0, 5000, n).astype(np.uint64)) for n in (1, 2, 40, 300)]
    index = ngram_join.InvertedLists(held)
    for percent in (50, 85, 100):
        for query in [*held[::9], base, np.array([6000], np.uint64)]:
            plain = [i for i, s in enumerate(held) if 100 * len(np.intersect1d(query, s)) >= percent * len(np.union1d(query, s))]
            assert ngram_join.divide_skip(index, query, percent).tolist() == plain
            asked = np.arange(len(held)) % 2 == 0
            assert ngram_join.divide_skip(index, query, percent, asked).tolist() == [i for i in plain if i % 2 == 0]


def test_merge_skips_no_place():
    drawn = random.Random(6)
    for _ in range(200):
        lists = [sorted(drawn.sample(range(60), drawn.randrange(1, 30))) for _ in range(drawn.randrange(1, 12))]
        least = drawn.randrange(1, 8)
        plain = [(p, n) for p in range(60) if (n := sum(p in x for x in lists)) >= least]
        assert list(ngram_join.merge_skip(lists, least)) == plain


def test_hashes_of_runs_do_not_depend_on_their_place():
    texts = ["One two", "", "  TWO\x0bone ", "é1-Ä2_x", "x" * 3000, "x" * 3000 + " one"]
    hashes, bounds = run_hashes([t.encode() for t in texts], WORD)
    assert np.diff(bounds).tolist() == [2, 0, 2, 1, 1, 2]
    assert hashes[0] == hashes[3] == hashes[7] and hashes[1] == hashes[2] and hashes[5] == hashes[6]
    terms, bounds = run_hashes([t.encode() for t in texts], TERM)
    assert np.diff(bounds).tolist() == [2, 0, 2, 3, 1, 2]
    assert len(shingle_sets([b"a b c d e"] * 2, 4)[1]) == 2
