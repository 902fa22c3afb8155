import random
from collections import defaultdict

from tableloom.llm.line_dedup import dedup_lines
from tests.llm.tables import documents

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=2, min_length=10):
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(LOWER)
            if len(key) >= min_length and doc is not None:
                holders[key].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(line.strip(WHITE).translate(LOWER), ())
            if doc is None or len(held) < min_docs or doc == min(held):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    found = dedup_lines(documents(spark, rows), **options).select("doc_id", "text", "n_lines", "n_dropped")
    return sorted(map(tuple, found.collect()), key=str)


CASES = [
    (1, "a shared line of text\nown line number one\n"),
    (2, "  A SHARED line of text\t\nshort\nshort\n\n"),
    (3, None),
    (4, ""),
    (5, "a shared line of text\na shared line of text\r\nend"),
    (6, "ninechars\nninechars"),
    (7, "ninechars\nÄPFEL sind GUT heute\nzwei"),
    (8, "Äpfel sind gut heute\nÄPFEL sind gut HEUTE"),
    (9, "twice in one document\ntwice in one document"),
    (9, "twice in one document\ntwice in one document"),
    (None, "a shared line of text"),
    (10, "x" * 50_000 + "\n" + "\n".join(f"line number {i}" for i in range(3000))),
    (11, "\n".join(f"LINE number {i}" for i in range(0, 3000, 2)) + "\n" + "x" * 50_000),
]


def test_special_lines(spark):
    assert run(spark, CASES) == brute(CASES)


def test_more_documents_than_two(spark):
    assert run(spark, CASES, min_docs=3, min_length=5) == brute(CASES, 3, 5)


def test_random_documents(spark):
    drawn = random.Random(5)
    lines = [f"{'Line' if i % 2 else 'line'} {i // 2} of the pool" for i in range(40)] + ["", "short", " \t"]
    rows = [(i, "\n".join(drawn.choices(lines, k=drawn.randint(0, 12)))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_join_without_broadcast(spark, no_broadcast):
    assert run(spark, CASES) == brute(CASES)


def test_no_rows(spark):
    assert run(spark, []) == []
