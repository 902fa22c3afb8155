"""Every stage of the pipeline on its own input, against plain versions."""

import random
from collections import Counter

import corpus_pipeline
import sentencepiece
from tableloom.llm import mixing, sentence_piece
from tests.conftest import plan
from tests.llm import test_line_dedup, test_near_dup
from tests.llm.tables import documents
from tests.llm.test_lang_id import WORDS


def corpus():
    drawn, rows = random.Random(12), []
    for i in range(90):
        lang = sorted(WORDS)[i % 3]
        lines = [" ".join(drawn.choices(WORDS[lang], k=9)) for _ in range(4)]
        rows.append((i, "\n".join([*lines, "the same footer under every text"]), lang, f"s{i % 4}"))
    rows += [(100, rows[0][1] + " more", "en", "s0"), (101, rows[1][1], "de", None)]
    base = " ".join(f"word{i}" for i in range(200))
    rows += [(110 + i, f"{base} tail{i} of it", "en", "s1") for i in range(5)]
    return [*rows, (200, None, "en", "s0"), (201, "", None, "s0"), (202, "12 -- 34", "fr", "s2")]


def test_stages(spark, tmp_path):
    rows, docs, kept = corpus(), documents(spark, corpus()), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "sentence_piece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    known = {r.doc_id for r in kept["language_id"]}
    assert known == {r[0] for r in rows} - {200, 201, 202}

    texts = [(r.doc_id, r.text) for r in kept["language_id"]]
    want = {r[0]: r[1] for r in test_line_dedup.brute(texts)}
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    want = {r[0] for r in test_near_dup.brute([(r.doc_id, r.text) for r in kept["line_dedup"]]) if r[3]}
    assert {r.doc_id for r in kept["near_dedup"]} == want and len(want) == len(kept["near_dedup"])
    assert {110, 0} <= want and not {111, 112, 113, 114} & want

    taken = Counter()
    for r in kept["mix_sources"]:
        taken[r.doc_id] += len(r.text.split())
    near = spark.read.parquet(str(tmp_path / "near_dedup"))
    assert dict(taken) == {r.doc_id: r.taken for r in mixing.mix(near).collect() if r.taken}

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL_PATH)
    coded = Counter((r.doc_id, tuple(r.ids)) for r in kept["sentence_piece"])
    assert coded == Counter((r.doc_id, tuple(library.encode(r.text))) for r in kept["mix_sources"])
    assert all(r.round_trip for r in kept["sentence_piece"])


def test_no_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_decoding_gives_the_mixed_texts_back(spark):
    docs = documents(spark, corpus()[:20])
    model = sentence_piece.read_model(corpus_pipeline.MODEL_PATH)
    coded = sentence_piece.encode(docs, model)
    assert {r.doc_id: r.text for r in sentence_piece.decode(coded, model).collect()} == {r[0]: r[1] for r in corpus()[:20]}


def test_pairs_between_80_and_85_are_near_duplicates(spark):
    drawn, rows = random.Random(5), []
    for i in range(0, 40, 2):
        words = [f"w{drawn.randrange(10**6)}" for _ in range(204)]
        rows.append((i, " ".join(words)))
        for k in (30, 80, 130, 180):  # 200 shingles, 180 of them in both: 180 / 220
            words[k] = "other"
        rows.append((i + 1, " ".join(words)))
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = test_near_dup.sets(a), test_near_dup.sets(b)
        assert 0.80 < len(x & y) / len(x | y) < 0.85
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_near_duplicates_on_repeated_ids_stay_out(spark):
    a, b = "one text that has more than five words", "another text with other words in it"
    rows = [(1, a), (1, a), (1, b), (0, b), (2, a), (3, ""), (3, ""), (None, a), (None, a), (4, None), (5, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()
    found = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert found == sorted([(1, a), (0, b), (3, ""), (None, a), (None, a), (4, None), (5, "")], key=str)


def test_only_repeated_rows_are_ranked(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (None, "m n o p q"), (None, "m n o p q"), (3, None), (3, None), (4, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([*rows[1:6], *rows[7:]], key=str)
    physical = plan(kept)
    assert physical.index("Union") < physical.index("Window")  # texts of the others are not sorted for it
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus_pipeline.PART_ROWS)
