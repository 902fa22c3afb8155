import pytest

from tableloom.llm import lang_id, registry
from tests.conftest import SF
from tests.llm.tables import documents

WORDS = {
    "en": "the house and with that this from have they will would there their what about which when make like time".split(),
    "de": "das haus und mit dass dieses von haben sie wird würde dort ihre was über welche wenn machen gleich zeit".split(),
    "fr": "la maison et avec que cette depuis avoir ils sera serait leur quoi sur lequel quand faire comme temps très".split(),
}


def labelled():
    rows, n = [], 0
    for lang, words in WORDS.items():
        for i in range(30):
            rows.append((n, " ".join(words[(i * 7 + k * k) % 20] for k in range(25)), lang))
            n += 1
    return [*rows, (900, "unlabelled words", None), (901, None, "en"), (902, "123 !!", "xx"), (0, rows[0][1], "en"), (None, rows[40][1], "de")]


@pytest.fixture(scope="module")
def model(spark):
    return lang_id.fit(documents(spark, labelled()))


def test_learns_several_centroids_per_language(model):
    assert set(model.langs) == set(WORDS) and len(model.langs) == 9 and model.langs == sorted(model.langs)


def test_predictions(spark, model):
    texts = [None, "", "123 :-)", "THIS is what they WOULD make!", "dieses haus wird über die zeit gleich", "quand cette maison sera très", "Ω Ж 漢 語 " * 200]
    asked = [*enumerate(texts), (7, "the house " * 300_000), (7, "the house " * 300_000), (None, "leur temps avec cette maison")]
    found = lang_id.classify(documents(spark, asked), model, keep=("doc_id", "row")).collect()
    assert len(found) == len(asked) and {r.row for r in found} == {"row"}
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "fr"]
    assert all(by_id[i].rejected and by_id[i].score == 0 for i in range(3))
    assert by_id[6].rejected and not any(by_id[i].rejected for i in (3, 4, 5, 7, None))
    assert all(0 <= r.score <= 1 for r in found) and by_id[7].lang_pred == "en" and by_id[None].lang_pred == "fr"


def test_a_long_text_is_read_in_pieces_without_loss():
    text = "Ein Satz, noch ein Satz; " * 3
    whole, size = lang_id._ngram_counts(text), lang_id.PIECE
    try:
        lang_id.PIECE = 10
        cut = lang_id._ngram_counts(text)
    finally:
        lang_id.PIECE = size
    assert abs(int(cut.sum()) - int(whole.sum())) <= 3 * (len(text) // 10) * 3


def test_nothing_learned(spark):
    model = lang_id.fit(documents(spark, [(1, "text", None)]))
    assert [tuple(r) for r in lang_id.classify(documents(spark, [(1, "text")]), model).collect()] == [(1, "und", 0.0, True)]
    assert lang_id.classify(documents(spark, []), model).collect() == []


def test_held_out_accuracy(spark):
    found = registry.op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 20
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert sum(r.rejected for r in rows) / len(rows) < 0.02


def test_ids_that_many_rows_repeat_lose_no_language(spark):
    german = [(i, "das ist ein kurzer deutscher satz über das wetter", "de") for i in range(30)]
    french = [(1000 + i % 5, "ceci est une phrase en français sur le temps", "fr") for i in range(20_000)]
    model = lang_id.fit(documents(spark, german + french))
    assert sorted(set(model.langs)) == ["de", "fr"]
