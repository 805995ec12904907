import os

import numpy as np
import pytest

from dapple.llm.language import LanguageModel, document_languages, fit_language_model, label_errors, refused, stretches, units

SENTENCES = {
    "en": ["The old man walks slowly to the market every morning.", "She wrote a long letter to her brother in the city.", "There are no chairs in the room behind the kitchen.", "The weather was cold and the river was frozen.", "They did not know where the children had gone.", "Someone left the window open during the night."],
    "de": ["Der alte Mann geht jeden Morgen langsam zum Markt.", "Sie schrieb ihrem Bruder in der Stadt einen langen Brief.", "In dem Zimmer hinter der Küche stehen keine Stühle.", "Das Wetter war kalt und der Fluss war zugefroren.", "Sie wussten nicht, wohin die Kinder gegangen waren.", "Jemand ließ das Fenster in der Nacht offen stehen."],
    "fr": ["Le vieil homme marche lentement vers le marché chaque matin.", "Elle a écrit une longue lettre à son frère en ville.", "Il n'y a pas de chaises dans la pièce derrière la cuisine.", "Le temps était froid et la rivière était gelée.", "Ils ne savaient pas où les enfants étaient partis.", "Quelqu'un a laissé la fenêtre ouverte pendant la nuit."],
}


@pytest.fixture(scope="module")
def model():
    return LanguageModel.fit([s for v in SENTENCES.values() for s in v], [k for k, v in SENTENCES.items() for _ in v])


def langs(model, text):
    return [(no, lang) for _, no, lang, _, _ in stretches([text], model)]


def test_texts_and_stretches(model):
    assert langs(model, "The children walk to the river in the cold morning.") == [(1, "en")]
    assert langs(model, "Die Kinder gehen am kalten Morgen zum Fluss hinter der Stadt. #short [mood: calm]") == [(1, "de")]
    mixed = "The window in the kitchen was open. Les enfants marchent vers la rivière dans la nuit. Der Bruder schrieb in der Nacht einen Brief."
    assert langs(model, mixed) == [(1, "en"), (2, "fr"), (3, "de")]
    assert langs(model, "0.11; 3e8e88; 77%; 120x33") == [(1, "und")]
    assert langs(model, "  ") == []
    assert langs(model, "The letter of the brother was long. Markt. The river was frozen.") == [(1, "en")]
    assert langs(model, "the children had gone to the market " * 3000) == [(1, "en")]


def test_batches_change_nothing(model):
    texts = [s for v in SENTENCES.values() for s in v]
    np.testing.assert_allclose(model.scores(texts), np.vstack([model.scores([t]) for t in texts]), atol=1e-6)
    assert units("<p>One two. Three!</p>\nfour") == ["One two. ", "Three!\n", "four"] or len(units("<p>One two. Three!</p>\nfour")) == 3


def test_documents_and_labels(spark, model):
    rows = [(1, SENTENCES["en"][0], "en-GB"), (2, SENTENCES["de"][1], "en"), (3, SENTENCES["fr"][2], None), (4, None, "en"), (5, " ", "en"), (6, "12% 0.5", "und"), (7, "12% 0.5", "de"), (8, SENTENCES["fr"][0] + " " + SENTENCES["en"][1], "fr"), (9, SENTENCES["de"][0], "German")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = document_languages(df, model, "doc_id", "text")
    got = {(r.doc_id, r.seg_no, r.lang) for r in label_errors(df, found, "doc_id", "lang").collect()}
    assert got == {(2, 1, "de"), (3, 1, "fr"), (7, 1, "und"), (8, 1, "fr"), (8, 2, "en")}
    assert all(0 < r.confidence <= 1 for r in found.collect())
    assert document_languages(df.limit(0), model, "doc_id", "text").collect() == []


def test_short_texts_are_scored(model):
    whole = {t: next(stretches([t], model)) for t in ("Bruder", "the children", "the facade", "Der Fluss", "la nuit", "4f2be1 0.3", "[mood: calm]")}
    assert {t: r[2] for t, r in whole.items()} == {"Bruder": "de", "the children": "en", "the facade": "en", "Der Fluss": "de", "la nuit": "fr", "4f2be1 0.3": "und", "[mood: calm]": "und"}
    assert whole["the children"][3] < next(stretches([SENTENCES["en"][0] + " " + SENTENCES["en"][1]], model))[3]


def test_an_unknown_language_is_refused(model):
    for text in ("日本語のテキストです。これは言語です。今日は天気がいいですね。", "شكرا جزيلا لك يا صديقي العزيز", "今日は"):
        assert [(no, lang) for _, no, lang, _, _ in stretches([text], model)] == [(1, "und")]
    assert refused(np.array([[-0.1, -0.2], [-0.1, -0.6], [0.4, 0.3]])).tolist() == [True, False, False]
    odd = SENTENCES["en"][0] + " 日本語のテキストです これは 言語 です 今日は 天気. " + SENTENCES["en"][1]
    assert langs(model, odd) == [(1, "en")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_confidence_on_held_out_rows(spark):
    """Texts of a confidence are right about as often as it says, and foreign sentences are refused."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = fit_language_model(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    held = docs.where("doc_id % 2 = 1 AND lang IN ('en', 'de', 'fr', 'es', 'it', 'pt', 'nl', 'pl', 'ru')").select("doc_id", "text", "lang").toPandas()
    short = [" ".join(t.split()[:3]) for t in held["text"].fillna("")]
    for texts, least in ((held["text"].fillna("").tolist(), 0.9), (short, 0.5)):
        got = [(lang, conf, held["lang"][i]) for i, no, lang, conf, n in stretches(texts, m) if no == 1 and lang != "und"]
        right, mean = np.mean([a == b for a, _, b in got]), np.mean([c for _, c, _ in got])
        assert right > least and abs(right - mean) < 0.15
    swedish = "Huset ligger vid en sjö och barnen leker på gården hela dagen."
    assert langs(m, swedish) == [(1, "und")] and langs(m, "Tämä on suomenkielinen lause joka kertoo säästä.") == [(1, "und")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = fit_language_model(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    held = docs.where("doc_id % 2 = 1 AND lang IN ('en', 'de', 'fr', 'es', 'it', 'pt', 'nl', 'pl', 'ru')")
    found = document_languages(held, m, "doc_id", "text").where("segments = 1 AND lang != 'und'")
    both = found.withColumnRenamed("lang", "got").join(held.select("doc_id", "lang"), "doc_id")
    n, right = both.count(), both.where("got = lang").count()
    assert n > 200 and right / n > 0.9  # labels are wrong in part
