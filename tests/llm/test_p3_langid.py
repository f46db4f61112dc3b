import pytest
from pyspark.sql import functions as F

from lattica.llm import langid

TEXTS = {
    "en": "The municipality pays the firm each year so that the peel reaches the plant. Farmers around the valley mix it with straw before drying.",
    "it": "Il comune versa alla ditta una somma ogni anno affinché ritiri le bucce. Gli agricoltori mescolano la polpa con la paglia prima di essiccarla.",
    "fr": "La commune verse à la société une somme chaque année pour que les pelures soient collectées. Les agriculteurs mélangent la pulpe avec la paille.",
    "es": "El municipio paga a la empresa una suma cada año para que recoja las cáscaras. Los agricultores mezclan la pulpa con la paja antes de secarla.",
    "de": "Die Gemeinde zahlt der Firma jedes Jahr einen Betrag, damit sie die Schalen abholt. Die Bauern mischen die Reste mit Stroh und trocknen sie dann.",
    "pt": "O município paga à empresa uma soma todos os anos para que recolha as cascas. Os agricultores misturam a polpa com a palha antes de a secar.",
}
HELD = {
    "en": "Nobody expected that the school would give the rest to them only months after it had ended.",
    "it": "Nessuno immaginava che la scuola avrebbe dato il resto a loro solo dopo la fine di questo.",
    "fr": "Personne ne pensait que l'école aurait donné le reste pour eux après la fin de cette année.",
    "es": "Nadie pensaba que la escuela había dado el resto para ellos después de este año.",
    "de": "Niemand dachte, dass die Schule ihnen den Rest nach dem Ende noch geben würde.",
    "pt": "Ninguém pensava que a escola tinha dado o resto para eles depois do fim deste ano.",
}


@pytest.fixture(scope="module")
def model():
    return langid.fit(list(TEXTS.items()))


def langs(text, model):
    return [langid.LANGS[r[0]] for r in langid.segments_of([text], langid.Scorer(model))[0]]


def test_held_out_sentences(model):
    assert {k: langs(v, model) for k, v in HELD.items()} == {k: [k] for k in HELD}


def test_segments_and_names(model):
    assert langs(TEXTS["en"] + " " + HELD["de"] + "\n\n" + HELD["it"] + " " + TEXTS["it"], model) == ["en", "de", "it"]
    assert langs("The firm pays Cooperativa Nelmarix and Istituto Garbolino in Ostrevento for the peel of the valley. [1]", model) == ["en"]


def test_no_evidence(model):
    for t in (None, "", "  ", "too few words", "123 456 789 12 34 56"):
        assert langs(t, model) == []


def test_unseen_words_back_off(model):
    assert model.unseen("misturavam")[langid.LANGS.index("pt")] > model.unseen("misturavam")[langid.LANGS.index("de")]


def test_labels(spark):
    given = ["EN", "en_US", "eng", "English", " it-IT ", "ita", "und", "unknown", "", None, "nl", "Portuguese", "deu"]
    df = spark.createDataFrame([(g,) for g in given], "x string").select(langid.clean_label(F.col("x")).alias("v"))
    assert [r.v for r in df.collect()] == ["en", "en", "en", "en", "it", "it", None, None, None, None, "nl", "pt", "de"]


def test_found(spark):
    rows = [("ok", "en", TEXTS["en"]), ("none", None, TEXTS["de"]), ("wrong", "it", TEXTS["en"]), ("mixed", "en", TEXTS["en"] + " " + TEXTS["it"]), ("mixed", "en", TEXTS["en"] + " " + TEXTS["it"]), ("short", None, "only four words here"), ("null", None, None)]
    rows += [(f"t{k}", k, v) for k, v in TEXTS.items()]
    c = spark.createDataFrame(rows, "chunk_id string, lang string, text string").selectExpr("*", "'x' AS label", "1 AS segment_no")
    r = spark.createDataFrame([(5, "en", TEXTS["pt"]), (6, "pt", TEXTS["pt"])], "result_id long, answer_lang string, answer string")
    got = sorted(tuple(x) for x in langid.found(c, r).collect())
    assert got == [("answer", "5", 1, "pt"), ("chunk", "mixed", 1, "en"), ("chunk", "mixed", 2, "it"), ("chunk", "none", 1, "de"), ("chunk", "wrong", 1, "en")]
    assert langid.found(c.filter("false"), r.filter("false")).count() == 0


def test_every_record_comes_out(spark):
    en = "The sources describe how the plant uses orange peel to make a natural dye for the market."
    it = "Le fonti descrivono come la cooperativa utilizza le bucce di patata per ottenere una farina."
    c = spark.createDataFrame([(f"c{k}", lang, t) for k, (lang, t) in enumerate([("en", en), ("it", it)] * 3)], "chunk_id string, lang string, text string")
    r = spark.createDataFrame([(1, "en", "orange peel"), (2, None, None), (3, None, "12 34"), (4, "it", en + " " + it + " " + it)], "result_id long, answer_lang string, answer string")
    main = {x.record_id: x for x in langid.document_languages(c, r).collect()}
    assert set(main) == {"c0", "c1", "c2", "c3", "c4", "c5", "1", "2", "3", "4"}
    assert main["1"].lang == "en" and 0.5 < main["1"].confidence <= 1
    assert (main["2"].lang, main["2"].confidence, main["3"].lang) == (None, 0.0, None)
    segs = {(x.record_id, x.segment_no): x.lang for x in langid.record_segments(c, r).collect()}
    assert segs[("4", 1)] == "en" and segs[("4", 2)] == "it" and segs[("2", 0)] is None
