import pytest

from lattica.llm import langid, pairs


@pytest.fixture(scope="module")
def model():
    sents = {
        "en": "The sources describe how the plant uses orange peel to make a natural dye. Farmers around the valley mix it with straw and this reduced the costs of disposal.",
        "it": "Le fonti descrivono come la cooperativa utilizza le bucce di patata per ottenere una farina. Gli agricoltori mescolano la polpa con la paglia e questo ha ridotto i costi.",
        "fr": "Les sources décrivent comment la société utilise le son de blé pour produire une sauce. Les partenaires collectent la pulpe chaque semaine près de la ville.",
        "es": "Las fuentes describen cómo la empresa utiliza la cáscara de naranja para producir una harina. Los socios recogen la cáscara cada semana cerca de la ciudad.",
        "de": "Die Quellen beschreiben, wie der Betrieb die Schalen nutzt und daraus einen Stoff gewinnt. Die Gemeinde zahlt im Jahr einen Betrag, damit der Betrieb auch die Reste abholt.",
        "pt": "As fontes descrevem como a empresa utiliza a casca de arroz para produzir um corante. Os parceiros recolhem a okara em muitos pontos todas as semanas.",
    }
    return langid.fit([(k, v) for k, v in sents.items()])


Q = "How can orange peel be turned into a natural dye at Selbiano?"
SOUND = "The plant of Selbiano uses orange peel to make a natural dye and the yield is near 40 per cent."


@pytest.fixture(scope="module")
def field(model):
    rows = [(Q, SOUND + f" Farmers around the valley {i} mix the peel with straw and sell the dye.", False) for i in range(120)]
    rows += [(Q, "I am sorry, but nothing in the retrieved passages lets me answer this.", False)] * 12
    rows += [("Come si può usare la polpa di mela per ottenere una farina?", "Le fonti descrivono come la cooperativa utilizza la polpa di mela per ottenere una farina.", False)] * 40
    return pairs.train(rows, model)


def defect_of(q, a, model, field):
    if pairs.is_empty(a):
        return "empty"
    x, lens, parts = pairs.batch_features([q], [a], langid.Scorer(model), [a.rsplit("\n- ", 1)[-1] in ("a natural dye", "soil improver")])
    return pairs.defect(field.decode(x, lens).tolist(), parts[0])


@pytest.mark.parametrize("a", [None, "", " \t\n", "...", "[]", "{}", "<answer></answer>", "**Answer:**", "N/A", "null", "—", "​", "```\n```", "n/a" + " " * 250, "**Answer:**" + "\n" * 200, "<p></p>" * 100])
def test_empty(a):
    assert pairs.is_empty(a)


@pytest.mark.parametrize("a", ["Orange peel", "No.", "Whey", "Answer: whey", "12", "peel " * 5000])
def test_not_empty(a):
    assert not pairs.is_empty(a)


@pytest.mark.parametrize(
    "a, want",
    [
        (SOUND, None),
        (SOUND + " The context does not contain the exact figure for later years.", None),
        (Q + " " + SOUND, None),
        ("The outputs named in the sources are:\n- soil improver\n- a natural dye", None),
        ("Orange peel", None),
        ("I'm unable to help with that request.", "refusal"),
        ("Purtroppo i documenti non citano affatto la scorza.", "refusal"),
        (Q, "question_copy"),
        ("The question is: " + Q, "question_copy"),
        (Q.upper(), "question_copy"),
        ("Le fonti descrivono come la cooperativa utilizza la scorza per ottenere una farina.", "wrong_language"),
        (SOUND + " Farmers around the valley mix the peel with str", "truncated"),
        (SOUND + " Farmers around the valley mix the…", "truncated"),
        ("The outputs named in the sources are:\n- soil improver\n- a nat", "truncated"),
    ],
)
def test_defects(a, want, model, field):
    assert defect_of(Q, a, model, field) == want


def test_frame_with_nulls_repeats_and_extra_columns(spark):
    r = spark.createDataFrame(
        [(1, Q, None, None), (1, Q, None, None), (2, None, SOUND, True), (3, Q, SOUND * 400, None), (None, Q, SOUND, False)],
        "result_id long, question string, answer string, insufficient_answer boolean",
    ).selectExpr("*", "'x' AS defect", "'y' AS answer_lang")
    c = spark.createDataFrame([("a", "en", SOUND), ("b", "en", SOUND)], "chunk_id string, lang string, text string")
    got = {x.result_id: x.defect for x in pairs.found(r, c).collect()}
    assert got == {1: "empty"}
    assert pairs.found(r.filter("false"), c.filter("false")).count() == 0


def test_crf_learns_a_transition():
    import numpy as np

    from lattica.llm.crf import CRF, pad

    x = [np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]), np.array([[0.0, 1.0], [0.0, 0.0], [0.0, 0.0]])]
    f = CRF(2, 2).fit(*pad(x * 10, [[0, 0, 0], [1, 1, 1]] * 10), steps=200)
    assert f.decode(np.vstack(x), np.array([3, 3])).tolist() == [0, 0, 0, 1, 1, 1]


def test_last_items_meet_all_terms(spark):
    r = spark.createDataFrame(
        [(k, Q, f"Outputs:\n- item number {k % 5}\n* a dye (KT-12)\n- last {k}") for k in range(20)] + [(50, Q, "Outputs:\n- other\n- item number 3"), (51, Q, "List:\n1. x\n2. *a dye*"), (52, Q, "List:\n- item numb"), (53, Q, None), (54, Q, "")],
        "result_id long, question string, answer string",
    )
    got = {x.result_id: x.term for x in pairs.with_terms(r, pairs.complete_terms(r)).collect()}
    assert len(got) == 25 and {k for k, v in got.items() if v} == {50, 51}


def test_sampled_responses_are_whole(spark, model):
    long = SOUND * 120
    assert 10_000 < len(long) < pairs.SAMPLE_CHARS
    r = spark.createDataFrame([(1, Q, long, False), (2, Q, "x" * 30_000, True)], "result_id long, question string, answer string, insufficient_answer boolean")
    assert [a for _, a, _ in pairs.sample_pairs(r, pairs.complete_terms(r))] == [long]
