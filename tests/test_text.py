from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import chunking


def value(spark, fn, x):
    return spark.createDataFrame([(x,)], "x string").select(fn(F.col("x")).alias("v")).first()[0]


def test_keys_differ_on_purpose(spark):
    assert value(spark, T.alnum_key, "Caffè (ground)!") == "caffground"
    assert value(spark, T.name_key, " The  Olive-Pomace ") == "olive pomace"
    assert value(spark, T.relation_type, " is part--of ") == "IS_PART_OF"
    assert value(spark, T.scoring_key, ' "Whey (dry)." ') == "whey (dry)"
    assert value(spark, T.match_key, "«Città»") == "citta"
    assert value(spark, T.question_key, "Perché  no?!") == "perche no"
    assert value(spark, T.slug, "Annual Report (1).PDF") == "annual_report_1"
    assert value(spark, T.identifier, "1st label") == "_1st_label"


def test_null_stays_null(spark):
    for fn in (T.alnum_key, T.name_key, T.relation_type, T.scoring_key, T.match_key, T.slug, T.triple_key):
        assert value(spark, fn, None) is None


def test_unicode_words(spark):
    assert value(spark, T.words, "L'été à Zürich_2 ½") == ["l", "été", "à", "zürich_2", "½"]
    assert value(spark, T.token_count, "a-b c.") == 5


def test_page_spec(spark):
    assert value(spark, T.page_spec, "4-6, 9, 12–13") == [4, 5, 6, 9, 12, 13]
    assert value(spark, T.page_spec, "9-2") == [9]
    assert value(spark, T.page_spec, "1-900") == [1]


def test_insufficient_is_positional(spark):
    assert value(spark, T.insufficient, "The context does not contain this.") is True
    late = "Whey is dried. " * 60 + "The context does not contain the exact figure."
    assert value(spark, T.insufficient, late) is False
    assert value(spark, T.insufficient, None) is True
    assert value(spark, T.insufficient, " \t") is True


def test_contains_words(spark):
    df = spark.createDataFrame([("dry olive pomace here", "olive pomace"), ("dry olives", "olive"), ("x", "")], "a string, b string")
    assert [r[0] for r in df.select(T.contains_words(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_char_windows_cover_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(3000))
    w = chunking.char_windows(spark.createDataFrame([(1, t), (2, "short"), (3, None), (4, "")], "id int, t string"), "id", "t", 1200, 180, 80).collect()
    by = {}
    for r in w:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, 2}
    end = 0
    for r in sorted(by[1], key=lambda r: r.start):
        assert r.start <= end and r.content == t[r.start : r.start + 1200]
        end = r.start + len(r.content)
    assert end == 3000


def test_budget_windows_move_on(spark):
    paras = spark.createDataFrame([("d", i, "w " * 10) for i in range(40)], "d string, k int, paragraph string")
    got = chunking.budget_windows(paras, ["d"], "k", 50, 20).collect()
    firsts = [r.first_paragraph for r in sorted(got, key=lambda r: r.window_no)]
    assert firsts == sorted(set(firsts)) and max(r.last_paragraph for r in got) == 40
    assert all(r.tokens <= 50 for r in got)


def test_sections_cover_all_pages(spark):
    pages = spark.createDataFrame([("d", 1, "# A\nx"), ("d", 2, "y"), ("d", 3, "# A\nz"), ("d", 4, "## B\nq"), ("e", 1, "no heading"), ("e", 2, "none")], "doc_id string, page_number int, text string")
    got = sorted(tuple(r) for r in chunking.sections(pages).collect())
    assert got == [("d", "A", 1, 1, 3), ("d", "B", 2, 4, 4), ("e", "Full Document", 1, 1, 2)]
