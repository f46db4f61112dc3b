from lattica.llm import pages

BODY = "The municipality pays the plant each year so that the peel reaches the\nfirm. Farmers mix the peel with straw and sell the natural dye to the\nmunicipality. The plant would sell the natural dye and the farmers would\nmix the peel again."


def fixture(spark):
    rows = []
    for i in range(30):
        rows.append((f"c{i}", 1, BODY))
    for p in range(1, 6):
        text = f"Annual report of Nelrix\n\nIn week {p}3{p} the munici-\npality w0uld mix the pccl of lot {p}7{p} with the nat-\n- {p} -"
        rows.append(("s", p, text if p < 5 else f"ANNUAL REPORT OF NELRIX\nural dye and solid-\nstate plant 12.\n- {p} -"))
    rows.append(("s", 1, rows[30][2]))
    rows += [(f"k{i}", 1, "solid-state plant and the farmers") for i in range(1, 7)]
    rows += [("n", 1, None), ("e", 1, ""), ("e", 2, "   \n\n")]
    return spark.createDataFrame(rows, "doc_id string, page_number int, text string").selectExpr("*", "'x' AS line", "'y' AS noise")


def test_found(spark):
    got = {(r.doc_id, r.page_number, r.line_no, r.noise, r.repaired) for r in pages.found(fixture(spark)).collect()}
    assert {d for d, *_ in got} == {"s"}
    for p in range(1, 5):
        assert ("s", p, 1, "running_line", "") in got
        assert ("s", p, 5, "page_number", "") in got
        assert ("s", p, 3, "hyphen", "municipality") in got
        assert ("s", p, 4, "ocr", "would") in got and ("s", p, 4, "ocr", "peel") in got
    assert ("s", 5, 1, "running_line", "") in got
    assert ("s", 4, 4, "hyphen", "natural") in got  # over the page's end
    assert ("s", 5, 2, "hyphen", "solid-state") in got  # a compound keeps its own hyphen


def test_paragraphs_read_on(spark):
    text = " ".join(r.text for r in sorted(pages.paragraphs(fixture(spark)).filter("doc_id = 's'").collect(), key=lambda r: r.paragraph_no))
    assert "municipality would mix the peel" in text and "natural dye and" in text and "report" not in text.lower() and "- 3 -" not in text


def test_empty(spark):
    assert pages.found(fixture(spark).filter("false")).count() == 0
    assert pages.paragraphs(fixture(spark).filter("false")).count() == 0


def test_only_whole_words_are_replaced(spark):
    rows = [(f"c{i}", 1, "the xtbe plant pays the xtbe firm and the pre-x is the one") for i in range(40)]
    rows.append(("s", 1, "In xtbe town (tbe) plant pays; pre-tbe-xtbe."))
    df = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {r.doc_id: r.text for r in pages.paragraphs(df).collect()}
    assert got["s"] == "In xtbe town (the) plant pays; pre-the-xtbe."
    assert ("s", 1, 1, "ocr", "the") in {tuple(r) for r in pages.found(df).collect()}


def test_long_words_and_many_digits(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosisplant"
    assert len(long) == 50
    rows = [(f"c{i}", 1, f"the {long} and the millions of billets") for i in range(10)]
    rows.append(("s", 1, f"the {long.replace('m', 'rn', 1)} and m1ll10ns of AB-12 and x12y3456"))
    df = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {(r.doc_id, r.noise, r.repaired) for r in pages.found(df).collect()}
    assert {("s", "ocr", long), ("s", "ocr", "millions")} <= got and not [r for r in got if r[2].startswith(("x", "AB"))]
    assert pages.restorations("l" + "1" * 12) and len(pages.restorations("l" + "1" * 12)) == 2
