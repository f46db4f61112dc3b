from lattica.llm import canonical

VOCAB = [
    (1, "PRODUCES", "produce", ["makes", "yields"]),
    (2, "LOCATED_IN", "situato in", ["based in"]),
    (3, "EMITS", "emette", ["gives off"]),
    (4, "DONATES_SURPLUS_TO", "dona eccedenze a", ["gives leftovers to"]),
    (5, "MEASURED_AS", "misurato come", None),
]
CASES = {
    "produces": "PRODUCES", "Producing": "PRODUCES", "is producing": "PRODUCES", "PRODUCE": "PRODUCES", " ​prodcues;": "PRODUCES", "Based-In": "LOCATED_IN", "locatedIn": "LOCATED_IN", "lcoate_din": "LOCATED_IN",
    "ＬＯＣＡＴＥＤ_ＩＮ": "LOCATED_IN", "emtis": "EMITS", "EMITS_1": "EMITS", "rel:EMITS": "EMITS", "<EMITS>": "EMITS", "EMITS (llm);": "EMITS", "DONAETS SURPLUE TO": "DONATES_SURPLUS_TO", "was measured as": "MEASURED_AS",
    "teleports": "UNMATCHED", "???": "UNMATCHED", "": "UNMATCHED", "12": "UNMATCHED", "è fratello di": "UNMATCHED", "wears": "UNMATCHED", "x" * 5000: "UNMATCHED",
}


def frames(spark):
    v = spark.createDataFrame(VOCAB, "vocab_id int, predicate string, label_it string, aliases array<string>")
    rows = list(enumerate(CASES)) + [(100, None), (101, "EMITS"), (102, "emtis"), (102, "emtis")]
    t = spark.createDataFrame(rows, "triple_id long, predicate string").selectExpr("*", "'x' AS canonical", "'y' AS value")
    return t, v


def test_cases(spark):
    t, v = frames(spark)
    got = {r.triple_id: r.canonical for r in canonical.found(t, v).collect()}
    assert {k: got[i] for i, k in enumerate(CASES)} == CASES
    assert got[102] == "EMITS" and 100 not in got and 101 not in got
    assert canonical.found(t, v).count() == len(CASES) + 1
    assert canonical.found(t.filter("false"), v).count() == 0
    assert {r.canonical for r in canonical.found(t, v.filter("false")).collect()} == {"UNMATCHED"}
