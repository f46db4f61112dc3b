import random

import pytest

from lattica.llm import sieve, spans


def brute(docs, w):
    docs = dict(docs)
    seen = {}
    for i, t in docs.items():
        for p in range(len(t or "") - w + 1):
            s = t[p : p + w]
            seen[s] = i if seen.get(s, i) == i else -1
    out = set()
    for i, t in docs.items():
        cur = None
        for p in range(len(t or "") - w + 1):
            if seen[t[p : p + w]] == -1:
                if cur and p <= cur[1]:
                    cur[1] = p + w
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [p, p + w]
        if cur:
            out.add((i, *cur))
    return out


def random_docs(seed, alphabet, n=30):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    pool = [text(rnd.randint(15, 90)) for _ in range(6)]
    docs = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.5 else text(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "a" * 150), (n + 3, "b" + "a" * 120 + "c"), (n + 4, "xy" * 60), docs[0]]


@pytest.mark.parametrize("seed, alphabet", [(1, "abcdefghij klm"), (2, "ab"), (3, "aé€😀 z"), (4, "abcdefgh")])
def test_against_brute_force(spark, seed, alphabet):
    docs = random_docs(seed, alphabet)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS at", "'x' AS anchor").repartition(5)
    got = [tuple(r) for r in spans.found(df, 20, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 20)


def test_a_line_in_every_document(spark):
    line = "this very line stands in each of the documents of the source"
    docs = [(i, f"{i * 7919} head {line} tail {i * 104729}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.found(df, 30, 12).collect()} == brute(docs, 30)


def test_long_text_is_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE_CHARS", 100)
    rnd = random.Random(3)
    t = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(3000))
    docs = [(1, "x" + t), (2, t[500:2500] + "end"), (3, t)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in spans.found(df, 20, 10).collect()} == brute(docs, 20)


def test_shares_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 30 + "bcdefghij" * 5), (2, "zz" + "bcdefghij" * 5), (3, None)], "doc_id long, text string")
    assert spans.found(df.filter("false"), 20, 10).count() == 0
    rows = {r.doc_id: r for r in spans.shares(df, 200).collect()}
    assert rows[3].share == 0 and rows[1].n_chars == 75


def test_a_sketch_too_large_to_send_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BROADCAST_BYTES", 0)
    docs = random_docs(5, "abcdefghij")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in spans.found(df, 20, 10).collect()} == brute(docs, 20)


def test_sketch_loses_no_repeat_and_lets_few_others_pass(monkeypatch):
    import numpy as np

    monkeypatch.setattr(sieve, "BLOCK_LOG2", 10)
    rng = np.random.default_rng(1)
    once = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    twice = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    keys = np.r_[once, twice, twice]
    blocks = sieve.blocks_for(len(keys), spans.CELLS_EACH)
    assert blocks > 50
    # cells of each block, counted up to two
    count = np.zeros((blocks, sieve.DEPTH << sieve.BLOCK_LOG2), np.int64)
    for c in sieve.cells(keys):
        np.add.at(count, (sieve.block_of(keys, blocks), c), 1)
    bits = np.packbits((count >= 2).ravel())
    assert sieve.passes(twice, bits, blocks).all()
    assert sieve.passes(once, bits, blocks).mean() < 0.08


def test_windows_of_short_texts_share_a_frame():
    import numpy as np
    import pandas as pd

    texts = [f"{i:03d} abcdefghij é\U0001f600 {i * i:06d}" for i in range(50)]
    pdf = pd.DataFrame({"text": texts, "at": [[0, 4]] * 50, "n": [[3, 2]] * 50, "h1": [[i, -i] for i in range(50)], "h2": [[7, 8]] * 50, "lo": [[i, i] for i in range(50)], "hi": [[i, 99] for i in range(50)]})
    frames = list(spans.windows_of(pdf, 10))
    assert len(frames) == 1 and len(frames[0]) == 250
    want = []
    for i, t in enumerate(texts):
        sums = spans.prefix_sums(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32))
        for at, n, h1, h2, hi in ((0, 3, i, 7, i), (4, 2, -i, 8, 99)):
            for k in range(n):
                w1, w2 = spans.text_hash(sums, np.array([at + k]), 10)
                want.append((w1[0], w2[0], h1, h2, i, hi, k))
    assert list(frames[0].itertuples(index=False, name=None)) == want
