"""Retrieval: BM25, vector top-k, diversity, channel merging and triple ranking, for sets of queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import bounded, materialize
from lattica.functions import text as T

K1, B = 1.5, 0.75


def term_arrays(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, terms): the length of each document in tokens and its distinct tokens as (token, tf).

    The tokens of a document are sorted and counted inside its row, so nothing is shuffled.
    """
    w = docs.select(F.col(key).alias("key"), F.sort_array(T.words(F.col(text))).alias("w")).withColumn("dl", F.coalesce(F.size("w"), F.lit(0)))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("dl") - 1, F.lit(0))), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    w = w.withColumn("at", starts)
    terms = F.transform("at", lambda s, j: F.struct(F.get("w", s).alias("token"), (F.coalesce(F.get("at", j + 1), F.col("dl")) - s).alias("tf")))
    return w.select("key", "dl", terms.alias("terms"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, dl, tf): term frequencies of each document; dl is its length in tokens."""
    # the outer form, for which no filter on the array, and with it a second tokenisation, is inferred
    e = term_arrays(docs, key, text).select("key", "dl", F.explode_outer("terms").alias("t"))
    return e.select("t.token", "key", "dl", "t.tf").filter("token IS NOT NULL")


def index_stats(post: DataFrame) -> DataFrame:
    """(token, df): the number of documents with each token."""
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: the number of documents with tokens, and their mean length."""
    return docs.select(F.size(T.words(F.col(text))).alias("dl")).filter("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25_scores(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, question: str) -> DataFrame:
    """(query, key, score): documents that share a token with the query; a query's token counts once.

    Every document is tokenised once and stays one row, of which only the tokens of the queries are kept (their number
    is counted before they are sent to the tasks, beyond it they are joined). So the scores of a document are summed
    where it lies, and only they are shuffled.
    """
    q = materialize(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(T.words(F.col(question)))).alias("token")).distinct(), "queries")
    wanted = bounded(q.select("token").distinct().unionByName(q.sparkSession.range(1).select(F.lit("").alias("token"))))
    rows = term_arrays(docs, key, text)
    # a row without a token for every document, so that the size of the corpus is read from the same pass
    post = rows.select("key", "dl", F.explode_outer(F.concat(F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("tf"))), "terms")).alias("t")).select("key", "dl", "t.token", "t.tf")
    post = materialize(post.join(wanted, "token", "left_semi"), "postings")
    size = post.filter("token = '' AND dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    post = post.filter("token <> ''")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = q.join(index_stats(post), "token").join(F.broadcast(size)).select("query", "token", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(bounded(terms), "token").groupBy("query", "key").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scores: DataFrame, k: int, group: str = "query", score: str = "score", key: str = "key") -> DataFrame:
    """The k best rows of each group with their rank; ties go to the smaller key."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


BM25_BLOCK = 2048
BM25_POSTINGS = 1 << 20
VOCABULARY = 200_000
HELD_BYTES = 256 << 20
COMMON = 1 / 256


def _grouped(ids: np.ndarray, at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings in the order of their token: the tokens, how many postings each has, and the postings."""
    order = np.lexsort((at, ids))
    found, n = np.unique(ids, return_counts=True)
    return found.astype(np.int64), n.astype(np.int32), at[order].astype(np.int32), *(x[order] for x in more)


def _document_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, dl, id, tf), where each document begins with a row of id -1, packed into rows of whole documents."""
    held: list[pd.DataFrame] = []

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tf = pdf.id.to_numpy(np.int64), pdf.tf.to_numpy(np.int32)
        head, at = ids < 0, np.cumsum(ids < 0) - 1
        found, n, at, tf = _grouped(ids[~head], at[~head], tf[~head])
        dl = pdf.dl.to_numpy(np.int32)[head]
        return pd.DataFrame({"keys": [pdf.key[head].tolist()], "dl": [dl.tobytes()], "ids": [found.tobytes()], "n": [n.tobytes()], "at": [at.tobytes()], "tf": [tf.tobytes()]})

    def cut(last: bool) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(held, ignore_index=True)
        heads = np.append(np.flatnonzero(pdf.id.to_numpy() < 0), len(pdf))
        a = 0
        while a < len(heads) - 1:
            b = min(a + BM25_BLOCK, max(a + 1, int(np.searchsorted(heads, heads[a] + BM25_POSTINGS, side="right")) - 1))
            if b >= len(heads) - 1:
                if not last:
                    break
                b = len(heads) - 1
            yield packed(pdf.iloc[heads[a] : heads[b]])
            a = b
        held[:] = [pdf.iloc[heads[a] :]] if a < len(heads) - 1 else []

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) > BM25_POSTINGS // 4:
            yield from cut(False)
    if held:
        yield from cut(True)


def _block_scores(d: pd.Series, q: pd.Series, avgdl: float) -> np.ndarray:
    """BM25 of every query of a block (rows) in every document of a block (columns); 0 where they share no token."""
    ints = lambda raw, kind=np.int32: np.frombuffer(raw, kind)
    dl, tf, d_at, q_at = ints(d.dl), ints(d.tf).astype(float), ints(d["at"]), ints(q.q_at)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[d_at] / avgdl))
    _, di, qi = np.intersect1d(ints(d.ids, np.int64), ints(q.q_ids, np.int64), assume_unique=True, return_indices=True)
    idf = ints(q.q_idf, np.float64)[qi]
    dn, qn = ints(d.n).astype(np.int64), ints(q.q_n).astype(np.int64)
    d_to, q_to = np.cumsum(dn)[di], np.cumsum(qn)[qi]
    d_from, q_from = d_to - dn[di], q_to - qn[qi]
    shape = (len(q.queries), len(dl))
    # tokens that many of the pairs share are a product of two matrices, each of the others is added where it is
    common = (d_to - d_from) * (q_to - q_from) > COMMON * shape[0] * shape[1]
    some = np.flatnonzero(common)
    left, right = np.zeros((shape[0], len(some))), np.zeros((len(some), shape[1]))
    for j, t in enumerate(some):
        left[q_at[q_from[t] : q_to[t]], j] = idf[t]
        right[j, d_at[d_from[t] : d_to[t]]] = part[d_from[t] : d_to[t]]
    s = left @ right
    for t in np.flatnonzero(~common):
        s[np.ix_(q_at[q_from[t] : q_to[t]], d_at[d_from[t] : d_to[t]])] += idf[t] * part[d_from[t] : d_to[t]]
    return s


class Leaders:
    """The k best (score, key) of each query of a block over the blocks of documents seen so far; ties go to the smaller key."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k, self.waiting = queries, k, 0
        self.least = np.zeros(len(queries))
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, s: np.ndarray, keys: np.ndarray) -> None:
        floor = self.least
        if not self.parts and s.shape[1] > self.k:
            floor = np.partition(s, -self.k, axis=1)[:, -self.k] - 1e-6
        # a score is above 0 where a token is shared, and may be rounded up
        row, col = np.nonzero(s >= np.maximum(floor, np.finfo(float).tiny)[:, None])
        self.parts.append((row, np.round(s[row, col], 6), keys[col]))
        self.waiting += len(row)
        if len(self.parts) == 1 or self.waiting > 2 * self.k * len(self.queries):
            self.settle()

    def settle(self) -> None:
        row, score, key = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, -score, row))
        row, score, key = row[order], score[order], key[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.least[row[last]] = score[last] - 1e-6
        keep = nth < self.k
        self.parts, self.waiting = [(row[keep], score[keep], key[keep])], 0

    def rows(self) -> pd.DataFrame:
        self.settle()
        row, score, key = self.parts[0]
        return pd.DataFrame({"query": self.queries[row], "key": key, "score": score})


def bm25_top_k(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, question: str, k: int) -> DataFrame:
    """(query, key, score, rank): the k best rows of bm25_scores for each query, exact, for query sets that grow with the documents.

    Nearly every pair of a query and a document shares some token, so pairs are never rows: documents are tokenised once
    and packed with their tokens that any query has, queries likewise, and each block of queries meets each block of
    documents once. A task keeps the k best of each query of its blocks, and only these are shuffled. Keys are unique.
    """
    spark = docs.sparkSession
    q = materialize(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(T.words(F.col(question)))).alias("token")).distinct(), "queries")
    ids = materialize(q.select("token").distinct().withColumn("id", F.monotonically_increasing_id()), "tokens")
    few = ids.limit(VOCABULARY + 1).count() <= VOCABULARY
    wanted = ids.unionByName(spark.range(1).select(F.lit("").alias("token"), F.lit(-1).cast("long").alias("id")))
    rows = term_arrays(docs, key, text)
    post = rows.select("key", "dl", F.explode_outer(F.concat(F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("tf"))), F.coalesce("terms", F.array()))).alias("t")).select("key", "dl", "t.token", "t.tf")
    post = post.join(F.broadcast(wanted) if few else wanted, "token").select("key", "dl", "id", "tf")
    if not few:
        post = post.repartition("key").sortWithinPartitions("key", "id")
    kinds = dict(post.dtypes) | {"query": dict(q.dtypes)["query"]}
    blocks = materialize(post.mapInPandas(_document_blocks, f"keys array<{kinds['key']}>, dl binary, ids binary, n binary, at binary, tf binary"), "postings")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dl, found, n in zip(pdf.dl, pdf.ids, pdf.n):
                dl = np.frombuffer(dl, np.int32)
                yield pd.DataFrame({"id": np.r_[-1, np.frombuffer(found, np.int64)], "df": np.r_[(dl > 0).sum(), np.frombuffer(n, np.int32)].astype(np.int64), "all": np.r_[dl.sum(dtype=np.int64), np.zeros(len(found) // 8, np.int64)]})

    df = materialize(blocks.select("dl", "ids", "n").mapInPandas(counts, "id long, df long, all long").groupBy("id").agg(F.sum("df").alias("df"), F.sum("all").alias("all")), "counts")
    size = df.filter("id = -1 AND df > 0").select(F.col("df").alias("n"), (F.col("all") / F.col("df")).alias("avgdl"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = q.join(ids, "token").join(df.select("id", "df"), "id").crossJoin(F.broadcast(size)).groupBy("query", "avgdl").agg(F.collect_list(F.struct("id", idf.alias("idf"))).alias("t"))

    def query_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BM25_BLOCK):
                part = pdf.iloc[a : a + BM25_BLOCK]
                at = np.repeat(np.arange(len(part)), part.t.map(len))
                every = [x for t in part.t for x in t]
                found, n, at, idf = _grouped(np.array([x["id"] for x in every], np.int64), at, np.array([x["idf"] for x in every]))
                each = idf[np.cumsum(n) - n]
                yield pd.DataFrame({"queries": [part["query"].tolist()], "q_ids": [found.tobytes()], "q_n": [n.tobytes()], "q_at": [at.tobytes()], "q_idf": [each.tobytes()], "avgdl": [part.avgdl.iloc[0]]})

    if terms.limit(BM25_BLOCK * 64 + 1).count() <= BM25_BLOCK * 64:
        terms = terms.coalesce(1)
    packed = materialize(terms.mapInPandas(query_blocks, f"queries array<{kinds['query']}>, q_ids binary, q_n binary, q_at binary, q_idf binary, avgdl double").withColumn("block", F.monotonically_increasing_id()), "blocks")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Leaders] = {}
        for pdf in batches:
            for _, r in pdf.iterrows():
                own = held.get(r.block)
                if own is None:
                    own = Leaders(np.asarray(r.queries), k)
                    # beyond what a task may hold, the leaders of one block of documents are given at once
                    if (len(held) + 1) * BM25_BLOCK * k * 3 * 24 <= HELD_BYTES:
                        held[r.block] = own
                own.add(_block_scores(r, r, r.avgdl), np.asarray(r["keys"]))
                if r.block not in held:
                    yield own.rows()
        for own in held.values():
            yield own.rows()

    return top_k(blocks.crossJoin(bounded(packed, 64)).mapInPandas(best, f"query {kinds['query']}, key {kinds['key']}, score double"), k)


def mmr(pool: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Diverse choice from (query, key, score, tokens): the next row maximises lam * score / best less
    (1 - lam) * its largest Jaccard overlap with the rows chosen. The pool of a query is a top-k, so it is small."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "key"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in pdf.tokens]
        best = pdf.score.iloc[0] or 1.0
        taken, left, out = [], list(range(len(pdf))), []
        while left and len(taken) < k:
            def gain(i: int) -> tuple[float, int]:
                over = max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in taken), default=0.0)
                return (round(lam * pdf.score.iloc[i] / best - (1 - lam) * over, 9), -i)

            pick = max(left, key=gain)
            left.remove(pick)
            taken.append(pick)
            out.append((pdf["query"].iloc[pick], pdf.key.iloc[pick], len(taken)))
        return pd.DataFrame(out, columns=["query", "key", "rank"])

    kinds = dict(pool.dtypes)
    return pool.groupBy("query").applyInPandas(choose, f"query {kinds['query']}, key {kinds['key']}, rank int")


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors as doubles of length one; null and zero vectors are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), v.alias("v")).withColumn("norm", norm).filter("norm > 0").select("key", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


QUERY_BLOCK = 512


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank): the k nearest of all vectors for each query vector, exact, by inner product.

    Queries are packed into rows of QUERY_BLOCK vectors each, vectors into rows as large; each block of queries meets each
    block of vectors once, as a product of two matrices, and gives its k best. So the driver holds nothing, no task more
    than two blocks, and a larger set of queries is more blocks of one join, not more scans.
    """

    def packed(df: DataFrame, name: str, per: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), per):
                    part = pdf.iloc[a : a + per]
                    yield pd.DataFrame({f"{name}_keys": [part["key"].tolist()], f"{name}_m": [np.vstack(part.v.to_numpy()).ravel().tolist()]})

        return df.select("key", "v").mapInPandas(run, f"{name}_keys array<long>, {name}_m array<double>")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qk, qm, vk, vm in zip(pdf.q_keys, pdf.q_m, pdf.v_keys, pdf.v_m):
                names, keys = np.asarray(qk), np.asarray(vk)
                s = np.round(np.asarray(qm).reshape(len(names), -1) @ np.asarray(vm).reshape(len(keys), -1).T, 6)
                keep = [np.lexsort((keys, -row))[:k] for row in s]
                n = [len(x) for x in keep]
                at = np.concatenate(keep)
                yield pd.DataFrame({"query": np.repeat(names, n), "key": keys[at], "score": s[np.repeat(np.arange(len(names)), n), at]})

    # blocks against blocks: each row on either side stands for up to QUERY_BLOCK vectors
    q = materialize(packed(queries.coalesce(1) if queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK else queries, "q", QUERY_BLOCK), "blocks")
    pairs = packed(vectors, "v", QUERY_BLOCK).crossJoin(bounded(q, 64))
    return top_k(pairs.mapInPandas(best, "query long, key long, score double"), k)


RECALL = 0.95


def bucket_plan(n: int, tau: float, recall: float = RECALL) -> tuple[int, int]:
    """Planes and bands of random-plane buckets for n vectors: about 32 unrelated vectors share a bucket of a band, and a
    pair of cosine tau meets in one of the bands with probability `recall` at least."""
    planes = max(1, int(np.ceil(np.log2(max(2, n) / 32))))
    meet = (1 - np.arccos(tau) / np.pi) ** planes
    return planes, int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))


def exact_copies(vectors: DataFrame) -> DataFrame:
    """(key, v, representative): rows with the smallest key among the rows of the same vector."""
    first = vectors.groupBy("v").agg(F.min("key").alias("representative"))
    return vectors.join(first, "v")


def similar_pairs(vectors: DataFrame, tau: float, seed: int = 7) -> DataFrame:
    """(a, b, score): pairs of different vectors with cosine of at least tau, met in random-plane buckets and checked exactly.

    Each of the bands has a key of the signs of some random projections; their numbers follow the number of vectors
    (bucket_plan). Exact copies are one vertex, their smallest key: exact_copies tells the membership.
    """
    first = materialize(vectors.groupBy("v").agg(F.min("key").alias("key")).select("key", "v"), "vectors")
    dim = first.select(F.size("v")).limit(1).collect()
    if not dim:
        return vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    planes, bands = bucket_plan(first.count(), tau)
    rng = np.random.default_rng(seed)
    normals = rng.normal(size=(dim[0][0], planes * bands))
    held = vectors.sparkSession.sparkContext.broadcast(normals)

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        signs = (np.vstack(v.to_numpy()) @ held.value > 0).reshape(len(v), bands, planes)
        code = (signs * (1 << np.arange(planes))).sum(axis=2) + (np.arange(bands) << planes)
        return pd.Series(list(code))

    b = materialize(first.withColumn("k", keys("v")), "buckets")
    left = b.select(F.col("key").alias("a"), F.explode("k").alias("k"))
    right = b.select(F.col("key").alias("b"), F.explode("k").alias("k"))
    cand = left.join(right, "k").filter("a < b").select("a", "b").distinct()
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    full = cand.join(b.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(b.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    return full.select("a", "b", F.round(dot, 6).alias("score")).filter(F.col("score") >= tau)


def capped(ranked: DataFrame, group: str, per: str, cap: int, rank: str = "rank") -> DataFrame:
    """Rows beyond `cap` of one document keep their order but move behind the others; adds new_rank."""
    w = Window.partitionBy(group, per).orderBy(rank)
    over = ranked.withColumn("over", (F.row_number().over(w) > cap).cast("int"))
    return over.withColumn("new_rank", F.row_number().over(Window.partitionBy(group).orderBy("over", rank))).drop("over")


def merged(channels: list[DataFrame], limit: int) -> DataFrame:
    """(query, key, rank): channels in their order, each row once, cut at `limit`; channels are (query, key, rank)."""
    every = None
    for i, c in enumerate(channels):
        c = c.select("query", "key", F.lit(i).alias("channel"), F.col("rank").alias("r"))
        every = c if every is None else every.unionByName(c)
    first = every.groupBy("query", "key").agg(F.min(F.struct("channel", "r")).alias("p"))
    w = Window.partitionBy("query").orderBy("p.channel", "p.r", "key")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query", "key", "rank")


def ranked_triples(triples: DataFrame, queries: DataFrame, w_text: float = 0.7, w_mention: float = 0.3) -> DataFrame:
    """(query, triple_id, score): share of the query's search words in the triple, and its mentions against the most.

    Only triples with a word in common are scored; system links count half.
    """
    t = triples.select(
        "triple_id",
        T.search_words(F.concat_ws(" ", "subject", F.regexp_replace("predicate", "_", " "), "object")).alias("tw"),
        T.mention_count(F.col("relationship_properties")["mention_count"]).alias("m"),
        F.coalesce(F.col("relationship_properties")["extraction_method"] == "system_linking", F.lit(False)).alias("link"),
    )
    q = queries.select("query", F.explode("words").alias("w"), F.size("words").alias("n"))
    # the words of the queries go to the triples where their number is bounded, so a word in a third of all triples
    # moves none of them, and the matches of a triple are counted where it lies
    hit = t.select("triple_id", "m", "link", F.explode("tw").alias("w")).join(bounded(q), "w").groupBy("query", "n", "triple_id", "m", "link").agg(F.count(F.lit(1)).alias("c"))
    hit = materialize(hit, "hits")
    hit = hit.join(hit.groupBy("query").agg(F.max("m").alias("most")), "query")
    mention = F.when(F.col("most") <= 1, F.lit(1.0)).otherwise(F.log1p("m") / F.log1p("most"))
    score = (w_text * F.col("c") / F.col("n") + w_mention * mention) * F.when(F.col("link"), 0.5).otherwise(1.0)
    return hit.withColumn("score", F.round(score, 6)).select("query", "triple_id", "score")


@dataclass(frozen=True)
class Preset:
    """Which channels a named strategy reads."""

    nodes: bool = True
    triples: bool = True
    neighbors: bool = True
    subgraph: bool = True
    path: bool = True
    text: bool = False
    hops: int = 1


PRESETS = {
    "default": Preset(),
    "hybrid": Preset(text=True),
    "text_only": Preset(False, False, False, False, False, True),
    "no_retrieval": Preset(False, False, False, False, False, False),
    "text_plus_triples": Preset(neighbors=False, subgraph=False, path=False),
    "neighbors_focus": Preset(nodes=False, subgraph=False, path=False),
    "subgraph_2hop": Preset(nodes=False, neighbors=False, path=False, hops=2),
    "shortest_path": Preset(nodes=False, neighbors=False, subgraph=False),
}

