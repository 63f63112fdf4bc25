"""Lexical, dense and fused rankings, and how well they retrieve."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import rows as W
from quire.functions import text as T

K1, B = 1.2, 0.75
RRF_K = 60
MAX_BROADCAST_TERMS = 200_000  # of queries; more are joined by a shuffle, and so are their pairs with queries
MAX_PAIRS = 2_000_000  # of queries and terms that a task holds
MAX_SCORES = 1 << 19  # of texts and queries that a task holds at once
BLOCK = 1024  # vectors of a block
DIGITS = 6  # scores that differ less are ties
SIZES = {T.search_terms: T.search_size, T.word_terms: T.word_size}
#: The terms of a text's folded word, for kinds of terms that are found word by word.
WORD_TERMS: dict[Callable[[Column], Column], Callable[[str], list[str]]] = {T.search_terms: W.word_grams, T.word_terms: lambda word: [word]}


def term_counts(texts: DataFrame, terms: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """keys, term and tf of every distinct term of every text."""
    return texts.select(*keys, F.explode(terms(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def bm25(texts: DataFrame, queries: DataFrame, keys: list[str], query_key: str, terms: Callable[[Column], Column] = T.search_terms, limit: int = 10) -> DataFrame:
    """query_key, keys, score, rank: for each query the `limit` texts that share a term with it, best first; ties (to six
    digits) in order of keys.

    The terms of queries are held by every task: a text's score for every query is summed where it lies, and only what may be
    among a task's best of a query goes on. The length of a text counts all of its terms, and the average is over all texts.
    Queries with too many terms for that are joined."""
    if terms in WORD_TERMS:
        # not more than it takes to see that they are too many
        asked = _asked(queries, query_key, WORD_TERMS[terms]).limit(MAX_PAIRS + 1).toArrow()
        if asked.num_rows <= MAX_PAIRS:
            return _bm25_held(texts, asked, queries.schema[query_key], keys, WORD_TERMS[terms], limit)
    return _bm25_joined(texts, queries, keys, query_key, terms, limit)


def _asked(queries: DataFrame, query_key: str, of_word: Callable[[str], list[str]]) -> DataFrame:
    kinds = queries.select(query_key).schema.add("term", "string")
    arrow = to_arrow_schema(kinds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for w in W.word_terms(x) for t in of_word(w)}) for x in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(terms)), list(map(len, terms)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(list(chain.from_iterable(terms)), pa.string())], schema=arrow)

    return queries.select(query_key, "text").mapInArrow(of, kinds).distinct()


class _Held:
    """The terms of queries, numbered, and those of every word met so far."""

    def __init__(self, terms: list[str], of_word: Callable[[str], list[str]]) -> None:
        self.number, self.of_word = {t: k for k, t in enumerate(terms)}, of_word
        self.found = W.Memo(self.of)

    def of(self, word: str) -> tuple[int, tuple[int, ...]]:
        every = self.of_word(word)
        return len(every), tuple(self.number[t] for t in every if t in self.number)

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """How many terms a text has, and how often it has each of the queries'."""
        met = [self.found[w] for w in W.word_terms(text)]
        return sum(n for n, _ in met), Counter(chain.from_iterable(ids for _, ids in met))


def _bm25_held(texts: DataFrame, asked: pa.Table, query_field: object, keys: list[str], of_word: Callable[[str], list[str]], limit: int) -> DataFrame:
    query_key = query_field.name
    names = asked.column(query_key).combine_chunks().dictionary_encode()
    vocabulary = asked.column("term").combine_chunks().dictionary_encode()
    words, queries = vocabulary.dictionary.to_pylist(), names.dictionary
    term_of, query_of = vocabulary.indices.to_numpy(), names.indices.to_numpy()
    in_order = np.argsort(term_of, kind="stable")
    first, query_of = np.searchsorted(term_of[in_order], np.arange(len(words) + 1)), query_of[in_order].astype(np.int32)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, df, n, size = _Held(words, of_word), np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total, tf = held.counts(text)
                n, size = n + 1, size + total
                df[list(tf)] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, size]))], names=["term", "df"])

    sums = texts.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    known = dict(zip(sums.column("term").to_pylist(), sums.column("df").to_pylist(), strict=True))
    n = known.pop(-1, 0)
    mean = known.pop(-2, 0) / max(n, 1)
    df = np.array([known.get(k, 0) for k in range(len(words))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    kinds = texts.select(*keys).schema.add(query_field).add("_score", "double")
    arrow = to_arrow_schema(kinds)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = _Held(words, of_word), np.zeros(len(queries))  # what the task's best so far reach, for each query
        best = np.zeros((0, len(queries)))
        block = max(1, MAX_SCORES // max(1, len(queries)))
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                scores = np.zeros((part.num_rows, len(queries)))
                for row, text in enumerate(part.column(len(keys)).to_pylist()):
                    total, tf = held.counts(text)
                    if not tf:
                        continue
                    at, times = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
                    norm = K1 * (1 - B + B * total / mean) if mean else K1
                    weight = idf[at] * times * (K1 + 1) / (times + norm)
                    many = first[at + 1] - first[at]
                    ends = np.cumsum(many)
                    where = np.arange(ends[-1]) + np.repeat(first[at] - ends + many, many)
                    scores[row] = np.bincount(query_of[where], np.repeat(weight, many), len(queries))
                best = np.concatenate([best, scores])
                if len(best) > limit:
                    best = np.partition(best, len(best) - limit, axis=0)[-limit:]
                    least = best[0]
                # what rounds to the same may be ahead by its keys
                row, query = np.nonzero((scores > 0) & (scores >= least - 10.0**-DIGITS))
                row_of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(row_of) for k in range(len(keys))], queries.take(pa.array(query)), pa.array(scores[row, query])], schema=arrow)

    found = texts.select(*keys, "text").mapInArrow(ranked, kinds).withColumn("score", F.round("_score", DIGITS)).drop("_score")
    place = Window.partitionBy(query_key).orderBy(F.desc("score"), *keys)
    return found.select(query_key, *keys, "score").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def _bm25_joined(texts: DataFrame, queries: DataFrame, keys: list[str], query_key: str, terms: Callable[[Column], Column], limit: int) -> DataFrame:
    """Texts are dealt by their keys once; a text's terms meet those of the queries, are counted and summed where it lies, and
    only each task's best of a query are shuffled again."""
    count = SIZES.get(terms)
    size = count(F.col("text")) if count else F.size(terms(F.col("text")))
    n, mean = texts.agg(F.count("*"), F.avg(size)).first()
    asked = queries.select(query_key, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    small = wanted.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    # a stated number of parts, as texts are small beside their terms; sizes before explode, which would compute them for every term
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    dealt = texts.select(*keys, "text").repartition(parts, *[F.col(k) for k in keys]).select(*keys, size.alias("_len"), terms(F.col("text")).alias("_terms"))
    postings = dealt.select(*keys, "_len", F.explode("_terms").alias("term")).join(held(wanted), "term", "left_semi")
    postings = postings.groupBy(*keys, "_len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").select(query_key, "term", idf.alias("_idf"))
    norm = K1 * (1 - B + B * F.col("_len") / mean) if mean else F.lit(K1)
    score = F.round(F.sum(F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)), DIGITS).alias("score")
    found = postings.join(held(weighted), "term").groupBy(query_key, *keys).agg(score)
    place = Window.partitionBy(query_key).orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def reciprocal_rank_fusion(rankings: list[DataFrame], query_key: str, keys: list[str], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """query_key, keys, score, rank of rankings (query_key, keys, rank) fused: the sum of w / (k + rank). Ties go to what an
    earlier ranking has first."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings) or any(w < 0 for w in weights):
        raise ValueError("one non-negative weight for each ranking")
    every = None
    for i, (r, w) in enumerate(zip(rankings, weights, strict=True)):
        part = r.select(query_key, *keys, F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("_first"), (F.lit(w) / (k + F.col("rank"))).alias("_s"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(query_key, *keys).agg(F.round(F.sum("_s"), 9).alias("score"), F.min("_first").alias("_first"))
    place = Window.partitionBy(query_key).orderBy(F.desc("score"), "_first")
    return fused.withColumn("rank", F.row_number().over(place)).drop("_first")


def _packed(vectors: DataFrame, key: str, vector: str, block: int, name: str) -> DataFrame:
    """Blocks of vectors: ids, and their unit vectors as bytes. Vectors that are null or zero are left out."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x = np.array(rows[vector].tolist(), np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({f"{name}_ids": [rows[key].tolist()], f"{name}_x": [x.tobytes()]})

    usable = vectors.filter(F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)))
    blocks = max(1, -(-usable.count() // block))
    dealt = usable.select(key, vector, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b"))
    return dealt.groupBy("_b").applyInPandas(pack, f"{name}_ids array<long>, {name}_x binary")


def dense_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, limit: int = 10, block: int = BLOCK, itself: bool = False) -> DataFrame:
    """query_id, key, similarity, rank: for each query the `limit` vectors of the greatest cosine, ties (to six digits) by key.

    A stated query set against all vectors, in blocks: a pair of blocks is one matrix product, and only the best of each
    block go on. itself: whether a query may find its own key."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for q_ids, q_x, v_ids, v_x in zip(rows["q_ids"], rows["q_x"], rows["v_ids"], rows["v_x"], strict=True):
                q, v = (np.frombuffer(x).reshape(len(i), -1) for i, x in ((q_ids, q_x), (v_ids, v_x)))
                q_ids, v_ids = np.array(q_ids), np.array(v_ids)
                near = np.round(q @ v.T, DIGITS)
                if not itself:
                    near[q_ids[:, None] == v_ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(v_ids, near.shape), -near))[:, :limit]
                top = np.take_along_axis(near, order, 1)
                r, c = np.nonzero(top > -2)
                yield pd.DataFrame({"query_id": q_ids[r], key: v_ids[order[r, c]], "similarity": top[r, c]})

    pairs = _packed(queries, key, vector, block, "q").crossJoin(_packed(vectors, key, vector, block, "v"))  # of blocks
    found = pairs.mapInPandas(best, f"query_id long, {key} long, similarity double")
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int = 5) -> DataFrame:
    """query_key, recall, precision, reciprocal_rank, ndcg at k of each query with relevant keys. relevant: query_key, key, gain."""
    hits = relevant.join(ranked.select(query_key, key, "rank"), [query_key, key], "left")
    ideal = Window.partitionBy(query_key).orderBy(F.desc("gain"), key)
    hits = hits.withColumn("_ideal", F.row_number().over(ideal))
    inside = F.col("rank") <= k
    dcg = F.sum(F.when(inside, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    best = F.sum(F.when((F.col("_ideal") <= k) & (F.col("gain") > 0), F.col("gain") / F.log2(F.col("_ideal") + 1)).otherwise(0.0))
    good = F.sum(F.when(inside, 1).otherwise(0))
    return hits.groupBy(query_key).agg(
        (good / F.count("*")).alias("recall"),
        (good / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.round(F.when(best > 0, dcg / best).otherwise(0.0), 6).alias("ndcg"),
    )


POOL = 50
MAX_LEXICAL = 5_000  # chunks of a scope that words are ranked in


def fused_hits(lexical: DataFrame | None, dense: DataFrame | None, chunks: DataFrame, query_key: str, key: str, limit: int = 5, k: int = RRF_K, lexical_weight: float = 1.0) -> DataFrame:
    """query_key, key, mode, rank, dense_rank, lexical_rank, lexical_score, similarity, fusion_score: the `limit` best of a lexical
    ranking (score, rank) and a dense one (similarity, rank), each a pool deeper than that.

    Vectors whose chunk is gone from `chunks` are orphans: they go, and the ranks close up. Both rankings: hybrid, by reciprocal
    rank; one alone: dense or lexical, in its own order, without a fusion score. Neither is an error."""
    if lexical is None and dense is None:
        raise ValueError("neither a lexical nor a dense ranking")
    place = lambda *order: Window.partitionBy(query_key).orderBy(*order)
    if dense is not None and lexical is not None:
        known = dense.join(chunks.select(key), key, "left_semi").withColumn("rank", F.row_number().over(place("rank")))
        fused = reciprocal_rank_fusion([known.select(query_key, key, "rank"), lexical.select(query_key, key, "rank")], query_key, [key], k, [1.0, lexical_weight])
        top = fused.filter(F.col("rank") <= limit).withColumnRenamed("score", "fusion_score")
        with_dense = top.join(known.select(query_key, key, F.col("rank").alias("dense_rank"), "similarity"), [query_key, key], "left")
        out = with_dense.join(lexical.select(query_key, key, F.col("rank").alias("lexical_rank"), F.round("score", 4).alias("lexical_score")), [query_key, key], "left")
        return out.select(query_key, key, F.lit("hybrid").alias("mode"), "rank", "dense_rank", "lexical_rank", "lexical_score", "similarity", F.round("fusion_score", 6).alias("fusion_score"))
    none = lambda t: F.lit(None).cast(t)
    if dense is not None:
        return dense.filter(F.col("rank") <= limit).select(query_key, key, F.lit("dense").alias("mode"), "rank", F.col("rank").alias("dense_rank"), none("int").alias("lexical_rank"), none("double").alias("lexical_score"), "similarity", none("double").alias("fusion_score"))
    return lexical.filter(F.col("rank") <= limit).select(query_key, key, F.lit("lexical").alias("mode"), "rank", none("int").alias("dense_rank"), F.col("rank").alias("lexical_rank"), F.round("score", 4).alias("lexical_score"), none("double").alias("similarity"), none("double").alias("fusion_score"))


def retrieve(queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None, vectors: DataFrame | None, query_key: str, key: str, limit: int = 5, fusion: bool = True, pool: int = POOL, max_lexical: int = MAX_LEXICAL, **how: object) -> tuple[DataFrame | None, list[str]]:
    """The fused hits of queries (query_key, text) among chunks (key, text), and notes on what was left out. Vectors: key, vector;
    None where no embedder answers. Without fusion dense alone ranks, and a scope of more than max_lexical chunks isn't ranked
    by words. Nothing to rank by: None."""
    notes: list[str] = []
    depth = max(limit, pool) if fusion else limit
    dense = lexical = None
    if vectors is None or query_vectors is None:
        notes.append("dense ranking unavailable")
    else:
        found = dense_topk(query_vectors.select(F.col(query_key).alias(key), "vector"), vectors, key, "vector", limit=depth, itself=True)
        dense = found.withColumnRenamed("query_id", query_key)
    if fusion:
        if chunks.limit(max_lexical + 1).count() > max_lexical:
            notes.append(f"lexical ranking skipped: more than {max_lexical} chunks in scope")
        else:
            lexical = bm25(chunks, queries, [key], query_key, limit=depth)
    if dense is None and lexical is None:
        return None, notes
    return fused_hits(lexical, dense, chunks, query_key, key, limit, **how), notes
