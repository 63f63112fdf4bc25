"""Toxicity scores by a counterfactually regularised classifier.

A logistic regression over the words, and beginnings of words, that a text holds. It is fitted on labelled texts, and on
the same texts with identity terms swapped for others: a change of score between a text and its swapped form is
penalised, so that neutral mentions of groups don't raise a score. Which words count is decided by a test of their share of toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written

#: Labelled rows that a classifier is fitted on at most, in the order of a hash of doc_id.
MAX_TRAIN = 20_000
MAX_WORDS = 4_000
THRESHOLD = 0.7
STEP = 200  # texts whose words are held at once
IDENTITY_TERMS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "foreigner", "native"), ("immigrants", "citizens", "foreigners", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer", "menschen"), ("femmes", "hommes", "gens"), ("mujeres", "hombres", "gente"),
)
_BREAKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡·•0123456789"})


STEMS = (4, 5, 6)  # letters of the word beginnings that count beside whole words
#: Words whose beginnings don't count: a swap changes the weights of two whole words and nothing else.
WHOLE = frozenset(t for group in IDENTITY_TERMS for t in group)


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(_BREAKS).split())


def features_of(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer ones but identity terms, marked with a *: inflected forms share them."""
    words = words_of(text)
    return words.union(*({w[:k] + "*" for w in words - WHOLE if len(w) > k} for k in STEMS))


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        whole = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        stems = [{f[:-1]: w for f, w in self.weights.items() if f.endswith("*") and len(f) == k + 1} for k in STEMS]
        out = []
        for t in texts:
            words = words_of(t)
            found = [whole[w] for w in words & whole.keys()]
            for k, stem in zip(STEMS, stems, strict=True):
                if stem:
                    found += [stem[x] for x in {w[:k] for w in words - WHOLE if len(w) > k} & stem.keys()]
            out.append(sum(sorted(found)))
        logit = np.array(out, float) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, swap_penalty: float = 5.0, ridge: float = 2e-5) -> Classifier:
    """Fit on labelled (doc_id, text, toxic), which sample() bounds: at most max_train distinct rows go in. Null text is empty; rows without a label
    don't count. Without rows of either label the classifier gives the share of toxic rows (none: 0)."""
    bound = labelled.filter(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    swaps = {t: [x for x in group if x != t] for group in IDENTITY_TERMS for t in group}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), STEP):
                step = b.slice(at, STEP)
                words = [sorted(features_of(t)) for t in step["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), step["toxic"].cast(pa.int32())], names=["words", "toxic"])

    held = written(bound.mapInArrow(bags, "words array<string>, toxic int"), "toxicity-words")
    n, positive = held.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or positive == n:
        return Classifier(bias if n else -40.0, {})
    # words whose share of toxic texts is above or below the rest's beyond chance
    found = held.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    z = (F.col("k") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    found = found.withColumn("z", z).filter((F.col("n") >= 3) & (F.abs("z") >= 5)).orderBy(F.desc(F.abs("z")), "word").limit(max_words)
    chosen = sorted({r["word"] for r in found.collect()} | swaps.keys())
    number = {w: i for i, w in enumerate(chosen)}
    kept = F.array_intersect("words", F.array(*[F.lit(w) for w in chosen])) if len(chosen) < 50 else F.filter("words", lambda w: w.isin(chosen))
    rows = held.select(kept.alias("words"), "toxic").groupBy("words", "toxic").agg(F.count("*").alias("times"))
    if n > max_train:  # doc_ids that repeat in the documents
        rows = rows.orderBy(F.xxhash64("words", "toxic"), "words", "toxic").limit(max_train)
    rows = rows.toPandas()
    docs = [[number[w] for w in ws] for ws in rows["words"]]
    y, times = rows["toxic"].to_numpy(float), rows["times"].to_numpy(float)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = np.array([i for d in docs for i in d], np.int64)
    # a swapped form lacks a term and has another, unless that stands in the text as well; nothing else changes, so each
    # pair adds the square of w_a - w_b, or of w_a, as often as the text occurs
    pairs = [(number[a], number[b], t, b not in ws) for ws, t in zip(map(set, rows["words"]), times, strict=True) for a in sorted(ws & swaps.keys()) for b in swaps[a]]
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    often, new = np.array([p[2] for p in pairs], float) / n, np.array([p[3] for p in pairs], float)
    w, moment, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[-1] = bias
    for step in range(1, 1501):
        logit = np.bincount(row, w[col], len(docs)) + w[-1]
        error = times * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
        grad = np.append(np.bincount(col, error[row], len(chosen)) + ridge * w[:-1], error.sum())
        if len(pairs):
            gap = 2 * swap_penalty * often * (w[a] - new * w[b])
            grad[:-1] += np.bincount(a, gap, len(chosen)) - np.bincount(b, new * gap, len(chosen))
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Classifier(float(w[-1]), {x: float(v) for x, v in zip(chosen, w[:-1], strict=True) if abs(v) > 1e-3})


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, fold: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, text, toxic of up to max_train labelled documents outside the held-out fold. Repeated labels of a doc_id
    count once, toxic if any is; labels without doc_id don't count."""
    from quire.llm.shared import crc_mod

    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # no task sorts more than a little over max_train rows: hashes above the share asked for can't be among the first
    place, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1.2 * max_train / max(chosen.count(), 1)
    chosen = chosen.filter(place < F.lit(int(min(share, 1.0) * (1 << 40)))) if share < 1 and max_train > 1000 else chosen
    chosen = chosen.orderBy(place, "doc_id").limit(max_train)
    # max_train rows of two numbers: small whatever the input
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def score(text: Column, classifier: Classifier) -> Column:
    """The score of a text from 0 to 1; null text counts as empty."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            scores = [classifier.scores(x.slice(at, STEP).to_pylist()) for at in range(0, len(x), STEP)]
            yield pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs with score (double) and predicted (1 if score >= threshold, else 0) added, or put in place of columns so named.

    docs has doc_id and text, labels doc_id and toxic; nothing but text goes into a score. Every row is scored over its
    whole text and kept as it is otherwise: null text counts as empty, rows without doc_id and repeated rows included.
    Empty docs: no rows; empty labels: score 0."""
    classifier = fit(sample(docs, labels, max_train), max_train)
    out = docs.withColumn("score", score(F.col("text"), classifier))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
