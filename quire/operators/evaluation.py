"""Error rates of transcriptions, their summaries and intervals."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.functions import text as T


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences; one row of the table at a time, vectorised along it."""
    if not a or not b:
        return len(a) + len(b)
    number = {x: i for i, x in enumerate({*a, *b})}
    x, y = np.array([number[v] for v in a]), np.array([number[v] for v in b])
    row, steps = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, v in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - steps) + steps  # insertions
    return int(row[-1])


MAX_CELLS = 25_000_000  # of an alignment's table; longer pairs get their distance alone


def _table(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole table of edit distances between beginnings of a and b, with both as numbers."""
    number = {v: i for i, v in enumerate({*a, *b})}
    x, y = np.array([number[v] for v in a], np.int64), np.array([number[v] for v in b], np.int64)
    steps = np.arange(len(y) + 1, dtype=np.int32)
    rows = np.empty((len(x) + 1, len(y) + 1), np.int32)
    rows[0] = steps
    for i, v in enumerate(x, 1):
        rows[i, 0] = i
        rows[i, 1:] = np.minimum(rows[i - 1, 1:] + 1, rows[i - 1, :-1] + (y != v))
        rows[i] = np.minimum.accumulate(rows[i] - steps) + steps
    return rows, x, y


def _path(a: list, b: list) -> Iterator[tuple[int, int, str]]:
    """The steps of a shortest edit from the end to the beginning: where each begins in a and b, and what it is. Of equally good
    ones a match or substitution goes before a deletion and that before an insertion."""
    rows, x, y = _table(a, b)
    i, j = len(a), len(b)
    while i or j:
        if i and j and rows[i, j] == rows[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            yield i, j, "match" if x[i] == y[j] else "substitution"
        elif i and rows[i, j] == rows[i - 1, j] + 1:
            i -= 1
            yield i, j, "deletion"
        else:
            j -= 1
            yield i, j, "insertion"


def breakdown(a: list, b: list) -> tuple[int, int | None, int | None, int | None]:
    """Edit distance of two sequences and its substitutions, deletions and insertions (null for pairs that are too long)."""
    if (len(a) + 1) * (len(b) + 1) > MAX_CELLS:
        return distance(a, b), None, None, None
    kinds = [kind for _, _, kind in _path(a, b)]
    parts = [kinds.count(k) for k in ("substitution", "deletion", "insertion")]
    return sum(parts), *parts


def projected(a: list, b: list) -> list[int]:
    """For every offset of a, its end included, the offset of b that a shortest edit puts beside it; later ones never before."""
    out = [0] * (len(a) + 1)
    out[len(a)] = len(b)
    for i, j, kind in _path(a, b):
        if kind != "insertion":
            out[i] = j
    return out


def error_breakdown(pairs: DataFrame, words: bool = False) -> DataFrame:
    """pairs (page_id, reference, hypothesis) with distance, substitutions, deletions, insertions and n, the length of the
    reference, in characters or words of normalised texts. Empty texts: all is deleted or inserted."""
    fields = ("distance", "substitutions", "deletions", "insertions", "n")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            split = [(r.split(), h.split()) if words else (list(r), list(h)) for r, h in zip(rows["_r"], rows["_h"], strict=True)]
            found = [(*breakdown(r, h), len(r)) for r, h in split]
            yield rows.drop(columns=["_r", "_h"]).assign(**{f: pd.array([x[k] for x in found], "Int64") for k, f in enumerate(fields)})

    both = pairs.withColumns({"_r": T.normalized_for_eval(F.col("reference")), "_h": T.normalized_for_eval(F.col("hypothesis"))})
    return both.mapInPandas(count, StructType([*pairs.schema.fields, *[StructField(f, LongType()) for f in fields]]))


def projected_spans(spans: DataFrame) -> DataFrame:
    """spans (reference, hypothesis, start, end) with hyp_start and hyp_end, where the span lies in the other reading."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            known: dict[tuple[str, str], list[int]] = {}
            found = []
            for r, h, a, b in zip(rows["reference"], rows["hypothesis"], rows["start"], rows["end"], strict=True):
                at = known.get((r, h))
                if at is None:
                    known.clear()  # rows of a pair stand together; a pair's offsets are held once
                    at = known[r, h] = projected(list(r), list(h))
                found.append((at[min(a, len(r))], at[min(b, len(r))]))
            yield rows.assign(hyp_start=[a for a, _ in found], hyp_end=[b for _, b in found])

    return spans.mapInPandas(place, StructType([*spans.schema.fields, StructField("hyp_start", LongType()), StructField("hyp_end", LongType())]))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character errors by the reference's length after normalising: 0 for two empty texts, infinite for an empty reference."""
    a, b = T.normalized_for_eval(reference), T.normalized_for_eval(hypothesis)
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a)).when(F.length(b) > 0, F.lit(float("inf"))).otherwise(0.0)


def word_errors(pairs: DataFrame) -> DataFrame:
    """pairs (page_id, reference, hypothesis) with word_distance and reference_words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            split = [(r.split(), h.split()) for r, h in zip(rows["_r"], rows["_h"], strict=True)]
            yield rows.drop(columns=["_r", "_h"]).assign(word_distance=[distance(r, h) for r, h in split], reference_words=[len(r) for r, _ in split])

    both = pairs.withColumns({"_r": T.normalized_for_eval(F.col("reference")), "_h": T.normalized_for_eval(F.col("hypothesis"))})
    schema = StructType([*pairs.schema.fields, StructField("word_distance", LongType()), StructField("reference_words", LongType())])
    return both.mapInPandas(count, schema)


def corpus_report(pairs: DataFrame) -> DataFrame:
    """Pages, micro and macro rates of characters: all errors by all characters, and the mean of the pages' finite rates."""
    a, b = T.normalized_for_eval(F.col("reference")), T.normalized_for_eval(F.col("hypothesis"))
    page = pairs.select(F.levenshtein(a, b).alias("d"), F.length(a).alias("n"), cer(F.col("reference"), F.col("hypothesis")).alias("rate"))
    finite = F.when(F.col("rate") < float("inf"), F.col("rate"))
    return page.agg(F.count("*").alias("pages"), (F.sum("d") / F.sum("n")).alias("micro_cer"), F.round(F.avg(finite), 9).alias("macro_cer"), F.max("rate").alias("worst_cer"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1; an empty denominator gives 1."""
    rate = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


DRAWS = 1 << 20  # held at once


def _drawn(n: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).randrange(n) draws for resamples of n items, some resamples (rows) at a time: of a stream of 32-bit
    numbers the first bits of each, where they are less than n."""
    kind, (*key, at), _ = random.Random(seed).getstate()
    stream = np.random.MT19937()
    stream.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint64), "pos": at}}
    bits, left = n.bit_length(), np.empty(0, np.int64)
    if bits > 32:
        raise ValueError("more than 2^32 rows in a group")
    rows = max(1, DRAWS // n)
    for begin in range(0, resamples, rows):
        many = min(rows, resamples - begin)
        parts, held = [left], len(left)
        while held < many * n:
            drawn = (stream.random_raw(min(DRAWS, 2 * (many * n - held) + 64)) >> np.uint64(32 - bits)).astype(np.int64)
            parts.append(drawn[drawn < n])
            held += len(parts[-1])
        every = np.concatenate(parts)
        left = every[many * n :]
        yield every[: many * n].reshape(many, n)


def bootstrap_interval(samples: DataFrame, group: str, value: str, order: str, weight: str | None = None, resamples: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """group, estimate, low, high: percentile intervals by resampling each group's rows, in order, with replacement. The estimate
    is the mean of value, or with a weight the sum of values by the sum of weights (a micro rate). Groups of fewer than two rows
    have no interval; a null group is one of its own.

    A group is a set of pages or queries under evaluation and is held by one task, but not its draws: they are one stream of the
    seed, item by item, so that groups of equal size draw alike, and are made a few resamples at a time."""

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x = rows[value].to_numpy(float)
        w = rows[weight].to_numpy(float) if weight else np.ones(len(x))
        low = high = None
        if len(x) >= 2:
            found = np.sort(np.concatenate([x[at].sum(1) / (w[at].sum(1) if weight else len(x)) for at in _drawn(len(x), max(1, resamples), seed)]))
            tail = (1 - confidence) / 2
            low, high = found[math.floor(tail * (len(found) - 1))], found[math.ceil((1 - tail) * (len(found) - 1))]
        return pd.DataFrame({group: [rows[group].iloc[0]], "estimate": [x.sum() / w.sum()], "low": [low], "high": [high]})

    return samples.groupBy(group).applyInPandas(interval, f"{group} {dict(samples.dtypes)[group]}, estimate double, low double, high double")


def clustered_interval(scores: DataFrame, metric: str, cluster: str, value: str, order: str, baseline: str | None = None, **how: object) -> DataFrame:
    """metric, estimate, low, high of the mean of value (or of its lead over a baseline), resampling clusters of rows as a whole:
    queries of one target aren't independent. Clusters stand in the order of their first row."""
    gain = F.col(value) - F.col(baseline) if baseline else F.col(value)
    per = scores.groupBy(metric, cluster).agg(F.sum(gain).alias("_sum"), F.count("*").cast("double").alias("_n"), F.min(order).alias("_order"))
    return bootstrap_interval(per, metric, "_sum", "_order", weight="_n", **how)


def full_corpus_report(pairs: DataFrame, **how: object) -> DataFrame:
    """unit (character, word), pages, micro and macro rate with their intervals, and substitutions, deletions and insertions
    (null unless all pages have them). Pages without reference have no finite rate and no part in the macro rate."""
    parts = [error_breakdown(pairs, words).select(F.lit(unit).alias("unit"), "page_id", "distance", "substitutions", "deletions", "insertions", "n") for unit, words in (("character", False), ("word", True))]
    every = parts[0].unionAll(parts[1])
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    sums = every.groupBy("unit").agg(F.count("*").alias("pages"), whole("substitutions"), whole("deletions"), whole("insertions"))
    micro = bootstrap_interval(every, "unit", "distance", "page_id", weight="n", **how).selectExpr("unit", "estimate AS micro", "low AS micro_low", "high AS micro_high")
    rates = every.filter((F.col("n") > 0) | (F.col("distance") == 0)).withColumn("_rate", F.when(F.col("n") > 0, F.col("distance") / F.col("n")).otherwise(0.0))
    macro = bootstrap_interval(rates, "unit", "_rate", "page_id", **how).selectExpr("unit", "estimate AS macro", "low AS macro_low", "high AS macro_high")
    return sums.join(micro, "unit").join(macro, "unit")


def worst_pages(pairs: DataFrame, most: int = 5) -> DataFrame:
    """page_id, cer: the pages of the highest character error rate, ties by page_id."""
    return pairs.select("page_id", cer(F.col("reference"), F.col("hypothesis")).alias("cer")).orderBy(F.desc("cer"), "page_id").limit(most)


def greedy_matches(predicted: DataFrame, gold: DataFrame, page: str = "page") -> DataFrame:
    """page, tp, fp, fn: predicted spans (page, kind, start, end) against gold ones; in the order of start each takes the first
    free gold span of its kind that it overlaps. A page's spans are held together."""
    every = predicted.select(page, "kind", "start", "end", F.lit(0).alias("_gold")).unionByName(gold.select(page, "kind", "start", "end", F.lit(1).alias("_gold")))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end", "kind"], kind="stable")
        gold = list(rows[rows["_gold"] == 1][["kind", "start", "end"]].itertuples(index=False, name=None))
        free, tp = [True] * len(gold), 0
        ours = rows[rows["_gold"] == 0]
        for kind, a, b in ours[["kind", "start", "end"]].itertuples(index=False, name=None):
            k = next((k for k, (g, x, y) in enumerate(gold) if free[k] and g == kind and a < y and b > x), None)
            if k is not None:
                free[k] = False
                tp += 1
        return pd.DataFrame({page: [rows[page].iloc[0]], "tp": [tp], "fp": [len(ours) - tp], "fn": [len(gold) - tp]})

    return every.groupBy(page).applyInPandas(match, f"{page} {dict(predicted.dtypes)[page]}, tp long, fp long, fn long")


def gold_spans(texts: DataFrame, entities: DataFrame, page: str = "page") -> DataFrame:
    """page, kind, surface, start, end of the n-th occurrence (from 1) of each entity's surface; entities that don't occur that
    often have none. entities: page, surface, kind, occurrence."""
    both = entities.join(texts, page)
    times = (F.length("text") - F.length(F.replace("text", F.col("surface"), F.lit("")))) / F.nullif(F.length("surface"), F.lit(0))
    found, before = both.filter(times >= F.col("occurrence")), F.expr("substring_index(text, surface, occurrence)")
    start = F.length(before)
    return found.select(page, "kind", "surface", start.alias("start"), (start + F.length("surface")).alias("end"))
