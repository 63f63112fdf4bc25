"""Similarities and normal forms that Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """1 for equal texts (two empty ones included), 0 if either is empty or nothing matches."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == ch), None)
        if j is not None:
            taken[j] = True
            matched.append(ch)
    if not matched:
        return 0.0
    m = len(matched)
    turned = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro, raised by a common beginning of up to four characters, however low it is."""
    base = jaro(a, b)
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return base + same * weight * (1 - base)


def name_similarity(a: str, b: str) -> float:
    """The greater of Jaro-Winkler and the share of matching blocks, of lower-cased names."""
    a, b = a.lower(), b.lower()
    return max(jaro_winkler(a, b), SequenceMatcher(None, a, b).ratio())


def _pairwise(f: Callable[[str, str], float], a: Column, b: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([f(p or "", q or "") for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler, a, b)


def string_similarity(a: Column, b: Column) -> Column:
    """name_similarity of two columns; null counts as empty."""
    return _pairwise(name_similarity, a, b)


def normal_form(text: Column, form: str = "NFC") -> Column:
    """text in a Unicode normal form; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in x.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)
