"""Mentions in texts: sequences of names, anchors, dates, titles, and further places of accepted names.

Spans need offsets, which no built-in expression of a pattern gives, so they are found over Arrow batches of whole texts; what
follows from spans are joins and aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import lexicon as X

# Letters of words, particles, anchors and patterns of dates.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏḀ-ỿ꜠-ꟿꬰ-꭯"
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
WORD = rf"[{LETTERS}][{LETTERS}{MARKS}'’\-]*"
PARTICLES = ("de", "d'", "d’", "du", "des")
PLACES = ("lausanne", "paris", "lyon", "rome", "avignon", "geneve", "genève")
TITLES = ("euesque", "évesque", "evesque", "prince", "chapellain", "pere")
DATES = (r"\b(?:l['’]an|lan|an de grace)\b(?:\s+[A-Za-z0-9IVXLCDM]+){0,4}", r"\b(?:mil|mille)\b(?:\s+[A-Za-z0-9IVXLCDM]+){0,4}", r"\b1[0-9]{3}\b", r"\bM{1,4}[CDLXVI]{2,}\b")
DATE_WORDS = ("an", "l'an", "l’an", "lan", "ans", "apres", "après", "avant")
DATE_PHRASES = ("en l'an", "en l’an")
MONTHS = (
    "janvier", "fevrier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "aout", "septembre", "octobre", "novembre", "decembre", "décembre", "januarii", "februarii", "martii", "aprilis",
    "maii", "junii", "julii", "augusti", "septembris", "octobris", "novembris", "decembris",
)
YEAR = r"\b[0-9]{3,4}\b"
ROMAN_YEAR = r"\bM{1,4}[CDLXVI]{2,}\b"
FORMULA = r"(?i)\b(?:l['’]an|lan|an\s+de\s+grace)\s+(?:mil|mille)\b"
CONFIDENCE = {"place": 0.84, "title": 0.64, "date": 0.72, "work": 0.56, "propagated": 0.5}
TITLE_LINE = 80
TEXTS, MAX_HELD = 256, 200_000  # texts whose words are held at once; names that every task may hold

_TOKEN = re.compile(WORD)
_ROMAN = re.compile("(?i)[IVXLCDM]+")
_BETWEEN = re.compile(r"[\s,.;:()\-–—]*")
_ANCHORED = [re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(words)))})\b", re.I) for words in (PLACES, TITLES)]
_DATE_PATTERNS = [re.compile(p, 0 if k > 1 else re.I) for k, p in enumerate(DATES)]
SPANS = "start int, end int, surface string, kind string, confidence double, method string"


def name_runs(line: str) -> Iterator[tuple[int, int, float]]:
    """Begin, end and confidence of each run of two to five capitalised words, seven tokens at most with particles between; the
    longest from its first word on."""
    words = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(line)]
    is_name = [w[0].isupper() and not _ROMAN.fullmatch(w) for _, _, w in words]
    small = [w.lower() in PARTICLES for _, _, w in words]
    i = 0
    while i < len(words):
        last, names, best = i, 1, None
        while is_name[i] and last + 1 < min(len(words), i + 7) and _BETWEEN.fullmatch(line[words[last][1] : words[last + 1][0]]):
            last += 1
            if small[last]:
                continue
            if not is_name[last]:
                break
            names += 1
            if names <= 5:
                best = last, names
        if best is None:
            i += 1
            continue
        end, names = best
        # a particle counts wherever the run looked, as far as it could go on
        confidence = 0.65 + min(0.15, 0.05 * (names - 2))
        if any(small[i + 1 : last + 1]):
            confidence = min(0.85, confidence + 0.05)
        yield words[i][0], words[end][1], confidence
        i = end + 1


def has_date_anchor(span: str) -> bool:
    """Whether a span holds what only dates have: a formula, a year, a month or a word for years."""
    low = span.lower()
    words = re.findall("[a-zà-ÿ'’]+", low)
    known = {*DATE_WORDS, *MONTHS}
    return bool(re.search(FORMULA, low) or re.search(YEAR, span) or re.search(ROMAN_YEAR, span)) or any(w in known for w in words) or any(p in " ".join(words) for p in DATE_PHRASES)


def spans_of(text: str) -> Iterator[tuple[int, int, str, str, float, str]]:
    """Spans of names, places, titles, dates and a title in the first line, as start, end, surface, kind, confidence, method."""
    at = 0
    for line in text.splitlines():
        for a, b, sure in name_runs(line):
            yield at + a, at + b, text[at + a : at + b], "person", sure, "proper_name_sequence"
        at += len(line) + 1
    for kind, pattern, method in zip(("place", "title"), _ANCHORED, ("toponym_anchor", "title_anchor"), strict=True):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), m.group(), kind, CONFIDENCE[kind], method
    for pattern in _DATE_PATTERNS:
        for m in pattern.finditer(text):
            parts = m.group().split("\n")
            over_lines = len(parts) > 1 and not re.search(FORMULA, m.group().lower()) and not (has_date_anchor(parts[0]) and has_date_anchor(parts[-1]))
            if m.group().strip() and has_date_anchor(m.group().strip()) and not over_lines:
                yield m.start(), m.end(), m.group(), "date", CONFIDENCE["date"], "date_pattern"
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    if first and len(first) <= TITLE_LINE and first.lower().startswith(("la ", "le ", "l'", "l’")) and len(first.split()) >= 2:
        a = text.find(first)
        yield a, a + len(first), first, "work", CONFIDENCE["work"], "first_line_title"


def extracted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans of mentions of every text, not yet deduplicated; null text has none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), *s) for k, t in zip(batch.column(0), batch.column(1), strict=True) for s in spans_of(t.as_py() or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "start", "end", "surface", "kind", "confidence", "method"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {SPANS}")


def best_of_each(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of mentions with the same span and kind the most confident, ties by method; spans that are empty or begin before the text
    go."""
    valid = mentions.filter((F.col("start") >= 0) & (F.col("end") > F.col("start")))
    top = F.max_by(F.struct(*[F.col(c) for c in mentions.columns]), F.struct("confidence", F.col("method")))
    return valid.groupBy(key, "start", "end", "kind").agg(top.alias("_row")).select("_row.*")


def token_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """key, surface, start, end of every word of a text; keyed: with name_key, its search key."""
    field = docs.schema[key]
    kinds = StructType([field]).add("surface", "string").add("start", "integer").add("end", "integer")
    kinds = kinds.add("name_key", "string") if keyed else kinds
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                many, found = [], []
                for t in part.column(1).to_pylist():
                    before = len(found)
                    found += _TOKEN.finditer(t or "")
                    many.append(len(found) - before)
                surfaces = [m.group() for m in found]
                columns = [part.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(surfaces, pa.string()), pa.array([m.start() for m in found], pa.int32()), pa.array([m.end() for m in found], pa.int32())]
                if keyed:
                    columns.append(pa.array([X.word_key(w) for w in surfaces], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(key, text).mapInArrow(run, kinds)


def _keyed(tokens: DataFrame) -> DataFrame:
    return tokens if "name_key" in tokens.columns else tokens.withColumn("name_key", X.search_key(F.col("surface")))


def _among(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """tokens whose search key is any name's, where names are few enough for every task to hold."""
    some = names.select("name_key").distinct()
    few = some.limit(MAX_HELD + 1).count() <= MAX_HELD
    return tokens.join(F.broadcast(some), "name_key", "left_semi") if few else tokens


def propagated(tokens: DataFrame, mentions: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, surface, confidence of further places of accepted names: tokens whose search key is a name of their page of
    four letters or more, outside the spans of persons. names: key, name_key."""
    long = names.filter(F.length("name_key") >= 4)
    met = _among(_keyed(tokens), long).join(long, [key, "name_key"], "left_semi")
    covers = mentions.filter("kind = 'person'").select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))
    return met.join(covers, inside, "left_anti").select(key, "start", "end", "surface", F.lit(CONFIDENCE["propagated"]).alias("confidence"))


def first_canonical(tokens: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, surface, canonical of tokens that are names of a lexicon (name, position), by search key; of several names
    with one key the first."""
    known = names.withColumn("name_key", X.search_key(F.col("name"))).groupBy("name_key").agg(F.min_by("name", "position").alias("canonical"))
    return _among(_keyed(tokens), known).join(known, "name_key").select(key, "start", "end", "surface", "canonical")
