"""Sanity of transcriptions: odd tokens and lines, masks for them, confidence and choices that follow.

All are functions of their own row, so each takes one scan; what is said of tokens is found once for each distinct one."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rows as W
from quire.functions import text as T

# Letter pairs that no language here has, numerals, limits.
IMPROBABLE = ("qj", "vvv", "iii", "kk", "iiit", "xq", "jq", "zx", "qx")
ROMAN = "(?i)^[MDCLXVI]{2,}$"
YEAR = "(?i)^(anno|an|m[cdxlvi]+)$"
CONSONANTS = "[bcdfghjklmnpqrstvwxyz]"
SINGLE_LIMIT, DIGIT_LIMIT, JUNK_LIMIT = 0.30, 0.25, 0.35
EDIT_LIMIT, DRIFT_LIMIT, RETENTION_LEAST, CHURN_LIMIT = 0.40, 0.30, 0.50, 0.50


_FIVE, _FOUR = (re.compile(CONSONANTS + n) for n in ("{5,}", "{4,}"))
_PAIRS, _THRICE, _ROMAN, _YEAR, _HARMLESS = (re.compile(x) for x in ("|".join(IMPROBABLE), r"(.)\1{2,}", ROMAN, YEAR, r"[?…\[\]'\-–—.,;:]"))
_VOWELS = frozenset(T.VOWELS)


def vowel_share(token: str) -> float:
    n = W.n_letters(token)
    return sum(c in _VOWELS for c in token.lower()) / n if n else 0.0


def is_weird(token: str) -> bool:
    """Ten letters or more with few vowels, five consonants in a row, an improbable pair, or a character three times over
    in what is no numeral; tokens without letters aren't."""
    low, n = token.lower(), W.n_letters(token)
    return n > 0 and bool((n >= 10 and vowel_share(token) < 0.20) or _FIVE.search(low) or _PAIRS.search(low) or (_THRICE.search(low) and not _ROMAN.search(token)))


def is_junk(token: str) -> bool:
    """Two characters or more of which over 0.4 are neither letters nor plain punctuation."""
    other = len(token) - W.n_letters(token) - len(_HARMLESS.findall(token))
    return len(token) >= 2 and token != "[…]" and other / len(token) > 0.40


def is_suspicious(token: str) -> bool:
    """Tokens to be masked: digits among letters that are no numeral or year, twelve letters or more with few vowels, improbable
    pairs, characters three times over, five consonants in a row."""
    low, n = token.lower(), W.n_letters(token)
    if not n:
        return False
    numeral = bool(_ROMAN.search(token))
    if any(map(str.isdecimal, token)) and not numeral and not _YEAR.search(token) and not _ROMAN.search("".join(filter(str.isalpha, token))):
        return True
    if n >= 3 and (_PAIRS.search(low) or (_THRICE.search(low) and not numeral)):
        return True
    return bool((n >= 12 and vowel_share(token) < 0.20) or (_FIVE.search(low) and not numeral))


METRICS = ("single_char_ratio", "digit_ratio", "weird_ratio", "junk_ratio", "uncertainty_marker_ratio")
_MEASURED = W.Memo(lambda t: (len(t) == 1, any(map(str.isdecimal, t)), is_weird(t), is_junk(t), "?" in t or t == "[…]"))
_SUSPICIOUS = W.Memo(is_suspicious)


def _metrics_of(text: str | None) -> tuple[float, ...]:
    words = [w for w in W.by_line(text or "") if w]
    counts, n = [0] * len(METRICS), sum(map(len, words))
    for t, c in Counter(t for w in words for t in w).items():
        for k, met in enumerate(_MEASURED[t]):
            if met:
                counts[k] += c
    return *[c / max(n, 1) for c in counts], sum(len(w[0]) == 1 for w in words) / max(len(words), 1)


def _metric_rows(texts: list) -> pa.Array:
    return W.structs((*METRICS, "leading_single_ratio"), [_metrics_of(t) for t in texts])


_metrics = W.mapped(_metric_rows, W.doubles((*METRICS, "leading_single_ratio")))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with six ratios: single characters, digits, weird and junk tokens and marks of uncertainty among tokens, and lines
    that a single character begins. A text without tokens has 0 in all."""
    return docs.withColumn("_s", _metrics(F.col(text))).select("*", "_s.*").drop("_s")


def label() -> Column:
    """HIGH, MEDIUM or LOW by a row's ratios of metrics()."""
    s, d, w, j = (F.col(c) for c in ("single_char_ratio", "digit_ratio", "weird_ratio", "junk_ratio"))
    return F.when((s < 0.05) & (d < 0.01) & (w < 0.08) & (j < 0.03), "HIGH").when((s < 0.10) & (d < 0.01) & (w < 0.15) & (j < 0.06), "MEDIUM").otherwise("LOW")


def adjusted_confidence(confidence: Column) -> Column:
    """Confidence by a row's ratios of metrics(), between 0.05 and 0.95: lower for odd tokens, lower still for odd text without
    a mark of uncertainty, and for many single characters."""
    s, w, j, u = (F.col(c) for c in ("single_char_ratio", "weird_ratio", "junk_ratio", "uncertainty_marker_ratio"))
    out = confidence * (1.0 - s) * (1.0 - w) * (1.0 - j)
    out = out * F.when((u == 0) & ((w > 0.05) | (j > 0.03)), 0.70).otherwise(1.0) * F.when(s > 0.15, 0.60).otherwise(1.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), out))


def simple_metrics(text: Column) -> Column:
    """single, digit, junk: shares of tokens of one character, with a digit, without a letter."""
    some = lambda ts, f: T.share(F.size(F.filter(ts, f)), F.size(ts))
    return T.once(T.tokens(text), lambda ts: F.struct(some(ts, lambda t: F.length(t) == 1).alias("single"), some(ts, lambda t: t.rlike(r"\p{Nd}")).alias("digit"), some(ts, lambda t: ~t.rlike(r"\p{L}")).alias("junk")))


def is_sane(m: Column) -> Column:
    return (m["single"] <= SINGLE_LIMIT) & (m["digit"] <= DIGIT_LIMIT) & (m["junk"] <= JUNK_LIMIT)


def penalty(m: Column, confidence: Column) -> Column:
    """What the better of two readings has less of."""
    return m["single"] * 2.0 + m["digit"] * 1.5 + m["junk"] - F.coalesce(confidence, F.lit(0.0)) * 0.5


def better_reading(a: Column, a_confidence: Column, b: Column, b_confidence: Column) -> Column:
    """a or b, whichever has the smaller penalty (a of equals); a blank one loses."""
    x, y = T.stripped(T.text_or_empty(a)), T.stripped(T.text_or_empty(b))
    first = penalty(simple_metrics(x), a_confidence) <= penalty(simple_metrics(y), b_confidence)
    return F.when(x == "", b).when(y == "", a).when(first, a).otherwise(b)


MOST = 0.30


def _masked(text: str | None) -> str:
    text = text or ""
    return "\n".join("[…]" if w and sum(_SUSPICIOUS[t] for t in w) / len(w) > MOST else x for x, w in zip(text.split("\n"), W.by_line(text), strict=True))


def _masked_rows(texts: list) -> pa.Array:
    return pa.array([_masked(t) for t in texts], pa.string())


#: A text with every line masked of whose tokens more than 0.30 are suspicious.
masked_lines = W.mapped(_masked_rows, "string")


def suspicion(token: str) -> float:
    """1 for a suspicious token, 0.5 for six letters or more with few vowels, 0.3 for four consonants in a row."""
    if token in ("[…]", "?"):
        return 0.0
    n = W.n_letters(token)
    return (1.0 if is_suspicious(token) else 0.0) + (0.5 if n >= 6 and vowel_share(token) < 0.25 else 0.0) + (0.3 if n >= 3 and _FOUR.search(token.lower()) else 0.0)


_SUSPICION = W.Memo(suspicion)


def _forced(text: str | None, needs: bool | None) -> dict:
    if not needs:
        return {"marked": text, "forced": 0}
    lines, words = text.split("\n"), W.by_line(text)
    found = sorted((-_SUSPICION[t], i, k) for i, w in enumerate(words) for k, t in enumerate(w) if _SUSPICION[t] > 0)
    if not found:
        return {"marked": text.rstrip(" ") + " [?]", "forced": 1}
    top = found[: min(max(1, int(len(found) * 0.10)), 3)]
    for _, i, k in top:
        words[i][k] += "?"
    for i in {i for _, i, _ in top}:
        lines[i] = " ".join(words[i])
    return {"marked": "\n".join(lines), "forced": len(top)}


_FORCED = pa.struct([("marked", pa.string()), ("forced", pa.int32())])


def _forced_rows(texts: list, needs: list) -> pa.Array:
    return pa.array([_forced(t, n) for t, n in zip(texts, needs, strict=True)], _FORCED)


_forced_marks = W.mapped(_forced_rows, "struct<marked: string, forced: int>")


def forced_marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with metrics()) with marked and forced: a noisy text without a mark of uncertainty gets ? behind its most suspicious
    tokens, a tenth of them, one to three, the first of equals; or [?] at its end if none is suspicious."""
    needs = (F.col("uncertainty_marker_ratio") == 0) & ((F.col("weird_ratio") > 0.05) | (F.col("junk_ratio") > 0.03))
    return docs.withColumn("_m", _forced_marks(F.col(text), needs)).select("*", "_m.*").drop("_m")


def _counted_rows(texts: list) -> pa.Array:
    return pa.array([[{"t": t, "suspicious": _SUSPICIOUS[t], "n": n} for t, n in Counter(W.splitter(x or "")(x or "")).items()] for x in texts], pa.list_(pa.struct([("t", pa.string()), ("suspicious", pa.bool_()), ("n", pa.int64())])))


#: The distinct tokens of a text with whether each is suspicious and how often it occurs.
counted_tokens = W.mapped(_counted_rows, "array<struct<t: string, suspicious: boolean, n: bigint>>")


def line_duplicates(text: Column) -> Column:
    """The share of lines that repeat another but for case and white space; 0 for fewer than two."""
    rows = F.transform(T.full_lines(text), lambda x: F.regexp_replace(F.lower(x), r"\s+", " "))
    return T.once(rows, lambda r: F.when(F.size(r) < 2, 0.0).otherwise(1.0 - F.size(F.array_distinct(r)) / F.size(r)))


def garbage_ratio(text: Column) -> Column:
    """Characters beyond the fourth of a run, and controls, by length; an empty text is all garbage."""
    t = T.text_or_empty(text)
    runs = F.regexp_extract_all(t, F.lit(r"((.)\2{4,})"), F.lit(1))
    excess = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 4)
    return F.when(F.length(t) == 0, 1.0).otherwise(F.least(F.lit(1.0), (excess + F.regexp_count(t, F.lit(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"))) / F.length(t)))


def script_drift(text: Column, script: Column) -> Column:
    """Greek and Cyrillic letters among letters of a text that should be Latin; 0 for other scripts."""
    n = F.regexp_count(text, F.lit(r"[A-Za-zÀ-ÿͰ-ϿЀ-ӿ]"))
    return F.when(script == "latin", T.share(F.regexp_count(text, F.lit(r"[Ͱ-ϿЀ-ӿ]")), n)).otherwise(0.0)


def looks_hallucinated(text: Column) -> Column:
    """A long text that goes in circles: 900 characters, 12 lines and 140 words or more, over a quarter of its lines and some six
    words four times over, and hardly a mark of uncertainty."""
    t = T.text_or_empty(text)
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-zà-ÿ]{3,}"), F.lit(0))
    sure = (F.regexp_count(t, F.lit(r"\?")) + F.regexp_count(t, F.lit(r"\[…\]"))) / F.greatest(F.length(t), F.lit(1)) <= 0.01
    long = (F.length(t) >= 900) & (F.size(T.lines(t)) >= 12) & (line_duplicates(t) >= 0.28) & sure
    circles = T.once(words, lambda w: (F.size(w) >= 140) & (T._most_often(T.word_ngrams(w, 6)) >= 4))
    return F.when(long, circles).otherwise(False)


def is_low_quality(text: Column, script: Column) -> Column:
    t = T.text_or_empty(text)
    repeats = (line_duplicates(t) >= 0.40) & (F.size(T.lines(t)) >= 8)
    return (T.stripped(t) == "") | (garbage_ratio(t) >= 0.22) | (script_drift(t, script) >= 0.20) | repeats


def _is_junk_word(token: str) -> bool:
    n = W.n_letters(token)
    return n < 3 or vowel_share(token) < 0.20 or (len(token) - n) / len(token) > 0.30


_JUNK = W.Memo(lambda t: (W.n_letters(t), len(t) >= 3, len(t) >= 3 and _is_junk_word(t)))


def _junk_of(text: str | None) -> tuple[float, float]:
    letters = long = junk = 0
    for t, c in Counter(W.splitter(text or "")(text or "")).items():
        a, b, d = _JUNK[t]
        letters += a * c
        long += b * c
        junk += d * c
    return junk / long if long else 0.0, float(letters)


def _junk_rows(texts: list) -> pa.Array:
    return W.structs(("junk", "letters"), [_junk_of(t) for t in texts])


_junk = W.mapped(_junk_rows, W.doubles(("junk", "letters")))


def junk_ratio(text: Column) -> Column:
    """Tokens of three characters or more that have fewer than three letters, few vowels or many signs, of all such."""
    return _junk(text)["junk"]


def capped_confidence(confidence: Column, text: Column) -> Column:
    """Confidence of 0.75 at most for much junk (less for a short text), of 0.85 for some."""
    much = lambda x: (x["junk"] >= 0.35) | ((x["letters"] < 120) & (x["junk"] >= 0.25))
    return T.once(_junk(text), lambda x: F.when(much(x), F.least(confidence, F.lit(0.75))).when(x["junk"] >= 0.20, F.least(confidence, F.lit(0.85))).otherwise(confidence))


def tile_quality(text: Column) -> Column:
    """0 to 1: letters, printable characters, lines longer than two characters, tokens; less for ellipses and other scripts."""

    def of(t: Column) -> Column:
        n = F.length(t)
        rows = F.filter(F.transform(T.lines(t), T.stripped), lambda x: x != "")
        short = F.size(F.filter(rows, lambda x: F.length(x) <= 2)) / F.greatest(F.size(rows), F.lit(1))
        printable = n - F.regexp_count(t, F.lit(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"))
        score = 0.40 * F.least(F.lit(1.0), T.letters(t) / F.greatest(n * 0.6, F.lit(1.0))) + 0.30 * (printable / n) + 0.20 * (1.0 - short) + 0.10 * F.least(F.lit(1.0), F.regexp_count(t, F.lit("[A-Za-zÀ-ÿ]+")) / 20.0)
        score = score - F.least(F.lit(0.20), F.regexp_count(t, F.lit("…")) / n) - F.least(F.lit(0.50), F.regexp_count(t, F.lit("[Ͱ-ϿЀ-ӿ぀-ヿ㐀-䶿一-鿿豈-﫿]")) / n)
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

    return T.once(T.stripped(T.text_or_empty(text)), of)


def region_quality(confidence: Column, plausibility: Column, repetition: Column, text: Column) -> Column:
    """How good a region's reading is: its confidence (null: 0.5), how well it fits a language, how little it repeats; 0 for a
    blank one."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5))))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.20 * sure + 0.45 * plausibility + 0.35 * (1.0 - repetition))), 4)
    return F.when(T.stripped(T.text_or_empty(text)) == "", 0.0).otherwise(score)


def marks(text: Column) -> Column:
    """? and … in a text; in brackets they count three."""
    t = T.text_or_empty(text)
    return F.regexp_count(t, F.lit("[?…]")) + 2 * F.regexp_count(t, F.lit(r"\[[?…]\]"))


def proofread_delta(raw: Column, proof: Column) -> Column:
    """A struct on a correction: accepted, the first reason against it (none: null) and the four measures: characters changed,
    change of the number of lines, marks of uncertainty kept, new tokens among its own."""
    flat = lambda t: F.regexp_replace(F.lower(T.stripped(T.text_or_empty(t))), r"\s+", " ")
    words = lambda t: F.array_distinct(T.tokens(F.lower(t)))
    n, m = F.size(T.full_lines(raw)), F.size(T.full_lines(proof))
    drift = F.when(n > 0, F.abs(m - n) / n).otherwise(0.0)
    kept = F.when(marks(raw) > 0, marks(proof) / marks(raw)).otherwise(1.0)
    churn = T.share(F.size(F.array_except(words(proof), words(raw))), F.size(words(proof)))
    measured = F.struct(T.edit_distance_ratio(flat(raw), flat(proof)).alias("edit"), drift.alias("drift"), kept.alias("kept"), churn.alias("churn"))

    def judged(x: Column) -> Column:
        reason = F.when(x["edit"] > EDIT_LIMIT, "char_edit_ratio").when(x["drift"] > DRIFT_LIMIT, "line_drift").when(x["kept"] < RETENTION_LEAST, "uncertainty_stripped").when(x["churn"] > CHURN_LIMIT, "token_churn")
        return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"), *[x[c].alias(c) for c in ("edit", "drift", "kept", "churn")])

    return T.once(measured, judged)


def hallucinated_hyphen(token: Column, unstable: Column) -> Column:
    """A word in two parts with three of four signs: case that changes at the hyphen, a rare pair, a part of two letters or
    fewer, an unstable reading."""
    parts = F.split(token, "-")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    mixed = (a.rlike(r"\p{Ll}$") & b.rlike(r"^\p{Lu}")) | (a.rlike(r"\p{Lu}$") & b.rlike(r"^\p{Ll}"))
    rare = F.lower(F.concat(a, b)).rlike("|".join(T.RARE_BIGRAMS))
    signs = sum((x.cast("int") for x in (mixed, rare, (F.length(a) <= 2) | (F.length(b) <= 2), unstable)), F.lit(0))
    return F.coalesce((F.size(parts) == 2) & (a != "") & (b != "") & (signs >= 3), F.lit(False))


def max_consonant_run(token: Column) -> Column:
    """The longest run of letters that are no vowels."""
    runs = F.regexp_extract_all(F.lower(token), F.lit(r"[\p{L}&&[^aeiouyàâäéèêëïîôùûüœæ]]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def dedupe_key(line: Column) -> Column:
    """What lines are compared by: marks of uncertainty alike, lower case, no punctuation, white space collapsed."""
    low = F.lower(T.uncertainty_tokens(line))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[‘’“”`'\".,;:!(){}<>]", ""), r"\s+", " "))
