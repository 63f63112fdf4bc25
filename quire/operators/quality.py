"""Quality reports of transcriptions, their labels and the gates that follow from them.

A report is a projection: every signal is a function of its own row's text, so a report takes one scan, whatever the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicon as X
from quire.functions import rows as W
from quire.functions import text as T

# Limits and weights.
GIBBERISH_HARD, GIBBERISH_SOFT = 0.40, 0.25
NON_WORDLIKE_RISKY, NON_WORDLIKE_GATE = 0.35, 0.55
ENTROPY_LOW, ENTROPY_HIGH = 2.0, 5.5
UNCERTAINTY_HARD, UNCERTAINTY_RISKY = 0.15, 0.08
REPETITION_HARD, REPETITION_SOFT = 0.35, 0.20
LEADING_LIMIT, SEAM_LIMIT = 0.15, 0.10
WEIGHTS = {"repetition_score": 0.30, "non_wordlike_frac": 0.35, "entropy": 0.13, "rare_bigram": 0.12, "uncertainty": 0.10}


def non_wordlike_frac(text: Column) -> Column:
    """Tokens of three characters or more that score above 0.45, of all such."""
    return W.non_wordlike_frac(text)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the signals of a report, each a double."""
    return docs.withColumn("_r", W.report(F.col(text))).select("*", "_r.*").drop("_r")


def gibberish(weights: dict[str, float] | None = None, lexical: Column | None = None) -> Column:
    """The composite of a row's signals; by default the one where no language is known."""
    entropy = F.when(F.col("char_entropy") < ENTROPY_LOW, 0.3).when(F.col("char_entropy") > ENTROPY_HIGH, 0.2).otherwise(0.0)
    parts = {
        "repetition_score": F.col("repetition_score"),
        "non_wordlike_frac": F.col("non_wordlike_frac"),
        "entropy": entropy,
        "rare_bigram": F.least(F.lit(1.0), F.col("rare_bigram_ratio") * 5),
        "uncertainty": F.least(F.lit(1.0), F.col("uncertainty_density") * 5),
    }
    score = F.lit(0.0)
    for name, weight in (weights or WEIGHTS).items():
        score = score + (lexical if name == "lexical" else parts[name]) * weight
    return F.least(F.lit(1.0), score)


def label(tiled: bool = False) -> Column:
    """HIGH, OK, RISKY or UNRELIABLE: the first rule that a row's signals meet."""
    g, n, e = F.col("gibberish_score"), F.col("non_wordlike_frac"), F.col("char_entropy")
    u, r, lead = F.col("uncertainty_density"), F.col("repetition_score"), F.col("leading_fragment_ratio")
    bad = (g >= GIBBERISH_HARD) | (u >= UNCERTAINTY_HARD) | (n >= NON_WORDLIKE_GATE) | (e < 1.5) | (r >= REPETITION_HARD)
    risky = (g >= GIBBERISH_SOFT) | (n >= NON_WORDLIKE_RISKY) | (e < ENTROPY_LOW) | (e > ENTROPY_HIGH) | (u >= UNCERTAINTY_RISKY) | (r >= REPETITION_SOFT)
    high = (g < 0.10) & (n < 0.15) & (u < 0.03) & e.between(2.5, 5.0) & (r < 0.10)
    if tiled:
        risky, high = risky | (lead >= LEADING_LIMIT), high & (lead < 0.06)
    return F.when(bad, "UNRELIABLE").when(risky, "RISKY").when(high, "HIGH").otherwise("OK")


def report(docs: DataFrame, text: str = "text", tiled: bool = False) -> DataFrame:
    """docs with signals, gibberish_score and quality_label. Null text is empty: entropy 0, UNRELIABLE."""
    out = signals(docs, text)
    blank = T.stripped(T.text_or_empty(F.col(text))) == ""
    return out.withColumn("gibberish_score", F.when(blank, 0.0).otherwise(gibberish())).withColumn("quality_label", label(tiled))


def gates(reported: DataFrame) -> DataFrame:
    """reported with a boolean for each gate, blocked (stages, sorted) and downstream_mode."""
    ok = F.array().cast("array<string>")
    passed = {
        "gate_gibberish": F.col("gibberish_score") < GIBBERISH_HARD,
        "gate_wordlike": F.col("non_wordlike_frac") < NON_WORDLIKE_GATE,
        "gate_fragment": F.col("leading_fragment_ratio") < LEADING_LIMIT,
        "gate_uncertainty": F.col("uncertainty_density") < UNCERTAINTY_HARD,
    }
    out = reported.withColumns(passed)
    words = F.array(F.lit("token_search"), F.lit("token_ner"))
    claims = F.array(F.lit("translation"), F.lit("paraphrase"), F.lit("entity_claims"))
    blocked = F.concat(
        F.when(~F.col("gate_gibberish") | ~F.col("gate_wordlike") | (F.col("quality_label") == "UNRELIABLE"), words).otherwise(ok),
        F.when(~F.col("gate_fragment"), F.array(F.lit("seam_not_resolved"))).otherwise(ok),
        F.when(F.col("quality_label").isin("RISKY", "UNRELIABLE"), claims).otherwise(ok),
    )
    mode = F.when(F.col("quality_label").isin("HIGH", "OK"), "full").when(F.col("quality_label") == "RISKY", "restricted").otherwise("blocked")
    return out.withColumn("blocked", F.array_sort(F.array_distinct(blocked))).withColumn("downstream_mode", mode)


WEIGHTS_WITH_LANGUAGE = {"lexical": 0.45, "repetition_score": 0.20, "non_wordlike_frac": 0.15, "entropy": 0.07, "rare_bigram": 0.07, "uncertainty": 0.06}


def full_report(docs: DataFrame, text: str = "text", language: str = "language", tiled: bool = False) -> DataFrame:
    """docs with the whole report: signals, lexical_contrast (-1: too short to tell), lexical_plausibility (best fit; 0.5 for a
    language without profile), gibberish_score with its lexical part where the contrast is known, quality_label, blocked and
    downstream_mode. The contrast's shuffles run in an Arrow function, the rest is one projection."""
    out = signals(docs, text).withColumn("_c", X.contrasts(F.col(text)))
    out = out.withColumns({"lexical_contrast": F.coalesce(X.lexical_contrast(F.col("_c")), F.lit(-1.0)), "lexical_plausibility": X.best_fit_plausibility(X.fits(F.col(text)), F.col(language))}).drop("_c")
    blank, c, p = T.stripped(T.text_or_empty(F.col(text))) == "", F.col("lexical_contrast"), F.col("lexical_plausibility")
    score = F.when(c < 0, gibberish()).otherwise(gibberish(WEIGHTS_WITH_LANGUAGE, X.implausibility(c)))
    out = out.withColumn("gibberish_score", F.when(blank, 0.0).otherwise(F.round(score, 4)))
    plain = label(tiled)
    told = F.when((plain == "UNRELIABLE") | ((c >= 0) & (c < X.CONTRAST_BAD)), "UNRELIABLE").when((plain == "RISKY") | ((c >= 0) & (c < X.CONTRAST_RISKY)) | (p < X.PLAUSIBILITY_FLOOR), "RISKY")
    out = out.withColumn("quality_label", told.when((plain == "HIGH") & (c >= 0) & (c < X.CONTRAST_CLEAN), "OK").otherwise(plain))
    gated = gates(out)
    weak = (p < X.PLAUSIBILITY_FLOOR) | ((c >= 0) & (c < X.CONTRAST_BAD))
    words = F.when(weak, F.array(F.lit("token_search"), F.lit("token_ner"))).otherwise(F.array().cast("array<string>"))
    return gated.withColumn("blocked", F.array_sort(F.array_distinct(F.concat("blocked", words))))


def agreement(readings: DataFrame, page: str, reading: str, text: str = "text") -> DataFrame:
    """page and agreement: the mean Jaccard of the trigram sets of every two readings of a page; 1 for a single one, and for two
    without trigrams. A page has a handful of readings."""
    sets = readings.select(page, F.col(reading).alias("_r"), X.trigram_set(F.col(text)).alias("_s"))
    other = sets.select(F.col(page).alias("_page"), F.col("_r").alias("_q"), F.col("_s").alias("_t"))
    pairs = sets.join(other, (F.col(page) == F.col("_page")) & (F.col("_r") < F.col("_q"))).groupBy(page).agg(F.avg(T.jaccard(F.col("_s"), F.col("_t"), 1.0)).alias("agreement"))
    return sets.select(page).distinct().join(pairs, page, "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))


def text_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the mean token quality, the share of low tokens and HIGH, MEDIUM or LOW."""
    out = docs.withColumn("_q", W.token_qualities(F.col(text))).withColumns({"token_quality": F.col("_q.avg"), "low_frac": F.col("_q.low")})
    kind = F.when(F.col("_q.n") == 0, "LOW").when((F.col("_q.avg") >= 0.55) & (F.col("_q.low") < 0.15), "HIGH").when((F.col("_q.avg") >= 0.35) & (F.col("_q.low") < 0.40), "MEDIUM").otherwise("LOW")
    return out.withColumn("text_quality", kind).drop("_q")


def token_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the mean and standard deviation of token lengths and the shares of short (under 3) and long (over 15) ones."""
    sizes = F.transform(T.tokens(F.col(text)), F.length)

    def of(s: Column) -> Column:
        n = F.size(s)
        avg = T.mean(F.transform(s, lambda x: x.cast("double")))
        spread = T.once(avg, lambda m: F.sqrt(T.mean(F.transform(s, lambda x: (x - m) * (x - m)))))
        short = F.when(n == 0, 1.0).otherwise(F.size(F.filter(s, lambda x: x < 3)) / n)
        return F.struct(avg.alias("mean_len"), spread.alias("std_len"), short.alias("short_frac"), T.share(F.size(F.filter(s, lambda x: x > 15)), n).alias("long_frac"))

    return docs.withColumn("_t", T.once(sizes, of)).select("*", "_t.*").drop("_t")


def sanity(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the shares of single-character, digit-bearing and uncertain tokens, and of lines that a single character begins."""
    words = T.tokens(F.col(text))
    n = lambda ts: F.greatest(F.size(ts), F.lit(1))
    some = lambda ts, f: F.size(F.filter(ts, f)) / n(ts)
    both = T.once(words, lambda ts: F.struct(some(ts, lambda t: F.length(t) == 1).alias("single_char_ratio"), some(ts, lambda t: t.rlike("[0-9]")).alias("digit_ratio"), some(ts, lambda t: t.contains("?") | (t == "[…]")).alias("uncertain_ratio")))
    starts = T.once(T.full_lines(F.col(text)), lambda rows: some(rows, lambda x: F.length(F.get(T.tokens(x), F.lit(0))) == 1))
    return docs.withColumn("_s", both).withColumn("single_start_ratio", starts).select("*", "_s.*").drop("_s")


def mention_recall(length: Column, mentions: Column) -> Column:
    """Whether a text of a length has as many mentions as expected: 2 for every 1000 characters, 1 at least, from 200 on."""
    wanted = F.greatest(F.lit(1), F.floor(length / 1000 * 2))
    return (length < 200) | (mentions >= wanted)
