"""Column functions on texts and tokens. All are built-in expressions that stay in a row: no shuffle, no Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be these for equal results.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöùúûüýÿœ"
RARE_BIGRAMS = (
    "zx", "xz", "qx", "xq", "jx", "xj", "zq", "qz", "bx", "xb", "vx", "xv", "kx", "xk", "wx", "xw",
    "jq", "qj", "jz", "zj", "bk", "kb", "fq", "qf", "vq", "qv", "zz", "xx", "qq",
)
FUNCTION_WORDS = (
    "a", "à", "au", "de", "du", "en", "et", "il", "je", "la", "le", "li", "ne", "ni", "nu", "on", "ou", "où", "si", "tu", "un",
    "ab", "ad", "an", "at", "ex", "in", "is", "it", "id", "ob", "se", "ut",
    "al", "da", "di", "do", "el", "eu", "ha", "ho", "lo", "mi", "no", "os", "su", "te", "ti", "va", "vi", "yo",
    "am", "as", "be", "by", "go", "he", "if", "me", "my", "of", "ok", "or", "so", "to", "up", "us", "we",
    "um", "zu", "e", "i", "o", "u", "y",
)
SCRIPTS = (("latin", r"\p{IsLatin}"), ("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}"), ("arabic", r"\p{IsArabic}"), ("hebrew", r"\p{IsHebrew}"))

#: Letters that decompose into a Latin letter and marks, with that letter; from Unicode, up to Latin Extended-B.
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)}


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """What white space parts; a blank or null text has none."""
    return F.filter(F.split(text_or_empty(text), r"\s+"), lambda t: t != "")


def lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def full_lines(text: Column) -> Column:
    """Lines that aren't blank, without white space around them."""
    return F.filter(F.transform(lines(text), stripped), lambda x: x != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def vowel_count(low: Column) -> Column:
    return F.length(low) - F.length(F.translate(low, VOWELS, ""))


def vowel_ratio(token: Column) -> Column:
    """Vowels among a token's letters; 0 without letters."""
    return share(vowel_count(F.lower(token)), letters(F.lower(token)))


def vowel_anomaly(token: Column) -> Column:
    return (vowel_ratio(token) < 0.15) | (vowel_ratio(token) > 0.75)


def rare_bigram_ratio(text: Column) -> Column:
    """Rare pairs among all pairs of adjacent letters. A run of n letters has n - 1 pairs; pairs may overlap."""
    low = F.lower(text)
    pairs = letters(low) - F.regexp_count(low, F.lit(r"\p{L}+"))
    return share(F.regexp_count(low, F.lit(f"(?={'|'.join(RARE_BIGRAMS)})")), pairs)


def without_vowels(low: Column, vowels: str = VOWELS) -> Column:
    return F.translate(low, vowels, " " * len(vowels))


def non_wordlike_score(token: Column) -> Column:
    """0 for a word, up to 1 for gibberish: signs among letters, odd vowel share, runs of consonants, rare pairs."""

    def score(x: Column) -> Column:
        n, count, rest = F.length(x["low"]), x["letters"], x["rest"]
        signs = F.when(count > 0, F.least(F.lit(0.3), (n - count) / n)).otherwise(0.0)
        odd = F.when(x["vowels"] < 0.12, 0.30).when(x["vowels"] < 0.18, 0.15).when(x["vowels"] > 0.80, 0.20).otherwise(0.0)
        run = F.when(~rest.rlike(r"\p{L}{4}"), 0.0).when(rest.rlike(r"\p{L}{5}"), 0.35).otherwise(0.15)
        rare = F.when((count >= 4) & x["low"].rlike("|".join(RARE_BIGRAMS)), rare_bigram_ratio(x["low"]) * 0.5).otherwise(0.0)
        return F.when(n < 2, 0.5).otherwise(F.least(F.lit(1.0), signs + odd + run + rare))

    def parts(x: Column) -> Column:
        return F.struct(x["low"].alias("low"), x["letters"].alias("letters"), share(vowel_count(x["low"]), x["letters"]).alias("vowels"), without_vowels(x["low"]).alias("rest"))

    return once(once(once(F.lower(token), lambda low: F.struct(low.alias("low"), letters(low).alias("letters"))), parts), score)


def token_quality_score(token: Column) -> Column:
    """0 to 1: length, vowel share of all characters, runs of consonants, letters only."""
    low, n = F.lower(token), F.length(token)
    vowels = vowel_count(low) / n
    rest = without_vowels(low)
    score = F.lit(0.50) + F.when(n < 3, -0.20).when(n <= 20, 0.15).otherwise(-0.10)
    score = score + F.when(vowels.between(0.25, 0.65), 0.20).when(vowels.between(0.15, 0.80), 0.05).otherwise(-0.25)
    score = score + F.when(rest.rlike(r"\p{L}{4}"), -0.35).when(rest.rlike(r"\p{L}{3}"), -0.05).otherwise(0.0)
    score = score + F.when(low.rlike(r"^\p{L}+$"), 0.10).otherwise(-0.15)
    return F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def mean(values: Column) -> Column:
    return share(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def char_entropy(text: Column) -> Column:
    """Bits of a text's lower-cased characters; an empty text has 0. One count for each distinct character."""
    low = F.lower(text_or_empty(text))
    n = F.length(text_or_empty(text))
    counts = F.transform(F.filter(F.array_distinct(F.split(low, "")), lambda c: c != ""), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(F.array_sort(counts), F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def uncertainty_density(text: Column) -> Column:
    """Marks of uncertain readings: ?, … and […] (which counts four in all) by length."""
    t = text_or_empty(text)
    marks = F.regexp_count(t, F.lit("[?…]")) + 3 * F.regexp_count(t, F.lit(r"\[…\]"))
    return share(marks, F.length(t))


def _most_often(items: Column) -> Column:
    """How often the most frequent item stands in an array."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: a["best"])


def word_ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def repetition_score(text: Column, n: int = 5) -> Column:
    """The greater of: lines that repeat an earlier one (of 3 or more lines), and tokens that the most frequent n-gram
    within lines covers (of 3 n tokens or more, if it occurs twice)."""

    def of(rows: Column) -> Column:
        count = F.aggregate(F.transform(rows, lambda x: F.size(tokens(x))), F.lit(0), lambda a, x: a + x)
        repeated = F.when(F.size(rows) >= 3, (F.size(rows) - F.size(F.array_distinct(rows))) / F.size(rows)).otherwise(0.0)
        top = _most_often(F.flatten(F.transform(rows, lambda x: once(tokens(x), lambda w: word_ngrams(w, n)))))
        covered = once(top, lambda k: F.when((count >= 3 * n) & (k > 1), F.least(F.lit(1.0), k * n / count)).otherwise(0.0))
        return F.least(F.lit(1.0), F.greatest(repeated, covered))

    return once(full_lines(text), of)


def trailing_fragment_ratio(text: Column) -> Column:
    """Lines that end with a hyphen or with a single consonant, of those that aren't blank."""

    def broken(x: Column) -> Column:
        last = F.element_at(tokens(x), -1)
        return x.endswith("-") | ((F.length(x) >= 2) & last.rlike(r"^\p{L}$") & ~F.lower(last).rlike(f"[{VOWELS}]"))

    return once(full_lines(text), lambda rows: share(F.size(F.filter(rows, broken)), F.size(rows)))


def begins_broken(line: Column) -> Column:
    """Whether a line begins with a piece of a word: a dash, a single consonant, or two lower-case letters that are no function
    word; a capital set apart before a lower-case word is none."""
    words = tokens(line)
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    apart = first.rlike(r"^\p{Lu}$") & second.rlike(r"^\p{Ll}")
    alone = first.rlike(r"^\p{L}$") & ~F.lower(first).rlike(f"[{VOWELS}]")
    pair = first.rlike(r"^\p{L}{2}$") & ~first.rlike(r"^\p{Lu}")
    return F.when(first.rlike("^[-–—]"), True).when(F.lower(first).isin(*FUNCTION_WORDS) | apart, False).otherwise(alone | pair)


def leading_fragment_ratio(text: Column) -> Column:
    """Lines that begin broken, of those that aren't blank."""
    return once(full_lines(text), lambda rows: share(F.size(F.filter(rows, begins_broken)), F.size(rows)))


def seam_fragment_ratio(text: Column, seams: Column | None = None) -> Column:
    """Lines that begin broken, or end with a hyphen or a single letter, of those at a seam or next to one that aren't blank
    (without seams: of all). seams: an array of line numbers from 0."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(stripped(x).alias("x"), i.alias("i")))
    near = (lambda r: F.exists(seams, lambda s: F.abs(r["i"] - s) <= 1) | (F.size(seams) == 0)) if seams is not None else (lambda r: F.lit(True))
    ends = lambda x: x.endswith("-") | F.element_at(tokens(x), -1).rlike(r"^\p{L}$")
    checked = F.filter(numbered, lambda r: (r["x"] != "") & near(r))
    return once(checked, lambda rows: share(F.size(F.filter(rows, lambda r: begins_broken(r["x"]) | ends(r["x"]))), F.size(rows)))


def script_family(text: Column) -> Column:
    """The script of at least four in five letters, else mixed if there are several, else unknown."""

    def of(t: Column) -> Column:
        counts = F.array(*[F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (s, p) in enumerate(SCRIPTS)])
        rest = letters(t) - F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
        every = F.filter(F.concat(counts, F.array(F.struct(rest.alias("n"), F.lit(-len(SCRIPTS)).alias("i"), F.lit("other").alias("s")))), lambda x: x["n"] > 0)
        top = F.array_max(every)
        return F.when(F.size(every) == 0, "unknown").when(top["n"] / letters(t) >= 0.8, top["s"]).when(F.size(every) >= 2, "mixed").otherwise(top["s"])

    # letters alone, so that a script's digits and marks don't count
    return once(F.regexp_replace(text_or_empty(text), r"[^\p{L}]+", ""), of)


def folded(text: Column) -> Column:
    """Orthography folded for search: lower case, ae and oe as e, no accents, j as i, v as u, w as uu; letters and digits stay
    in tokens, anything else parts them."""
    out = F.lower(text_or_empty(text))
    for old in ("æ", "œ", "ae", "oe"):
        out = F.replace(out, F.lit(old), F.lit("e"))
    # marks have no counterpart, so they go
    out = F.translate(out, "jv" + "".join(ACCENTED) + MARKS, "iu" + "".join(ACCENTED.values()).translate(str.maketrans("jv", "iu")))
    return F.trim(F.regexp_replace(F.replace(out, F.lit("w"), F.lit("uu")), r"[^\p{L}\p{N}]+", " "))


def rejoined(text: Column) -> Column:
    """Words that a hyphen parts at the end of a line, put together."""
    return F.regexp_replace(text_or_empty(text), "[-‐‑‒–­¬]\\s*\\n\\s*", "")


def search_terms(text: Column) -> Column:
    """Character 4-grams of each folded token with a space on either side; shorter tokens stay whole. One scan of the text:
    tokens stand two spaces apart, so that a gram has none inside."""
    apart = F.concat(F.lit(" "), F.replace(folded(rejoined(text)), F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.regexp_extract_all(apart, F.lit("(?=(.[^ ]{2}.| [^ ] ))"), F.lit(1))


def search_size(text: Column) -> Column:
    """How many terms search_terms gives, without making them: a token of n letters has n - 1, one of a letter has 1."""
    low = folded(rejoined(text))
    return once(low, lambda t: F.regexp_count(t, F.lit("[^ ]")) - F.regexp_count(t, F.lit("[^ ]+")) + F.regexp_count(t, F.lit("(?<![^ ])[^ ](?![^ ])")))


def word_size(text: Column) -> Column:
    return F.regexp_count(folded(rejoined(text)), F.lit("[^ ]+"))


def word_terms(text: Column) -> Column:
    return tokens(folded(rejoined(text)))


def bigram_set(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 1)), lambda i: F.substring(low, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Dice of the sets of character pairs; 0 if either has none."""
    x, y = bigram_set(a), bigram_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def edit_distance_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length: 0 for two empty texts, 1 for one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - edit_distance_ratio(a, b)


def jaccard(x: Column, y: Column, both_empty: float = 0.0) -> Column:
    whole = F.size(F.array_union(x, y))
    return F.when(whole == 0, both_empty).otherwise(F.size(F.array_intersect(x, y)) / whole)


def coverage(context: Column, description: Column) -> Column:
    """Tokens of the description that the context has."""
    x, y = F.array_distinct(context), F.array_distinct(description)
    return share(F.size(F.array_intersect(x, y)), F.size(y))


def cross_pass_stability(a: Column, b: Column) -> Column:
    return (edit_similarity(a, b) + jaccard(tokens(a), tokens(b), 1.0)) / 2


def normalized_for_eval(text: Column) -> Column:
    """Lower case, punctuation as spaces (but ⁊, ⹒ and &), white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(text)), r"[\p{P}&&[^⁊⹒&]]", " "), r"\s+", " "))


def uncertainty_tokens(text: Column) -> Column:
    """... and … written as […]; a […] stays."""
    t = F.replace(text_or_empty(text), F.lit("[…]"), F.lit("\u0000"))
    t = F.replace(F.replace(t, F.lit("..."), F.lit("\u0000")), F.lit("…"), F.lit("\u0000"))
    return F.replace(t, F.lit("\u0000"), F.lit("[…]"))


def has_meta_text(text: Column) -> Column:
    """Replies that speak of the model instead of the page."""
    return F.coalesce(F.lower(text).rlike(r"i'm sorry|i am sorry|as an ai|i cannot|i can't"), F.lit(False))


def pattern_junk(line: Column) -> Column:
    """Six question marks, one character seven times over, or ten characters with two distinct letters at most."""
    distinct = F.size(F.array_distinct(F.filter(F.split(F.lower(line), ""), lambda c: c.rlike(r"\p{L}"))))
    return line.rlike(r"\?{6,}") | line.rlike(r"(.)\1{6,}") | ((F.length(line) >= 10) & (distinct <= 2))


def repeat_signature(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(text)), r"^[^\p{L}]+", ""), r"[^\p{L}\p{N}_]+", " "))


def reversed_words(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.array_join(F.transform(F.split(x, " "), F.reverse), " ")), "\n")


def langid_text(text: Column, least: int = 50) -> Column:
    """What a language detector reads: lower-case letters, without tokens that are mostly signs or, from four letters on, have
    few vowels; empty under `least` letters."""
    words = tokens(F.replace(F.lower(text_or_empty(text)), F.lit("&"), F.lit(" et ")))

    def reads(t: Column) -> Column:
        return once(letters(t), lambda n: (n * 2 >= F.length(t)) & ((n < 4) | (vowel_count(t) / F.greatest(n, F.lit(1)) >= 0.20)))

    kept = F.array_join(F.filter(F.transform(F.filter(words, reads), lambda t: F.regexp_replace(t, r"[^\p{L}]+", "")), lambda t: t != ""), " ")
    return once(kept, lambda t: F.when(letters(t) >= least, t).otherwise(""))
