"""How much a text reads like a language: its letter trigrams against those of language profiles.

Profiles meet the words of a text once for each distinct one. The contrast with shuffled letters needs seeded shuffles, which
no built-in gives. Both are Arrow functions.
"""

from __future__ import annotations

import random
import re
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rows as W
from quire.functions import text as T

# Trigrams of languages, limits, weights.
LATIN = """
ent ter ion tio ati nis est unt tis que per tur ita oru rum ere iss sti con ant tur mus qui ius ine eri min men ali tes pro tra str
bus ita ris dem cum nos ter dom ndo tus ium omi ect unt tat atu sec nes ver tan pot ens mit pra end ost pon aut quo tem und int unt
rat cit ect dit ere ibu tri ati non nti ere nte sed tis ras ris ica rea ore mis nos mni lla pri lib nim eri uri eni san ern ist acc
pre nat cre gen gra mul ple sem spi
"""
OLD_FRENCH = """
ent les est ant oit ois oit que ous ure des ont aut par ain ien ter our ort com con ere ier ion ais ame oie roi ors ois ver ali oit
nes mes lor ent art ard ort ure ust ren out tot poi hom gra ran ble res nce ele ien rou uss eur ais ort der sen ten gen ave oir oir
vil ail ner rei erm ard sem pre pro soi ign age ail onn rie anc ari noi moi doi voi nui tos uel cor don mon hon bon fon pon lon son
enc emp ens erl ble ain ein oin uin
"""
MIDDLE_FRENCH = """
ent les est que ant des ous our ion con par ois com ait ure ont ter aut ain ien ere res ier ois nce ble eur ais ort ren mes ver ali
ois art ard pre pro sen ten gen age onn rie ave enc emp ens erl ain ein oin uin oir deu ieu ieu roy mon don hon bon pon tre ell omm
app aue lle iss ans oir pri che cha chi cho chu ran san man dis mis fai mai lai pai rai sai tai ign gne ner mer per der ser ler rer
nte ntr str cti iqu eme ess ass oss
"""
FRENCH = """
les ent des que ion est ait ons ant ous our con par com eur ois ure ier ter res nce ble men ais oir ort pre pro age ell omm app lle
iss ans oir tre ain ein oin enc emp ens che cha ran san man dis mis fai mai rai tai nte ntr str iqu eme ess ass iti ali ens ell lle
eau aux eux ieu oeu ail eil ouv ouv cha chi cho chu cha gne
"""
ALIASES = {"anglo_norman": "old_french", "occitan": "middle_french", "italian": "latin", "spanish": "latin", "portuguese": "latin", "catalan": "middle_french"}
FULL_HIT_RATE = 0.55
NEUTRAL = 0.50
SHUFFLES, PSEUDO_HITS, LEAST_TRIGRAMS = 8, 4.0, 150
CONTRAST_BAD, CONTRAST_RISKY, CONTRAST_CLEAN = 2.0, 2.2, 3.0
PLAUSIBILITY_FLOOR = 0.25
LATIN_MARGIN = 1.25


def _fold(trigram: str) -> str:
    for old, new in (("ae", "e"), ("oe", "e"), ("j", "i"), ("v", "u"), ("w", "uu")):
        trigram = trigram.replace(old, new)
    return trigram


#: Distinct trigrams of each profile, folded as search keys are.
PROFILES = {name: sorted({f for f in map(_fold, words.split()) if len(f) == 3}) for name, words in (("latin", LATIN), ("old_french", OLD_FRENCH), ("middle_french", MIDDLE_FRENCH), ("french", FRENCH))}


def key_words(text: Column) -> Column:
    """The words of a text's search key that have three letters or more, all of them a to z, as one string."""
    return F.array_join(F.regexp_extract_all(T.folded(T.rejoined(text)), F.lit("(?<![^ ])[a-z]{3,}(?![^ ])"), F.lit(0)), " ")


def profile_of(language: Column) -> Column:
    """The profile of a language, itself or under another name; null if there is none."""
    names = {**{p: p for p in PROFILES}, **ALIASES}
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.coalesce(language, F.lit("")))


_TRIGRAMS = W.Memo(W.trigrams_in(PROFILES))


def _fit_of(text: str | None) -> tuple[float, ...]:
    """The share of a text's trigrams that each profile has, by the share that good texts have."""
    counts = [0] * (1 + len(PROFILES))
    for t, c in Counter(W.key_words(text)).items():
        for k, n in enumerate(_TRIGRAMS[t]):
            counts[k] += n * c
    total, *found = counts
    return tuple(min(1.0, n / total / FULL_HIT_RATE) if total else NEUTRAL for n in found)


def _fit_rows(texts: list) -> pa.Array:
    return W.structs(tuple(PROFILES), [_fit_of(t) for t in texts])


#: A struct with the plausibility of a text in each profile, computed in one go.
fits = W.mapped(_fit_rows, W.doubles(tuple(PROFILES)))


def lexical_plausibility(text: Column, language: Column) -> Column:
    """0 to 1: the share of a text's trigrams that its language's profile has, by the share that good texts have; 0.5 where
    there is no profile or no trigram."""

    def of(fit: Column) -> Column:
        out, p = F.lit(NEUTRAL), profile_of(language)
        for name in PROFILES:
            out = F.when(p == name, fit[name]).otherwise(out)
        return out

    return T.once(fits(text), of)


def best_fit_language(fit: Column, text: Column) -> Column:
    """The first profile of the greatest plausibility; unknown for a blank text."""
    best, name = F.lit(0.0), F.lit("unknown")
    for p in PROFILES:
        name = F.when(fit[p] > best, p).otherwise(name)
        best = F.greatest(best, fit[p])
    return F.when(T.stripped(T.text_or_empty(text)) == "", "unknown").otherwise(name)


def best_fit_plausibility(fit: Column, language: Column) -> Column:
    """The greatest plausibility of any profile, for a language that has one; else 0.5."""
    return F.when(profile_of(language).isNull(), NEUTRAL).otherwise(F.greatest(*[fit[p] for p in PROFILES]))


def trust_adjusted(confidence: Column, plausibility: Column) -> Column:
    """Confidence by plausibility: lowered under 0.25 and 0.40, raised a little from 0.70 on, kept between 0.05 and 0.95."""
    out = F.when(plausibility < 0.25, confidence * 0.55).when(plausibility < 0.40, confidence * 0.75).when(plausibility >= 0.70, F.least(F.lit(0.95), confidence * 1.05)).otherwise(confidence)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), out))


def line_mismatch(n_lines: Column, expected: Column) -> Column:
    """How far the lines read are from those expected, by the greater number; 0 where none are expected."""
    return F.when(F.coalesce(expected, F.lit(0)) <= 0, 0.0).otherwise(F.abs(n_lines - expected) / F.greatest(n_lines, expected))


def implausibility(ratio: Column) -> Column:
    """A contrast as 0 (as clean texts) to 1 (as shuffled letters)."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (CONTRAST_CLEAN - ratio) / (CONTRAST_CLEAN - 1.0))), 4)


def trigram_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(key_words(text), F.lit("(?=([a-z]{3}))"), F.lit(1)))


_LETTERS = ord("a")
_BITS = np.zeros(26**3, np.uint8)
for _k, _trigrams in enumerate(PROFILES.values()):
    for _t in _trigrams:
        _BITS[sum((ord(c) - _LETTERS) * 26**i for c, i in zip(_t, (2, 1, 0), strict=True))] |= 1 << _k
LONG_WORD, AT_ONCE = 24, 1 << 15  # letters of words whose draws are looked up; words shuffled at once
LONG_TEXT = 1 << 15  # letters of texts whose draws are looked up; the tables take 2 KB for each


class Draws:
    """What random.Random(seed).shuffle draws, for words of each length from each place of the stream. A stream of 32-bit numbers is
    one for all texts, and a draw under n takes its first one whose upper bits are less: tables say where a word's draws end."""

    def __init__(self, seed: int) -> None:
        kind, (*key, at), _ = random.Random(seed).getstate()
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint64), "pos": at}}
        self.stream = np.empty(0, np.uint32)
        self.after: dict[int, array] = {}

    def reach(self, most: int) -> None:
        """Tables from every place up to `most`."""
        if most + 1000 > len(self.stream):
            self.stream = np.concatenate([self.stream, self.bits.random_raw(max(1 << 15, len(self.stream), most + 1000 - len(self.stream))).astype(np.uint32)])
            size = len(self.stream)
            self.chosen, self.after, ends = {}, {}, np.arange(size + 1, dtype=np.int32)
            for n in range(2, LONG_WORD + 1):
                drawn = self.stream >> np.uint32(32 - n.bit_length())
                taken = np.where(drawn < n, np.arange(size, dtype=np.int32), np.int32(size - 1))
                first = np.minimum.accumulate(taken[::-1])[::-1]
                self.chosen[n] = first, drawn.astype(np.uint8)
                # a word of n letters draws under n, then as a word of n - 1 does
                ends = ends[np.append(first + 1, size)]
                self.after[n] = array("i", ends.tobytes())

    def starts(self, lengths: list[int]) -> list[int]:
        """Where the draws of each of a text's words begin, and where the last end."""
        out, at, after = [], 0, self.after
        for n in lengths:
            out.append(at)
            at = after[n][at]
        out.append(at)
        return out


_DRAWS: dict[int, Draws] = {}


def _mask_counts(letters: np.ndarray, texts: np.ndarray, out: np.ndarray) -> None:
    """Adds to out (texts x masks of profiles) the trigrams of words of one length."""
    codes = letters.astype(np.int32)
    masks = _BITS[codes[:, :-2] * 676 + codes[:, 1:-1] * 26 + codes[:, 2:]]
    wide = out.shape[1]
    out += np.bincount((texts[:, None] * wide + masks).ravel(), minlength=out.size).reshape(out.shape)


def _plain_shuffles(tokens: list[str], seed: int) -> list[str]:
    rng, mixed = random.Random(seed), []
    for t in tokens:
        letters = list(t)
        rng.shuffle(letters)
        mixed.append("".join(letters))
    return mixed


def contrasts_of(texts: list[list[str]]) -> list[list[float] | None]:
    """For each profile: the trigrams that a text's key words have, by those expected of shuffled letters; None for too few
    trigrams. A text's shuffles are those of random.Random of seeds 0 to 7, each from the beginning; words of all texts are
    shuffled together by their lengths."""
    wide = 1 << len(PROFILES)
    real, mixed = np.zeros((len(texts), wide), np.int64), np.zeros((len(texts), wide), np.int64)
    by_length: dict[int, tuple[list, list, list]] = {}
    sizes = [[len(t) for t in ts] for ts in texts]
    every = [sum(n) - 2 * len(n) for n in sizes]
    asked = [k for k, n in enumerate(every) if n >= LEAST_TRIGRAMS]
    short = {k for k in asked if sum(sizes[k]) <= LONG_TEXT and max(sizes[k]) <= LONG_WORD}
    for seed in range(SHUFFLES):
        if seed not in _DRAWS:
            _DRAWS[seed] = Draws(seed)
        _DRAWS[seed].reach(2 * max((sum(sizes[k]) for k in short), default=0))
    for k in asked:
        starts = [_DRAWS[seed].starts(sizes[k]) for seed in range(SHUFFLES)] if k in short else []
        if not starts or any(s[-1] >= len(_DRAWS[seed].stream) for seed, s in enumerate(starts)):
            _add_plain(texts[k], k, real, mixed)
            continue
        for t, n, at in zip(texts[k], sizes[k], zip(*[s[:-1] for s in starts], strict=True), strict=True):
            words, owners, places = by_length.setdefault(n, ([], [], []))
            words.append(t)
            owners.append(k)
            places.append(at)
    for n, (words, owners, places) in by_length.items():
        for i in range(0, len(words), AT_ONCE):
            letters = np.frombuffer("".join(words[i : i + AT_ONCE]).encode(), np.uint8).reshape(-1, n) - _LETTERS
            texts_of, at = np.array(owners[i : i + AT_ONCE]), np.array(places[i : i + AT_ONCE], np.int32)
            _mask_counts(letters, texts_of, real)
            rows = np.arange(len(letters))
            for seed in range(SHUFFLES):
                shuffled, place = letters.copy(), at[:, seed]
                for m in range(n, 1, -1):
                    first, drawn = _DRAWS[seed].chosen[m]
                    place = first[place]
                    j = drawn[place]
                    place = place + 1
                    shuffled[rows, j], shuffled[:, m - 1] = shuffled[:, m - 1].copy(), shuffled[rows, j]
                _mask_counts(shuffled, texts_of, mixed)
    out: list[list[float] | None] = [None] * len(texts)
    has = [[mask for mask in range(wide) if mask >> p & 1] for p in range(len(PROFILES))]
    for k in asked:
        n, total = every[k], int(mixed[k].sum())
        pairs = [(int(real[k, has[p]].sum()), int(mixed[k, has[p]].sum())) for p in range(len(PROFILES))]
        out[k] = [round((r + PSEUDO_HITS) / (n * c / total + PSEUDO_HITS), 4) for r, c in pairs]
    return out


def _add_plain(tokens: list[str], k: int, real: np.ndarray, mixed: np.ndarray) -> None:
    """A text with a very long word, or a very long text, word by word."""
    for words, out in [(tokens, real), *[(_plain_shuffles(tokens, seed), mixed) for seed in range(SHUFFLES)]]:
        for t in words:
            row = np.zeros((1, out.shape[1]), np.int64)
            _mask_counts(np.frombuffer(t.encode(), np.uint8)[None, :] - _LETTERS, np.zeros(1, np.int64), row)
            out[k] += row[0]


def contrast_of(words: str) -> list[float] | None:
    return contrasts_of([words.split()])[0]


PART = 1 << 20  # letters of texts shuffled together


def _contrast_rows(texts: list) -> pa.Array:
    out, held, size = [], [], 0
    for t in texts:
        held.append(W.key_words(t))
        size += sum(map(len, held[-1]))
        if size >= PART:
            out += contrasts_of(held)
            held, size = [], 0
    return pa.array(out + contrasts_of(held), pa.list_(pa.float64()))


#: An array of contrasts in the order of PROFILES; null for a text of fewer than 150 trigrams. Each text is its own seed's, so the
#: same text gives the same contrasts.
contrasts = W.mapped(_contrast_rows, "array<double>")


def lexical_contrast(contrasts: Column) -> Column:
    return F.array_max(contrasts)


def reads_as_latin(contrasts: Column) -> Column:
    """Whether the Latin contrast is well above the best French one; false for texts too short to tell."""
    french = F.array_max(F.slice(contrasts, 2, len(PROFILES) - 1))
    return F.coalesce(F.get(contrasts, F.lit(0)) >= LATIN_MARGIN * french, F.lit(False))


# Signs, what they stand for, and whole words that a bar can't resolve.
SIGNS = {
    "ꝑ": "per", "ꝓ": "pro", "ꝕ": "pro", "ꝗ": "qui", "ꝙ": "quod", "ꝛ": "r", "ꝝ": "rum", "ꝯ": "con", "ꝰ": "us", "ꝫ": "et", "ꝭ": "is", "⁊": "et", "ſ": "s", "ß": "ss", "ʒ": "z",
    "ͣ": "a", "ͤ": "e", "ͥ": "i", "ͦ": "o", "ͧ": "u", "ͨ": "c", "ͩ": "d", "ͪ": "h", "ͫ": "m", "ͬ": "r", "ͭ": "t", "ͮ": "v", "ͯ": "x",
}
SUSPENSIONS = {
    "dns": "dominus", "dni": "domini", "dno": "domino", "dnm": "dominum", "ihs": "iesus", "ihu": "iesu", "xps": "christus", "xpi": "christi", "xpo": "christo", "scs": "sanctus", "sci": "sancti", "sco": "sancto", "sca": "sancta",
    "eps": "episcopus", "epi": "episcopi", "nra": "nostra", "nri": "nostri", "nro": "nostro", "spu": "spiritu", "sps": "spiritus", "aplus": "apostolus", "oins": "omnis", "oim": "omnium", "oina": "omnia",
    "tnc": "tunc", "qnd": "quando", "qm": "quoniam", "qa": "quia", "ee": "esse", "ht": "habet", "hns": "habens",
}
NASALS = "̄̅̃"
_BAR = "\ue000"  # private: a bar that stands for a nasal


def expanded(text: Column, nasals: bool = True) -> Column:
    """Scribal signs as letters: signs and superscripts as what they stand for, a bar or tilde right above a Latin vowel as m
    before b, p and m, else as n (or left out). Other marks stay as they stand; null stays null."""
    out = text
    for v in "aeiouyAEIOUY":
        whole = "".join(c for m in NASALS if len(c := unicodedata.normalize("NFC", v + m)) == 1)
        out = F.regexp_replace(out, F.lit(f"{v}[{NASALS}]" + (f"|[{whole}]" if whole else "")), F.lit(v + _BAR))
    for sign, letters in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    if nasals:
        out = F.regexp_replace(out, F.lit(rf"{_BAR}(?=[\p{{M}}{_BAR}]*[bpmBPM])"), F.lit("m"))
    return F.replace(out, F.lit(_BAR), F.lit("n" if nasals else ""))


_NFC = {v: "".join(c for c in (unicodedata.normalize("NFC", v + m) for m in NASALS) if len(c) == 1) for v in "aeiouyAEIOUY"}
_BARRED = [(re.compile(f"{v}[{NASALS}]" + (f"|[{whole}]" if whole else "")), v + _BAR) for v, whole in _NFC.items()]


def _expanded_token(token: str, nasals: bool) -> str:
    """As expanded()."""
    for pattern, put in _BARRED:
        token = pattern.sub(put, token)
    for sign, letters in SIGNS.items():
        token = token.replace(sign, letters)
    if not nasals:
        return token.replace(_BAR, "")
    out = []
    for i, c in enumerate(token):
        if c == _BAR:
            follow = next((x for x in token[i + 1 :] if x != _BAR and unicodedata.category(x)[0] != "M"), "")
            c = "m" if follow and follow in "bpmBPM" else "n"
        out.append(c)
    return "".join(out)


def _search_words(token: str) -> tuple[str, ...]:
    if token.isascii():
        return tuple(SUSPENSIONS.get(w, w) for w in W.folded_words(token))
    whole, plain = W.folded_words(_expanded_token(token, True)), W.folded_words(_expanded_token(token, False))
    return tuple(SUSPENSIONS.get(p, SUSPENSIONS.get(t, t)) for t, p in zip(whole, plain, strict=True))


_SEARCH = W.Memo(_search_words)


def search_words(text: str | None) -> list[str]:
    if (text or "").isascii():
        return [SUSPENSIONS.get(w, w) for w in W.folded_words(text or "")]
    return [w for t in text.split() for w in _SEARCH[t]]


_KEYS = W.Memo(lambda token: " ".join(search_words(token)))


def word_key(word: str) -> str:
    """The search key of a word, found once."""
    return _KEYS[word]


def _search_rows(texts: list) -> pa.Array:
    return pa.array([" ".join(search_words(t)) for t in texts], pa.string())


#: A text's search key: signs expanded, orthography folded, and whole words that stand for others (dns: dominus).
search_key = W.mapped(_search_rows, "string")


def rejoined_by(text: Column, lexicon: list[str]) -> Column:
    """Lines put together at hyphens, and without one where the last word of a line and the first of the next make a word of
    the lexicon but neither is in it."""
    words = F.array(*map(F.lit, lexicon))
    bare = lambda w: F.lower(F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", ""))
    last = lambda line: F.coalesce(F.element_at(T.tokens(line), -1), F.lit(""))
    first = lambda line: F.coalesce(F.get(T.tokens(line), F.lit(0)), F.lit(""))

    def joins(a: Column, b: Column) -> Column:
        x, y = bare(last(a)), bare(first(b))
        return (F.length(x) >= 2) & (F.length(y) > 0) & ~F.array_contains(words, x) & ~F.array_contains(words, y) & F.array_contains(words, F.concat(x, y))

    rows = T.lines(T.rejoined(text))
    out = F.aggregate(rows, F.lit(None).cast("string"), lambda a, line: F.when(a.isNull(), line).otherwise(F.concat(F.when(joins(F.element_at(F.split(a, "\n"), -1), line), F.rtrim(a)).otherwise(F.concat(a, F.lit("\n"))), F.when(joins(F.element_at(F.split(a, "\n"), -1), line), F.ltrim(line)).otherwise(line))))
    return F.coalesce(out, F.lit(""))
