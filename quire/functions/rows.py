"""Text functions over Arrow batches. Built-in expressions look at every token of every text anew, through patterns; here what
depends on a token alone is computed once for each distinct one, so that a text costs its split and one look-up a token."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

SPACE = " \t\n\x0b\f\r"
#: White space to Python's split() that doesn't part tokens.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
_SPACES = re.compile(f"[{SPACE}]+")
_HYPHEN = re.compile("[-‐‑‒–­¬][ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*")
_RARE, _VOWELS, _FUNCTION_WORDS = frozenset(T.RARE_BIGRAMS), frozenset(T.VOWELS), frozenset(T.FUNCTION_WORDS)
_UNVOICED = str.maketrans(dict.fromkeys(T.VOWELS, " "))


class Memo(dict):
    """f(x) of each distinct x, computed once; emptied when it holds `most`. Long ones aren't held."""

    def __init__(self, f: Callable, most: int = 1 << 17) -> None:
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, x: str) -> object:
        value = self.f(x)
        if len(x) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[x] = value
        return value


def mapped(f: Callable[[list], pa.Array], kind: str) -> Callable[..., Column]:
    """A column function from f, which takes the lists of values of its columns and gives an Arrow array. f is a function of a
    module."""

    def make(*columns: Column) -> Column:
        if len(columns) == 1:

            def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for x in batches:
                    yield f(x.to_pylist())

            of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        else:

            def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for xs in batches:
                    yield f(*[x.to_pylist() for x in xs])

            of.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(of, kind)(*columns)

    return make


def doubles(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{n}: double" for n in names) + ">"


def structs(names: tuple[str, ...], rows: list[tuple]) -> pa.Array:
    """An array of structs of doubles."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(names))


def splitter(text: str) -> Callable[[str], list[str]]:
    """What parts a text, or lines of it, into tokens."""
    return by_pattern if any(c in text for c in ODD_SPACE) else str.split


def by_pattern(text: str) -> list[str]:
    return [t for t in _SPACES.split(text) if t]


def full_lines(text: str) -> list[str]:
    return [x for x in (x.strip(SPACE) for x in text.split("\n")) if x]


def n_letters(token: str) -> int:
    return sum(map(str.isalpha, token))


def letter_run(text: str) -> int:
    """The longest run of letters."""
    best = run = 0
    for c in text:
        run = run + 1 if c.isalpha() else 0
        best = max(best, run)
    return best


# Signals of a report
SIGNALS = ("char_entropy", "non_wordlike_frac", "rare_bigram_ratio", "uncertainty_density", "repetition_score", "leading_fragment_ratio", "trailing_fragment_ratio")


def token_signals(token: str) -> tuple[int, int, int, int]:
    """Pairs of adjacent letters, rare ones, whether a token has three characters or more, and whether such a token is no word."""
    low, n = token.lower(), len(token)
    count, pairs = n_letters(low), sum(a.isalpha() and b.isalpha() for a, b in zip(low, low[1:], strict=False))
    rare = sum(low[i : i + 2] in _RARE for i in range(len(low) - 1))
    if n < 3:
        return pairs, rare, 0, 0
    share = sum(c in _VOWELS for c in low) / count if count else 0.0
    signs = min(0.3, (len(low) - count) / len(low)) if count else 0.0
    odd = 0.30 if share < 0.12 else 0.15 if share < 0.18 else 0.20 if share > 0.80 else 0.0
    run = letter_run(low.translate(_UNVOICED))
    runs = 0.0 if run < 4 else 0.35 if run >= 5 else 0.15
    seldom = rare / pairs * 0.5 if count >= 4 and rare and pairs else 0.0
    return pairs, rare, 1, int(min(1.0, signs + odd + runs + seldom) > 0.45)


_TOKENS = Memo(token_signals)


def entropy(text: str) -> float:
    if not text:
        return 0.0
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(at) if at.max() < 1 << 14 else np.unique(at, return_counts=True)[1]
    p = np.sort(counts[counts > 0]) / len(text)
    return -sum((p * np.log2(p)).tolist())


def uncertainty(text: str) -> float:
    return (text.count("?") + text.count("…") + 3 * text.count("[…]")) / len(text) if text else 0.0


def repetition(rows: list[str], words: list[list[str]], n: int = 5) -> float:
    """See text.repetition_score; rows: the lines that aren't blank, and the words of each."""
    count, covered = sum(map(len, words)), 0.0
    repeated = (len(rows) - len(set(rows))) / len(rows) if len(rows) >= 3 else 0.0
    if count >= 3 * n:
        times = Counter(chain.from_iterable(zip(*[w[k:] for k in range(n)], strict=False) for w in words))
        top = max(times.values(), default=0)
        covered = min(1.0, top * n / count) if top > 1 else 0.0
    return min(1.0, max(repeated, covered))


def begins_broken(words: list[str]) -> bool:
    first = words[0]
    if first[0] in "-–—":
        return True
    if len(first) > 2 or not first.isalpha() or first.lower() in _FUNCTION_WORDS:
        return False
    upper = unicodedata.category(first[0]) == "Lu"
    if len(first) == 2:
        return not upper
    if upper and len(words) > 1 and unicodedata.category(words[1][0]) == "Ll":
        return False
    return not any(c in _VOWELS for c in first.lower())


def ends_broken(line: str, last: str) -> bool:
    return line.endswith("-") or (len(line) >= 2 and len(last) == 1 and last.isalpha() and not any(c in _VOWELS for c in last.lower()))


def report_of(text: str | None) -> tuple[float, ...]:
    text = text or ""
    split = splitter(text)
    rows = full_lines(text)
    words = [split(x) for x in rows]
    pairs = rare = long = odd = 0
    for t, c in Counter(chain.from_iterable(words)).items():
        a, b, d, e = _TOKENS[t]
        pairs += a * c
        rare += b * c
        long += d * c
        odd += e * c
    share = lambda a, b: a / b if b else 0.0
    leading, trailing = sum(map(begins_broken, words)), sum(ends_broken(x, w[-1]) for x, w in zip(rows, words, strict=True))
    return entropy(text), share(odd, long), share(rare, pairs), uncertainty(text), repetition(rows, words), share(leading, len(rows)), share(trailing, len(rows))


def report_rows(texts: list) -> pa.Array:
    return structs(SIGNALS, [report_of(t) for t in texts])


def non_wordlike_rows(texts: list) -> pa.Array:
    out = []
    for t in texts:
        long = odd = 0
        for x, c in Counter(splitter(t or "")(t or "")).items():
            _, _, a, b = _TOKENS[x]
            long += a * c
            odd += b * c
        out.append(odd / long if long else 0.0)
    return pa.array(out, pa.float64())


def repetition_rows(texts: list) -> pa.Array:
    out = []
    for t in texts:
        rows, split = full_lines(t or ""), splitter(t or "")
        out.append(repetition(rows, [split(x) for x in rows]))
    return pa.array(out, pa.float64())


#: A struct of a text's signals, each a double.
report = mapped(report_rows, doubles(SIGNALS))
non_wordlike_frac = mapped(non_wordlike_rows, "double")
repetition_score = mapped(repetition_rows, "double")


# Quality of tokens, in hundredths, so that means on a limit are exact
_NO_WORD = Memo(lambda token: "".join(c if c.isalnum() or c == "_" or c in SPACE else " " for c in token))


def token_quality(token: str) -> int:
    low, n = token.lower(), len(token)
    vowels = sum(c in _VOWELS for c in low)
    score = 50 + (-20 if n < 3 else 15 if n <= 20 else -10)
    score += 20 if 0.25 <= vowels / n <= 0.65 else 5 if 0.15 <= vowels / n <= 0.80 else -25
    run = letter_run(low.translate(_UNVOICED))
    score += -35 if run >= 4 else -5 if run == 3 else 0
    return max(0, min(100, score + (10 if low.isalpha() else -15)))


def _qualities(token: str) -> tuple[int, int, int]:
    """How many words a token holds between signs, their qualities' sum, and how many are low."""
    scores = [token_quality(w) for w in by_pattern(_NO_WORD[token]) if len(w) >= 2]
    return len(scores), sum(scores), sum(s < 30 for s in scores)


_QUALITIES = Memo(_qualities)


def quality_rows(texts: list) -> pa.Array:
    out = []
    for t in texts:
        n = total = low = 0
        for x, c in Counter(splitter(t or "")(t or "")).items():
            a, b, d = _QUALITIES[x]
            n += a * c
            total += b * c
            low += d * c
        out.append((total / (100 * n) if n else 0.0, low / n if n else 0.0, float(n)))
    return structs(("avg", "low", "n"), out)


token_qualities = mapped(quality_rows, doubles(("avg", "low", "n")))


# Folded words
_ACCENTS = str.maketrans("jv" + "".join(T.ACCENTED), "iu" + "".join(T.ACCENTED.values()).translate(str.maketrans("jv", "iu")), T.MARKS)
_NO_ALNUM = re.compile(r"[\W_]+")


_LATIN = bytes(ord(c) if c.isalnum() else 32 for c in (chr(k).translate(_ACCENTS) for k in range(256)))


def folded_words(text: str) -> list[str]:
    """The words of text.folded."""
    out = text.lower()
    try:
        # bytes are folded by a table
        low = out.encode("latin-1")
    except UnicodeEncodeError:
        out = out.replace("æ", "e").replace("œ", "e").replace("ae", "e").replace("oe", "e").translate(_ACCENTS).replace("w", "uu")
        return _NO_ALNUM.sub(" ", out).split()
    low = low.replace(b"\xe6", b"e").replace(b"ae", b"e").replace(b"oe", b"e").translate(_LATIN).replace(b"w", b"uu")
    return low.decode("latin-1").split()


def rejoined(text: str) -> str:
    return _HYPHEN.sub("", text) if "\n" in text else text


def word_grams(word: str) -> list[str]:
    """The terms that text.search_terms has of a folded word."""
    if len(word) == 1:
        return [f" {word} "]
    apart = f" {word} "
    return [apart[i : i + 4] for i in range(len(apart) - 3)]


def word_terms(text: str | None) -> list[str]:
    return folded_words(rejoined(text or ""))


# Language profiles
def key_words(text: str | None) -> list[str]:
    """The words of lexicon.key_words."""
    return [w for w in word_terms(text) if len(w) >= 3 and w.isascii() and w.isalpha()]


def trigrams_in(profiles: dict[str, list[str]]) -> Callable[[str], tuple[int, ...]]:
    """How many trigrams a key word has, and how many of them each profile has."""
    known = [frozenset(p) for p in profiles.values()]

    def of(word: str) -> tuple[int, ...]:
        grams = [word[i : i + 3] for i in range(len(word) - 2)]
        return len(grams), *[sum(g in k for g in grams) for k in known]

    return of


def by_line(text: str) -> list[list[str]]:
    """The tokens of every line, blank ones too."""
    split = splitter(text)
    return [split(x) for x in text.split("\n")]
