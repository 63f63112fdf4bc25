"""What models reply, brought to plain text; names of languages and scripts; labels that hold text. All in a row, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Names, aliases, marks and words.
LANGUAGES = (
    "latin", "old_english", "middle_english", "french", "old_french", "middle_french", "anglo_norman", "occitan", "old_high_german", "middle_high_german", "german", "dutch", "italian", "spanish",
    "portuguese", "catalan", "church_slavonic", "greek", "hebrew", "arabic", "mixed", "unknown",
)
LANGUAGE_CODES = {
    "la": "latin", "fr": "french", "fro": "old_french", "frm": "middle_french", "enm": "middle_english", "ang": "old_english", "de": "german", "it": "italian", "es": "spanish", "pt": "portuguese",
    "nl": "dutch", "ca": "catalan", "oc": "occitan", "he": "hebrew", "ar": "arabic", "el": "greek",
}
SCRIPT_NAMES = {"latin_medieval": "latin", "insular_old_english": "unknown"}
FOREIGN = "[Ͱ-ϿЀ-ӿ぀-ヿ㐀-䶿一-鿿豈-﫿]"
ECHO_LEAST = 12
FRENCH_ANCHORS = ("tres", "tresreuerend", "pere", "euesque", "eusque", "prince", "lausanne", "laufanne", "grace", "considerat", "desirs", "chapellain", "seruiteur", "approchant")
FRENCH_FUNCTION = ("que", "et", "de", "la", "le", "des")
FRENCH_OLD = ("pur", "ki", "mei", "sun", "uostre", "nostre", "cil", "cest", "dunc")
FRENCH_MIDDLE = ("approchant", "considerat", "grace", "mille", "cens", "chapellain", "seruiteur", "desirs", "lausanne", "prince", "pere")
ANGLO_NORMAN = ("anglo", "norman", "normand", "engleterre")
LATIN_ANCHORS = ("domini", "amen", "quod", "canonici", "capitulum", "instrumentum", "publicum", "consensu", "confirmamus", "perpetuo")
EVIDENCE_TAGS = {"ocr_chunk_evidence": r"\[(?:OCR_CHUNK_EVIDENCE|EVIDENCE)\]", "linked_entity_evidence": r"\[LINKED_ENTITY_EVIDENCE\]", "unresolved_mention_evidence": r"\[UNRESOLVED_MENTION_EVIDENCE\]"}
E5_TASK = "Given a question, retrieve passages that answer it"


def detected_language(value: Column) -> Column:
    """A language's name from a name or code; unknown for others and null."""
    low = F.replace(F.replace(F.lower(F.trim(F.coalesce(value, F.lit("unknown")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return T.once(F.coalesce(F.element_at(table, low), low), lambda n: F.when(n.isin(*LANGUAGES), n).otherwise("unknown"))


def script_hint(value: Column) -> Column:
    """A script's name as reports use it."""
    low = F.lower(F.trim(F.coalesce(value, F.lit("unknown"))))
    table = F.create_map(*[F.lit(x) for pair in SCRIPT_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(table, low), low)


def detected_script(text: Column) -> Column:
    """unknown for other scripts and for no letters, insular by its letters or a lone 7, else medieval Latin."""
    t = T.text_or_empty(text)
    return F.when(t.rlike(FOREIGN), "unknown").when(t.rlike("[þðƿÞÐǷ]") | t.rlike("(?<![0-9])7(?![0-9])"), "insular_old_english").when(t.rlike("[A-Za-zÀ-ÿ]"), "latin_medieval").otherwise("unknown")


def _language_tokens(cleaned: Column) -> Column:
    return T.tokens(F.translate(F.lower(cleaned), "ſvj", "sui"))


def french_family(cleaned: Column) -> Column:
    """anglo_norman, old_french or middle_french for a cleaned text with two strong words, or one and two function words; null
    for other texts."""

    def of(ts: Column) -> Column:
        among = lambda words: F.size(F.filter(ts, lambda t: t.isin(*words)))
        strong = F.size(F.filter(ts, lambda t: t.rlike("^(" + "|".join(FRENCH_ANCHORS) + ")")))
        french = (strong >= 2) | ((strong >= 1) & (among(FRENCH_FUNCTION) >= 2))
        kind = F.when(among(ANGLO_NORMAN) >= 2, "anglo_norman").when((among(FRENCH_OLD) >= 2) & (among(FRENCH_MIDDLE) == 0), "old_french").otherwise("middle_french")
        return F.when(french, kind)

    return T.once(_language_tokens(T.text_or_empty(cleaned)), of)


def latin_anchors(cleaned: Column) -> Column:
    return F.size(F.array_intersect(_language_tokens(T.text_or_empty(cleaned)), F.array(*map(F.lit, LATIN_ANCHORS))))


def fallback_language(script: Column, text: Column) -> Column:
    """A language by letters, French words and script, where none was detected; Latin in the end, unknown for a blank text."""
    t, low = T.text_or_empty(text), F.lower(F.coalesce(script, F.lit("unknown")))
    by_script = F.when(low == "greek", "greek").when(low == "cyrillic", "church_slavonic").when(low == "mixed", "mixed").otherwise("latin")
    out = F.coalesce(french_family(T.langid_text(t, 0)), by_script)
    return F.when(T.stripped(t) == "", "unknown").when(t.rlike("[þðƿÞÐǷ]"), "old_english").when(t.rlike("[؀-ۿ]"), "arabic").when(t.rlike("[֐-׿]"), "hebrew").otherwise(out)


def sanitized_reply(raw: Column) -> Column:
    """A reply as plain text: without fences and quotes; of an object its text, transcription, content or output, else nothing;
    nothing for a reply that says there is no text."""
    text = T.stripped(T.text_or_empty(raw))
    bare = T.stripped(F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))
    text = F.when(text.startswith("```"), bare).otherwise(text)
    quoted = (F.length(text) >= 2) & (text.rlike('(?s)^".*"$') | text.rlike("(?s)^'.*'$"))
    text = F.when(quoted, T.stripped(F.substring(text, F.lit(2), F.greatest(F.lit(0), F.length(text) - 2)))).otherwise(text)
    keys = F.coalesce(*[T.stripped(F.get_json_object(text, f"$.{k}")) for k in ("text", "transcription", "content", "output")], F.lit(""))
    is_json = F.try_parse_json(text).isNotNull()
    told = F.when(text.startswith("{") & is_json, keys).when(text.startswith("[") & is_json, "").otherwise(text)
    return F.when(F.lower(T.text_or_empty(raw)).rlike("no readable text|nothing readable|return an empty string"), "").otherwise(told)


def normalized_line(line: Column, latin_only: bool = True) -> Column:
    """A line without controls, marks of uncertainty alike, long runs of ? as […], letters of other scripts as ?, white space
    collapsed."""
    out = T.uncertainty_tokens(F.regexp_replace(T.text_or_empty(line), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))
    out = F.regexp_replace(out, r"\?{6,}", "[…]")
    out = F.regexp_replace(out, FOREIGN, "?") if latin_only else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalized_lines(text: Column, latin_only: bool = True) -> Column:
    """A struct: lines that are neither blank, nor junk, nor about the model itself; warnings; the share of characters replaced."""
    raw = T.lines(text)
    told = F.transform(raw, lambda x: F.struct(T.has_meta_text(x).alias("meta"), normalized_line(x, latin_only).alias("x"), F.regexp_count(x, F.lit(FOREIGN)).alias("n")))

    def of(rows: Column) -> Column:
        real = F.filter(rows, lambda r: ~r["meta"])
        junk = F.filter(real, lambda r: (r["x"] != "") & T.pattern_junk(r["x"]))
        kept = F.transform(F.filter(real, lambda r: (r["x"] != "") & ~T.pattern_junk(r["x"])), lambda r: r["x"])
        replaced = F.aggregate(real, F.lit(0), lambda a, r: a + r["n"]) if latin_only else F.lit(0)
        size = F.aggregate(real, F.lit(0), lambda a, r: a + F.greatest(F.lit(1), F.length(r["x"])))
        warnings = F.array_compact(F.array(F.when(F.size(F.filter(rows, lambda r: r["meta"])) > 0, "meta_text_removed"), F.when(F.size(junk) > 0, "pattern_junk_removed"), F.when(replaced > 0, "non_latin_chars_replaced")))
        return F.struct(kept.alias("lines"), warnings.alias("warnings"), (replaced / F.greatest(size, F.lit(1))).alias("replaced"))

    return T.once(told, of)


def _echo_key(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", ""), r"\s+", " "))
    return F.lower(F.regexp_replace(bare, r"[.:;]+$", ""))


def without_echo(text: Column, prompt: Column) -> Column:
    """text (without lines copied from the prompt, whole or from their beginning on, whatever their bullets) and removed."""
    asked = F.filter(F.transform(T.lines(prompt), _echo_key), lambda k: k != "")
    copied = lambda k: (k != "") & F.exists(asked, lambda p: (p == k) | ((F.length(k) >= ECHO_LEAST) & p.startswith(k)))
    rows = T.lines(text)
    return T.once(F.filter(rows, lambda x: ~copied(_echo_key(x))), lambda kept: F.struct(T.stripped(F.array_join(kept, "\n")).alias("text"), (F.size(rows) - F.size(kept)).alias("removed")))


def evidence_tags(text: Column) -> Column:
    return F.struct(*[F.regexp_count(T.text_or_empty(text), F.lit(p)).alias(n) for n, p in EVIDENCE_TAGS.items()])


def evidence_block(run: Column, ref: Column, chunk: Column, start: Column, end: Column, similarity: Column, text: Column) -> Column:
    """A chunk as the block that a model is shown."""
    n = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    score = F.coalesce(similarity.cast("string"), F.lit("n/a"))
    parts = ("[OCR_CHUNK_EVIDENCE]\nrun_id: ", n(run), "\nasset_ref: ", n(ref), "\nchunk_id: ", n(chunk), "\noffsets: ", n(start), "-", n(end), "\nretrieval_score: ", score, "\ntext: ", n(text), "\n[/OCR_CHUNK_EVIDENCE]")
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def query_terms(text: Column) -> Column:
    """The distinct words of a to z and digits that have two characters or more."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(T.text_or_empty(text)), F.lit("[a-z0-9]{2,}"), F.lit(0))))


def embedding_input(text: Column, model: Column, task: str = E5_TASK) -> Column:
    """What is embedded for a query: instructed models get the task before it; passages stay as they are."""
    return F.when(F.lower(model).rlike("e5.*instruct"), F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)).otherwise(text)


def is_text_label(label: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether a region's label stands for text: what is left out goes before what is let in."""
    low = F.lower(F.trim(T.text_or_empty(label)))
    has = lambda words: low.rlike("|".join(words))
    return (low != "") & ~has(exclude) & has(include)


def has_entity_cues(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether a text has one of the words that names stand beside."""
    words = F.regexp_extract_all(F.lower(T.text_or_empty(text)), F.lit(r"[\p{L}\p{M}'’\-]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, cues)))


def unresolved_display_type(kind: Column, reason: Column) -> Column:
    """How an unresolved mention's type is shown: a place with little evidence is told apart."""
    low, r = F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit("unknown")), T.text_or_empty(reason)
    weak = (low == "place") & r.contains("low_evidence_place")
    return F.when(weak & r.contains("lexical=True"), "lexical/unknown").when(weak & r.contains("context=False"), "possible_place_unresolved").otherwise(low)


def repaired(lines: Column, text: Column) -> Column:
    """A struct of lines and text that agree: line breaks inside lines part them, and a text that is missing or other than its
    lines is made from them, lines from the text where there are none."""
    split = F.filter(F.flatten(F.transform(F.coalesce(lines, F.array().cast("array<string>")), T.lines)), lambda x: T.stripped(x) != "")
    return T.once(split, lambda s: F.struct(F.when(F.size(s) > 0, s).otherwise(F.filter(T.lines(text), lambda x: T.stripped(x) != "")).alias("lines"), F.when(F.size(s) > 0, F.array_join(s, "\n")).otherwise(T.text_or_empty(text)).alias("text")))
