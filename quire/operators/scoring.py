"""Scores of candidates for mentions, and the evidence on which a mention is taken for a name or a place.

Similarities come as columns, so that they are computed once; the rest is expressions of a row and one window a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.linking import composite_score

# Weights, priors, types and words that must be these for equal results.
SOURCE_CONFIDENCE = {"wikidata": 1.0, "viaf": 0.92, "geonames": 0.95}
OTHER_SOURCE = 0.8
CHRONOLOGY = ("medieval", "arthurian", "saint", "abbey", "monastery", "diocese")
NAME_ITEMS = ("given name", "family name", "surname", "prénom", "nom de famille")
DOMAIN = (
    "arthurian", "round table", "table ronde", "chevalier", "knight", "grail", "graal", "camelot", "legendary", "fictional character", "literary character", "mythological",
    "legendary king", "queen consort", "medieval", "chrétien", "troyes", "lancelot", "perceval", "galahad", "gawain", "gauvain", "tristan", "merlin", "guinevere",
)
KNOWN_PLACES = (
    "lausanne", "paris", "lyon", "rome", "avignon", "geneve", "genève", "camelot", "logres", "bretagne", "cornouailles", "gaules", "tintagel", "carduel", "carlion",
    "winchester", "londres", "jérusalem", "jerusalem", "constantinople", "acre", "norgales", "gorre", "sarras", "benoic", "gaule",
)
NO_PLACES = (
    "enfant", "enfans", "enfants", "vilanie", "vilenie", "villanie", "amor", "amour", "courtoisie", "felonie", "honte", "honor", "honneur", "merci", "paor", "peor", "peur", "proece",
    "proesce", "chevalerie",
)
BEFORE_PLACES = (
    "a", "a la", "au", "aux", "as", "en", "vers", "sur", "sor", "de la cite de", "de la ville de", "del pais de", "du pais de", "en la cite de", "en la ville de",
)
LOCATIVES = ("a", "au", "aux", "en", "vers", "sur", "sor", "devers", "lez", "pres")
PLACE_WORDS = ("cite", "ville", "castel", "chastel", "pais", "pays", "terre", "roiaume", "reaume", "contree", "abbaye", "monastere", "eglise", "diocese")
NAME_QIDS = ("Q202444", "Q101352", "Q12308941", "Q11879590", "Q4167410")
TYPES = {
    "person": ("Q5", "Q15632617", "Q95074", "Q3658341", "Q15773317", "Q15773347", "Q4271324", "Q21070568", "Q14073567"),
    "place": ("Q515", "Q486972", "Q6256", "Q35657", "Q3024240", "Q82794", "Q23442", "Q46831", "Q8502", "Q4022", "Q618123", "Q2221906", "Q1549591", "Q3957", "Q532", "Q5119", "Q56061", "Q15642541"),
    "org": ("Q43229", "Q4830453", "Q3918", "Q9174", "Q1530022"),
    "work": ("Q7725634", "Q571", "Q47461344", "Q11424", "Q5398426"),
    "title": ("Q7725634", "Q571", "Q47461344"),
    "event": ("Q1190554", "Q178561", "Q198"),
}
NAME_VOWELS = "aeiouyàâäéèêëïîôùûüœæ"


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def source_confidence(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(OTHER_SOURCE))


def base_score(label: Column, alias: Column, typed: Column, context: Column, domain_bonus: Column) -> Column:
    """The weighted sum of similarities and bonuses: a candidate of the wrong type gets no type bonus and loses 0.30."""
    domain = F.when(domain_bonus > 0, F.least(F.lit(1.0), domain_bonus / 0.20)).otherwise(0.0)
    return composite_score(label, unit(F.coalesce(alias, F.lit(0.0))), typed.cast("double"), context, domain, (~typed).cast("double"))


def label_prior(source: Column, kind: Column, label: Column) -> Column:
    """A small prior for sources that fit a mention's type, or labels that name one."""
    named = F.coalesce(F.lower(label).rlike("^(person|place|work)"), F.lit(False))
    return F.when((source == "geonames") & (kind == "place"), 0.04).when((source == "viaf") & kind.isin("person", "work"), 0.03).when(named, 0.02).otherwise(0.0)


def final_score(base: Column, source: Column, confidence: Column, prior: Column, together: Column, description: Column) -> Column:
    """0.88 of the base and 0.12 of the source's confidence (null: by source), with the label prior, 0.05 for a name that is
    resolved already beside it and 0.03 for a description of the period; 4 digits, 0 to 1."""
    sure = F.coalesce(F.nullif(confidence, F.lit(0.0)), source_confidence(source))
    score = base * 0.88 + sure * 0.12 + prior + F.when(together, 0.05).otherwise(0.0) + F.when(_has(description, CHRONOLOGY), 0.03).otherwise(0.0)
    return unit(F.round(score, 4))


def rescore_with_canonical(candidates: DataFrame, mention: str = "mention_id") -> DataFrame:
    """candidates with score and type_compatible once their mention's name is known: items that are names alone get 0.10 at most
    and don't fit; near labels of the right type (0.95, or 0.85 with a description of the domain) are lifted together, by what
    the best of them lacks to its floor. candidates: mention, score, label_similarity, type_compatible, description, and
    canonical (null: the mention has no known name, nothing changes)."""
    known, typed = F.col("canonical").isNotNull(), F.coalesce("type_compatible", F.lit(False))
    name, hit, near = _has(F.col("description"), NAME_ITEMS), _has(F.col("description"), DOMAIN), F.col("label_similarity")
    floor = F.when(~known | name | ~typed, None).when(near >= 0.95, F.when(hit, 0.92).otherwise(0.90)).when((near >= 0.85) & hit, 0.88)
    every = candidates.withColumn("_floor", floor)
    best = F.max_by(F.struct("score", "_floor"), F.when(F.col("_floor").isNotNull(), F.struct("score", "_floor"))).over(Window.partitionBy(mention))
    lifted = every.withColumn("_best", best).withColumn("_lift", F.greatest(F.lit(0.0), F.col("_best._floor") - F.col("_best.score")))
    score = F.when(known & name, F.least("score", F.lit(0.10))).when(F.col("_floor").isNotNull(), F.least(F.lit(1.0), F.col("score") + F.col("_lift"))).otherwise(F.col("score"))
    return lifted.withColumns({"score": score, "type_compatible": F.when(known & name, False).otherwise(F.col("type_compatible"))}).drop("_floor", "_best", "_lift")


def is_type_compatible(kind: Column, qids: Column, description: Column, accept: tuple[str, ...] = DOMAIN) -> Column:
    """Whether what a candidate is an instance of fits a mention's type. A type that isn't known fits all. Items that are names
    never fit a person; without any instance nothing fits, but a person whose description is of the domain."""
    low, ids = F.lower(kind), F.coalesce(qids, F.array().cast("array<string>"))
    table = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.element_at(table, low)
    person = (low == "person") & _has(description, accept) & ~_has(description, NAME_ITEMS)
    names = (low == "person") & F.arrays_overlap(ids, F.array(*map(F.lit, NAME_QIDS)))
    return F.when(wanted.isNull(), True).when(names, False).when(F.arrays_overlap(wanted, ids), True).otherwise(person)


def name_likeness(surface: Column, known: Column, near_known: Column, stop: tuple[str, ...]) -> Column:
    """0 to 1, how much a surface looks like a name: 1 for a known one, 0.90 near one, else the mean over its words of length,
    vowels and consonants, a little more for two good words; 0.05 for stop words alone, 0 for none."""
    words = T.tokens(F.regexp_replace(F.lower(T.text_or_empty(surface)), r"[^\p{L}\p{N}_\s]", " "))

    def score(w: Column) -> Column:
        n = F.length(w)
        rest = F.translate(w, NAME_VOWELS, " " * len(NAME_VOWELS))
        vowels = (n - F.length(F.translate(w, NAME_VOWELS, ""))) / n
        s = F.lit(0.5) - F.when((n < 3) | (n > 20), 0.30).otherwise(0.0)
        s = s + F.when((vowels < 0.15) | (vowels > 0.85), -0.30).when(vowels.between(0.25, 0.65), 0.15).otherwise(0.0)
        return F.greatest(F.lit(0.0), s - F.when(rest.rlike("[^ ]{4}"), 0.35).otherwise(0.0))

    def rated(scores: Column) -> Column:
        good = F.size(F.filter(scores, lambda s: s > 1e-9))
        avg = T.mean(scores) + F.when(good >= 2, 0.10).otherwise(0.0)
        return F.when(F.size(scores) == 0, 0.05).otherwise(F.round(unit(avg), 3))

    content = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    return F.when(F.size(words) == 0, 0.0).when(known, 1.0).when(near_known, 0.90).otherwise(T.once(F.transform(content, score), rated))


def has_place_context(surface: Column, evidence: Column) -> Column:
    """Whether folded evidence has a folded surface behind words that places follow: a preposition right before it or up to three
    words earlier, or a word for a place with de, del, du or des."""
    literal = F.regexp_replace(surface, r"([^\p{L}\p{N}_ ])", r"\\$1")
    padded = F.concat(F.lit(" "), evidence, F.lit(" "))
    near = padded.contains
    right = F.lit(False)
    for w in BEFORE_PLACES:
        right = right | near(F.concat(F.lit(f" {w} "), surface, F.lit(" ")))
    locative = F.regexp_like(padded, F.concat(F.lit(rf"\b(?:{'|'.join(LOCATIVES)})\b(?:\s+\w+){{0,3}}\s+"), literal, F.lit(r"\b")))
    headed = F.regexp_like(padded, F.concat(F.lit(rf"\b(?:{'|'.join(PLACE_WORDS)})\b(?:\s+\w+){{0,2}}\s+(?:de|del|du|des)\s+"), literal, F.lit(r"\b")))
    return F.coalesce((surface != "") & (F.trim(evidence) != "") & (right | locative | headed), F.lit(False))


def deferred_reason(surface: Column, kind: Column, context_ok: Column, reason: Column) -> Column:
    """The reason a mention waits, with what speaks against a place where little speaks for one."""
    low, given = F.lower(surface), F.trim(T.text_or_empty(reason))
    capital, lexical = surface.rlike(r"^\p{Lu}"), low.isin(*NO_PLACES)
    shape = (F.length(low) >= 4) & (T.token_quality_score(low) >= 0.45 - 1e-9)
    yes = lambda c: F.when(c, "True").otherwise("False")
    suffix = F.concat(F.lit("low_evidence_place: cap="), yes(capital), F.lit(" context="), yes(context_ok), F.lit(" lexical="), yes(lexical), F.lit(" shape="), yes(shape))
    sound = low.isin(*KNOWN_PLACES) | ((capital | context_ok) & ~lexical & shape)
    return F.when((F.lower(kind) != "place") | (low == "") | sound, given).when(given == "", suffix).when(given.contains(suffix), given).otherwise(F.concat(given, F.lit("; "), suffix))


def summarised_reason(reason: Column, surface: Column, kind: Column) -> Column:
    """A reason as a reader is told it; an unknown one in its first 120 characters."""
    r, low = F.trim(T.text_or_empty(reason)), F.lower(F.trim(T.text_or_empty(surface)))
    lexical = low.isin(*NO_PLACES) | r.contains("lexical=True")
    return (
        F.when(r == "", "no reliable authority match")
        .when(r.contains("low_evidence_place") & lexical, "insufficient evidence to treat this lexical item as a place")
        .when(r.contains("low_evidence_place"), "insufficient contextual evidence to support place linking")
        .when(r.contains("token_search_allowed=False"), "linking deferred because the passage quality was too risky for reliable authority lookup")
        .when(r.contains("name_likeness="), "surface form is too noisy for reliable authority lookup")
        .when(r == "no wikidata candidates", "no reliable authority candidate found")
        .when(r == "no candidate marked as selected", "no candidate met the selection threshold")
        .when(r == "marked ambiguous", "multiple candidates remained ambiguous")
        .when((F.lower(kind) == "date") & r.contains("date"), "date detected but not authority-linked")
        .otherwise(F.substring(r, 1, 120))
    )


def unresolved_type(kind: Column) -> Column:
    """How an unresolved mention's type is shown."""
    return F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit("unknown"))


def context_window(text: Column, start: Column, end: Column, radius: int = 40) -> Column:
    """The text from `radius` characters before a span to as many after it, trimmed."""
    first = F.greatest(F.lit(0), start - radius)
    return F.trim(F.substring(text, first + 1, F.least(F.length(text), end + radius) - first))


def built_context(text: Column, start: Column, end: Column, chunk: Column, window: int = 200) -> Column:
    """A span's wide window, and its chunk where that isn't part of it."""
    near = context_window(text, start, end, window)
    more = T.text_or_empty(chunk)
    return F.when((more == "") | near.contains(more), near).otherwise(F.concat(near, F.lit(" "), more))


def name_similarity(label: Column, alias: Column) -> Column:
    """The greater of label and alias similarity; 1 where neither was measured."""
    return F.when(label.isNull() & alias.isNull(), 1.0).otherwise(F.greatest(F.coalesce(label, F.lit(0.0)), F.coalesce(alias, F.lit(0.0))))


def parsed_note(notes: Column, name: str) -> Column:
    """A number that notes give as name=…; null if there is none."""
    return F.nullif(F.regexp_extract(T.text_or_empty(notes), rf"\b{name}=([0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")


def parsed_canonical(notes: Column) -> Column:
    return F.nullif(F.regexp_extract(T.text_or_empty(notes), r"\bcanonical=([^\s;,]+)", 1), F.lit(""))


def similarity(distance: Column, missing: Column | None = None) -> Column:
    """1 - distance in 4 digits; `missing` (null) without one."""
    return F.coalesce(F.round(1 - distance, 4), missing if missing is not None else F.lit(None).cast("double"))


def preferred_language(values: Column, order: tuple[str, ...] = ("en", "fr", "de")) -> Column:
    """Of a map from language to text the first of `order` that isn't blank, else the first of its own; null for none."""
    found = F.coalesce(*[F.nullif(F.trim(F.element_at(values, x)), F.lit("")) for x in order])
    return F.coalesce(found, F.get(F.filter(F.map_values(values), lambda v: F.trim(v) != ""), F.lit(0)))


def distinct_aliases(aliases: DataFrame, entity: str) -> DataFrame:
    """Aliases (entity, lang, value, position) without blank ones and those that repeat an earlier one of their language but for
    case."""
    told = aliases.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("value", F.trim("value"))
    first = F.min_by(F.struct(*[F.col(c) for c in aliases.columns]), "position")
    return told.groupBy(entity, "lang", F.lower("value").alias("_v")).agg(first.alias("_row")).select("_row.*")


def first_coordinate(claims: DataFrame, entity: str) -> DataFrame:
    """entity, lat, lon: the first claim (by position) whose coordinates are numbers on the globe."""
    valid = claims.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return valid.groupBy(entity).agg(F.min_by(F.struct("lat", "lon"), "position").alias("_c")).select(entity, "_c.*")
