"""Queries on candidates' scores: line items stand for candidates, their orders for mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import scoring as P
from quire.plans.queries import query, table

SOURCES = "['wikidata', 'viaf', 'geonames', 'other'][CAST(l_partkey % 4 AS INTEGER) + 1]"
KINDS = "['person', 'place', 'work', 'date'][CAST(l_orderkey % 4 AS INTEGER) + 1]"
DESCRIBED = "['medieval king of Logres', 'a given name', 'singer', 'Knight of the Round Table'][CAST(l_suppkey % 4 AS INTEGER) + 1]"
KEY = "(l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey"
unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
BASE = unit("0.45 * (l_quantity / 53.7) + 0.25 * (l_discount * 10) + CASE WHEN l_returnflag <> 'R' THEN 0.15 ELSE -0.30 END + 0.10 * (l_tax * 10) + 0.05 * CASE WHEN l_linenumber > 2 THEN least(1.0, (l_linenumber - 2) * 0.05 / 0.20) ELSE 0 END")
has = lambda c, words: f"regexp_matches(lower({c}), '{'|'.join(words)}')"


def _of(values: tuple[str, ...], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("mention_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("candidate_id"),
        (F.col("l_quantity") / 53.7).alias("label"), (F.col("l_discount") * 10).alias("alias"), (F.col("l_returnflag") != "R").alias("typed"), (F.col("l_tax") * 10).alias("context"),
        ((F.col("l_linenumber") - 2) * 0.05).alias("domain"), _of(("wikidata", "viaf", "geonames", "other"), "l_partkey").alias("source"), _of(("person", "place", "work", "date"), "l_orderkey").alias("kind"),
        _of(("medieval king of Logres", "a given name", "singer", "Knight of the Round Table"), "l_suppkey").alias("description"), (F.col("l_linenumber") % 2 == 0).alias("together"),
        F.when(F.col("l_linenumber") == 1, "Person name").otherwise("other").alias("named"),
    )


@query(f"SELECT l_orderkey AS mention_id, {KEY} AS candidate_id, round({BASE}, 6) AS base FROM lineitem")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _candidates(spark, d).select("mention_id", "candidate_id", F.round(P.base_score(c("label"), c("alias"), c("typed"), c("context"), c("domain")), 6).alias("base"))


PRIOR = f"CASE WHEN {SOURCES} = 'geonames' AND {KINDS} = 'place' THEN 0.04 WHEN {SOURCES} = 'viaf' AND {KINDS} IN ('person', 'work') THEN 0.03 WHEN l_linenumber = 1 THEN 0.02 ELSE 0 END"


@query(f"""SELECT l_orderkey AS mention_id, {KEY} AS candidate_id, round({unit(f"{BASE} * 0.88 + CASE {SOURCES} WHEN 'wikidata' THEN 1.0 WHEN 'viaf' THEN 0.92 WHEN 'geonames' THEN 0.95 ELSE 0.8 END * 0.12 + {PRIOR} + CASE WHEN l_linenumber % 2 = 0 THEN 0.05 ELSE 0 END + CASE WHEN {has(DESCRIBED, P.CHRONOLOGY)} THEN 0.03 ELSE 0 END")}, 4) AS score FROM lineitem""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _candidates(spark, d).withColumn("base", P.base_score(c("label"), c("alias"), c("typed"), c("context"), c("domain")))
    prior = P.label_prior(c("source"), c("kind"), c("named"))
    score = P.final_score(c("base"), c("source"), F.lit(None).cast("double"), prior, c("together"), c("description"))
    return rows.select("mention_id", "candidate_id", score.alias("score"))


@query(f"""WITH c AS (SELECT l_orderkey AS mention_id, {KEY} AS candidate_id, l_quantity / 60.0 AS score, 0.8 + l_discount * 2 AS near, l_returnflag <> 'R' AS typed, l_orderkey % 3 > 0 AS known, {has(DESCRIBED, P.NAME_ITEMS)} AS name, {has(DESCRIBED, P.DOMAIN)} AS hit FROM lineitem),
f AS (SELECT *, CASE WHEN NOT known OR name OR NOT typed THEN NULL WHEN near >= 0.95 THEN CASE WHEN hit THEN 0.92 ELSE 0.90 END WHEN near >= 0.85 AND hit THEN 0.88 END AS floor FROM c),
b AS (SELECT mention_id, max(score) AS top, max_by(floor, (score, floor)) AS floor FROM f WHERE floor IS NOT NULL GROUP BY mention_id)
SELECT f.mention_id, candidate_id, round(CASE WHEN known AND name THEN least(score, 0.10) WHEN f.floor IS NOT NULL THEN least(1.0, score + greatest(0.0, b.floor - b.top)) ELSE score END, 4) AS score, typed AND NOT (known AND name) AS type_compatible
FROM f LEFT JOIN b USING (mention_id)""")
def canonical_rescore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("mention_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("candidate_id"), (F.col("l_quantity") / 60.0).alias("score"), (0.8 + F.col("l_discount") * 2).alias("label_similarity"),
        (F.col("l_returnflag") != "R").alias("type_compatible"), F.when(F.col("l_orderkey") % 3 > 0, "lancelot").alias("canonical"), _of(("medieval king of Logres", "a given name", "singer", "Knight of the Round Table"), "l_suppkey").alias("description"),
    )
    return P.rescore_with_canonical(rows).select("mention_id", "candidate_id", F.round("score", 4).alias("score"), "type_compatible")


QIDS = "['Q5', 'Q515', 'Q571', 'Q202444', 'Q43229', ''][CAST(l_partkey % 6 AS INTEGER) + 1]"


@query(f"""SELECT l_orderkey AS mention_id, {KEY} AS candidate_id, CASE WHEN {KINDS} = 'date' THEN true WHEN {KINDS} = 'person' AND {QIDS} = 'Q202444' THEN false WHEN {QIDS} = CASE {KINDS} WHEN 'person' THEN 'Q5' WHEN 'place' THEN 'Q515' ELSE 'Q571' END THEN true
ELSE {KINDS} = 'person' AND {has(DESCRIBED, P.DOMAIN)} AND NOT {has(DESCRIBED, P.NAME_ITEMS)} END AS compatible FROM lineitem""")
def type_compatible(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("q", _of(("Q5", "Q515", "Q571", "Q202444", "Q43229", ""), "l_partkey"))
    qids = F.when(F.col("q") != "", F.array("q"))
    fits = P.is_type_compatible(_of(("person", "place", "work", "date"), "l_orderkey"), qids, _of(("medieval king of Logres", "a given name", "singer", "Knight of the Round Table"), "l_suppkey"))
    return rows.select(F.col("l_orderkey").alias("mention_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("candidate_id"), fits.alias("compatible"))


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda t: length(t) >= 2 AND t NOT IN ('red', 'blue')) AS w FROM part),
s AS (SELECT p_partkey, t, length(t) AS n, length(t) - length(translate(t, '{P.NAME_VOWELS}', '')) AS v, translate(t, '{P.NAME_VOWELS}', '{" " * len(P.NAME_VOWELS)}') AS rest FROM (SELECT p_partkey, unnest(w) AS t FROM w)),
r AS (SELECT p_partkey, greatest(0.0, 0.5 - CASE WHEN n < 3 OR n > 20 THEN 0.30 ELSE 0 END + CASE WHEN v / CAST(n AS DOUBLE) < 0.15 OR v / CAST(n AS DOUBLE) > 0.85 THEN -0.30 WHEN v / CAST(n AS DOUBLE) BETWEEN 0.25 AND 0.65 THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(rest, '[^ ]{{4}}') THEN 0.35 ELSE 0 END) AS score FROM s)
SELECT p.p_partkey, CASE WHEN p.p_partkey % 17 = 0 THEN 1.0 WHEN p.p_partkey % 19 = 0 THEN 0.90 ELSE coalesce(round(least(1.0, a + CASE WHEN good >= 2 THEN 0.10 ELSE 0 END), 3), 0.05) END AS likeness
FROM part p LEFT JOIN (SELECT p_partkey, avg(score) AS a, count(*) FILTER (WHERE score > 1e-9) AS good FROM r GROUP BY 1) USING (p_partkey)""")
def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", P.name_likeness(F.col("p_name"), k % 17 == 0, k % 19 == 0, ("red", "blue")).alias("likeness"))


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN false ELSE true END AS context FROM (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS s FROM part)""")
def place_context(spark: SparkSession, d: str) -> DataFrame:
    s = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))
    near = F.array(F.concat(F.lit("li rois va vers "), s, F.lit(" le matin")), F.concat(F.lit("en la noble "), s), F.concat(F.lit("la cite bele de "), s, F.lit(" brule")), F.concat(F.lit("il dist que "), s, F.lit(" est bon")))
    return table(spark, d, "part").select("p_partkey", P.has_place_context(s, F.get(near, (F.col("p_partkey") % 4).cast("int"))).alias("context"))


SURFACES = "['Paris', 'amor', 'Xzt', 'carduel', 'Bois', 'en'][CAST(l_partkey % 6 AS INTEGER) + 1]"
SHAPES = "['True', 'True', 'False', 'True', 'True', 'False'][CAST(l_partkey % 6 AS INTEGER) + 1]"


@query(f"""SELECT l_orderkey AS mention_id, {KEY} AS candidate_id, CASE WHEN {KINDS} <> 'place' OR {SURFACES} IN ('Paris', 'carduel') OR ((regexp_matches({SURFACES}, '^[A-Z]') OR l_linenumber > 3) AND {SURFACES} <> 'amor' AND {SHAPES} = 'True') THEN 'waits'
ELSE 'waits; low_evidence_place: cap=' || CASE WHEN regexp_matches({SURFACES}, '^[A-Z]') THEN 'True' ELSE 'False' END || ' context=' || CASE WHEN l_linenumber > 3 THEN 'True' ELSE 'False' END || ' lexical=' || CASE WHEN {SURFACES} = 'amor' THEN 'True' ELSE 'False' END || ' shape=' || {SHAPES} END AS reason FROM lineitem""")
def deferred_reason(spark: SparkSession, d: str) -> DataFrame:
    surface = _of(("Paris", "amor", "Xzt", "carduel", "Bois", "en"), "l_partkey")
    reason = P.deferred_reason(surface, _of(("person", "place", "work", "date"), "l_orderkey"), F.col("l_linenumber") > 3, F.lit(" waits "))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mention_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("candidate_id"), reason.alias("reason"))


REASONS = ("", "x low_evidence_place: lexical=True", "low_evidence_place: lexical=False", "token_search_allowed=False", "name_likeness=0.1", "no wikidata candidates", "marked ambiguous", "a date", "no candidate marked as selected")
TOLD = (
    "no reliable authority match", "insufficient evidence to treat this lexical item as a place", "insufficient contextual evidence to support place linking",
    "linking deferred because the passage quality was too risky for reliable authority lookup", "surface form is too noisy for reliable authority lookup", "no reliable authority candidate found",
    "multiple candidates remained ambiguous", "date detected but not authority-linked", "no candidate met the selection threshold",
)


@query(f"SELECT o_orderkey, [{', '.join(repr(x) for x in TOLD)}][CAST(o_orderkey % 9 AS INTEGER) + 1] AS reason FROM orders")
def reason_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", P.summarised_reason(_of(REASONS, "o_orderkey"), F.lit("Paris"), F.lit("date")).alias("reason"))


@query("""SELECT doc_id, md5(trim(substr(text, a + 1, least(length(text), b + 40) - a), ' ')) AS near, md5(trim(substr(text, c + 1, least(length(text), b + 200) - c), ' ') || ' chunk~') AS wide
FROM (SELECT doc_id, text, greatest(0, s - 40) AS a, s + 7 AS b, greatest(0, s - 200) AS c FROM (SELECT doc_id, text, CAST(length(text) // 3 AS INTEGER) AS s FROM documents))""")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("s", F.floor(F.length("text") / 3).cast("int"))
    return docs.select("doc_id", F.md5(P.context_window(F.col("text"), F.col("s"), F.col("s") + 7)).alias("near"), F.md5(P.built_context(F.col("text"), F.col("s"), F.col("s") + 7, F.lit("chunk~"))).alias("wide"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE round(greatest(CASE WHEN event_id % 4 = 1 THEN 0 ELSE value / 100 END, CASE WHEN event_id % 4 = 2 THEN 0 ELSE 0.5 END), 6) END AS similarity FROM events")
def candidate_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", F.round(P.name_similarity(F.when(k > 1, F.col("value") / 100), F.when(k.isin(1, 3), 0.5)), 6).alias("similarity"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round(value / 1000, 6) END AS nd, 0.5 AS bo, CASE WHEN event_id % 5 > 0 THEN 'Arthur' END AS canonical FROM events")
def parsed_notes(spark: SparkSession, d: str) -> DataFrame:
    nd = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("nd="), F.format_string("%.6f", F.col("value") / 1000))).otherwise("nd=?")
    notes = F.concat(nd, F.lit(" bo=.5 "), F.when(F.col("event_id") % 5 > 0, "canonical=Arthur; more").otherwise(""))
    return table(spark, d, "events").select("event_id", F.round(P.parsed_note(notes, "nd"), 6).alias("nd"), P.parsed_note(notes, "bo").alias("bo"), P.parsed_canonical(notes).alias("canonical"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round(1 - value / 100, 4) ELSE -1 END AS similarity FROM events")
def distance_similarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", P.similarity(F.when(F.col("event_id") % 3 > 0, F.col("value") / 100), F.lit(-1.0)).alias("similarity"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'en' WHEN c_custkey % 3 = 0 THEN 'de' ELSE 'la' END AS label FROM customer")
def preferred_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    values = F.create_map(F.lit("la"), F.lit("la"), F.lit("de"), F.when(k % 3 == 0, "de").otherwise(" "), F.lit("en"), F.when(k % 2 == 0, "en"))
    return table(spark, d, "customer").select("c_custkey", P.preferred_language(values).alias("label"))


@query("SELECT user_id, lang, min_by(value, event_id) AS value FROM (SELECT user_id, CAST(event_id % 2 AS VARCHAR) AS lang, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS value, event_id FROM events WHERE event_id % 7 > 0) GROUP BY user_id, lang, lower(value)")
def alias_extraction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 7 == 0, " ").when(k % 3 == 0, F.upper("event_type")).otherwise(F.concat(F.col("event_type"), F.lit(" ")))
    rows = table(spark, d, "events").select("user_id", (k % 2).cast("string").alias("lang"), value.alias("value"), k.alias("position"))
    return P.distinct_aliases(rows, "user_id").select("user_id", "lang", F.trim("value").alias("value"))


@query("SELECT user_id, min_by(value * 2, event_id) AS lat, min_by(value, event_id) AS lon FROM events WHERE value * 2 <= 90 GROUP BY user_id")
def first_coordinate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("value") * 2).alias("lat"), F.col("value").alias("lon"), F.col("event_id").alias("position"))
    return P.first_coordinate(rows, "user_id")
