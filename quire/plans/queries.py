"""The engine's queries over the test tables, and the SQL that gives the same rows.

Documents stand for transcribed pages (runs), events for visits and log entries, line items for boxes on pages (orders).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import evaluation as E
from quire.operators import geometry as G
from quire.operators import linking as L
from quire.operators import quality as Q
from quire.operators import retrieval as R
from quire.operators import runs as U
from quire.session import spread
from quire.streaming import trace as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def quoted(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Shared pieces of the SQL.
V = T.VOWELS
SPACES = " " * len(V)
TOKENS = "SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS t FROM documents"
LINES = "SELECT doc_id, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)"
COUNT = "len(regexp_extract_all({}, '{}'))"
letters = lambda x: COUNT.format(x, r"\p{L}")
vowels = lambda x: COUNT.format(x, f"[{V}]")
RARE = f"len(list_filter(range(1, length(low)), lambda i: substr(low, i, 2) IN {quoted(T.RARE_BIGRAMS)}))"
TOKEN_SIGNALS = f"""
SELECT *, lower(t) AS low, length(t) AS n, {letters("lower(t)")} AS k, {vowels("lower(t)")} AS v, translate(lower(t), '{V}', '{SPACES}') AS rest,
       {COUNT.format("lower(t)", r"[" + chr(92) + "p{L}]+")} AS runs FROM ({TOKENS})"""
NON_WORDLIKE = f"""
SELECT *, CASE WHEN n < 2 THEN 0.5 ELSE least(1.0, CAST(CASE WHEN k > 0 THEN least(0.3, CAST(n - k AS DOUBLE) / n) ELSE 0 END AS DOUBLE)
  + CASE WHEN vr < 0.12 THEN 0.30 WHEN vr < 0.18 THEN 0.15 WHEN vr > 0.80 THEN 0.20 ELSE 0 END
  + CASE WHEN regexp_matches(rest, '\\p{{L}}{{5}}') THEN 0.35 WHEN regexp_matches(rest, '\\p{{L}}{{4}}') THEN 0.15 ELSE 0 END
  + CASE WHEN k >= 4 AND k > runs THEN 0.5 * rare / (k - runs) ELSE 0 END) END AS score
FROM (SELECT *, CASE WHEN k > 0 THEN CAST(v AS DOUBLE) / k ELSE 0 END AS vr, {RARE} AS rare FROM ({TOKEN_SIGNALS}))"""
ENTROPY = """
SELECT doc_id, -sum(c / n * log2(c / n)) AS char_entropy FROM (
  SELECT doc_id, ch, CAST(count(*) AS DOUBLE) AS c, max(n) AS n FROM (
    SELECT doc_id, length(text) AS n, unnest(string_split(lower(text), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id"""
REPETITION = f"""
WITH l AS ({LINES}), f AS (SELECT doc_id, l, list_filter(string_split_regex(l, '\\s+'), lambda t: t <> '') AS w FROM l WHERE l <> ''),
a AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN (count(*) - count(DISTINCT l)) / CAST(count(*) AS DOUBLE) ELSE 0 END AS lines, sum(len(w)) AS n FROM f GROUP BY doc_id),
g AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, gram, count(*) AS c FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS gram FROM f WHERE len(w) >= 5) GROUP BY doc_id, gram) GROUP BY doc_id)
SELECT doc_id, least(1.0, greatest(coalesce(lines, 0), CASE WHEN n >= 15 AND top > 1 THEN least(1.0, top * 5 / CAST(n AS DOUBLE)) ELSE 0 END)) AS repetition_score
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN a USING (doc_id) LEFT JOIN g USING (doc_id)"""
UNCERTAIN = f"({COUNT.format('text', '[?…]')} + 3 * {COUNT.format('text', chr(92) + '[…' + chr(92) + ']')}) / CAST(greatest(length(text), 1) AS DOUBLE)"
NWL = f"SELECT doc_id, avg(CASE WHEN score > 0.45 THEN 1.0 ELSE 0.0 END) AS non_wordlike_frac FROM ({NON_WORDLIKE}) WHERE n >= 3 GROUP BY doc_id"
RBR = f"""SELECT doc_id, CASE WHEN sum(k - runs) > 0 THEN sum(rare) / CAST(sum(k - runs) AS DOUBLE) ELSE 0 END AS rare_bigram_ratio
FROM (SELECT *, {RARE} AS rare FROM ({TOKEN_SIGNALS})) GROUP BY doc_id"""
FIRST_WORD = f"""SELECT doc_id, l, w[1] AS first, coalesce(w[2], '') AS second, w[-1] AS last FROM (
  SELECT doc_id, l, list_filter(string_split_regex(l, '\\s+'), lambda t: t <> '') AS w FROM ({LINES}) WHERE l <> '')"""
FRAGMENTS = f"""
SELECT doc_id,
  avg(CASE WHEN regexp_matches(first, '^[-–—]') THEN 1.0
           WHEN lower(first) IN {quoted(T.FUNCTION_WORDS)} OR (regexp_matches(first, '^\\p{{Lu}}$') AND regexp_matches(second, '^\\p{{Ll}}')) THEN 0.0
           WHEN (regexp_matches(first, '^\\p{{L}}$') AND NOT regexp_matches(lower(first), '[{V}]')) OR (regexp_matches(first, '^\\p{{L}}{{2}}$') AND NOT regexp_matches(first, '^\\p{{Lu}}')) THEN 1.0 ELSE 0.0 END) AS leading_fragment_ratio,
  avg(CASE WHEN l LIKE '%-' OR (length(l) >= 2 AND regexp_matches(last, '^\\p{{L}}$') AND NOT regexp_matches(lower(last), '[{V}]')) THEN 1.0 ELSE 0.0 END) AS trailing_fragment_ratio
FROM ({FIRST_WORD}) GROUP BY doc_id"""
SIGNALS = f"""
SELECT d.doc_id, coalesce(char_entropy, 0) AS char_entropy, coalesce(non_wordlike_frac, 0) AS non_wordlike_frac, coalesce(rare_bigram_ratio, 0) AS rare_bigram_ratio,
  {UNCERTAIN} AS uncertainty_density, repetition_score, coalesce(leading_fragment_ratio, 0) AS leading_fragment_ratio, regexp_matches(text, '\\S') AS has_text
FROM documents d LEFT JOIN ({ENTROPY}) USING (doc_id) LEFT JOIN ({NWL}) USING (doc_id) LEFT JOIN ({RBR}) USING (doc_id) LEFT JOIN ({REPETITION}) USING (doc_id) LEFT JOIN ({FRAGMENTS}) USING (doc_id)"""
GIBBERISH = f"""
SELECT *, CASE WHEN has_text THEN least(1.0, 0.30 * repetition_score + 0.35 * non_wordlike_frac + 0.13 * CASE WHEN char_entropy < 2.0 THEN 0.3 WHEN char_entropy > 5.5 THEN 0.2 ELSE 0 END
  + 0.12 * least(1.0, rare_bigram_ratio * 5) + 0.10 * least(1.0, uncertainty_density * 5)) ELSE 0 END AS gibberish_score FROM ({SIGNALS})"""
LABELLED = f"""
SELECT *, CASE
  WHEN gibberish_score >= 0.40 OR uncertainty_density >= 0.15 OR non_wordlike_frac >= 0.55 OR char_entropy < 1.5 OR repetition_score >= 0.35 THEN 'UNRELIABLE'
  WHEN gibberish_score >= 0.25 OR non_wordlike_frac >= 0.35 OR char_entropy < 2.0 OR char_entropy > 5.5 OR uncertainty_density >= 0.08 OR repetition_score >= 0.20 THEN 'RISKY'
  WHEN gibberish_score < 0.10 AND non_wordlike_frac < 0.15 AND uncertainty_density < 0.03 AND char_entropy BETWEEN 2.5 AND 5.0 AND repetition_score < 0.10 THEN 'HIGH' ELSE 'OK' END AS quality_label
FROM ({GIBBERISH})"""
CHUNKS = """
WITH RECURSIVE l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (
  SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM l),
k AS (
  SELECT doc_id, s, CAST(s + length(line) AS INTEGER) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE regexp_matches(line, '\\S')),
w AS (
  SELECT a.doc_id, CAST(a.r // 4 AS INTEGER) AS idx, a.s AS start_offset, b.e AS end_offset, CAST(a.r AS INTEGER) AS line_start, CAST(b.r AS INTEGER) AS line_end,
         count(*) OVER (PARTITION BY a.doc_id) AS many
  FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.r = least(a.r + 6, a.n) - 1
  WHERE a.r % 4 = 0 AND (a.r = 0 OR a.r + 2 < a.n)),
t AS (
  SELECT *, lead(end_offset - start_offset) OVER v AS next_size, lead(end_offset) OVER v AS next_end, lead(line_end) OVER v AS next_line FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY idx)),
chunks AS (
  SELECT doc_id, idx, start_offset, CASE WHEN idx = many - 2 AND next_size < 40 THEN next_end ELSE end_offset END AS end_offset, line_start,
         CASE WHEN idx = many - 2 AND next_size < 40 THEN next_line ELSE line_end END AS line_end
  FROM t WHERE NOT (idx = many - 1 AND many >= 2 AND end_offset - start_offset < 40)),
texts AS (
  SELECT c.*, substring(d.text, start_offset + 1, end_offset - start_offset) AS text FROM chunks c JOIN documents d USING (doc_id))"""
SPANS = "s AS (SELECT doc_id, span_id, CAST(floor(length(text) * span_id / 7.0) AS INTEGER) AS a, CAST(floor(length(text) * span_id / 7.0) AS INTEGER) + 12 * (span_id + 1) AS b FROM documents, (VALUES (0), (1), (3), (5)) v(span_id))"
ASSIGNED = """, assigned AS (
  SELECT doc_id, span_id, min(idx) FILTER (WHERE a >= start_offset AND b <= end_offset) AS inside, min(idx) FILTER (WHERE a < end_offset AND b > start_offset) AS touching
  FROM s LEFT JOIN chunks USING (doc_id) GROUP BY doc_id, span_id)"""
FOLD = "trim(regexp_replace(replace(replace(replace(strip_accents(replace(replace(replace(replace(lower({0}), 'æ', 'e'), 'œ', 'e'), 'ae', 'e'), 'oe', 'e')), 'j', 'i'), 'v', 'u'), 'w', 'uu'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
REJOIN = "regexp_replace({0}, '[-‐‑‒–­¬]\\s*\\n\\s*', '', 'g')"
WORDS = "list_filter(string_split(" + FOLD.format(REJOIN) + ", ' '), lambda t: t <> '')"
GRAMS = "flatten(list_transform(" + WORDS + ", lambda t: CASE WHEN length(t) <= 2 THEN [' ' || t || ' '] ELSE list_transform(range(1, length(t)), lambda i: substring(' ' || t || ' ', i, 4)) END))"


def bm25_sql(terms: str, name: str, limit: int) -> str:
    of = lambda text: terms.replace("{0}", text).replace("{{", "{").replace("}}", "}")
    return f"""
{name}_d AS (SELECT doc_id, {of("text")} AS g FROM documents),
{name}_s AS (SELECT count(*) AS n, avg(len(g)) AS mean FROM {name}_d),
{name}_q AS (SELECT DISTINCT item_id, unnest({of("text")}) AS term FROM benchmark),
{name}_p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(g) AS size, unnest(g) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_r AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term), {name}_s GROUP BY item_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}_r) WHERE rank <= {limit})"""


BM25_GRAMS, BM25_WORDS = bm25_sql(GRAMS, "lexical", 50), bm25_sql(WORDS, "words", 50)
DENSE = """dense AS (
  SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10)"""


# Visits and the relational core
@query("SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS visits, count(DISTINCT user_id) AS unique_visitors FROM events GROUP BY events.event_type")
def analytics_by_type(spark: SparkSession, d: str) -> DataFrame:
    return U.visits_by(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS visits, count(DISTINCT user_id) AS unique_visitors FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30")
def analytics_by_day(spark: SparkSession, d: str) -> DataFrame:
    return U.visits_by_day(table(spark, d, "events"), "ts", "user_id").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def analytics_recent(spark: SparkSession, d: str) -> DataFrame:
    return U.recent_visits(table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT count(*) AS total_visits, count(DISTINCT user_id) AS unique_visitors, count(DISTINCT coalesce(nullif(event_type, ''), 'Unknown')) AS places, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS today_visits, count(*) FILTER (WHERE value < 1) AS bot_visits FROM events")
def analytics_summary(spark: SparkSession, d: str) -> DataFrame:
    return U.visit_summary(table(spark, d, "events"), "ts", "user_id", "event_type", "2024-01-15", F.col("value") < 1)


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    runs = docs.select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("asset_ref"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sha"), (F.col("doc_id") % 40).cast("string"))).otherwise("").alias("asset_sha256"),
        (F.col("doc_id") * 7919 % 1009).alias("created_at"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") > 500).alias("search_allowed"),
    )
    reports = table(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.lit(0).alias("pass_idx"), F.lit(0).alias("created_at"), (F.col("quality") == 1).alias("token_search_allowed"))
    return runs, docs.filter("n_chars > 200").select(F.col("doc_id").alias("run_id")), reports


RUNS = """
WITH r AS (SELECT doc_id AS run_id, source AS asset_ref, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'sha' || (doc_id % 40) END, 'asset_ref:' || source) AS page_key, doc_id * 7919 % 1009 AS created_at,
  coalesce(CASE WHEN doc_id % 5 = 0 THEN n_chars > 500 END, quality = 1) AS allowed FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 200)
"""


@query(RUNS + "SELECT run_id, asset_ref, page_key, created_at FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY created_at DESC, run_id DESC) AS n FROM r WHERE allowed) WHERE n = 1")
def searchable_scope(spark: SparkSession, d: str) -> DataFrame:
    return U.searchable_runs(*_runs(spark, d))


@query(RUNS + "SELECT run_id, asset_ref, page_key, created_at FROM r WHERE allowed")
def searchable_explicit(spark: SparkSession, d: str) -> DataFrame:
    return U.searchable_runs(*_runs(spark, d), explicit=True)


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def latest_per_page(spark: SparkSession, d: str) -> DataFrame:
    return U.latest_per(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")])


@query("SELECT o_orderkey AS mention_id, o_custkey AS entity_id, l_linenumber AS link, c_name AS label, s_name AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 4 > 0")
def link_report_join(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.col("l_linenumber").alias("link"), F.col("l_suppkey").alias("evidence_id"))
    mentions = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_custkey").alias("entity_id"))
    entities = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("label"))
    evidence = table(spark, d, "supplier").filter("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("evidence_id"), F.col("s_name").alias("evidence"))
    return U.link_report(links, mentions, entities, evidence).select("mention_id", "entity_id", "link", "label", "evidence")


DECISIONS = "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ['ACCEPT_LINKABLE', 'REJECT_LINKABLE', 'SKIP_NON_LINKABLE', 'FILTERED_OUT', 'OTHER'][event_id % 5 + 1] AS status, event_id % 5 AS p FROM events"


@query(f"SELECT user_id, day, event_id, status, n - 1 AS losers FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY user_id, day) AS n FROM ({DECISIONS})) WHERE k = 1")
def span_decision_merge(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (*U.PRECEDENCE, "OTHER"))), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), status.alias("status"))
    return U.merge_decisions(rows, ["user_id", "day"], "event_id").select("user_id", "day", "event_id", "status", F.size("merged").cast("long").alias("losers"))


@query("SELECT doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(o.toxic, n.toxic) AS toxic FROM (SELECT * FROM labels WHERE doc_id % 3 > 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality + 10 END AS quality, toxic + 10 AS toxic FROM labels WHERE doc_id % 3 < 2) n USING (doc_id)")
def upsert_keep(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    new = labels.filter("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality") + 10).alias("quality"), (F.col("toxic") + 10).alias("toxic"))
    return U.upsert(labels.filter("doc_id % 3 > 0"), new, ["doc_id"], keep=("toxic",))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def replace_children_first(spark: SparkSession, d: str) -> DataFrame:
    return U.replace_children(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def clear_run_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return U.without_run(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_type = 'click'")
def optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    return U.optional_filter(table(spark, d, "events"), user_id=7, event_type="click", value=None).select("event_id", "user_id")


@query("SELECT source, count(doc_id) AS chunks, count(*) FILTER (WHERE i IS NULL) AS missing, count(*) FILTER (WHERE doc_id IS NULL) AS orphaned FROM (SELECT coalesce(d.source, x.source) AS source, d.doc_id, x.doc_id AS i FROM (SELECT source, doc_id FROM documents WHERE n_chars > 300 OR lang = 'en') d FULL JOIN (SELECT source, doc_id FROM documents WHERE n_chars <= 5000 OR lang <> 'en') x ON d.doc_id = x.doc_id AND d.source = x.source) GROUP BY source")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    # short texts of other languages are indexed but have no chunks any more, long English ones are still to be indexed
    docs = table(spark, d, "documents")
    of = lambda rows: docs.filter(rows).select("source", "doc_id")
    return U.index_freshness(of("n_chars > 300 or lang = 'en'"), of("n_chars <= 5000 or lang <> 'en'"), "source", "doc_id")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR")
def expired_sweep(spark: SparkSession, d: str) -> DataFrame:
    return U.expired(table(spark, d, "events"), "ts", "2024-01-20 00:00:00", 72).select("event_id")


@query("SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("copies")).filter("copies > 1")


# Text signals and quality
@query(f"SELECT doc_id, round(coalesce(char_entropy, 0), 6) AS char_entropy FROM documents LEFT JOIN ({ENTROPY}) USING (doc_id)")
def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.char_entropy(F.col("text")), 6).alias("char_entropy"))


@query(f"SELECT doc_id, round(coalesce(avg(length(t)), 0), 6) AS mean_len, round(coalesce(stddev_pop(length(t)), 0), 6) AS std_len, round(coalesce(avg(CASE WHEN length(t) < 3 THEN 1.0 WHEN t IS NOT NULL THEN 0.0 END), 1), 6) AS short_frac, round(coalesce(avg(CASE WHEN length(t) > 15 THEN 1.0 WHEN t IS NOT NULL THEN 0.0 END), 0), 6) AS long_frac FROM documents LEFT JOIN ({TOKENS}) USING (doc_id) GROUP BY doc_id")
def token_length_stats(spark: SparkSession, d: str) -> DataFrame:
    out = Q.token_lengths(table(spark, d, "documents"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("mean_len", "std_len", "short_frac", "long_frac")])


@query(f"SELECT doc_id, round(coalesce(rare_bigram_ratio, 0), 6) AS rare_bigram_ratio FROM documents LEFT JOIN ({RBR}) USING (doc_id)")
def rare_bigram_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.rare_bigram_ratio(F.col("text")), 6).alias("rare_bigram_ratio"))


@query(f"SELECT doc_id, round(coalesce(non_wordlike_frac, 0), 6) AS non_wordlike_frac FROM documents LEFT JOIN ({NWL}) USING (doc_id)")
def non_wordlike_frac(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(Q.non_wordlike_frac(F.col("text")), 6).alias("non_wordlike_frac"))


@query(f"SELECT doc_id, round(coalesce(leading_fragment_ratio, 0), 6) AS leading_fragment_ratio, round(coalesce(trailing_fragment_ratio, 0), 6) AS trailing_fragment_ratio FROM documents LEFT JOIN ({FRAGMENTS}) USING (doc_id)")
def fragment_ratios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.leading_fragment_ratio(F.col("text")), 6).alias("leading_fragment_ratio"), F.round(T.trailing_fragment_ratio(F.col("text")), 6).alias("trailing_fragment_ratio"))


@query(f"SELECT doc_id, round(repetition_score, 6) AS repetition_score FROM ({REPETITION})")
def repetition_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.repetition_score(F.col("text")), 6).alias("repetition_score"))


@query(f"SELECT doc_id, round({UNCERTAIN}, 6) AS uncertainty_density FROM documents")
def uncertainty_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.uncertainty_density(F.col("text")), 6).alias("uncertainty_density"))


@query(f"SELECT doc_id, round(gibberish_score, 6) AS gibberish_score FROM ({GIBBERISH})")
def gibberish_no_language(spark: SparkSession, d: str) -> DataFrame:
    return Q.report(table(spark, d, "documents")).select("doc_id", F.round("gibberish_score", 6).alias("gibberish_score"))


@query(f"SELECT doc_id, quality_label FROM ({LABELLED})")
def quality_label(spark: SparkSession, d: str) -> DataFrame:
    return Q.report(table(spark, d, "documents")).select("doc_id", "quality_label")


@query(f"""SELECT doc_id, gibberish_score < 0.40 AS gate_gibberish, non_wordlike_frac < 0.55 AS gate_wordlike, leading_fragment_ratio < 0.15 AS gate_fragment, uncertainty_density < 0.15 AS gate_uncertainty,
array_to_string(list_sort(list_filter([CASE WHEN w THEN 'token_search' END, CASE WHEN w THEN 'token_ner' END, CASE WHEN leading_fragment_ratio >= 0.15 THEN 'seam_not_resolved' END,
  CASE WHEN c THEN 'translation' END, CASE WHEN c THEN 'paraphrase' END, CASE WHEN c THEN 'entity_claims' END], lambda x: x IS NOT NULL)), ',') AS blocked,
CASE WHEN quality_label IN ('HIGH', 'OK') THEN 'full' WHEN quality_label = 'RISKY' THEN 'restricted' ELSE 'blocked' END AS downstream_mode
FROM (SELECT *, gibberish_score >= 0.40 OR non_wordlike_frac >= 0.55 OR quality_label = 'UNRELIABLE' AS w, quality_label IN ('RISKY', 'UNRELIABLE') AS c FROM ({LABELLED}))""")
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    gated = Q.gates(Q.report(table(spark, d, "documents")))
    return gated.select("doc_id", "gate_gibberish", "gate_wordlike", "gate_fragment", "gate_uncertainty", F.array_join("blocked", ",").alias("blocked"), "downstream_mode")


WORD_SCORES = f"""SELECT doc_id, greatest(0.0, least(1.0, 0.50 + CASE WHEN n < 3 THEN -0.20 WHEN n <= 20 THEN 0.15 ELSE -0.10 END
  + CASE WHEN v / CAST(n AS DOUBLE) BETWEEN 0.25 AND 0.65 THEN 0.20 WHEN v / CAST(n AS DOUBLE) BETWEEN 0.15 AND 0.80 THEN 0.05 ELSE -0.25 END
  + CASE WHEN regexp_matches(rest, '\\p{{L}}{{4}}') THEN -0.35 WHEN regexp_matches(rest, '\\p{{L}}{{3}}') THEN -0.05 ELSE 0 END
  + CASE WHEN regexp_matches(low, '^\\p{{L}}+$') THEN 0.10 ELSE -0.15 END)) AS score
FROM ({TOKEN_SIGNALS.replace(TOKENS, "SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '[^" + chr(92) + "p{L}" + chr(92) + "p{N}_" + chr(92) + "s]', ' ', 'g'), '" + chr(92) + "s+'), lambda t: length(t) >= 2)) AS t FROM documents")})"""


@query(f"""SELECT doc_id, round(coalesce(l, 0), 6) AS low_frac,
CASE WHEN a >= 0.55 AND l < 0.15 THEN 'HIGH' WHEN a >= 0.35 AND l < 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS text_quality
FROM documents LEFT JOIN (SELECT doc_id, avg(score) AS a, avg(CASE WHEN score < 0.30 - 1e-9 THEN 1.0 ELSE 0.0 END) AS l FROM ({WORD_SCORES}) GROUP BY doc_id) USING (doc_id)""")
def text_quality_label(spark: SparkSession, d: str) -> DataFrame:
    return Q.text_quality(table(spark, d, "documents")).select("doc_id", F.round("low_frac", 6).alias("low_frac"), "text_quality")


@query(f"""SELECT doc_id, round(coalesce(single_char_ratio, 0), 6) AS single_char_ratio, round(coalesce(digit_ratio, 0), 6) AS digit_ratio, round(coalesce(uncertain_ratio, 0), 6) AS uncertain_ratio, round(coalesce(single_start_ratio, 0), 6) AS single_start_ratio FROM documents LEFT JOIN
(SELECT doc_id, avg(CASE WHEN length(t) = 1 THEN 1.0 ELSE 0.0 END) AS single_char_ratio, avg(CASE WHEN regexp_matches(t, '[0-9]') THEN 1.0 ELSE 0.0 END) AS digit_ratio, avg(CASE WHEN t LIKE '%?%' OR t = '[…]' THEN 1.0 ELSE 0.0 END) AS uncertain_ratio FROM ({TOKENS}) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, avg(CASE WHEN length(first) = 1 THEN 1.0 ELSE 0.0 END) AS single_start_ratio FROM ({FIRST_WORD}) GROUP BY doc_id) USING (doc_id)""")
def sanity_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = Q.sanity(table(spark, d, "documents"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("single_char_ratio", "digit_ratio", "uncertain_ratio", "single_start_ratio")])


@query("SELECT lang, quality, toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (quality, toxic), ())")
def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.groupingSets([["lang"], ["quality", "toxic"], []], "lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda w: reverse(w)), ' ')), chr(10))) AS turned FROM documents")
def reversed_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.reversed_words(F.col("text"))).alias("turned"))


# Chunks
@query(CHUNKS + " SELECT doc_id, idx, start_offset, end_offset, line_start, line_end, md5(text) AS digest FROM texts")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.window_chunks(table(spark, d, "documents")).select("doc_id", "idx", "start_offset", "end_offset", "line_start", "line_end", F.md5("text").alias("digest"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    start = F.floor(F.length("text") * F.col("span_id") / 7.0).cast("int")
    spans = docs.withColumn("span_id", F.explode(F.array(*map(F.lit, (0, 1, 3, 5))))).select("doc_id", "span_id", start.alias("start"), (start + 12 * (F.col("span_id") + 1)).alias("end"))
    return C.assign_chunks(spans, C.window_chunks(docs))


@query(CHUNKS + ", " + SPANS + ASSIGNED + " SELECT doc_id, span_id, coalesce(inside, touching) AS chunk_idx, inside IS NOT NULL AS contained FROM assigned")
def assign_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("doc_id", "span_id", "chunk_idx", "contained")


@query(CHUNKS + ", " + SPANS + ASSIGNED + " SELECT doc_id, avg(CASE WHEN inside IS NOT NULL THEN 1.0 ELSE 0.0 END) AS containment, count(*) AS spans FROM assigned GROUP BY doc_id")
def chunk_containment(spark: SparkSession, d: str) -> DataFrame:
    return C.containment(_assigned(spark, d))


@query(CHUNKS + " SELECT doc_id, CAST(sum(n) AS BIGINT) AS budget, count(*) AS n_chunks FROM (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, idx) AS k FROM texts) WHERE k <= 5 GROUP BY doc_id")
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_budget(C.window_chunks(table(spark, d, "documents")))


# Retrieval
@query(f"WITH {BM25_GRAMS} SELECT item_id, doc_id, score, rank FROM lexical WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), ["doc_id"], "item_id", limit=10)


@query(f"WITH {BM25_WORDS} SELECT item_id, doc_id, score, rank FROM words WHERE rank <= 10")
def bm25_words_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), ["doc_id"], "item_id", terms=T.word_terms, limit=10)


@query(f"""WITH {BM25_GRAMS}, {BM25_WORDS}, every AS (SELECT item_id, doc_id, 0 AS list, rank FROM lexical UNION ALL SELECT item_id, doc_id, 1, rank FROM words),
f AS (SELECT item_id, doc_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 9) AS score, min((list, rank)) AS first FROM every GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    rankings = [R.bm25(docs, asked, ["doc_id"], "item_id", terms=t, limit=50) for t in (T.search_terms, T.word_terms)]
    return R.reciprocal_rank_fusion(rankings, "item_id", ["doc_id"]).filter("rank <= 10")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return R.dense_topk(vectors.filter("vec_id % 50 = 0"), vectors, "vec_id", "embedding", limit=10)


@query(f"WITH {DENSE} SELECT query_id, vec_id, similarity, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


@query(f"""WITH {DENSE}, rel AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS i FROM rel LEFT JOIN dense USING (query_id, vec_id))
SELECT query_id, count(*) FILTER (WHERE rank <= 5) / CAST(count(*) AS DOUBLE) AS recall, count(*) FILTER (WHERE rank <= 5) / 5.0 AS precision, coalesce(1.0 / min(rank), 0) AS reciprocal_rank,
round(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN 1 / log2(i + 1) ELSE 0 END), 6) AS ndcg FROM h GROUP BY query_id""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(vectors.select("vec_id", "label"), "label").filter("query_id <> vec_id").select("query_id", "vec_id", F.lit(1.0).alias("gain"))
    return R.retrieval_scores(_dense(spark, d), relevant, "query_id", "vec_id")


# Similarity and linking
PAIRS = "p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part)"


def _part_pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    follow = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(follow, "p_partkey")


@query(f"""WITH {PAIRS}, g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: lower(substr(a, i, 2)))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: lower(substr(b, i, 2)))) AS y FROM p WHERE b IS NOT NULL)
SELECT p_partkey, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 6) AS dice FROM g""")
def bigram_dice(spark: SparkSession, d: str) -> DataFrame:
    return _part_pairs(spark, d).select("p_partkey", F.round(T.bigram_overlap(F.col("a"), F.col("b")), 6).alias("dice"))


@query(f"WITH {PAIRS} SELECT p_partkey, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS similarity FROM p WHERE b IS NOT NULL")
def edit_similarity_ascii(spark: SparkSession, d: str) -> DataFrame:
    return _part_pairs(spark, d).select("p_partkey", F.levenshtein("a", "b").alias("distance"), F.round(T.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {PAIRS}, t AS (SELECT p_partkey, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p WHERE b IS NOT NULL)
SELECT p_partkey, round(len(list_intersect(x, y)) / CAST(len(y) AS DOUBLE), 6) AS coverage, round(len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE), 6) AS jaccard FROM t""")
def context_coverage(spark: SparkSession, d: str) -> DataFrame:
    x, y = T.tokens(F.col("a")), T.tokens(F.col("b"))
    return _part_pairs(spark, d).select("p_partkey", F.round(T.coverage(x, y), 6).alias("coverage"), F.round(T.jaccard(x, y), 6).alias("jaccard"))


@query("""WITH c AS (SELECT l_orderkey AS mention_id, l_linenumber AS candidate_id, l_quantity / 50.0 AS score, CASE WHEN l_linenumber % 4 > 0 THEN 0.4 + l_tax * 5 END AS similarity, l_returnflag <> 'R' AS typed, ['HIGH', 'MEDIUM', 'LOW'][l_orderkey % 3 + 1] AS q FROM lineitem),
t AS (SELECT *, CASE q WHEN 'HIGH' THEN 0.80 WHEN 'LOW' THEN 0.90 ELSE 0.85 END AS th, CASE q WHEN 'LOW' THEN 0.20 ELSE 0.15 END AS mg, typed AND coalesce(similarity, 1) >= CASE q WHEN 'HIGH' THEN 0.60 WHEN 'LOW' THEN 0.70 ELSE 0.65 END AS fit FROM c),
r AS (SELECT *, row_number() OVER w AS n, lead(CASE WHEN fit THEN score END) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY mention_id ORDER BY fit DESC, score DESC, candidate_id))
SELECT mention_id, CASE WHEN fit AND score >= th AND (nxt IS NULL OR score - nxt >= mg) THEN candidate_id END AS selected,
CASE WHEN NOT fit OR score < th THEN 'unresolved' WHEN nxt IS NULL OR score - nxt >= mg THEN 'linked' ELSE 'ambiguous' END AS status, CASE WHEN fit THEN round(score, 6) END AS best_score FROM r WHERE n = 1""")
def disambiguate(spark: SparkSession, d: str) -> DataFrame:
    quality = F.get(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("l_orderkey") % 3).cast("int"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("mention_id"), F.col("l_linenumber").alias("candidate_id"), (F.col("l_quantity") / 50.0).alias("score"),
        F.when(F.col("l_linenumber") % 4 > 0, 0.4 + F.col("l_tax") * 5).alias("similarity"), (F.col("l_returnflag") != "R").alias("type_compatible"), quality.alias("quality"),
    )
    return L.disambiguate(rows).withColumn("best_score", F.round("best_score", 6))


@query("""WITH m AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS position, unnest(w) AS t, unnest(list_prepend(NULL, w[:-2])) AS before FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents)),
s AS (SELECT doc_id, CAST(position AS INTEGER) AS position, regexp_replace(t, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g') AS surface, before FROM m)
SELECT doc_id, position, surface FROM s WHERE regexp_matches(surface, '^\\p{Lu}\\p{L}+$') AND length(surface) >= 5 AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?:]$')""")
def high_recall_mentions(spark: SparkSession, d: str) -> DataFrame:
    return L.capitalised_mentions(table(spark, d, "documents"))


@query("""WITH n AS (SELECT n_name AS name, n_nationkey AS position FROM nation), s AS (SELECT c_custkey, upper(left(n_name, 1)) || lower(substr(replace(n_name, 'A', CASE WHEN c_custkey % 4 = 0 THEN 'O' ELSE 'A' END), 2)) AS surface FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT c_custkey, name, position, lower(surface) AS x, lower(name) AS y FROM s, n),
k AS (SELECT *, levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) AS nd, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS p, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS q FROM g),
b AS (SELECT c_custkey, min((nd, position, name)) AS best FROM k WHERE CASE WHEN length(x) < 5 THEN x = y ELSE nd <= 0.25 AND 2.0 * len(list_intersect(p, q)) / (len(p) + len(q)) >= 0.40 END GROUP BY c_custkey)
SELECT c_custkey, best[3] AS canonical, round(best[1], 6) AS distance FROM s LEFT JOIN b USING (c_custkey)""")
def canonical_match(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    name = F.replace("n_name", F.lit("A"), F.when(F.col("c_custkey") % 4 == 0, "O").otherwise("A"))
    mentions = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.upper(F.left("n_name", F.lit(1))), F.lower(F.substring(name, 2, 1000))).alias("surface"))
    found = L.canonical_match(mentions, nations.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position")))
    return found.select("c_custkey", "canonical", F.round("distance", 6).alias("distance"))


@query("SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_user_query(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return U.latest_per(asked, ["conv_id"], [F.col("turn")]).select("conv_id", "question")


# Geometry
BOXES = "boxes AS (SELECT l_orderkey AS page, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS box_id, CAST(l_partkey % 300 AS INTEGER) AS x1, CAST(l_suppkey % 200 AS INTEGER) AS y1, CAST(l_partkey % 300 + 20 + l_quantity * 3 AS INTEGER) AS x2, CAST(l_suppkey % 200 + 10 + l_quantity * 2 AS INTEGER) AS y2, CAST(l_linenumber % 3 AS INTEGER) AS kind, CAST(l_discount AS DOUBLE) AS score FROM lineitem)"
INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("box_id"), x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 20 + F.col("l_quantity") * 3).cast("int").alias("x2"),
        (y + 10 + F.col("l_quantity") * 2).cast("int").alias("y2"), (F.col("l_linenumber") % 3).cast("int").alias("kind"), F.col("l_discount").cast("double").alias("score"),
    )


@query(f"""WITH {BOXES}, p AS (SELECT page, a.box_id AS a_box_id, b.box_id AS b_box_id, {INTER} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes a JOIN boxes b USING (page) WHERE a.box_id < b.box_id)
SELECT page, a_box_id, b_box_id, i / CAST(s - i AS DOUBLE) AS iou FROM p WHERE i > 0""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.overlapping_pairs(_boxes(spark, d))


@query(f"WITH {BOXES} SELECT a.page, a.box_id, coalesce(max(CASE WHEN b.page IS NULL THEN 0 ELSE {INTER} / CAST((a.x2 - a.x1) * (a.y2 - a.y1) AS DOUBLE) END), 0) AS inside FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND b.kind = 1 WHERE a.kind = 2 GROUP BY a.page, a.box_id")
def contained_fraction(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return G.contained_fraction(boxes.filter("kind = 2"), boxes.filter("kind = 1")).select("page", "box_id", "inside")


@query(f"WITH {BOXES} SELECT CASE kind WHEN 0 THEN 'MainZone' WHEN 1 THEN 'MarginZone' ELSE 'cls_' || kind END AS name, CAST(count(*) AS BIGINT) AS boxes FROM boxes GROUP BY kind")
def coco_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.class_counts(_boxes(spark, d), spark.createDataFrame([(0, "MainZone"), (1, "MarginZone")], "kind int, name string"))


@query("""SELECT p.p_partkey AS page, r AS tile_row, c AS tile_col, CAST(greatest(0, floor(c * w / 3.0 - 0.15 * (w / 3.0))) AS BIGINT) AS x1, CAST(least(w, floor((c + 1) * (w / 3.0) + 0.15 * (w / 3.0))) AS BIGINT) AS x2,
CAST(greatest(0, floor(r * h / 2.0 - 0.15 * (h / 2.0))) AS BIGINT) AS y1, CAST(least(h, floor((r + 1) * (h / 2.0) + 0.15 * (h / 2.0))) AS BIGINT) AS y2
FROM (SELECT p_partkey, 600 + 40 * p_size AS w, 800 + 40 * p_size AS h FROM part) p, (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)""")
def grid_tiles(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page"), (600 + 40 * F.col("p_size")).alias("width"), (800 + 40 * F.col("p_size")).alias("height"))
    return G.grid_tiles(pages, 2, 3, 0.15).drop("width", "height")


# greedy choices, one box after the other: the state is what is kept so far
NMS = """r AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY score DESC, box_id, x1, y1, x2, y2) AS n FROM boxes),
s AS (SELECT page, kind, n, true AS kept_now, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM r WHERE n = 1
  UNION ALL SELECT page, kind, n, free, CASE WHEN free THEN list_append(kept, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) ELSE kept END FROM (
    SELECT r.*, s.kept, len(list_filter(s.kept, lambda k: greatest(least(r.x2, k.x2) - greatest(r.x1, k.x1), 0) * greatest(least(r.y2, k.y2) - greatest(r.y1, k.y1), 0)
      >= 0.3 * ((r.x2 - r.x1) * (r.y2 - r.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - greatest(least(r.x2, k.x2) - greatest(r.x1, k.x1), 0) * greatest(least(r.y2, k.y2) - greatest(r.y1, k.y1), 0)))) = 0 AS free
    FROM s JOIN r ON r.page = s.page AND r.kind = s.kind AND r.n = s.n + 1))"""
ORDER = """r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x1, y1, box_id, x2, y2) AS n FROM boxes),
s AS (SELECT page, n, 1 AS col, [{'a': x1, 'b': x2}] AS cols FROM r WHERE n = 1
  UNION ALL SELECT page, n, CASE WHEN spot > 0 THEN spot ELSE len(cols) + 1 END, CASE WHEN spot > 0 THEN list_transform(cols, lambda c, i: CASE WHEN i = spot THEN {'a': least(c.a, x1), 'b': greatest(c.b, x2)} ELSE c END) ELSE list_append(cols, {'a': x1, 'b': x2}) END FROM (
    SELECT r.*, s.cols, coalesce(list_position(list_transform(s.cols, lambda c: least(r.x2, c.b) - greatest(r.x1, c.a) > 0 AND least(r.x2 - r.x1, c.b - c.a) > 0 AND least(r.x2, c.b) - greatest(r.x1, c.a) >= 0.5 * least(r.x2 - r.x1, c.b - c.a)), true), 0) AS spot
    FROM s JOIN r ON r.page = s.page AND r.n = s.n + 1)),
l AS (SELECT page, arg_max(cols, n) AS cols FROM s GROUP BY page)"""


@query(f"WITH RECURSIVE {BOXES}, {NMS} SELECT r.page, box_id, x1, y1, x2, y2, r.kind, score FROM r JOIN s ON r.page = s.page AND r.kind = s.kind AND r.n = s.n WHERE kept_now")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return G.nms(_boxes(spark, d), 0.3)


@query(f"WITH RECURSIVE {BOXES}, {ORDER} SELECT r.page, box_id, x1, y1, x2, y2, kind, score, CAST(row_number() OVER (PARTITION BY r.page ORDER BY l.cols[s.col].a, l.cols[s.col].b, s.col, y1, x1, box_id, x2, y2) - 1 AS INTEGER) AS position FROM r JOIN s ON r.page = s.page AND r.n = s.n JOIN l ON l.page = r.page")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return G.reading_order(_boxes(spark, d))


# Evaluation
def _page_pairs(spark: SparkSession, d: str) -> DataFrame:
    # the SQL engine's distance counts bytes
    plain = table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"), F.regexp_replace("text", r"[^\x00-\x7F]", "e").alias("reference"))
    return plain.withColumn("hypothesis", F.regexp_replace("reference", "[aeq]([a-z])", "$1"))


PAIRED = r"""pairs AS (SELECT page_id, trim(regexp_replace(regexp_replace(lower(reference), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS r, trim(regexp_replace(regexp_replace(lower(regexp_replace(reference, '[aeq]([a-z])', '\1', 'g')), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS h
FROM (SELECT item_id AS page_id, regexp_replace(text, '[^\x00-\x7F]', 'e', 'g') AS reference FROM benchmark)), rates AS (SELECT page_id, levenshtein(r, h) AS d, length(r) AS n, CASE WHEN length(r) > 0 THEN levenshtein(r, h) / CAST(length(r) AS DOUBLE) WHEN length(h) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS rate FROM pairs)"""


@query(f"WITH {PAIRED} SELECT count(*) AS pages, sum(d) / CAST(sum(n) AS DOUBLE) AS micro_cer, round(avg(rate) FILTER (WHERE rate < 'inf'::DOUBLE), 9) AS macro_cer, max(rate) AS worst_cer FROM rates")
def cer_corpus(spark: SparkSession, d: str) -> DataFrame:
    return E.corpus_report(_page_pairs(spark, d))


@query(f"WITH {PAIRED} SELECT page_id, rate AS cer FROM rates ORDER BY rate DESC, page_id LIMIT 5")
def worst_pages(spark: SparkSession, d: str) -> DataFrame:
    return E.worst_pages(_page_pairs(spark, d))


@query(f"WITH {PAIRED} SELECT page_id, d AS distance, n, length(r) - length(h) AS deletions_over_insertions FROM rates JOIN pairs USING (page_id)")
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    out = E.error_breakdown(_page_pairs(spark, d))
    return out.select("page_id", "distance", "n", (F.col("deletions") - F.col("insertions")).alias("deletions_over_insertions"))


@query()
def corpus_report_with_intervals(spark: SparkSession, d: str) -> DataFrame:
    return E.full_corpus_report(_page_pairs(spark, d))


@query()
def wer_pages(spark: SparkSession, d: str) -> DataFrame:
    return E.word_errors(_page_pairs(spark, d)).select("page_id", "word_distance", "reference_words")


@query()
def projected_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = _page_pairs(spark, d).withColumn("start", F.explode(F.array(F.lit(0), F.lit(10), F.lit(40)))).withColumn("end", F.col("start") + 12)
    return E.projected_spans(spans).select("page_id", "start", "end", "hyp_start", "hyp_end")


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_interval(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey")


@query()
def clustered_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("base", F.col("p_retailprice") - F.col("p_size"))
    return E.clustered_interval(rows, "p_brand", "p_size", "p_retailprice", "p_partkey", "base")


@query("""WITH c AS (SELECT l_returnflag AS kind, count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (WHERE l_quantity > 25 AND l_discount <= 0.05) AS fp, count(*) FILTER (WHERE l_quantity <= 25 AND l_discount > 0.05) AS fn FROM lineitem GROUP BY 1)
SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    q, g = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count_if(q & g).alias("tp"), F.count_if(q & ~g).alias("fp"), F.count_if(~q & g).alias("fn"))
    return E.precision_recall(counts).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# Streaming, driven to the end over what there is
def _drained(spark: SparkSession, stream: DataFrame, mode: str, timed: bool = False) -> DataFrame:
    """What a stream gives over the rows there are, written batch by batch as Parquet (in complete mode each batch stands for all)
    beside its checkpoint. timed: a stream with processing-time timeouts never runs out of batches, so it takes all in one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quire-streams-")
    at = f"{root.rstrip('/')}/quire-streams/{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/" + ("all" if mode == "complete" else f"batch={batch}"))

    running = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(**({"once": True} if timed else {"availableNow": True})).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, S.window_counts(_event_stream(spark, d), "ts", "event_type"), "complete").withColumn("start", F.to_date("start").cast("string"))


@query("SELECT user_id AS run_id, max_by(event_type, event_id) AS stage, count(*) AS events FROM events GROUP BY user_id")
def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    events = _event_stream(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"))
    return _drained(spark, S.trace_snapshots(events), "append", timed=True)


@query("SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    upto = F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: F.struct(k.alias("seq"), F.array_join(F.transform(F.slice("t", 1, k), lambda x: x["text"]), "").alias("chunk")))
    chunks = rows.select(F.col("conv_id").alias("stream_id"), F.explode(upto).alias("c")).select("stream_id", "c.*")
    return S.joined_deltas(chunks)


# More of the relational core
@query(RUNS.rstrip() + " SELECT run_id, page_key, created_at FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY created_at DESC, run_id DESC) AS n FROM r) WHERE n > 1")
def superseded_runs(spark: SparkSession, d: str) -> DataFrame:
    runs, has_chunks, _ = _runs(spark, d)
    keyed = runs.join(has_chunks, "run_id", "left_semi").select("run_id", U.page_key(F.col("asset_sha256"), F.col("asset_ref")).alias("page_key"), "created_at")
    return U.superseded(keyed, "page_key", "created_at", "run_id")


@query("SELECT l_orderkey, least(1.0, greatest(0.0, round(sum(l_discount * 10 * greatest(1, l_linenumber)) / sum(greatest(1, l_linenumber)), 6))) AS confidence FROM lineitem GROUP BY l_orderkey")
def merged_confidence(spark: SparkSession, d: str) -> DataFrame:
    tiles = table(spark, d, "lineitem").withColumn("c", F.col("l_discount") * 10)
    return U.weighted_confidence(tiles, "l_orderkey", "c", "l_linenumber").withColumn("confidence", F.round("confidence", 6))


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE k = 1")
def most_common_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return U.vote(table(spark, d, "events"), "user_id", "event_type", F.lit(1), "event_id")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INTEGER) AS seen_before FROM events")
def repeat_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.repeats(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "seen_before")


@query("SELECT doc_id AS run_id, CASE WHEN lang = 'en' AND n_chars > 500 THEN 'searchable' WHEN quality = 1 THEN 'superseded' WHEN lang <> 'es' THEN 'refused' ELSE 'orphaned' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def vector_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    of = lambda rows: rows.select(F.col("doc_id").alias("run_id"))
    return U.classify_vectors(of(docs), of(docs.filter("lang <> 'es'")), of(docs.filter("lang = 'en' and n_chars > 500")), of(table(spark, d, "labels").filter("quality = 1")))


@query("""SELECT doc_id, field, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') ORDER BY doc_id, i) AS n FROM (
SELECT doc_id, 0 AS i, 'text' AS field, text FROM documents UNION ALL SELECT doc_id, 1, 'turned', reverse(text) FROM documents) WHERE length(text) >= 400) WHERE n = 1""")
def distinct_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("turned", F.reverse("text"))
    return U.distinct_readings(rows, "doc_id", ["text", "turned"]).select("doc_id", "field", F.md5("text").alias("digest"))


@query("""SELECT p_brand, max(s) AS best, string_agg(p_name, '|' ORDER BY n) AS surfaces FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_name) AS n FROM (
SELECT p_brand, p_name, max(p_retailprice) AS s FROM part GROUP BY ALL)) WHERE n <= 12 GROUP BY p_brand""")
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return U.entity_index(table(spark, d, "part"), "p_brand", "p_name", "p_retailprice")


@query(f"WITH {BOXES} SELECT box_id, page, CAST(lead(x1) OVER (PARTITION BY page ORDER BY x1, y1, box_id, x2) - x2 AS INTEGER) AS gap FROM boxes")
def box_gaps(spark: SparkSession, d: str) -> DataFrame:
    return G.gaps(_boxes(spark, d)).select("box_id", "page", "gap")


@query(f"WITH {BOXES} SELECT o_orderkey AS page, o_custkey FROM orders WHERE o_orderkey IN (SELECT page FROM boxes WHERE kind = 2)")
def coco_filter(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey")
    return G.of_classes(images, _boxes(spark, d), [2])[0]


@query(f"""SELECT doc_id, md5(CASE WHEN {letters("t")} >= 50 THEN t ELSE '' END) AS read FROM (SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(replace(lower(text), '&', ' et '), '\\s+'),
lambda w: w <> '' AND {letters("w")} * 2 >= length(w) AND ({letters("w")} < 4 OR {vowels("w")} / CAST(greatest({letters("w")}, 1) AS DOUBLE) >= 0.20)), lambda w: regexp_replace(w, '[^\\p{{L}}]+', '', 'g')), lambda w: w <> ''), ' ') AS t FROM documents)""")
def langid_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.langid_text(F.col("text"))).alias("read"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS normal FROM documents")
def normal_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(N.normal_form(F.col("text"))).alias("normal"))


@query()
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _part_pairs(spark, d).select("p_partkey", N.jaro_winkler_similarity(F.col("a"), F.col("b")).alias("jaro_winkler"), N.string_similarity(F.col("a"), F.col("b")).alias("similarity"))
