"""Queries on replies, mentions, regions and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import replies as A
from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import mentions as M
from quire.operators import regions as N
from quire.operators import retrieval as R
from quire.plans.queries import BM25_GRAMS, BOXES, CHUNKS, FOLD, _boxes, query, table

WORD_SQL = "[A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ][A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ''’\\-]*"


# Hybrid retrieval
DENSE_POOL = """dense AS (SELECT item_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN benchmark ON q.vec_id = item_id, embeddings v)) WHERE rank <= 50),
known AS (SELECT item_id, doc_id, similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rank) AS INTEGER) AS rank FROM dense JOIN documents USING (doc_id))"""
RANKED = "(SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fusion_score DESC, first) AS INTEGER) AS rank FROM f)"


def _hybrid(spark: SparkSession, d: str, dense: bool = True, fusion: bool = True) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = table(spark, d, "benchmark").select("item_id", "text")
    of_queries = vectors.join(asked.select(F.col("item_id").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "item_id")
    chunks = table(spark, d, "documents").select("doc_id", "text")
    # the test tables are one scope, of whatever size
    hits, _ = R.retrieve(asked, chunks, of_queries if dense else None, vectors if dense else None, "item_id", "doc_id", fusion=fusion, max_lexical=(1 << 31) - 2)
    return hits


@query(f"""WITH {BM25_GRAMS}, {DENSE_POOL}, every AS (SELECT item_id, doc_id, 0 AS list, rank FROM known UNION ALL SELECT item_id, doc_id, 1, rank FROM lexical),
f AS (SELECT item_id, doc_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 9) AS fusion_score, min((list, rank)) AS first FROM every GROUP BY item_id, doc_id)
SELECT r.item_id, r.doc_id, 'hybrid' AS mode, r.rank, k.rank AS dense_rank, l.rank AS lexical_rank, round(l.score, 4) AS lexical_score, round(fusion_score, 6) AS fusion_score FROM {RANKED} r LEFT JOIN known k USING (item_id, doc_id) LEFT JOIN lexical l USING (item_id, doc_id) WHERE r.rank <= 5""")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).drop("similarity")


@query(f"WITH {BM25_GRAMS} SELECT item_id, doc_id, 'lexical' AS mode, rank, round(score, 4) AS lexical_score FROM lexical WHERE rank <= 5")
def lexical_only_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, dense=False).select("item_id", "doc_id", "mode", "rank", "lexical_score")


@query(f"WITH {DENSE_POOL} SELECT item_id, doc_id, 'dense' AS mode, rank, similarity FROM dense WHERE rank <= 5")
def dense_only_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, fusion=False).select("item_id", "doc_id", "mode", "rank", "similarity")


@query(f"WITH {DENSE_POOL} SELECT item_id, label, round(max(similarity) + 1e-9, 4) AS similarity FROM dense JOIN embeddings ON vec_id = doc_id WHERE rank <= 20 GROUP BY item_id, label")
def best_entity_similarity(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    # six digits that end in 50 would be rounded either way
    hits = R.dense_topk(asked, vectors, "vec_id", "embedding", limit=20, itself=True).join(vectors.select("vec_id", "label"), "vec_id")
    return N.best_hits(hits.select(F.col("query_id").alias("item_id"), "label", (1 - F.col("similarity") - 1e-9).alias("distance")), "item_id", "label")


# Replies
LANGS = ("fr", " FRO ", "Old-French", "la", "xx", "middle high german", "de")
LANG_NAMES = ("french", "old_french", "old_french", "latin", "unknown", "middle_high_german", "german")


def _of(values: tuple[str, ...], key: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


@query(f"SELECT event_id, [{', '.join(repr(x) for x in LANG_NAMES)}][CAST(event_id % 7 AS INTEGER) + 1] AS language FROM events")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", A.detected_language(_of(LANGS, "event_id")).alias("language"))


@query("SELECT event_id, ['latin', 'unknown', 'greek', 'unknown'][CAST(event_id % 4 AS INTEGER) + 1] AS script FROM events")
def script_names(spark: SparkSession, d: str) -> DataFrame:
    hint = F.when(F.col("event_id") % 4 < 3, _of(("latin_medieval", "insular_old_english", " Greek ", ""), "event_id"))
    return table(spark, d, "events").select("event_id", A.script_hint(hint).alias("script"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 OR regexp_matches(text, '(^|[^0-9])7([^0-9]|$)') THEN 'insular_old_english' WHEN regexp_matches(text, '[A-Za-zÀ-ÿ]') THEN 'latin_medieval' ELSE 'unknown' END AS script FROM documents")
def script_detection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.concat("text", F.lit("ж"))).when(k == 1, F.concat(F.lit("þ"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", A.detected_script(text).alias("script"))


TOKENS_NORM = "list_filter(string_split_regex(translate(lower({0}), 'ſvj', 'sui'), '\\s+'), lambda t: t <> '')"
among = lambda words: "len(list_filter(w, lambda t: t IN (" + ", ".join(f"'{x}'" for x in words) + ")))"
FRENCH = f"""SELECT *, CASE WHEN strong >= 2 OR (strong >= 1 AND func >= 2) THEN CASE WHEN anglo >= 2 THEN 'anglo_norman' WHEN old >= 2 AND middle = 0 THEN 'old_french' ELSE 'middle_french' END END AS family FROM (
SELECT *, len(list_filter(w, lambda t: regexp_matches(t, '^({"|".join(A.FRENCH_ANCHORS)})'))) AS strong, {among(A.FRENCH_FUNCTION)} AS func, {among(A.FRENCH_OLD)} AS old, {among(A.FRENCH_MIDDLE)} AS middle, {among(A.ANGLO_NORMAN)} AS anglo FROM (SELECT *, {TOKENS_NORM.format("x")} AS w FROM src))"""
FRENCH_SRC = "src AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' pere de la grace' WHEN 1 THEN ' euesque ki et la mei' WHEN 2 THEN ' prince de lausanne anglo norman' ELSE '' END AS x FROM documents)"


def _french(spark: SparkSession, d: str) -> DataFrame:
    added = _of((" pere de la grace", " euesque ki et la mei", " prince de lausanne anglo norman", ""), "doc_id")
    return table(spark, d, "documents").select("doc_id", F.concat("text", added).alias("x"))


@query(f"WITH {FRENCH_SRC} SELECT doc_id, family FROM ({FRENCH})")
def french_family(spark: SparkSession, d: str) -> DataFrame:
    return _french(spark, d).select("doc_id", A.french_family(F.col("x")).alias("family"))


@query(f"WITH src AS (SELECT doc_id, text || ' quod amen domini' AS x FROM documents) SELECT doc_id, len(list_intersect(list_distinct(w), [{', '.join(repr(x) for x in A.LATIN_ANCHORS)}])) AS anchors FROM (SELECT *, {TOKENS_NORM.format('x')} AS w FROM src)")
def latin_anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.latin_anchors(F.concat("text", F.lit(" quod amen domini"))).cast("long").alias("anchors"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'old_english' WHEN 2 THEN 'arabic' WHEN 3 THEN 'hebrew' WHEN 4 THEN 'middle_french' WHEN 5 THEN 'greek' WHEN 6 THEN 'church_slavonic' ELSE 'latin' END AS language FROM events")
def fallback_language(spark: SparkSession, d: str) -> DataFrame:
    text = _of((" ", "þat", "كتب", "שלום", "pere de la grace et la ville", "logos", "slovo", "in nomine"), "event_id")
    script = _of(("latin", "latin", "arabic", "latin", "latin", "greek", "cyrillic", "latin"), "event_id")
    return table(spark, d, "events").select("event_id", A.fallback_language(script, text).alias("language"))


@query("SELECT conv_id, turn, role, md5(CASE turn % 5 WHEN 4 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS reply FROM conversations WHERE length(text) > 2 AND NOT regexp_matches(text, '[\"{}\\[\\]`\\\\\\x00-\\x1F]') AND NOT starts_with(trim(text), chr(39))")
def sanitized_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter((F.length("text") > 2) & ~F.col("text").rlike(r'["{}\[\]`\\\x00-\x1F]') & ~F.trim("text").startswith("'"))
    k = F.col("turn") % 5
    raw = F.when(k == 0, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(k == 1, F.concat(F.lit('"'), "text", F.lit('"'))).when(k == 2, F.concat(F.lit('{"other": 1, "transcription": "'), "text", F.lit('"}'))).when(k == 3, F.col("text")).otherwise(F.concat(F.lit("There is no readable text: "), "text"))
    return rows.select("conv_id", "turn", "role", F.md5(A.sanitized_reply(raw)).alias("reply"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '...', '[…]'), '\\?{6,}', '[…]', 'g'), '\\s+', ' ', 'g'), ' ')) AS line FROM documents")
def normalized_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(A.normalized_line(F.concat("text", F.lit("\u0001")))).alias("line"))


@query("""SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(lower(x), 'as an ai'))) AS kept, CASE WHEN doc_id % 3 = 0 THEN 'meta_text_removed,' ELSE '' END || 'non_latin_chars_replaced' AS warnings FROM (
SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) < 10 OR len(list_distinct(regexp_extract_all(lower(x), '\\p{L}'))) > 2) AS l FROM documents) WHERE doc_id % 2 = 0""")
def normalized_lines(spark: SparkSession, d: str) -> DataFrame:
    # a line about the model and one with a letter of another script are added
    added = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nAs an AI model").otherwise(""), F.lit("\nж"))
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0")
    out = docs.select("doc_id", A.normalized_lines(added).alias("o"), F.array_contains(F.transform(T.lines(F.col("text")), T.pattern_junk), True).alias("junk"))
    return out.select("doc_id", (F.size("o.lines") - 1).cast("long").alias("kept"), F.array_join(F.filter("o.warnings", lambda w: w != "pattern_junk_removed"), ",").alias("warnings"))


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text, 2 AS removed FROM documents WHERE NOT regexp_matches(text, '(?i)transcribe')")
def prompt_echo(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(~F.lower("text").contains("transcribe"))
    prompt = F.lit("Transcribe every line exactly.\n- Do not translate; keep abbreviations:")
    told = A.without_echo(F.concat(F.lit("1. Do not translate; keep\ntranscribe every line exactly\n"), "text"), prompt)
    return docs.select("doc_id", told.alias("o")).select("doc_id", F.md5("o.text").alias("text"), "o.removed")


@query("SELECT event_id, event_id % 3 AS a, event_id % 2 AS b, 1 AS c FROM events")
def evidence_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.concat(F.repeat(F.lit("[EVIDENCE] x "), (k % 3).cast("int")), F.repeat(F.lit("[LINKED_ENTITY_EVIDENCE]"), (k % 2).cast("int")), F.lit("[UNRESOLVED_MENTION_EVIDENCE]"))
    return table(spark, d, "events").select("event_id", A.evidence_tags(text).alias("t")).select("event_id", F.col("t.ocr_chunk_evidence").cast("long").alias("a"), F.col("t.linked_entity_evidence").cast("long").alias("b"), F.col("t.unresolved_mention_evidence").alias("c"))


@query("SELECT doc_id, md5('[OCR_CHUNK_EVIDENCE]' || chr(10) || 'run_id: ' || doc_id || chr(10) || 'asset_ref: ' || source || chr(10) || 'chunk_id: c' || doc_id || chr(10) || 'offsets: 0-' || n_chars || chr(10) || 'retrieval_score: n/a' || chr(10) || 'text: ' || text || chr(10) || '[/OCR_CHUNK_EVIDENCE]') AS block FROM documents")
def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    block = A.evidence_block(c("doc_id"), c("source"), F.concat(F.lit("c"), "doc_id"), F.lit(0), c("n_chars"), F.lit(None).cast("double"), c("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(block).alias("block"))


@query("SELECT conv_id, turn, role, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))), ' ') AS terms FROM conversations")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_join(A.query_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN 'Instruct: {A.E5_TASK}' || chr(10) || 'Query: ' || text ELSE text END) AS input FROM benchmark")
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("item_id") % 2 == 0, "multilingual-e5-large-instruct").otherwise("local")
    return table(spark, d, "benchmark").select("item_id", F.md5(A.embedding_input(F.col("text"), model)).alias("input"))


@query("SELECT p_partkey, regexp_matches(lower(p_name), 'blue|green') AND NOT regexp_matches(lower(p_name), 'small|red') AS relevant FROM part")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", A.is_text_label(F.col("p_name"), ("blue", "green"), ("small", "red")).alias("relevant"))


@query("SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}''’\\-]+'), ['le', 'roi', 'river'])) > 0 AS cues FROM documents")
def entity_cues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.has_entity_cues(F.col("text"), ("le", "roi", "river")).alias("cues"))


@query("SELECT event_id, ['lexical/unknown', 'possible_place_unresolved', 'place', 'unknown', 'person'][CAST(event_id % 5 AS INTEGER) + 1] AS shown FROM events")
def unresolved_types(spark: SparkSession, d: str) -> DataFrame:
    kind = _of((" Place", "place", "place", " ", "PERSON"), "event_id")
    reason = _of(("low_evidence_place: lexical=True", "low_evidence_place: context=False", "other", "", "x"), "event_id")
    return table(spark, d, "events").select("event_id", A.unresolved_display_type(kind, reason).alias("shown"))


@query("SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents)")
def repaired_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.when(F.col("doc_id") % 2 == 0, F.array("text", F.lit(" ")))
    out = table(spark, d, "documents").select("doc_id", A.repaired(lines, F.col("text")).alias("o"))
    return out.select("doc_id", F.size("o.lines").cast("long").alias("n"), F.md5(F.array_join("o.lines", "\n")).alias("text"))


# Mentions
@query()
def extracted_mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.best_of_each(M.extracted(table(spark, d, "documents")))


@query("SELECT doc_id, start, \"end\", kind, max(confidence) AS confidence FROM (SELECT user_id AS doc_id, CAST(event_id % 50 AS INTEGER) AS start, CAST(event_id % 50 + 3 AS INTEGER) AS \"end\", event_type AS kind, value AS confidence FROM events) GROUP BY ALL")
def mention_best_of_each(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 50
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), k.cast("int").alias("start"), (k + 3).cast("int").alias("end"), F.lit("x").alias("surface"), F.col("event_type").alias("kind"), F.col("value").alias("confidence"), F.lit("rule").alias("method"))
    empty = rows.withColumn("end", F.col("start"))
    return M.best_of_each(rows.unionAll(empty)).select("doc_id", "start", "end", "kind", "confidence")


@query(f"SELECT doc_id, len(w) AS words, len(list_filter(w, lambda t: regexp_matches(t, '^\\p{{Lu}}'))) AS capitals, CAST(list_sum(list_transform(w, lambda t: length(t))) AS BIGINT) AS letters FROM (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM documents) WHERE len(w) > 0")
def token_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = M.token_spans(table(spark, d, "documents"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("surface").rlike(r"^\p{Lu}")).alias("capitals"), F.sum(F.col("end") - F.col("start")).alias("letters"))


PROPAGATED = "t AS (SELECT doc_id, unnest(regexp_extract_all(text, '" + WORD_SQL + "')) AS w FROM documents WHERE regexp_matches(text, '[A-Za-z]')), k AS (SELECT doc_id, " + FOLD.format("replace(w, 'ß', 'ss')") + " AS key FROM t)"


@query(f"WITH {PROPAGATED}, n AS (SELECT doc_id, key FROM k WHERE length(key) >= 4 AND NOT key LIKE '% %' GROUP BY doc_id, key HAVING min(key) = key AND key IN ('about', 'their', 'other', 'which', 'there')) SELECT doc_id, key, count(*) AS n FROM k JOIN n USING (doc_id, key) GROUP BY ALL")
def name_propagation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = docs.select("doc_id", F.explode(F.array(*map(F.lit, ("about", "their", "other", "which", "there", "the")))).alias("name_key"))
    none = spark.createDataFrame([], "doc_id long, start int, end int, kind string")
    found = M.propagated(M.token_spans(docs, keyed=True), none, names)
    return found.groupBy("doc_id", F.lower("surface").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {PROPAGATED} SELECT doc_id, upper(key) AS canonical, count(*) AS n FROM k WHERE key IN ('about', 'their', 'other', 'which') GROUP BY ALL")
def canonical_tokens(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("ABOUT", 1), ("THEIR", 2), ("OTHER", 3), ("WHICH", 4), ("which", 5)], "name string, position int")
    return M.first_canonical(M.token_spans(table(spark, d, "documents"), keyed=True), names).groupBy("doc_id", "canonical").agg(F.count("*").alias("n"))


# Regions, lines and votes
@query(f"WITH {BOXES} SELECT page, box_id, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, box_id, x2, y2) - 1 AS INTEGER) AS position FROM boxes")
def position_sort(spark: SparkSession, d: str) -> DataFrame:
    return N.by_position(_boxes(spark, d)).select("page", "box_id", "position")


@query(f"WITH {BOXES} SELECT page, box_id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN kind > 0 THEN 10 - kind END NULLS LAST, box_id) - 1 AS INTEGER) AS position FROM boxes")
def reading_order_sort(spark: SparkSession, d: str) -> DataFrame:
    return N.by_reading_order(_boxes(spark, d).withColumn("reading_order", F.when(F.col("kind") > 0, 10 - F.col("kind")))).select("page", "box_id", "position")


@query(f"WITH {BOXES} SELECT page, arg_min(box_id, (-(x2 - x1) * (y2 - y1), box_id)) AS largest, arg_min(box_id, (y1, box_id)) AS topmost FROM boxes WHERE kind = 1 GROUP BY page")
def label_regions(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d).withColumn("name", F.col("kind").cast("string"))
    of = lambda how: N.region_of_label(boxes, "1", how).select("page", F.col("box_id").alias(how))
    return of("largest").join(of("topmost"), "page")


@query("""WITH w AS (SELECT user_id, event_type AS hint, sum(greatest(0.05, value / 100)) AS w, min(event_id) AS f FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT u.user_id, coalesce(h, 'unknown') AS hint FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, arg_max(hint, (round(w, 9), -f)) AS h FROM w GROUP BY user_id) USING (user_id)""")
def script_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "view", "unknown").otherwise(F.col("event_type")).alias("hint"), (F.col("value") / 100).alias("confidence"), F.col("event_id").alias("position"))
    return N.weighted_vote(rows, "user_id")


@query("""WITH f AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 5) AS n FROM events), m AS (SELECT user_id, event_type AS backend, avg(value) AS mean_quality, min(length(event_type)) AS plan FROM f WHERE n <= 6 GROUP BY ALL)
SELECT user_id, backend, round(mean_quality, 6) AS mean_quality FROM m""")
def backend_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 5).alias("region"), F.col("event_type").alias("backend"), F.length("event_type").alias("plan"), F.col("value").alias("quality"))
    return N.backend_order(rows, "user_id").select("user_id", "backend", F.round("mean_quality", 6).alias("mean_quality"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, trim(regexp_replace(regexp_replace(lower(text), '^[^\\p{L}]+', ''), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') ORDER BY doc_id) > 1 AND length(trim(regexp_replace(regexp_replace(lower(text), '^[^\\p{L}]+', ''), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ')) >= 8 AS repeat FROM documents")
def degenerate_repeats(spark: SparkSession, d: str) -> DataFrame:
    return N.suppressed_repeats(table(spark, d, "documents").select("doc_id", "source", "text"), ["source"], "doc_id").select("doc_id", "repeat")


@query()
def merged_tile_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = N.lines_with_offsets(table(spark, d, "documents")).filter(F.length("line") > 0)
    tiles = lines.select(F.col("doc_id").alias("page"), (2 * F.col("n")).alias("line_id"), "line", F.lit(0.5).alias("confidence"))
    again = lines.select(F.col("doc_id").alias("page"), (2 * F.col("n") + 1).alias("line_id"), F.concat("line", F.lit("?")).alias("line"), F.lit(0.9).alias("confidence"))
    return N.merged_lines(tiles.unionAll(again))


OFFSETS = """o AS (SELECT doc_id, i - 1 AS n, l, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query(f"WITH {OFFSETS} SELECT doc_id, CAST(n AS INTEGER) AS n, s AS start, CAST(s + length(l) AS INTEGER) AS \"end\" FROM o")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return N.lines_with_offsets(table(spark, d, "documents")).select("doc_id", "n", "start", "end")


@query(f"WITH {OFFSETS}, k AS (SELECT *, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS b FROM o) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS idx, s AS start, CAST(s + length(l) AS INTEGER) AS \"end\" FROM k WHERE length(b) >= 2 AND lower(b) NOT IN ('et', 'de')")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return N.line_chunks(N.lines_with_offsets(table(spark, d, "documents")), ("et", "de")).select("doc_id", "idx", "start", "end")


@query("""SELECT doc_id, len(list_filter(range(1, greatest(len(s) - 3, 1)), lambda i: list_sum(s[i:i+4]) >= 3)) AS windows FROM (SELECT doc_id, list_transform(list_filter(string_split_regex(replace(text, 'e', ' e '), '\\s+'), lambda t: t <> ''), lambda t: CASE WHEN length(t) = 1 THEN 1 ELSE 0 END) AS s FROM documents)""")
def fragment_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.fragment_windows(F.replace("text", F.lit("e"), F.lit(" e "))).cast("long").alias("windows"))


@query(CHUNKS + """, pp AS (SELECT doc_id, CAST(k AS INTEGER) AS passage_id, CAST(length(text) * k // 4 AS INTEGER) AS a, CAST(length(text) * k // 4 AS INTEGER) + 30 * (k + 1) AS b FROM documents, (VALUES (0), (1), (2), (3)) v(k)),
mm AS (SELECT doc_id, passage_id, idx, least(b, end_offset) - greatest(a, start_offset) AS o, start_offset <= a AND b <= end_offset AS whole, b - a AS n FROM pp JOIN chunks USING (doc_id) WHERE least(b, end_offset) - greatest(a, start_offset) > 0),
ww AS (SELECT *, bool_or(whole) OVER v AS any_whole, bool_or(o >= 0.5 * n) OVER v AS any_half, first_value(idx) OVER (PARTITION BY doc_id, passage_id ORDER BY o DESC, idx) AS best FROM mm WINDOW v AS (PARTITION BY doc_id, passage_id))
SELECT doc_id, passage_id, idx FROM ww WHERE CASE WHEN any_whole THEN whole WHEN any_half THEN o >= 0.5 * n ELSE idx = best END""")
def passage_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    start = F.floor(F.length("text") * F.col("passage_id") / 4).cast("int")
    passages = docs.withColumn("passage_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 3))))).select("doc_id", "passage_id", start.alias("start"), (start + 30 * (F.col("passage_id") + 1)).alias("end"))
    return N.passage_chunks(passages, C.window_chunks(docs))


@query("SELECT user_id, round(avg(value) FILTER (WHERE event_id >= 0), 6) AS first FROM (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id HAVING count(*) = 3")
def smoothed_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("p")).filter(F.size("p") >= 3)
    return rows.select("user_id", F.round(F.get(N.smoothed(F.col("p"), 2), F.lit(0)), 6).alias("first"))


@query("SELECT user_id, count(*) AS bands FROM (SELECT user_id, value >= 50 AS hi, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id) >= 50, false) AS before FROM events) WHERE hi AND NOT before GROUP BY user_id")
def ink_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("p"))
    return rows.select("user_id", F.size(N.bands(F.col("p"), 50.0)).cast("long").alias("bands")).filter("bands > 0")


@query(f"WITH {BOXES} SELECT page, round(sum(score * greatest(1, (x2 - x1) * (y2 - y1))) / sum(greatest(1, (x2 - x1) * (y2 - y1))), 6) AS confidence FROM boxes GROUP BY page")
def area_weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    return N.retry_rank(_boxes(spark, d).withColumn("confidence", F.col("score")), "page").select("page", F.round("confidence", 6).alias("confidence"))


@query("SELECT event_id, NOT (value / 300 >= 0.18 OR (event_id % 2 = 0 AND value / 300 > 0.05)) AS kept FROM events")
def tile_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", N.tile_kept(F.col("value") / 300, F.col("event_id") % 2).alias("kept"))
