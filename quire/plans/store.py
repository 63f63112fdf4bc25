"""Queries of the store of runs: events are the log (user: run), documents the chunks (source: run), orders decisions with
line items as their attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import store as O
from quire.plans.queries import query, table

ORDER_STATUS = "['ACCEPT_LINKABLE', 'REJECT_LINKABLE', 'SKIP_NON_LINKABLE', 'FILTERED_OUT'][CAST(o_custkey % 4 AS INTEGER) + 1]"
STATUSES = ("ACCEPT_LINKABLE", "REJECT_LINKABLE", "SKIP_NON_LINKABLE", "FILTERED_OUT")


def _status(key: str):
    return F.get(F.array(*map(F.lit, STATUSES)), (F.col(key) % 4).cast("int"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("decision_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("attempt_id"), "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag", "l_discount")


ATTEMPTS = "(SELECT l_orderkey AS decision_id, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS attempt_id, l_linenumber, l_partkey, l_quantity, l_tax, l_returnflag, l_discount FROM lineitem)"


# Scans
@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def get_run(spark: SparkSession, d: str) -> DataFrame:
    return O.scan(table(spark, d, "orders"), ["o_orderkey"], o_orderkey=7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS position FROM events")
def ordered_log(spark: SparkSession, d: str) -> DataFrame:
    return O.numbered(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT source, doc_id, n_chars FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id LIMIT 20")
def list_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return O.scan(docs, ["doc_id"], 20, source=docs.agg(F.min("source")).first()[0])


@query("SELECT d.source, d.doc_id, r.chunks FROM documents d JOIN (SELECT source, count(*) AS chunks FROM documents GROUP BY source HAVING count(*) > 3) r USING (source) ORDER BY d.source, d.doc_id LIMIT 500")
def list_chunks_for_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    return O.of_runs(docs, docs.groupBy("source").agg(F.count("*").alias("chunks")).filter("chunks > 3"), "source", ["doc_id"], 500)


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS position FROM conversations")
def list_mentions(spark: SparkSession, d: str) -> DataFrame:
    return O.numbered(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "position")


@query(f"SELECT decision_id, attempt_id, o_custkey AS run_id FROM {ATTEMPTS} JOIN orders ON decision_id = o_orderkey")
def attempts_for_run(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("run_id"))
    return O.through_parent(_attempts(spark, d).select("decision_id", "attempt_id"), parents, "decision_id", "run_id")


@query("SELECT doc_id, quality <> 0 AS quality, toxic <> 0 AS toxic, CAST(row_number() OVER (PARTITION BY quality ORDER BY toxic, doc_id) - 1 AS INTEGER) AS position FROM labels")
def backend_results(spark: SparkSession, d: str) -> DataFrame:
    return O.flagged(O.numbered(table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["quality"], ["toxic", "doc_id"]), "quality", "toxic")


@query("SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS pass_idx FROM events")
def quality_reports_of_runs(spark: SparkSession, d: str) -> DataFrame:
    return O.numbered(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "pass_idx").select("user_id", "event_type", "event_id", "pass_idx")


@query(f"SELECT decision_id, attempt_id, CAST(row_number() OVER (PARTITION BY decision_id ORDER BY attempt_id) - 1 AS INTEGER) AS attempt_idx FROM {ATTEMPTS}")
def attempts_of_decision(spark: SparkSession, d: str) -> DataFrame:
    return O.numbered(_attempts(spark, d).select("decision_id", "attempt_id"), ["decision_id"], ["attempt_id"], "attempt_idx")


@query("SELECT n_regionkey AS run_id, n_nationkey AS tile, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS position FROM nation")
def tile_audit(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("tile"), "n_name")
    return O.numbered(nations, ["run_id"], ["tile"])


@query("SELECT item_id, length(text) AS n_chars, CAST(row_number() OVER (ORDER BY length(text) DESC, item_id) AS INTEGER) AS place FROM benchmark ORDER BY 3 LIMIT 25")
def benchmark_references(spark: SparkSession, d: str) -> DataFrame:
    rows = O.scan(table(spark, d, "benchmark").select("item_id", F.length("text").alias("n_chars")), [F.desc("n_chars"), "item_id"], 25)
    return O.numbered(rows.withColumn("_", F.lit(0)), ["_"], [F.desc("n_chars"), "item_id"], "place").select("item_id", "n_chars", (F.col("place") + 1).alias("place"))


@query(f"SELECT o_orderkey, o_custkey, {ORDER_STATUS} AS status FROM orders WHERE {ORDER_STATUS} = 'ACCEPT_LINKABLE' ORDER BY o_custkey, o_orderkey LIMIT 100")
def list_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", _status("o_custkey").alias("status"))
    return O.scan(rows, ["o_custkey", "o_orderkey"], 100, status="ACCEPT_LINKABLE")


@query("SELECT n_regionkey, 'n_nationkey,n_name' AS columns, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey")
def table_view(spark: SparkSession, d: str) -> DataFrame:
    view = O.table_view(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", ["n_nationkey"])
    return view.select("n_regionkey", F.array_join("columns", ",").alias("columns"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ":")), ",").alias("rows"))


@query("SELECT DISTINCT label, vec_id FROM embeddings")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id").distinct()


# Writes, as the new state of a table
@query("SELECT user_id, event_type, max_by(event_id, (fresh, event_id)) AS event_id, max_by(value, (fresh, event_id)) AS value FROM (SELECT *, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS fresh FROM events) GROUP BY user_id, event_type")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return O.insert_or_replace(rows.filter("value < 50"), rows.filter("value >= 50"), ["user_id", "event_type"], "event_id")


@query("SELECT count(*) AS n, count(DISTINCT decision_id) AS decisions FROM (SELECT CASE WHEN l_quantity > 10 THEN l_orderkey END AS decision_id, CASE WHEN l_tax > 0.01 THEN l_returnflag ELSE ' ' END AS candidate FROM lineitem) WHERE decision_id IS NOT NULL AND trim(candidate) <> ''")
def insert_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _attempts(spark, d).select(F.when(F.col("l_quantity") > 10, F.col("decision_id")).alias("decision_id"), F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).otherwise(" ").alias("candidate"))
    return O.complete(rows, "decision_id", "candidate").agg(F.count("*").alias("n"), F.count_distinct("decision_id").alias("decisions"))


@query("SELECT user_id, event_type, label, value, min(event_id) AS event_id FROM (SELECT user_id, event_type, CASE WHEN event_id % 7 > 0 THEN 'p' || event_id % 3 ELSE '' END AS label, CAST(floor(value / 25) AS INTEGER) AS value, event_id FROM events) WHERE label <> '' GROUP BY ALL")
def replace_assertions(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("p"), F.col("event_id") % 3)).otherwise("")
    rows = table(spark, d, "events").select("user_id", "event_type", name.alias("label"), F.floor(F.col("value") / 25).cast("int").alias("value"), "event_id")
    return O.replace_assertions(rows, "user_id", "event_type", "label", "value", "event_id")


@query("SELECT o_custkey AS mention_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS link, max(o_orderdate) AS at FROM orders GROUP BY o_custkey")
def upsert_mention_link(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("mention_id"), F.col("o_orderkey").alias("link"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    out = O.insert_or_replace(rows.filter("link % 2 = 0").limit(0), rows, ["mention_id"], "at")
    return out.select("mention_id", "link", F.col("at.o_orderdate").alias("at"))


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN customer ON o_orderkey = c_custkey")
def update_fields(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.when(F.col("c_custkey") % 3 == 0, "done").alias("o_orderstatus"), F.lit(-1.0).alias("o_totalprice"), F.lit(1).alias("other"))
    return O.update_fields(runs, new, "o_orderkey", ["o_orderstatus", "other"])


@query("SELECT c_custkey AS user_id, CAST(coalesce(max(ts), TIMESTAMP '2020-01-01') AS VARCHAR) AS updated_at, coalesce(max_by(event_type, event_id), 'RECEIVED') AS current_stage FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey")
def log_event_touch(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2020-01-01 00:00:00").cast(table(spark, d, "events").schema["ts"].dataType).alias("updated_at"), F.lit("RECEIVED").alias("current_stage"))
    out = O.touched(runs, table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")
    return out.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("SELECT vec_id, label + 10 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 > 0")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("at"))
    new = old.filter("vec_id % 3 = 0").withColumns({"label": F.col("label") + 10, "at": F.lit(1)})
    return O.insert_or_replace(old, new, ["vec_id"], "at").drop("at")


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT label FROM embeddings WHERE vec_id < 5) r WHERE r.label = e.label)")
def delete_run_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return vectors.join(vectors.filter("vec_id < 5").select("label").distinct(), "label", "left_anti").select("vec_id")


# Lookups, counts and choices
@query("SELECT u.user_id, coalesce(v, '') AS v FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) u LEFT JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS v FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id) USING (user_id)")
def authority_aliases(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    out = O.values_of(ids, table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")
    return out.select("user_id", F.array_join("values", ",").alias("v"))


@query("SELECT u.user_id, len(coalesce(v, [])) AS n, coalesce(v[1], -1) AS first FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) u LEFT JOIN (SELECT user_id, list(k ORDER BY f) AS v FROM (SELECT user_id, CAST(floor(value) AS INTEGER) AS k, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id) USING (user_id)")
def authority_assertions(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    out = O.values_of(ids, table(spark, d, "events").select("user_id", F.floor("value").cast("int").alias("k"), "event_id"), "user_id", "k", "event_id")
    return out.select("user_id", F.size("values").cast("long").alias("n"), F.coalesce(F.get("values", F.lit(0)), F.lit(-1)).alias("first"))


@query("SELECT e.event_id, m.id AS mention_id FROM events e LEFT JOIN (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS id FROM events WHERE event_id % 3 > 0 GROUP BY ALL) m ON e.user_id = m.user_id AND e.event_type = m.event_type AND CAST(e.ts AS DATE) = m.day")
def resolve_mention_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    stored = rows.filter("event_id % 3 > 0").withColumnRenamed("event_id", "mention_id")
    return O.resolve_ids(rows, stored, ["user_id", "event_type", "day"], "mention_id").select("event_id", "mention_id")


@query(f"SELECT o_custkey AS run_id, {ORDER_STATUS.replace('o_custkey', 'o_orderkey')} AS status, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_custkey, {ORDER_STATUS.replace('o_custkey', 'o_orderkey')}), (o_custkey))")
def count_decisions(spark: SparkSession, d: str) -> DataFrame:
    return O.counts_of_run(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), _status("o_orderkey").alias("status")), "run_id", "status")


@query("SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def count_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))


@query(f"""WITH d AS (SELECT o_custkey AS run_id, o_orderkey AS decision_id, CASE WHEN o_orderkey % 97 = 0 THEN 'ODD' ELSE {ORDER_STATUS.replace('o_custkey', 'o_orderkey')} END AS status, o_custkey || '|' || o_orderdate AS span FROM orders WHERE o_orderkey % 10 > 0),
a AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status <> 'ODD') AS known, count(DISTINCT span) AS spans FROM d GROUP BY run_id),
o AS (SELECT o_custkey AS run_id, count(*) AS orphans FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey NOT IN (SELECT decision_id FROM d) GROUP BY 1)
SELECT run_id, coalesce(total, 0) AS total, coalesce(orphans, 0) AS orphans, coalesce(known = total, true) AS statuses_known, coalesce(orphans, 0) = 0 AS attempts_decided, coalesce(known = total, true) AS parts_add_up, coalesce(spans = total, true) AS spans_unique FROM a FULL JOIN o USING (run_id)""")
def audit_gates(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    span = F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("string"))
    decided = orders.filter("o_orderkey % 10 > 0").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderkey") % 97 == 0, "ODD").otherwise(_status("o_orderkey")).alias("status"), span.alias("span"))
    attempts = O.through_parent(_attempts(spark, d).select("decision_id"), orders.select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("run_id")), "decision_id", "run_id")
    return O.audit_gates(decided, attempts, "run_id", STATUSES)


@query(f"""SELECT decision_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY l_quantity <= 25, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END, l_tax, attempt_id) AS k FROM {ATTEMPTS}) WHERE k = 1""")
def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "N", "OK").otherwise("UNRELIABLE")
    rows = _attempts(spark, d).select("decision_id", "attempt_id", (F.col("l_quantity") > 25).alias("passed"), label.alias("label"), F.col("l_tax").alias("gibberish"))
    return O.best_attempt(rows, ["decision_id"], "passed", "label", "gibberish", "attempt_id").select("decision_id", "attempt_id")


@query("SELECT c_custkey AS run_id, e AS event_id FROM customer LEFT JOIN (SELECT user_id, max_by(event_id, event_id) AS e FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id) ON c_custkey = user_id")
def report_of_pass(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    least = events.agg(F.min("event_type")).first()[0]
    reports = events.select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == least, 0).otherwise(1).alias("pass_idx"), F.col("event_id").alias("created_at"), "event_id")
    return O.report_of_pass(table(spark, d, "customer").select(F.col("c_custkey").alias("run_id")), reports, "run_id", 0)


@query("SELECT user_id, max_by(event_type, event_id) AS stage FROM events WHERE value > 30 GROUP BY user_id")
def latest_completed_stage(spark: SparkSession, d: str) -> DataFrame:
    return O.latest_completed(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 30, "event_id")


@query("SELECT source, count(*) AS n, count(*) > 60 AS too_large FROM documents GROUP BY source")
def scope_cap(spark: SparkSession, d: str) -> DataFrame:
    return O.capped_scope(table(spark, d, "documents"), "source", 60)


@query("""WITH c AS (SELECT user_id, event_type, max_by(value, ts) AS value, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY ALL), a AS (SELECT DISTINCT c_custkey AS user_id, event_type FROM customer, (SELECT DISTINCT event_type FROM events))
SELECT a.user_id, a.event_type, CASE WHEN ts IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) / 3600.0 > 240 THEN 'expired' WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'empty-hit' ELSE 'hit' END AS status FROM a LEFT JOIN c USING (user_id, event_type)""")
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    cache = events.filter("event_id % 2 = 0").select("user_id", "event_type", F.col("ts").alias("fetched_at"), (F.floor("value") % 4).alias("n_results"))
    # every customer asks for every type: five types, a fixed few
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*[F.lit(r[0]) for r in events.select("event_type").distinct().collect()])).alias("event_type"))
    return O.cache_status(asked, cache, ["user_id", "event_type"], "2024-01-30 00:00:00", 240)


@query("SELECT user_id, event_type, max_by(event_id, (fresh, event_id)) AS fetched_at, max_by(CAST(floor(value) AS BIGINT) % 4, (fresh, event_id)) AS n_results FROM (SELECT *, event_id % 2 AS fresh FROM events) WHERE fresh = 0 OR CAST(floor(value) AS BIGINT) % 4 > 0 GROUP BY ALL")
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("fetched_at"), (F.floor("value") % 4).alias("n_results"))
    return O.cache_put(rows.filter("fetched_at % 2 = 0"), rows.filter("fetched_at % 2 = 1"), ["user_id", "event_type"])


@query("SELECT c_custkey, sha256('wikidata|' || lower(trim(c_name)) || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'fr' ELSE '' END || '|person') AS cache_key FROM customer")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("c_custkey") % 2 == 0, "fr")
    return table(spark, d, "customer").select("c_custkey", O.cache_key(F.lit("WIKIDATA"), F.concat(F.lit(" "), "c_name"), lang, F.lit("person")).alias("cache_key"))


@query("SELECT doc_id, l.doc_id IS NOT NULL AS tiled FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) l USING (doc_id) WHERE n_chars <= 900 AND lang = 'en'")
def regrade_candidates(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 900, True).alias("search_allowed"), (F.col("lang") == "en").alias("graded"))
    return O.regrade_candidates(runs, table(spark, d, "labels").filter("toxic = 0"), "doc_id").select("doc_id", "tiled")


@query("SELECT o_custkey AS entity, max(o_totalprice) AS confidence, count(DISTINCT o_orderstatus) AS n, min_by(o_orderstatus, o_orderkey) AS first FROM orders GROUP BY o_custkey")
def grouped_evidence(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("confidence"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("surface"), F.col("o_orderkey").alias("position"))
    return O.grouped_evidence(links, "entity").select("entity", "confidence", F.size("surfaces").cast("long").alias("n"), F.get("evidence", F.lit(0)).alias("first"))


@query("""SELECT o_custkey AS run_id, count(*) AS mentions, CAST(coalesce(sum(n), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(k), 0) AS BIGINT) AS selected, count(n) AS with_candidates, round(avg(best), 6) AS mean_best
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS k, max(l_quantity) AS best FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def linking_report(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when(F.col("l_linenumber") == 1, '{"selected": true}').when(F.col("l_linenumber") == 2, "not json").otherwise('{"selected": false}')
    candidates = _attempts(spark, d).filter("l_returnflag <> 'R'").select(F.col("decision_id").alias("mention_id"), F.col("l_quantity").alias("score"), meta.alias("meta"))
    mentions = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_custkey").alias("run_id"))
    return O.linking_report(candidates, mentions, "run_id").withColumn("mean_best", F.round("mean_best", 6))


@query("SELECT user_id, max_by(CASE WHEN event_id % 3 > 0 THEN event_type END, CASE WHEN event_id % 3 > 0 THEN event_id END) AS kind, max_by(CASE WHEN event_id % 5 > 0 THEN value END, CASE WHEN event_id % 5 > 0 THEN event_id END) AS value FROM events GROUP BY user_id")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise("").alias("kind"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"), "event_id")
    return O.merged_candidates(rows, ["user_id"], "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Q' || c_custkey WHEN c_custkey % 3 = 1 THEN 'viaf:' || c_custkey ELSE 'viaf:label:' || lower(c_name) END AS identity FROM customer")
def candidate_identity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entity, number = F.when(k % 3 == 0, F.concat(F.lit("Q"), k)).otherwise(" "), F.when(k % 3 == 1, k.cast("string"))
    return table(spark, d, "customer").select("c_custkey", O.identity_key(entity, F.lit("viaf"), number, F.col("c_name")).alias("identity"))


@query("""SELECT user_id, string_agg(CASE WHEN lo = 1 THEN s END, ',' ORDER BY s) AS accepted, string_agg(CASE WHEN hi = 0 THEN s END, ',' ORDER BY s) AS rejected, string_agg(CASE WHEN hi = 1 AND lo = 0 THEN s END, ',' ORDER BY s) AS both
FROM (SELECT user_id, event_type AS s, max(CAST(value > 60 AS INTEGER)) AS hi, min(CAST(value > 60 AS INTEGER)) AS lo FROM events GROUP BY ALL) GROUP BY user_id""")
def surface_difference(spark: SparkSession, d: str) -> DataFrame:
    out = O.surface_difference(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 60)
    return out.select("user_id", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("accepted", "rejected", "both")])


@query("SELECT event_id, CASE WHEN value > 90 THEN 'FILTERED_OUT' WHEN event_type NOT IN ('click', 'view') THEN 'SKIP_NON_LINKABLE' WHEN value / 100 < 0.4 THEN 'REJECT_LINKABLE' ELSE 'ACCEPT_LINKABLE' END AS status FROM events")
def decision_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), (F.col("value") / 100).alias("confidence"), (F.col("value") > 90).alias("filtered"))
    return O.route_decisions(rows, ("click", "view"), 0.4).select("event_id", "status")


@query("SELECT o_orderkey AS mention_id, 'low quality' AS reason, 'unresolved_low_quality' AS status, least(0.35, o_custkey % 10 / 10.0) AS confidence FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def deferred_mentions(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), (F.col("o_custkey") % 10 / 10.0).alias("confidence"))
    links = table(spark, d, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("mention_id"))
    return O.deferred(mentions, "low quality", links)


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS metric FROM events")
def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 3 > 0, F.col("value")).when(F.col("event_id") % 6 == 0, float("nan")).otherwise(float("inf"))
    return table(spark, d, "events").select("event_id", O.finite(odd).alias("metric"))
