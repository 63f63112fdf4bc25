"""The relational core: newest runs, joins of links, merges of decisions, upserts, visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECEDENCE = ("ACCEPT_LINKABLE", "REJECT_LINKABLE", "SKIP_NON_LINKABLE", "FILTERED_OUT")


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, as a partial aggregate: no sort of whole groups. Columns as in df."""
    values = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(values, F.struct(*order)).alias("_row")).select("_row.*")


def page_key(sha: Column, ref: Column) -> Column:
    """What names a page: its hash, or its reference where no hash was recorded."""
    return F.coalesce(F.nullif(F.trim(sha), F.lit("")), F.concat(F.lit("asset_ref:"), ref))


def searchable_runs(runs: DataFrame, chunks: DataFrame, reports: DataFrame, explicit: bool = False) -> DataFrame:
    """run_id, asset_ref, page_key, created_at of runs that have chunks and that the gate allows (the run's own flag, else that
    of its latest report); without explicit only the newest of each page.

    runs: run_id, asset_ref, asset_sha256, created_at, search_allowed; chunks: run_id; reports: run_id, pass_idx, created_at,
    token_search_allowed."""
    latest = reports.groupBy("run_id").agg(F.max_by("token_search_allowed", F.struct("pass_idx", "created_at")).alias("_report"))
    allowed = runs.join(chunks.select("run_id"), "run_id", "left_semi").join(latest, "run_id", "left").filter(F.coalesce("search_allowed", "_report"))
    out = allowed.select("run_id", "asset_ref", page_key(F.col("asset_sha256"), F.col("asset_ref")).alias("page_key"), "created_at")
    return out if explicit else latest_per(out, ["page_key"], [F.col("created_at"), F.col("run_id")])


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every argument that isn't None."""
    given = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new by key: new values replace old ones unless null; columns in keep stay as they were."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, reduce(Column.__and__, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]), "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])


def replace_children(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key in the order of position."""
    return latest_per(rows, keys, [-F.col(position)])


def without_run(df: DataFrame, gone: DataFrame, key: str = "run_id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def merge_decisions(decisions: DataFrame, keys: list[str], position: str, status: str = "status") -> DataFrame:
    """One decision for each span: the first of the highest status; merged: statuses of the others, in order of position."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col(status))
    ranked = decisions.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(PRECEDENCE) + 1))
    place = Window.partitionBy(*keys).orderBy("_rank", position)
    ranked = ranked.withColumn("_place", F.row_number().over(place))
    losers = F.array_sort(F.collect_list(F.when(F.col("_place") > 1, F.struct(F.col(position).alias("p"), F.col(status).alias("s")))))
    merged = ranked.groupBy(*keys).agg(F.max_by(position, -F.col("_place")).alias(position), F.max_by(status, -F.col("_place")).alias(status), losers.alias("_l"))
    return merged.select(*keys, position, status, F.transform("_l", lambda x: x["s"]).alias("merged"))


def link_report(links: DataFrame, mentions: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """links with their mention (which must exist), and the entity and evidence where there are any."""
    return links.join(mentions, "mention_id").join(entities, "entity_id", "left").join(evidence, "evidence_id", "left")


def visits_by(visits: DataFrame, column: str, visitor: str, unknown: str = "Unknown") -> DataFrame:
    """Visits and distinct visitors by a column's own values: null and the empty text are two groups of the same name."""
    grouped = visits.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("visits"), F.count_distinct(visitor).alias("unique_visitors"))
    return grouped.select(F.coalesce(F.nullif(F.col("_value"), F.lit("")), F.lit(unknown)).alias(column), "visits", "unique_visitors")


def visits_by_day(visits: DataFrame, ts: str, visitor: str, days: int = 30) -> DataFrame:
    daily = visits.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("visits"), F.count_distinct(visitor).alias("unique_visitors"))
    return daily.orderBy(F.desc("day")).limit(days)


def recent_visits(visits: DataFrame, ts: str, tie: str, n: int = 100) -> DataFrame:
    return visits.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def visit_summary(visits: DataFrame, ts: str, visitor: str, column: str, today: str, bot: Column) -> DataFrame:
    return visits.agg(
        F.count("*").alias("total_visits"),
        F.count_distinct(visitor).alias("unique_visitors"),
        F.count_distinct(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))).alias("places"),
        F.count_if(F.to_date(ts) == F.lit(today).cast("date")).alias("today_visits"),
        F.count_if(bot).alias("bot_visits"),
    )


def span_key(start: Column, end: Column, surface: Column) -> Column:
    return F.sha2(F.concat_ws("|", start.cast("string"), end.cast("string"), F.lower(surface)), 256)


def index_freshness(chunks: DataFrame, indexed: DataFrame, key: str = "run_id", item: str = "chunk_id") -> DataFrame:
    """Of each run: chunks, those that the index lacks, and those in the index that are no longer chunks."""
    c = chunks.select(key, item).distinct().withColumn("_c", F.lit(1))
    i = indexed.select(key, item).distinct().withColumn("_i", F.lit(1))
    both = c.join(i, [key, item], "full")
    return both.groupBy(key).agg(F.count("_c").alias("chunks"), F.count_if(F.col("_i").isNull()).alias("missing"), F.count_if(F.col("_c").isNull()).alias("orphaned"))


def expired(tasks: DataFrame, ts: str, now: str, ttl_hours: float) -> DataFrame:
    """Rows older than a time to live."""
    return tasks.filter(F.col(ts) < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(int(ttl_hours))))


def superseded(runs: DataFrame, page: str, created: str, run: str) -> DataFrame:
    """Runs of which the page has a newer one. The newest of each page is an aggregate, met by an equi-join."""
    newest = runs.groupBy(F.col(page).alias("_page")).agg(F.max(F.struct(created, run)).alias("_newest"))
    both = runs.join(newest, F.col(page) == F.col("_page"))
    return both.filter(F.struct(created, run) < F.col("_newest")).select(*[runs[c] for c in runs.columns])


def weighted_confidence(tiles: DataFrame, key: str, confidence: str, weight: str) -> DataFrame:
    """Mean confidence by key, weighted by lines (1 at least), within 0 and 1."""
    w = F.greatest(F.lit(1), F.col(weight))
    mean = F.sum(F.col(confidence) * w) / F.sum(w)
    return tiles.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("confidence"))


def vote(rows: DataFrame, key: str, choice: str, weight: Column, position: str) -> DataFrame:
    """The choice of the greatest summed weight by key; ties go to the one seen first."""
    sums = rows.groupBy(key, choice).agg(F.sum(weight).alias("_w"), F.min(position).alias("_first"))
    return sums.groupBy(key).agg(F.max_by(choice, F.struct("_w", -F.col("_first"))).alias(choice))


def repeats(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """rows with seen_before: how many earlier rows have the same keys."""
    place = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("seen_before", F.row_number().over(place) - 1)


def classify_vectors(vectors: DataFrame, runs: DataFrame, searchable: DataFrame, approved: DataFrame) -> DataFrame:
    """vectors (run_id) with state: searchable, superseded (approved, no longer searched), refused, or orphaned (of no run)."""
    marked = lambda df, name: df.select("run_id").distinct().withColumn(name, F.lit(True))
    out = vectors
    for df, name in ((searchable, "_s"), (approved, "_a"), (runs, "_r")):
        out = out.join(marked(df, name), "run_id", "left")
    state = F.when(F.col("_s"), "searchable").when(F.col("_a"), "superseded").when(F.col("_r"), "refused").otherwise("orphaned")
    return out.withColumn("state", state).drop("_s", "_a", "_r")


def distinct_readings(rows: DataFrame, key: str, fields: list[str], least: int = 400) -> DataFrame:
    """key, field, text of the texts of some columns, each once (white space folded): the first by key, then by field's order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])
    every = rows.select(key, F.explode(pairs).alias("x")).select(key, "x.*").filter(F.length("text") >= least)
    folded = F.trim(F.regexp_replace("text", r"\s+", " "))
    first = every.groupBy(F.sha2(folded, 256).alias("_fold")).agg(F.min(F.struct(key, "i", "field", "text")).alias("x"))
    return first.select(f"x.{key}", "x.field", "x.text")


def entity_index(rows: DataFrame, key: str, surface: str, score: str, most: int = 12) -> DataFrame:
    """By key: the best score and the `most` best distinct surfaces, joined by a bar. Surfaces are reduced to one row each first."""
    best = rows.groupBy(key, surface).agg(F.max(score).alias("_s"))
    place = Window.partitionBy(key).orderBy(F.desc("_s"), surface)
    top = best.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", surface)))
    return top.groupBy(key).agg(F.max("_s").alias("best"), F.array_join(F.transform(listed, lambda x: x[surface]), "|").alias("surfaces"))
