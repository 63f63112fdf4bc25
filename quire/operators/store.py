"""The store of runs: ordered scans, lookups, inserts that replace, partial updates, counts and audits.

Tables are DataFrames; a write gives the table's new state, which the caller saves (Parquet partitions are replaced as a
whole). A scan of a run is a filter that reaches the files, then an order; limits are top-k, not sorts of whole tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, order: list[str | Column], limit: int | None = None, **wanted: object) -> DataFrame:
    """Rows with the values asked for (None: any), in order, at most `limit`. Columns as in df; an empty table gives none."""
    for name, value in wanted.items():
        df = df if value is None else df.filter(F.col(name) == value)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def numbered(df: DataFrame, run: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """Every run's rows in order at once: df with each row's place (from 0) within its run. Ties need an order that parts them."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*run).orderBy(*order)) - 1)


def of_runs(children: DataFrame, runs: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Children of the runs asked for, with the runs' columns, in the order of run and then `order`. Runs without children
    and children of other runs don't show. A limit counts over all runs."""
    out = children.join(runs, key).orderBy(key, *order)
    return out if limit is None else out.limit(limit)


def through_parent(children: DataFrame, parents: DataFrame, parent_key: str, run: str) -> DataFrame:
    """Children with the run that their parent belongs to; children without a parent don't show."""
    return children.join(parents.select(parent_key, run), parent_key)


def flagged(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns of 0 and 1 as booleans; null stays null."""
    return df.withColumns({c: F.col(c) != 0 for c in columns})


def table_view(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, columns and rows: of each run its table as text, cells in the order of the columns, rows in `order`."""
    names = [c for c in df.columns if c != key]
    cells = F.struct(*[F.col(c) for c in order], F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("_cells"))
    rows = F.transform(F.array_sort(F.collect_list(cells)), lambda r: r["_cells"])
    return df.groupBy(key).agg(rows.alias("rows")).select(key, F.array(*map(F.lit, names)).alias("columns"), "rows")


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], written: str) -> DataFrame:
    """The table after rows are inserted: of each key the row written last, by column `written`; a new row wins over an old
    one. One aggregate, no sort of groups. Rows with a null in a key are each their own where all their columns differ."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*[F.col(c) for c in old.columns]), F.struct("_new", written))
    return every.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def complete(rows: DataFrame, *needed: str) -> DataFrame:
    """Rows whose needed columns are neither null nor, as text, blank."""
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return rows


def replace_assertions(rows: DataFrame, owner: str, source: str, name: str, value: str, order: str) -> DataFrame:
    """Of each owner's assertions the first of every (source, name, value); those without source or name go."""
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order)
    return complete(rows, source, name).groupBy(owner, source, name, value).agg(first.alias("_row")).select("_row.*")


def update_fields(table: DataFrame, updates: DataFrame, key: str, allowed: Iterable[str]) -> DataFrame:
    """table with the allowed columns of updates (a row for each key at most) put in where they aren't null; other columns of
    updates are left out, and updates of rows that aren't there do nothing."""
    fields = [c for c in updates.columns if c in set(allowed) and c in table.columns and c != key]
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = table.join(new, F.col(key) == F.col("_key"), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def touched(runs: DataFrame, events: DataFrame, key: str, at: str, stage: str, order: str) -> DataFrame:
    """runs with updated_at and current_stage of their last event; runs without events keep what they have."""
    last = events.groupBy(F.col(key).alias("_key")).agg(F.max(at).alias("_at"), F.max_by(stage, order).alias("_stage"))
    both = runs.join(last, F.col(key) == F.col("_key"), "left")
    return both.withColumns({"updated_at": F.coalesce("_at", "updated_at"), "current_stage": F.coalesce("_stage", "current_stage")}).drop("_key", "_at", "_stage")


def latest_completed(events: DataFrame, run: str, stage: str, ended: Column, order: str) -> DataFrame:
    """run and stage: the stage of each run's last event that ended one."""
    return events.filter(ended).groupBy(run).agg(F.max_by(stage, order).alias("stage"))


def best_attempt(attempts: DataFrame, run: list[str], passed: str, label: str, gibberish: str, order: str) -> DataFrame:
    """The best attempt of each run: gates passed, then the better label, then less gibberish; of equals the first. An unknown
    label ranks last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("HIGH", "OK", "RISKY", "UNRELIABLE"))), F.col(label)), F.lit(0))
    place = F.struct((~F.col(passed)).cast("int"), F.when(rank == 0, 9).otherwise(rank), F.col(gibberish), F.col(order))
    return attempts.groupBy(*run).agg(F.min_by(F.struct(*[F.col(c) for c in attempts.columns]), place).alias("_row")).select("_row.*")


def report_of_pass(runs: DataFrame, reports: DataFrame, run: str, number: int) -> DataFrame:
    """runs with the columns of their latest report (by created_at) of one pass; null where there is none."""
    fields = [c for c in reports.columns if c not in (run, "pass_idx", "created_at")]
    last = reports.filter(F.col("pass_idx") == number).groupBy(run).agg(F.max_by(F.struct(*fields), "created_at").alias("_row")).select(run, "_row.*")
    return runs.join(last, run, "left")


def counts_of_run(df: DataFrame, run: str, status: str) -> DataFrame:
    """run, status and n: rows of each run in all (status null) and by status; a null status is told from the total by
    its place in grouping, not shown."""
    out = df.groupingSets([[F.col(run), F.col(status)], [F.col(run)]], run, status).agg(F.count("*").alias("n"), F.grouping(status).alias("_all"))
    return out.filter((F.col("_all") == 1) | F.col(status).isNotNull()).drop("_all")


def audit_gates(decisions: DataFrame, attempts: DataFrame, run: str, statuses: tuple[str, ...]) -> DataFrame:
    """run and four gates: every status is known, every attempt has a decision, the statuses add up to the total, and no span
    is decided twice. decisions: run, decision_id, status, span; attempts: decision_id, run. Runs with neither don't show."""
    known = F.col("status").isin(*statuses)
    a = decisions.groupBy(run).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(known, F.lit(False))).alias("_known"), F.count_distinct("span").alias("_spans"),
        *[F.count_if(F.col("status") == s).alias(f"_{k}") for k, s in enumerate(statuses)],
    )
    orphans = attempts.join(decisions.select("decision_id"), "decision_id", "left_anti").groupBy(run).agg(F.count("*").alias("orphans"))
    both = a.join(orphans, run, "full").withColumns({"total": F.coalesce("total", F.lit(0)), "orphans": F.coalesce("orphans", F.lit(0))})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = sum((zero(f"_{k}") for k in range(len(statuses))), F.lit(0))
    return both.select(
        run, "total", "orphans", (zero("_known") == F.col("total")).alias("statuses_known"), (F.col("orphans") == 0).alias("attempts_decided"),
        (parts == F.col("total")).alias("parts_add_up"), (zero("_spans") == F.col("total")).alias("spans_unique"),
    )


def values_of(ids: DataFrame, facts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and values: for every id asked for, its facts in order, without repeats (none: an empty array)."""
    wanted = facts.join(ids.select(key).distinct(), key, "left_semi").groupBy(key, value).agg(F.min(order).alias("_o"))
    lists = wanted.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))
    return ids.select(key).distinct().join(lists, key, "left").withColumn("values", F.coalesce("values", F.array().cast(lists.schema["values"].dataType)))


def resolve_ids(rows: DataFrame, stored: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """rows with the id of the stored row that has the same values in all keys (nulls equal), the smallest of several; null
    where none has."""
    known = stored.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(id_column).alias(id_column))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(known, same, "left").drop(*[f"_{k}" for k in keys])


def capped_scope(df: DataFrame, group: str, cap: int) -> DataFrame:
    """group, n and too_large: whether a scope has more than `cap` rows, for which ranking by words is left out."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("too_large", F.col("n") > cap)


def cache_status(asked: DataFrame, cache: DataFrame, keys: list[str], now: str, hours: float) -> DataFrame:
    """asked with status: hit, empty-hit (cached without results), expired (older than hours) or miss. cache: keys,
    fetched_at, n_results; of several entries the newest counts."""
    last = cache.groupBy(*keys).agg(F.max_by(F.struct("fetched_at", "n_results"), "fetched_at").alias("_row")).select(*keys, "_row.*")
    old = (F.lit(now).cast("timestamp").cast("double") - F.col("fetched_at").cast("timestamp").cast("double")) / 3600 > hours
    status = F.when(F.col("fetched_at").isNull(), "miss").when(old, "expired").when(F.col("n_results") == 0, "empty-hit").otherwise("hit")
    return asked.join(last, keys, "left").select(*asked.columns, status.alias("status"))


def cache_put(cache: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The cache after results are put in: those without any aren't stored, others replace what stood under their key."""
    return insert_or_replace(cache, results.filter("n_results > 0"), keys, "fetched_at")


def cache_key(source: Column, query: Column, lang: Column, kind: Column) -> Column:
    """SHA-256 of source, query (trimmed, lower case), language and type."""
    return F.sha2(F.concat_ws("|", F.lower(source), F.lower(F.trim(query)), F.coalesce(lang, F.lit("")), F.coalesce(kind, F.lit(""))), 256)


def regrade_candidates(runs: DataFrame, attempts: DataFrame, run: str, include_ungraded: bool = False) -> DataFrame:
    """Runs to be graded anew: their search flag is null, and they have a report unless include_ungraded; tiled: whether they
    have attempts. runs: run, search_allowed, graded."""
    open_ = runs.filter(F.col("search_allowed").isNull() & (F.col("graded") | F.lit(include_ungraded)))
    tiled = attempts.select(F.col(run).alias("_of")).distinct()
    return open_.join(tiled, F.col(run) == F.col("_of"), "left").withColumn("tiled", F.col("_of").isNotNull()).drop("_of")


def grouped_evidence(links: DataFrame, entity: str, most: int = 4) -> DataFrame:
    """entity, confidence and score (the highest), surfaces (distinct, in order of position) and evidence (the first `most`):
    links has entity, confidence, score, surface, position."""
    first = links.groupBy(entity, "surface").agg(F.min("position").alias("_p"), F.max("confidence").alias("_c"), F.max("score").alias("_s"))
    surfaces = F.transform(F.array_sort(F.collect_list(F.struct("_p", "surface"))), lambda x: x["surface"])
    return first.groupBy(entity).agg(F.max("_c").alias("confidence"), F.max("_s").alias("score"), surfaces.alias("surfaces")).withColumn("evidence", F.slice("surfaces", 1, most))


def linking_report(candidates: DataFrame, mentions: DataFrame, run: str) -> DataFrame:
    """Of each run: candidates, selected ones, mentions with any and the mean best score, rebuilt from stored rows.
    candidates: mention_id, score, source, meta (JSON with a flag `selected`); mentions: mention_id, run."""
    chosen = F.coalesce(F.get_json_object("meta", "$.selected") == "true", F.lit(False))
    per = candidates.groupBy("mention_id").agg(F.count("*").alias("_n"), F.count_if(chosen).alias("_k"), F.max("score").alias("_best"))
    both = mentions.join(per, "mention_id", "left")
    return both.groupBy(run).agg(
        F.count("*").alias("mentions"), F.coalesce(F.sum("_n"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("_k"), F.lit(0)).alias("selected"),
        F.count("_n").alias("with_candidates"), F.avg("_best").alias("mean_best"),
    )


def merged_candidates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each identity: of every other column the last value that is neither null nor empty, in `order`."""
    fields = [c for c in rows.columns if c not in (*keys, order)]
    told = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.groupBy(*keys).agg(*[F.max_by(F.when(told(c), F.col(c)), F.when(told(c), F.col(order))).alias(c) for c in fields])


def identity_key(entity: Column, source: Column, source_id: Column, label: Column) -> Column:
    """What names a candidate: its entity, else its source and number, else its source and label."""
    named = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(named(entity), F.concat(source, F.lit(":"), named(source_id)), F.concat(source, F.lit(":label:"), F.lower(F.coalesce(label, F.lit("")))))


def surface_difference(rows: DataFrame, run: str, surface: str, accepted: Column) -> DataFrame:
    """run and, as sorted arrays, the surfaces that were accepted, only rejected, and both."""
    per = rows.groupBy(run, surface).agg(F.max(accepted.cast("int")).alias("_y"), F.min(accepted.cast("int")).alias("_n"))
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(surface))))
    return per.groupBy(run).agg(of(F.col("_n") == 1).alias("accepted"), of(F.col("_y") == 0).alias("rejected"), of((F.col("_y") == 1) & (F.col("_n") == 0)).alias("both"))


def route_decisions(rows: DataFrame, linkable: tuple[str, ...], least: float) -> DataFrame:
    """rows (type, confidence, filtered) with status: filtered ones FILTERED_OUT, other types SKIP_NON_LINKABLE, below the
    least confidence REJECT_LINKABLE (a null confidence is 0), the rest ACCEPT_LINKABLE."""
    status = F.when(F.coalesce("filtered", F.lit(False)), "FILTERED_OUT").when(~F.coalesce(F.col("type").isin(*linkable), F.lit(False)), "SKIP_NON_LINKABLE")
    return rows.withColumn("status", status.when(F.coalesce("confidence", F.lit(0.0)) < least, "REJECT_LINKABLE").otherwise("ACCEPT_LINKABLE"))


def deferred(mentions: DataFrame, reason: str, links: DataFrame, status: str = "unresolved_low_quality") -> DataFrame:
    """Rows for mentions without a link: status, reason, and a confidence of 0.35 at most (null: 0)."""
    open_ = mentions.join(links.select("mention_id"), "mention_id", "left_anti")
    return open_.withColumns({"status": F.lit(status), "reason": F.lit(reason), "confidence": F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.35))})


def finite(value: Column) -> Column:
    """A metric for JSON: NaN and infinities are null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
