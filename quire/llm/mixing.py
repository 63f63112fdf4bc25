"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a hashed order, over and over. A document's virtual finish time is the source's
tokens up to and with it, divided by the source's target. All documents are sorted by virtual finish time and the mix
ends where its total budget does. Both running sums are two-level: sums by bucket, a prefix over the buckets, and a
window inside each bucket, so that neither a hot source nor the global order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import WORD, fresh, written

WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)  # the mix takes 3/2 of all tokens
EPOCHS = 2  # a source is taken twice at most
TIME_BUCKETS = 1 << 16  # of a virtual time unit


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): weights go round by code point order, null last; no target is above
    epochs times its source and the excess is shared again by weight until none is. Adds rank, weight and target.

    The fixed point is found without iterating: sources ordered by cap / weight reach their caps in that order, and
    those left share what is left. One row for each source."""
    rank = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    out = sources.withColumn("rank", F.row_number().over(rank)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    out = (
        out.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left", F.lit(budget[0]) * F.col("total") - F.lit(budget[1]) * F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("weight_left", F.col("weights") - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("open", F.when(F.lit(budget[1]) * F.col("cap") * F.col("weight_left") > F.col("weight") * F.col("left"), F.struct("left", "weight_left")))
        .withColumn("level", F.min_by("open", F.when(F.col("open").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everything))
    )
    shared = F.col("weight") * F.col("level.left") / (F.lit(budget[1]) * F.col("level.weight_left"))
    is_open = F.col("level").isNotNull() & (F.lit(budget[1]) * F.col("cap") * F.col("level.weight_left") > F.col("weight") * F.col("level.left"))
    return out.withColumn("target", F.when(is_open, shared).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "rank", "weight", "target")


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (tokens the mix takes) of every row of docs.

    docs has doc_id, source and text; other columns are not read. Null text has size 0 and is taken 0 times; a null
    source is a source of its own, last in order; rows that share a doc_id queue as separate documents of equal hash, and
    rows without one by a hash of their text. Empty table: no rows. Reruns agree, as the order depends on hashes alone."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.substring(F.md5(F.concat(named, F.lit(f":{seed}"))), 1, 16).alias("key")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key)
    sized = written(sized.withColumn("bucket", F.substring("key", 1, 3)), "mix-sizes")

    # tokens of a source before each of its 4096 buckets
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs)

    in_order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("own", F.sum("size").over(in_order))
    s, t = sums.alias("s"), targets.alias("t")
    queued = (
        queued.alias("q")
        .join(s, F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
        .join(t, F.col("q.source").eqNullSafe(F.col("t.source")))
        .select("q.doc_id", "q.source", "size", "source_size", "target", "rank", "key", (F.col("ahead") + F.col("own")).alias("upto"))
    )

    # one row for each time that a document stands in its queue
    turn = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    turns = queued.filter(F.col("size") > 0).select("doc_id", "size", "rank", "key", turn, "target", "source_size", "upto")
    turns = turns.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    turns = turns.withColumn("slot", F.least(F.floor(F.col("finish") * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS)).cast("long"))
    everything = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slots = turns.groupBy("slot").agg(F.sum("size").alias("in_slot"))  # 2 * TIME_BUCKETS + 1 rows at most
    slots = slots.withColumn("upto_slot", F.sum("in_slot").over(Window.orderBy("slot")))
    over = F.lit(budget[1]) * F.col("upto_slot") > F.lit(budget[0] * everything)
    cut = slots.agg(
        F.min(F.when(over, F.col("slot"))).alias("cut"),
        F.min(F.when(over, F.struct("slot", (F.col("upto_slot") - F.col("in_slot")).alias("before")))).getField("before").alias("before"),
    )
    cut_slot, before = cut.first()
    if cut_slot is None:  # the budget holds every turn
        times = queued.withColumn("times", F.when(F.col("size") > 0, epochs).otherwise(0))
    else:
        # only the slot in which the budget ends is put in order
        edge = Window.orderBy("finish", "rank", "key", "doc_id", "epoch").rowsBetween(Window.unboundedPreceding, 0)
        last = turns.filter(F.col("slot") == cut_slot).withColumn("upto_all", F.sum("size").over(edge) + F.lit(before))
        last = last.filter(F.lit(budget[1]) * F.col("upto_all") <= F.lit(budget[0] * everything))
        end = last.agg(F.max(F.struct("finish", "rank", "key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "epoch")).alias("e")).first()["e"]
        times = queued.withColumn("times", F.lit(0))
        kinds = {"finish": "double", "rank": "int", "key": "string", "id": "bigint", "epoch": "int"}
        at_end = F.struct(*[F.lit(end[k]).cast(t).alias(k) for k, t in kinds.items()]) if end is not None else None
        for epoch in range(epochs):
            finish = (F.lit(epoch) * F.col("source_size") + F.col("upto")) / F.col("target")
            slot = F.least(F.floor(finish * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS))
            place = F.struct(finish.alias("finish"), F.col("rank"), F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.lit(epoch).alias("epoch"))
            within = slot < cut_slot
            if end is not None:
                within = within | ((slot == cut_slot) & (place <= at_end))
            times = times.withColumn("times", F.col("times") + F.when((F.col("size") > 0) & within, 1).otherwise(0))
    return times.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it; columns as in docs.

    Rows that share doc_id (or have none), source and size are alike to the mix, and what it takes of them is dealt out
    evenly, in the order of a hash of their texts. Rows without words aren't taken. Empty table: no rows."""
    nth, many, times, size, alike = (fresh(docs, c) for c in ("_nth", "_many", "_times", "_size", "_alike"))
    # what is taken of each class of rows that are alike
    plan = fair_mix(docs, **how).filter("taken > 0")
    plan = plan.select(F.struct("doc_id", "source", F.coalesce("size", F.lit(0).cast("long")).alias("size")).alias("_of"), (F.col("taken") / F.col("size")).alias(times))
    plan = plan.groupBy("_of").agg(F.sum(times).cast("long").alias(times))
    own = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    # a struct of nulls equals its like, so that rows are numbered and joined by one key and their texts are shuffled once
    own = own.withColumn(alike, F.struct("doc_id", "source", F.col(size).alias("size"))).drop(size)
    rows = Window.partitionBy(alike)
    own = own.withColumn(nth, F.row_number().over(rows.orderBy(F.xxhash64("text")))).withColumn(many, F.count("*").over(rows))
    both = own.join(plan, own[alike] == plan["_of"])
    whole = F.floor(F.col(times) / F.col(many))
    turns = (whole + F.when(F.col(nth) <= F.col(times) - whole * F.col(many), 1).otherwise(0)).cast("int")
    return both.withColumn(nth, F.explode(F.when(turns > 0, F.sequence(F.lit(1), turns)))).select(*[docs[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substring(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':mix'), 1, 16) AS key
  FROM {documents}),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM src),
caps AS (
  SELECT *, CAST([5, 2, 1][((rank - 1) % 3) + 1] AS BIGINT) AS weight, 2 * source_size AS cap FROM ranked),
fill AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER w, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_rest
  FROM caps WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest AS l_rest, weight_rest AS l_weight FROM fill WHERE 2 * cap * weight_rest > weight * rest ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN l_rest IS NOT NULL AND 2 * cap * l_weight > weight * l_rest
              THEN CAST(weight * l_rest AS DOUBLE) / CAST(2 * l_weight AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM caps LEFT JOIN level ON TRUE),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, s.key,
         CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, size, key, rank, epoch, CAST(epoch * source_size + upto AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1)) e(epoch) WHERE size > 0),
taken AS (
  SELECT doc_id, rank, key, size, count(*) AS times FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto_all FROM turns)
  WHERE 2 * upto_all <= 3 * (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.times, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.rank = t.rank AND q.key = t.key AND q.size = t.size
"""
