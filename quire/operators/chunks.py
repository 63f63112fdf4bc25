"""Overlapping windows of lines with offsets into the text, and joins of spans with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

WINDOW, OVERLAP, MIN_CHARS = 6, 2, 40
BUCKET = 2048  # characters of a bucket, by which spans meet chunks


def line_starts(rows: Column) -> Column:
    """The offset of each line; lines are parted by one character."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(rows, start, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def window_chunks(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, key: str = "doc_id") -> DataFrame:
    """key, idx, start_offset, end_offset, line_start, line_end, text of windows of `window` non-blank lines, each sharing
    `overlap` with the one before. A last window of under min_chars characters is merged into the one before. Blank or
    null text has none. All happens inside a row."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be smaller than window")
    step = window - overlap
    spans = T.once(T.lines(F.col("text")), lambda rows: F.zip_with(rows, line_starts(rows), lambda x, s: F.struct(x.alias("line"), s.alias("start"), (s + F.length(x)).alias("end"))))
    full = F.filter(spans, lambda x: T.stripped(x["line"]) != "")

    def windows(rows: Column) -> Column:
        n = F.size(rows)
        many = F.when(n <= window, 1).otherwise(1 + F.ceil((n - window) / step)).cast("int")
        last = lambda j: F.least(j * step + window, n) - 1
        every = F.transform(
            F.sequence(F.lit(0), many - 1),
            lambda j: F.struct(j.alias("idx"), F.get(rows, j * step)["start"].alias("start_offset"), F.get(rows, last(j))["end"].alias("end_offset"), (j * step).alias("line_start"), last(j).alias("line_end")),
        )
        return F.when(n > 0, every)

    def merged(every: Column) -> Column:
        tail, k = F.element_at(every, -1), F.size(every)
        runt = (k >= 2) & (tail["end_offset"] - tail["start_offset"] < min_chars)
        widened = lambda x: F.when(x["idx"] == k - 2, F.struct(x["idx"].alias("idx"), x["start_offset"].alias("start_offset"), tail["end_offset"].alias("end_offset"), x["line_start"].alias("line_start"), tail["line_end"].alias("line_end"))).otherwise(x)
        return F.when(runt, F.transform(F.slice(every, 1, k - 1), widened)).otherwise(every)

    found = T.once(T.once(full, windows), lambda w: F.when(w.isNotNull(), merged(w)))
    chunk = docs.select(key, "text", F.explode(found).alias("c"))
    return chunk.select(key, "c.*", F.substring(F.col("text"), F.col("c.start_offset") + 1, F.col("c.end_offset") - F.col("c.start_offset")).alias("text"))


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.greatest(F.col(start), F.col(end) - 1) / BUCKET))))


def assign_chunks(spans: DataFrame, chunks: DataFrame, key: str = "doc_id", span_id: str = "span_id") -> DataFrame:
    """spans with the idx of the first chunk that contains them, else of the first that overlaps them, else null.

    spans has key, span_id, start, end. A range join by buckets of offsets, so that a long text's chunks are only met near
    the span."""
    a = _bucketed(spans, "start", "end")
    b = _bucketed(chunks.select(F.col(key).alias("_key"), F.col("idx").alias("_idx"), "start_offset", "end_offset"), "start_offset", "end_offset")
    met = a.join(b.withColumnRenamed("_bucket", "_b"), (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")) & (F.col("start") < F.col("end_offset")) & (F.col("end") > F.col("start_offset")))
    contains = (F.col("start") >= F.col("start_offset")) & (F.col("end") <= F.col("end_offset"))
    best = met.groupBy(F.col(key).alias("_k"), F.col(span_id).alias("_s")).agg(F.min(F.when(contains, F.col("_idx"))).alias("_inside"), F.min("_idx").alias("_touching"))
    out = spans.join(best, (F.col(key) == F.col("_k")) & (F.col(span_id) == F.col("_s")), "left")
    return out.select(*[spans[c] for c in spans.columns], F.coalesce("_inside", "_touching").alias("chunk_idx"), F.col("_inside").isNotNull().alias("contained"))


def containment(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The share of spans that some chunk contains, by text."""
    return assigned.groupBy(key).agg(F.avg(F.col("contained").cast("double")).alias("containment"), F.count("*").alias("spans"))


def evidence_budget(chunks: DataFrame, top_k: int = 5, key: str = "doc_id") -> DataFrame:
    """Characters of the top_k longest chunks of each text."""
    rank = Window.partitionBy(key).orderBy(F.desc("n_chars"), "idx")
    sized = chunks.select(key, "idx", F.length("text").alias("n_chars")).withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= top_k)
    return sized.groupBy(key).agg(F.sum("n_chars").alias("budget"), F.count("*").alias("n_chunks"))
