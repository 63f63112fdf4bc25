"""Regions and readings: their order, votes between them, repeated lines and what is chosen."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T
from quire.operators import geometry as G
from quire.operators import sanity as S

ALIKE, SHORT_ALIKE, SHORT = 0.92, 0.96, 12
SAMPLES = 6


def by_position(boxes: DataFrame, page: str = "page") -> DataFrame:
    """boxes with position: from the top, then from the left."""
    return boxes.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy("y1", "x1", "box_id")) - 1)


def by_reading_order(regions: DataFrame, page: str = "page") -> DataFrame:
    """regions with position: by their reading_order, those without last, ties as they were put in (box_id)."""
    return regions.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy(F.asc_nulls_last("reading_order"), "box_id")) - 1)


def region_of_label(boxes: DataFrame, label: str, how: str, page: str = "page") -> DataFrame:
    """The one region of a page for a label: the largest, topmost or bottommost, ties by box_id."""
    order = {"largest": -G.area(), "topmost": F.col("y1"), "bottommost": -F.col("y2")}[how]
    row = F.min_by(F.struct(*[F.col(c) for c in boxes.columns]), F.struct(order, "box_id"))
    return boxes.filter(F.col("name") == label).groupBy(page).agg(row.alias("_row")).select("_row.*")


def weighted_vote(readings: DataFrame, page: str, hint: str = "hint", confidence: str = "confidence", order: str = "position") -> DataFrame:
    """page and hint: the one with the greatest sum of confidences (0.05 at least each), of equals the one first seen; unknown hints
    don't count, and a page with no other has unknown."""
    known = readings.filter(F.col(hint).isNotNull() & (F.col(hint) != "unknown")).groupBy(page, hint).agg(F.sum(F.greatest(F.lit(0.05), F.coalesce(confidence, F.lit(0.0)))).alias("_w"), F.min(order).alias("_first"))
    best = known.groupBy(page).agg(F.max_by(hint, F.struct(F.round("_w", 9), -F.col("_first"))).alias(hint))
    return readings.select(page).distinct().join(best, page, "left").withColumn(hint, F.coalesce(hint, F.lit("unknown")))


def backend_order(samples: DataFrame, page: str) -> DataFrame:
    """page, backend, mean_quality, rank: backends by their mean quality over the first six regions of a page, ties by their place
    in the plan. samples: page, region (a number), backend, plan (a number), quality."""
    first = samples.withColumn("_n", F.dense_rank().over(Window.partitionBy(page).orderBy("region"))).filter(F.col("_n") <= SAMPLES)
    means = first.groupBy(page, "backend").agg(F.avg("quality").alias("mean_quality"), F.min("plan").alias("_plan"))
    place = Window.partitionBy(page).orderBy(F.desc(F.round("mean_quality", 9)), "_plan")
    return means.withColumn("rank", F.row_number().over(place)).drop("_plan")


def suppressed_repeats(readings: DataFrame, page: list[str], order: str, text: str = "text") -> DataFrame:
    """readings with repeat: whether an earlier reading of the page has the same signature of eight characters or more."""
    signature = T.repeat_signature(F.col(text))
    seen = F.row_number().over(Window.partitionBy(*page, "_s").orderBy(order))
    return readings.withColumn("_s", signature).withColumn("repeat", (seen > 1) & (F.length("_s") >= 8)).drop("_s")


def _alike(a: str, b: str) -> float:
    """The share of matching blocks of two keys. In under 200 characters, of which none is left out as too frequent, a key that
    stands in the other is one block."""
    if len(b) < 200 and (a in b or b in a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


def merged_lines(lines: DataFrame, page: str = "page") -> DataFrame:
    """lines (page, line_id, line, confidence) of overlapping tiles as one text, in the order of line_id: a line that is alike to one
    kept before (0.92 of matching blocks, 0.96 for short ones, the most alike) takes its place if it has fewer marks of
    uncertainty, then more confidence, then more characters."""
    columns = lines.columns
    marks = lambda s: s.count("?") + 3 * s.count("[…]")

    def better(new: dict, old: dict) -> bool:
        a, b = marks(new["line"]), marks(old["line"])
        if a != b:
            return a < b
        if abs(new["confidence"] - old["best"]) > 1e-6:
            return new["confidence"] > old["best"]
        return len(new["line"]) > len(old["line"])

    def merge(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        places: dict[str, int] = {}  # of keys, which are distinct among what is kept
        # lengths of keys kept, and how often each has characters (of 64 kinds): no more of two keys than both have can match
        sizes, counts = np.empty(64, np.int64), np.empty((64, 64), np.int32)
        for r in rows:
            key = r["_key"]
            if not r["line"] or not key:
                continue
            at = places.get(key)
            own = np.bincount(np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
            if at is None:
                n = len(kept)
                most = 2.0 * np.minimum(counts[:n], own).sum(1) / (sizes[:n] + len(key))
                found = [(_alike(key, kept[i]["_key"]), -i) for i in np.nonzero(most >= ALIKE)[0].tolist()]
                found = [f for f in found if f[0] >= (SHORT_ALIKE if min(len(key), len(kept[-f[1]]["_key"])) < SHORT else ALIKE)]
                if not found:
                    if n == len(sizes):
                        sizes, counts = np.concatenate([sizes, sizes]), np.concatenate([counts, counts])
                    sizes[n], counts[n], places[key] = len(key), own, n
                    kept.append(r | {"best": r["confidence"]})
                    continue
                at = -max(found)[1]
            old = kept[at]
            if better(r, old):
                old.update(line=r["line"], best=max(old["best"], r["confidence"]))
        return [{c: k[c] for c in columns} for k in kept]

    keyed = lines.withColumns({"line": T.stripped(T.text_or_empty(F.col("line"))), "confidence": F.coalesce("confidence", F.lit(0.0)).cast("double")})
    return G.by_page(keyed.withColumn("_key", S.dedupe_key(F.col("line"))), (page,), ["line_id"], merge, StructType(keyed.schema.fields))


def line_chunks(lines: DataFrame, stop: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """key, idx, start, end, text: every line of two characters or more that is no stop word. lines: key, n, start, end, line."""
    bare = T.stripped(F.col("line"))
    kept = lines.filter((F.length(bare) >= 2) & ~F.lower(bare).isin(*stop))
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).select(key, "idx", "start", "end", F.col("line").alias("text"))


def lines_with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, start, end, line of every line, by a running sum of lengths within each text."""
    each = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("n", "line"))
    ahead = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.sum(F.length("line") + 1).over(ahead) - 1).cast("int")
    return each.select(key, "n", (end - F.length("line")).alias("start"), end.alias("end"), "line")


def fragment_windows(text: Column, width: int = 5, share: float = 0.6) -> Column:
    """How many windows of five tokens consist of single characters to 60 % or more."""
    single = F.transform(T.tokens(text), lambda t: (F.length(t) == 1).cast("int"))
    starts = lambda s: F.when(F.size(s) >= width, F.sequence(F.lit(1), F.size(s) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return T.once(single, lambda s: F.size(F.filter(starts(s), lambda i: F.aggregate(F.slice(s, i, width), F.lit(0), lambda a, x: a + x) >= share * width)))


def collapsed_letters(text: Column) -> Column:
    """A text with every run of three single letters or more as […]."""
    return F.regexp_replace(T.text_or_empty(text), r"(?<!\S)\p{L}(?:[^\S\n]+\p{L}(?!\S)){2,}", "[…]")


def smoothed(profile: Column, radius: int = 2) -> Column:
    """A centred moving average, over what there is at the ends."""
    n = F.size(profile)

    def at(x: Column, i: Column) -> Column:
        low = F.greatest(F.lit(0), i - radius)
        part = F.slice(profile, low + 1, F.least(n - 1, i + radius) - low + 1)
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part)

    return F.transform(profile, at)


def bands(profile: Column, least: float) -> Column:
    """start and end of the runs of a profile that reach `least`."""
    up = F.transform(profile, lambda v, i: F.struct(i.alias("i"), (v >= least).alias("on")))
    before = lambda i: F.coalesce(F.get(up, i - 1)["on"], F.lit(False))
    after = lambda i: F.coalesce(F.get(up, i + 1)["on"], F.lit(False))
    starts = F.transform(F.filter(up, lambda u: u["on"] & ~before(u["i"])), lambda u: u["i"])
    ends = F.transform(F.filter(up, lambda u: u["on"] & ~after(u["i"])), lambda u: u["i"] + 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def passage_chunks(passages: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, passage_id, idx of relevant chunks: those that hold a passage whole, else those that overlap half of it or more, else the
    one that overlaps it most (the first of equals). Passages (start, end) that no chunk meets have none."""
    p = passages.select(key, "passage_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    met = p.join(chunks.select(key, "idx", "start_offset", "end_offset"), key)
    both = F.least("_b", "end_offset") - F.greatest("_a", "start_offset")
    met = met.withColumn("_o", both).filter("_o > 0").withColumns({"_whole": (F.col("start_offset") <= F.col("_a")) & (F.col("_b") <= F.col("end_offset")), "_half": F.col("_o") >= 0.5 * (F.col("_b") - F.col("_a"))})
    every = Window.partitionBy(key, "passage_id")
    met = met.withColumns({"_any_whole": F.max("_whole").over(every), "_any_half": F.max("_half").over(every), "_best": F.min_by("idx", F.struct(-F.col("_o"), F.col("idx"))).over(every)})
    keep = F.when(F.col("_any_whole"), F.col("_whole")).when(F.col("_any_half"), F.col("_half")).otherwise(F.col("idx") == F.col("_best"))
    return met.filter(keep).select(key, "passage_id", "idx")


def best_hits(hits: DataFrame, query: str, name: str, distance: str = "distance") -> DataFrame:
    """query, name, similarity: of each name the best of its hits, in 4 digits; hits without distance count as 0 similar."""
    score = F.round(1.0 - F.coalesce(distance, F.lit(1.0)), 4)
    return hits.filter(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "").groupBy(query, name).agg(F.greatest(F.lit(0.0), F.max(score)).alias("similarity"))


def retry_rank(rows: DataFrame, page: str) -> DataFrame:
    """rows with the merged confidence of their tiles by area: wide tiles weigh more, none less than a pixel."""
    weight = F.greatest(F.lit(1.0), G.area().cast("double"))
    return rows.groupBy(page).agg((F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))


def tile_kept(weird: Column, uncertain: Column) -> Column:
    """Whether a tile's text is kept: not for many weird tokens, nor for some without a mark of uncertainty."""
    return ~((weird >= 0.18) | ((uncertain == 0) & (weird > 0.05)))
