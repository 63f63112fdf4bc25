"""Mentions, candidates and the decision between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Threshold, margin and name similarity by quality of the text; fixed values.
TIERS = {"HIGH": (0.80, 0.15, 0.60), "MEDIUM": (0.85, 0.15, 0.65), "LOW": (0.90, 0.20, 0.70)}


def thresholds(quality: Column) -> Column:
    """The struct of threshold, margin and similarity of a quality; an unknown one counts as MEDIUM."""
    of = lambda t: F.struct(*[F.lit(v).alias(n) for n, v in zip(("threshold", "margin", "similarity"), t, strict=True)])
    return F.when(quality == "HIGH", of(TIERS["HIGH"])).when(quality == "LOW", of(TIERS["LOW"])).otherwise(of(TIERS["MEDIUM"]))


def disambiguate(candidates: DataFrame, mention: str = "mention_id", candidate: str = "candidate_id") -> DataFrame:
    """mention, selected (a candidate or null), status (linked, ambiguous or unresolved) and best score.

    candidates: mention, candidate, score, similarity (null: not gated), type_compatible (null: true), quality. Incompatible
    and dissimilar candidates are out of the running; the best of the rest must reach the threshold and lead by the margin."""
    limits = candidates.withColumn("_t", thresholds(F.col("quality")))
    fit = F.coalesce("type_compatible", F.lit(True)) & (F.coalesce("similarity", F.lit(1.0)) >= F.col("_t.similarity"))
    place = Window.partitionBy(mention).orderBy(F.desc("_fit"), F.desc("score"), candidate)
    ranked = limits.withColumn("_fit", fit).withColumn("_n", F.row_number().over(place)).withColumn("_next", F.lead(F.when(F.col("_fit"), F.col("score"))).over(place)).filter("_n = 1")
    reached = F.col("_fit") & (F.col("score") >= F.col("_t.threshold"))
    clear = F.col("_next").isNull() | (F.col("score") - F.col("_next") >= F.col("_t.margin"))
    status = F.when(~reached, "unresolved").when(clear, "linked").otherwise("ambiguous")
    return ranked.select(mention, F.when(reached & clear, F.col(candidate)).alias("selected"), status.alias("status"), F.when(F.col("_fit"), F.col("score")).alias("best_score"))


def composite_score(label: Column, alias: Column, typed: Column, context: Column, domain: Column, mismatch: Column) -> Column:
    """The weighted sum of a candidate's signals, within 0 and 1."""
    score = 0.45 * label + 0.25 * alias + 0.15 * typed + 0.10 * context + 0.05 * domain - 0.30 * mismatch
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def canonical_match(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mentions (mention_id, surface) with the name nearest to each: equal if under 5 characters, else at a distance of 0.25 or
    less of the longer length and a bigram overlap of 0.40 or more; ties in order of position. names: name, position.

    Distinct surfaces meet the names that share a pair of letters with them, so the lexicon may be of any size."""
    surfaces = mentions.select(F.lower("surface").alias("_surface")).distinct()
    known = names.select(F.lower("name").alias("_name"), "name", "position")
    best = lambda nd: F.min(F.struct(nd.alias("nd"), F.col("position"), F.col("name")))
    equal = surfaces.filter(F.length("_surface") < 5).join(known, F.col("_surface") == F.col("_name")).groupBy("_surface").agg(best(F.lit(0.0)).alias("_best"))
    pairs = lambda c: F.explode(T.bigram_set(F.col(c))).alias("_pair")
    x = surfaces.filter(F.length("_surface") >= 5).select("_surface", F.size(T.bigram_set(F.col("_surface"))).alias("_n"), pairs("_surface"))
    y = known.select("_name", "name", "position", F.size(T.bigram_set(F.col("_name"))).alias("_m"), pairs("_name"))
    met = x.join(y, "_pair").groupBy("_surface", "_name", "name", "position", "_n", "_m").agg(F.count("*").alias("_both"))
    far = T.edit_distance_ratio(F.col("_surface"), F.col("_name"))
    close = met.filter(2 * F.col("_both") / (F.col("_n") + F.col("_m")) >= 0.40).withColumn("_nd", far).filter("_nd <= 0.25")
    found = equal.unionAll(close.groupBy("_surface").agg(best(F.col("_nd")).alias("_best")))
    return mentions.join(found, F.lower("surface") == F.col("_surface"), "left").select(*[mentions[c] for c in mentions.columns], F.col("_best.name").alias("canonical"), F.col("_best.nd").alias("distance"))


def capitalised_mentions(docs: DataFrame, key: str = "doc_id", least: int = 5) -> DataFrame:
    """key, position, surface of capitalised words of `least` letters or more that don't begin a sentence."""
    spotted = T.once(T.tokens(F.col("text")), lambda words: F.zip_with(words, F.concat(F.array(F.lit(None).cast("string")), F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1))), lambda w, b: F.struct(w.alias("w"), b.alias("before"))))
    spots = docs.select(key, F.posexplode(spotted).alias("position", "x")).filter(F.col("x.w").isNotNull())
    surface = F.regexp_replace("x.w", r"^[^\p{L}]+|[^\p{L}]+$", "")
    found = spots.withColumn("surface", surface).filter(F.col("surface").rlike(r"^\p{Lu}\p{L}+$") & (F.length("surface") >= least) & F.col("x.before").isNotNull() & ~F.col("x.before").rlike(r"[.!?:]$"))
    return found.select(key, "position", "surface")


def dedupe_mentions(mentions: DataFrame, page: str = "doc_id") -> DataFrame:
    """Mentions that don't overlap within a page and kind: the most confident, then the longest, then the first. Columns as in
    mentions (start, end, kind, confidence)."""

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_long=rows["end"] - rows["start"]).sort_values(["confidence", "_long", "start"], ascending=[False, False, True])
        taken: list[tuple[int, int]] = []
        at = []
        for n, (a, b) in enumerate(zip(rows["start"], rows["end"], strict=True)):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                at.append(n)
        return rows.iloc[at].drop(columns="_long")

    return mentions.groupBy(page, "kind").applyInPandas(greedy, mentions.schema)
