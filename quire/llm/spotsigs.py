"""SpotSigs fingerprints: chains of content words that follow common words.

Common words (anchors) are spread over running text and rare in lists, menus and headings. Each anchor with the next
content words after it is a signature, hashed to 64 bits; a text's fingerprint is its set of signatures. Sets are
likened by Jaccard. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import connected
from quire.llm.shared import shuffle_partitions, written

ANCHORS = tuple(
    sorted(
        {
            *"a an and are as at be by for he in is it of on that the this to was with".split(),
            *"au aux avec dans de des du elle en est et la le les ou par pour qui que un une".split(),
            *"auch auf das den der des die ein eine für im in ist mit nicht sch sich und von zu".split(),
            *"al como con del el es la las los no para por que se su un una y".split(),
        }
    )
)
CHAIN = 2
PER_PART = 64  # keys sampled for each bucket of documents in order


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures as array<bigint>. Words are what ASCII punctuation and white space part, in
    lower case. In a text without anchors every word counts as one; a text without words (null or empty, or nothing but
    punctuation) has one signature, the hash of the text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def parts(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(*ANCHORS) & (w != ""))
        places = F.filter(F.transform(F.filter(words, lambda w: w != ""), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*ANCHORS))
        every = F.transform(F.filter(words, lambda w: w != ""), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        found = _bind(places, lambda x: F.when(F.size(x) > 0, F.struct(content.alias("content"), x.alias("places"), F.lit(1).alias("anchored"))).otherwise(F.struct(F.filter(words, lambda w: w != "").alias("content"), every.alias("places"), F.lit(0).alias("anchored"))))
        return found

    def spots(parts: Column) -> Column:
        # k anchors stand before the k-th, so the content words before it number i - k; past the end there is nothing to hash.
        # where every word is an anchor, those after it follow at once
        first = lambda x, k: F.when(parts["anchored"] == 1, x["i"] - k).otherwise(x["i"] + 1)
        return F.transform(parts["places"], lambda x, k: F.xxhash64(x["w"], *[F.get(parts["content"], first(x, k) + j) for j in range(chain)]))

    def whole(spots: Column) -> Column:
        return F.when(F.size(spots) > 0, F.sort_array(F.array_distinct(spots))).otherwise(F.array(F.xxhash64(F.coalesce(text, F.lit("")))))

    return _bind(_bind(_bind(words, parts), spots), whole)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; sets that are equal, or of which one is empty, aren't intersected."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(a == b, 1.0)
        .when(F.least(F.size(a), F.size(b)) == 0, 0.0)
        .otherwise(_bind(both, lambda n: n / (F.size(a) + F.size(b) - n)))
    )


def fingerprint(signatures: Column) -> Column:
    """A digest of a signature set, equal for equal sets: 32 hex digits."""
    return F.md5(signatures.cast("string"))


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and tie of every row: null text is empty, tie a hash of the text that orders rows of one doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("tie", F.xxhash64("text"))


def _bounds(keys: DataFrame, parts: int) -> tuple[list[tuple[int | None, int]], list[tuple[int | None, int]]]:
    """Quantiles of (doc_id descending, nulls last; tie) that part keys into about `parts` runs of equal size, from a sample of
    about PER_PART keys for each; and the keys that fill more than a run alone."""
    n = keys.count()
    share = min(1.0, PER_PART * parts / max(n, 1))
    drawn = [tuple(r) for r in (keys.sample(share, 7) if share < 1 else keys).collect()]
    drawn.sort(key=lambda k: (k[0] is None, -(k[0] or 0), k[1]))
    cuts = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []
    seen = Counter(cuts)
    return list(seen), [k for k, often in seen.items() if often > 1]


def _bucket(bounds: list[tuple[int | None, int]], first: int = 0) -> str:
    """SQL for the number of bounds at or before a row's key: a decision tree, as deep as the logarithm of their number."""
    if not bounds:
        return str(first)
    half = len(bounds) // 2
    d, t = bounds[half]
    sooner = f"doc_id IS NOT NULL OR tie < {_long(t)}" if d is None else f"coalesce(doc_id > {_long(d)} OR doc_id = {_long(d)} AND tie < {_long(t)}, false)"
    return f"IF({sooner}, {_bucket(bounds[:half], first)}, {_bucket(bounds[half + 1 :], first + half + 1)})"


def _long(x: int) -> str:
    return f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)"


def in_turn(docs: DataFrame, chain: int = CHAIN) -> tuple[DataFrame, bool]:
    """doc_id, text, s (its signatures), next and next_s: the text after it by descending doc_id, of the last row the first's
    (null: empty), and its signatures; times: how many rows of docs it stands for, and whether any stands for several.

    Rows are dealt into buckets at quantiles of (doc_id, hash of the text), so that neither outliers nor repeats of a
    doc_id fill one; a bucket is sorted in one task and also holds a copy of the next one's first row, so texts are
    shuffled once. Rows without doc_id come last; rows that share a doc_id are in order of that hash. Equal rows that
    would fill a bucket alone are one row here, which is its own next but for the last of them."""
    rows = _keys(docs)
    keys = written(rows.select("doc_id", "tie"), "spotsigs-keys")
    bounds, hot = _bounds(keys, max(1, shuffle_partitions(docs.sparkSession)))
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    if hot:
        # a bucket's share of all rows each: no more than there are buckets
        table = docs.sparkSession.createDataFrame(hot, "of long, like long")
        of_hot = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("like"))
        heavy = rows.join(F.broadcast(table), of_hot, "left_semi").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.count("*").alias("times"))
        heavy = written(heavy.select("doc_id", "text", "tie", "times"), "spotsigs-heavy")
        rows = rows.join(F.broadcast(table), of_hot, "left_anti").unionByName(heavy)
        keys = keys.distinct()
    tree = F.expr(_bucket(bounds))
    rows, keys = rows.withColumn("bucket", tree), keys.withColumn("bucket", tree)
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.bitwise_not("doc_id").alias("y"), F.col("tie").alias("z"))
    # the first row of each bucket goes to the one before, the very first to the last; a row for each bucket
    tops = written(keys.groupBy("bucket").agg(F.min(place).alias("top")), "spotsigs-tops")
    used = sorted(r[0] for r in tops.select("bucket").collect())
    before = F.create_map(*[F.lit(x) for k, b in enumerate(used) for x in (b, used[k - 1])]) if used else F.create_map(F.lit(0), F.lit(0))
    top = F.broadcast(tops.select(F.col("bucket").alias("of"), "top"))
    firsts = rows.join(top, (F.col("bucket") == F.col("of")) & place.eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    firsts = written(firsts, "spotsigs-firsts")
    copies = firsts.select("doc_id", "text", F.element_at(before, F.col("bucket")).alias("bucket"), "tie", F.lit(1).alias("copy"), F.lit(1).cast("long").alias("times"))
    every = rows.select("doc_id", "text", "bucket", "tie", F.lit(0).alias("copy"), "times").unionAll(copies)
    order = ["copy", F.desc_nulls_last("doc_id"), "tie"]
    # sorted before signatures are made, so that the sort moves texts alone; a signature set serves its text and the one before
    sets = every.repartition(F.col("bucket")).sortWithinPartitions("bucket", *order).withColumn("s", signatures(F.col("text"), chain))
    turn = Window.partitionBy("bucket").orderBy(*order)
    out = sets.withColumn("next", F.lead("text").over(turn)).withColumn("next_s", F.lead("s").over(turn)).filter("copy = 0").select("doc_id", "text", "s", "next", "next_s", "times")
    if hot:
        own = F.struct(F.col("text").alias("next"), F.col("s").alias("next_s"), (F.col("times") - 1).alias("times"))
        follows = F.struct("next", "next_s", F.lit(1).cast("long").alias("times"))
        out = out.select("doc_id", "text", "s", F.explode(F.when(F.col("times") > 1, F.array(own, follows)).otherwise(F.array(follows))).alias("x")).select("doc_id", "text", "s", "x.*")
    return out, bool(hot)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, signatures, fingerprint, edited (text), edited_sha256, edited_fingerprint, near_edited, near_next of
    every row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by as many of the next document's first, or all
    of them if it is shorter; next by descending doc_id, after the last the first. docs has doc_id and text; other columns
    are not read. doc_id may be any long. Null text is empty; rows without doc_id come last in order; a table of one row is
    its own next; repeated rows follow one another. Empty table: no rows."""
    turn, several = in_turn(docs, chain)
    turn = turn.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next"), F.lit(1), cut))
    likened = _bind(signatures(F.col("edited"), chain), lambda e: F.struct(F.col("s").alias("signatures"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), likeness(F.col("s"), e).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next")))
    out = turn.withColumn("edited", edited).select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), likened.alias("x"), "times")
    columns = ["doc_id", "n_chars", "edited", "edited_sha256", "x.*"]
    return out.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_copy")).drop("_copy") if several else out.select(*columns)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row of docs; texts link whose signature
    sets have a Jaccard of threshold or more.

    Equal sets are one node. Sets are partitioned by length, so that a set meets only those up to 1 / threshold times
    longer; inside a partition only the rarest signatures can be shared first, and lengths prune before sets are
    intersected. Null text and rows without doc_id as in fingerprints; empty table: no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), chain).alias("s"))
    held = written(rows.withColumn("node", F.xxhash64("s")), "spotsigs")
    sets = held.groupBy("node").agg(F.first("s").alias("s"), F.min("doc_id").alias("first"))
    sets = written(sets.withColumn("n", F.size("s")), "spotsigs-sets")
    rare = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("often")).filter("often > 1")
    # the first n - ceil(threshold * n) + 1 signatures, rarest first, of which like sets share one
    ordered = sets.select("node", "n", F.explode("s").alias("sig")).join(rare, "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    by_rarity = Window.partitionBy("node").orderBy("often", "sig")
    prefix = ordered.withColumn("k", F.row_number().over(by_rarity)).filter((F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("often") > 1))
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int")
    prefix = prefix.select("node", "n", "sig", level.alias("level"))
    probes = prefix.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"))
    met = probes.join(prefix, ["sig", "level"]).filter((F.col("a") != F.col("node")) & (F.col("n_a") <= F.col("n")) & (F.col("n_a") >= F.col("n") * threshold))
    pairs = met.select("a", F.col("node").alias("b")).distinct()
    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), sets.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
    links = pairs.join(x, "a").join(y, "b").filter(likeness(F.col("s_a"), F.col("s_b")) >= threshold).select("a", "b")
    roots = connected(links)
    classes = sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "first")
    firsts = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    return held.join(classes.join(firsts, "class").select("node", "component_id"), "node").select("doc_id", "component_id")
