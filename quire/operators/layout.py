"""Page layout: lanes of text, columns, rules between classes of boxes, tiles and seams, and lines in crops.

Rules between boxes are joins within a page; what depends on boxes chosen before streams over a page's sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.text import once
from quire.operators import geometry as G

# Shares, limits and classes.
CONTAINED = 0.5
MAX_OUTSIDE = 1 / 3
COLUMN_MARGIN = 0.02
SAME_CLASS = 0.80
#: classes of the new box, classes that it is held against, share, whose area divides, whether the new box goes
SCRIPTS = ("Main script black", "Main script coloured", "Variant script black", "Variant script coloured")
INITIALS = ("Plain initial- coloured", "Plain initial - Highlighted", "Plain initial - Black")
RULES = (
    ((*SCRIPTS, *INITIALS), ("MarginTextZone", "NumberingZone"), 0.7, "new", True),
    (("Embellished", *INITIALS, "Inhabited"), ("DropCapitalZone", "GraphicZone"), 0.4, "both", False),
    (("Page Number",), ("NumberingZone",), 0.8, "new", True),
    (("Music",), ("MusicZone", "GraphicZone"), 0.7, "new", False),
    (("Table",), ("MainZone", "MarginTextZone"), 0.4, "old", False),
    (("Diagram", "Illustrations"), ("GraphicZone",), 0.5, "new", False),
)
NO_DEFAULT_LINE = ("Variant script coloured", "Variant script black", "Main script coloured", "NumberingZone", "Diagram", "MarginTextZone", "RunningTitleZone", "Table", "Quire Mark")
DEFAULT_LINE, COVERED_SCRIPT, COVERED = "DefaultLine", "Main script black", 0.6
SEAM_BAND, LEAST_BAND, LEAST_GAP = 16, 40, 8
GRIDS = ((2, 2), (3, 2), (2, 3), (3, 3), (4, 2))


# Lanes and columns
def lane(name: Column, main: tuple[str, ...], secondary: tuple[str, ...]) -> Column:
    """main, secondary or layout, whatever the case; a class in both is main."""
    low = F.lower(name)
    return F.when(low.isin(*[m.lower() for m in main]), "main").when(low.isin(*[s.lower() for s in secondary]), "secondary").otherwise("layout")


def split_lanes(boxes: DataFrame, main: tuple[str, ...], secondary: tuple[str, ...], at_least: float = 0.25, secondary_at_least: float = 0.10, iou: float = 0.5, min_size: int = 8, most: int = 50) -> DataFrame:
    """boxes (page, box_id, x1…y2, name, score) that stay, with lane and position in it: each lane has its threshold, slivers
    go, overlapping boxes are suppressed (per class in layout alone), secondary ones half inside a main box go, and main ones
    are in reading order, the others from top to bottom; at most `most` in main and secondary."""
    laned = G.non_degenerate(boxes.withColumn("lane", lane(F.col("name"), main, secondary)), min_size)
    of = lambda x, least: laned.filter((F.col("lane") == x) & (F.col("score") >= least))
    kept = G.reading_order(G.nms(of("main", at_least), iou, kind=None)).filter(F.col("position") < most)
    beside = G.contained_fraction(G.nms(of("secondary", secondary_at_least), iou, kind=None), kept).filter(F.col("inside") < CONTAINED).drop("inside")
    down = Window.partitionBy("page").orderBy("y1", "x1", "box_id")
    placed = lambda df: df.withColumn("position", (F.row_number().over(down) - 1).cast("int"))
    return kept.unionByName(placed(beside).filter(F.col("position") < most)).unionByName(placed(G.nms(of("layout", at_least), iou, kind="name")))


def overlap_of_left(a: str, b: str) -> Column:
    """The share of the left box that lies in the right one; an area under 1 counts as 1."""
    return G.intersection(a, b) / F.greatest(F.lit(1.0), G.area(a).cast("double"))


def in_columns(rows: DataFrame, columns: DataFrame, page: str = "page") -> DataFrame:
    """rows with in_column: whether the centre lies in a column of the page, widened by 2 % of its size."""
    met = G.side(rows, "a_", page).join(G.side(columns, "b_", page), page)
    x, y = (F.col("a_x1") + F.col("a_x2")) / 2, (F.col("a_y1") + F.col("a_y2")) / 2
    mx, my = COLUMN_MARGIN * (F.col("b_x2") - F.col("b_x1")), COLUMN_MARGIN * (F.col("b_y2") - F.col("b_y1"))
    inside = met.filter(x.between(F.col("b_x1") - mx, F.col("b_x2") + mx) & y.between(F.col("b_y1") - my, F.col("b_y2") + my))
    hit = inside.select(page, F.col("a_box_id").alias("box_id"), F.lit(True).alias("in_column")).distinct()
    return rows.join(hit, [page, "box_id"], "left").withColumn("in_column", F.coalesce("in_column", F.lit(False)))


def segmented_lanes(rows: DataFrame, columns: DataFrame, page: str = "page") -> DataFrame:
    """rows with lane: body, or outside for those in no column of their page; on a page without columns, or where more than a
    third lies outside, all are body."""
    marked = in_columns(rows, columns, page)
    every = Window.partitionBy(page)
    has = columns.select(page).distinct().withColumn("_has", F.lit(True))
    out = F.count_if(~F.col("in_column")).over(every)
    whole = F.col("_has").isNull() | (out > MAX_OUTSIDE * F.count("*").over(every))
    return marked.join(has, page, "left").withColumn("lane", F.when(whole | F.col("in_column"), "body").otherwise("outside")).drop("_has", "in_column")


def by_best_column(rows: DataFrame, columns: DataFrame, page: str = "page") -> DataFrame:
    """rows with column_id and position on the page: a row goes to the column with the greatest overlap, a quarter more for one
    that holds its centre, if that is over 0.05, ties to the first; columns in order of id, rows from the top, the rest last."""
    met = G.side(rows, "a_", page).join(G.side(columns, "b_", page), page)
    x = (F.col("a_x1") + F.col("a_x2")) / 2
    score = overlap_of_left("a_", "b_") + F.when(x.between(F.col("b_x1"), F.col("b_x2")), 0.25).otherwise(0.0)
    best = met.groupBy(page, F.col("a_box_id").alias("box_id")).agg(F.max_by(F.struct("b_box_id", score.alias("s")), F.struct(score, -F.col("b_box_id"))).alias("_b"))
    chosen = rows.join(best, [page, "box_id"], "left").withColumn("column_id", F.when(F.col("_b.s") > 0.05, F.col("_b.b_box_id"))).drop("_b")
    place = Window.partitionBy(page).orderBy(F.asc_nulls_last("column_id"), "y1", "x1", "box_id")
    return chosen.withColumn("position", F.row_number().over(place) - 1)


def without_columns(rows: DataFrame, page: str = "page") -> DataFrame:
    """rows with position: columns found from the rows themselves. A row, from left to right, joins the nearest column within 80
    or 8 % of the page's width: by centres where they overlap, else by the gap between; a column's centre is its rows' mean."""

    def order(group: list[dict]) -> list[dict]:
        width = max(r["x2"] for r in group) - min(r["x1"] for r in group)
        gap, columns = max(80.0, width * 0.08), []
        for r in sorted(group, key=lambda r: ((r["x1"] + r["x2"]) / 2, r["y1"], r["box_id"])):
            centre = (r["x1"] + r["x2"]) / 2
            near = [(abs(centre - c["c"]) if min(r["x2"], c["x2"]) > max(r["x1"], c["x1"]) else max(r["x1"] - c["x2"], c["x1"] - r["x2"], 0.0), k) for k, c in enumerate(columns)]
            at = min(near, default=(gap + 1, 0))
            if at[0] > gap:
                columns.append({"x1": r["x1"], "x2": r["x2"], "c": centre, "rows": [r]})
                continue
            c = columns[at[1]]
            c["rows"].append(r)
            c["x1"], c["x2"] = min(c["x1"], r["x1"]), max(c["x2"], r["x2"])
            c["c"] = sum((q["x1"] + q["x2"]) / 2 for q in c["rows"]) / len(c["rows"])
        columns.sort(key=lambda c: c["x1"])
        read = [r for c in columns for r in sorted(c["rows"], key=lambda r: (r["y1"], r["x1"], r["box_id"]))]
        return [r | {"position": n} for n, r in enumerate(read)]

    return G.by_page(rows, (page,), ["box_id"], order, StructType([*rows.schema.fields, StructField("position", IntegerType())]))


def two_columns(rows: DataFrame, page: str = "page", least: float = 0.08) -> DataFrame:
    """rows with column (0 or 1): a page is parted at the widest gap between neighbouring centres if that is over 8 % of its
    width; the first of equal gaps."""
    x = (F.col("x1") + F.col("x2")) / 2
    turn = Window.partitionBy(page).orderBy("_x", "box_id")
    out = rows.withColumn("_x", x).withColumn("_gap", F.lead("_x").over(turn) - F.col("_x"))
    cuts = out.groupBy(page).agg(F.max_by(F.struct("_x", "_gap"), F.struct("_gap", -F.col("_x"))).alias("_cut"), (F.max("x2") - F.min("x1")).alias("_width"))
    parted = F.coalesce(F.col("_cut._gap") > least * F.col("_width"), F.lit(False))
    return out.join(cuts, page).withColumn("column", F.when(parted & (F.col("_x") > F.col("_cut._x")), 1).otherwise(0)).drop("_x", "_gap", "_cut", "_width")


# Rules between classes
def _shares(divide: str) -> Column:
    both = G.intersection("a_", "b_")
    new, old = both / G.area("a_"), both / G.area("b_")
    return {"new": new, "old": old, "both": F.least(new, old)}[divide]


def suppressed(boxes: DataFrame, page: str = "page") -> DataFrame:
    """page, box_id of boxes (page, box_id, x1…y2, name) that a rule takes out when they are put in in the order of box_id: only
    boxes put in before count, whether they are out by then or not, so that a join of a page's boxes gives the same."""
    new, old = G.side(boxes, "a_", page), G.side(boxes, "b_", page)
    hit = lambda names, against: F.col("a_name").isin(*names) & F.col("b_name").isin(*against)
    some = F.lit(False)
    for names, against, *_ in RULES:
        some = some | hit(names, against)
    lines = (F.col("a_name") == DEFAULT_LINE) & F.col("b_name").isin(*NO_DEFAULT_LINE, COVERED_SCRIPT)
    met = new.join(old, (new[page] == old[page]) & (F.col("b_box_id") < F.col("a_box_id")) & (some | lines)).select(new[page], *[c for c in (*new.columns, *old.columns) if c != page])
    touch = (F.col("b_x1") <= F.col("a_x2")) & (F.col("b_x2") >= F.col("a_x1")) & (F.col("b_y1") <= F.col("a_y2")) & (F.col("b_y2") >= F.col("a_y1"))
    met = met.filter(touch)
    out = None
    for names, against, share, divide, itself in RULES:
        found = met.filter(hit(names, against) & (_shares(divide) > share)).select(page, F.col("a_box_id" if itself else "b_box_id").alias("box_id"))
        out = found if out is None else out.unionAll(found)
    line = met.filter(F.col("a_name") == DEFAULT_LINE)
    stopped = line.filter(F.col("b_name").isin(*NO_DEFAULT_LINE)).select(page, F.col("a_box_id").alias("box_id")).distinct()
    free = line.join(stopped.withColumnRenamed("box_id", "a_box_id"), [page, "a_box_id"], "left_anti")
    under = free.filter((F.col("b_name") == COVERED_SCRIPT) & (_shares("old") > COVERED)).select(page, F.col("b_box_id").alias("box_id"))
    return out.unionAll(stopped).unionAll(under).distinct()


def not_suppressed(boxes: DataFrame, page: str = "page") -> DataFrame:
    return boxes.join(suppressed(boxes, page), [page, "box_id"], "left_anti")


def without_contained(boxes: DataFrame, page: str = "page", share: float = SAME_CLASS) -> DataFrame:
    """boxes without those of which a larger one of their page and name covers more than `share`; of two of equal area the one
    with the greater box_id. What a box that is out itself covers stays: boxes are looked at in the order of box_id."""

    def keep(group: list[dict]) -> list[dict]:
        out: set[int] = set()
        size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        for i, r in enumerate(group):
            if i in out:
                continue
            for k, s in enumerate(group):
                if k == i or k in out:
                    continue
                both = max(0, min(r["x2"], s["x2"]) - max(r["x1"], s["x1"])) * max(0, min(r["y2"], s["y2"]) - max(r["y1"], s["y1"]))
                least = min(size(r), size(s))
                if least and both / least > share:
                    out.add(i if size(r) < size(s) else k)
        return [r for i, r in enumerate(group) if i not in out]

    return G.by_page(boxes, (page, "name"), ["box_id"], keep, boxes.schema)


def in_any_box(points: DataFrame, boxes: DataFrame, page: str = "page") -> DataFrame:
    """points (page, point_id, x, y) with inside: whether a box of the page holds them, its border included."""
    b = G.side(boxes, "b_", page)
    met = points.join(b, page).filter(F.col("x").between(F.col("b_x1"), F.col("b_x2")) & F.col("y").between(F.col("b_y1"), F.col("b_y2")))
    hit = met.select(page, "point_id", F.lit(True).alias("inside")).distinct()
    return points.join(hit, [page, "point_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def unified_names(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """boxes with the names that a table (name, unified) gives; others stay."""
    return boxes.join(names, "name", "left").withColumn("name", F.coalesce("unified", "name")).drop("unified")


def mappable(boxes: DataFrame, categories: DataFrame, page: str = "page") -> tuple[DataFrame, DataFrame]:
    """boxes whose name has a category (name, category_id), as rows of a layout file: xywh boxes, area, and ids from 1 on each
    page; and how many were left out, by name."""
    kept = boxes.join(categories, "name").withColumn("annotation_id", F.row_number().over(Window.partitionBy(page).orderBy("box_id")))
    rows = kept.select(page, "annotation_id", "category_id", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), G.area().alias("area"))
    return rows, boxes.join(categories, "name", "left_anti").groupBy("name").agg(F.count("*").alias("dropped"))


def merged_layouts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of many layout files (file, image_id, annotation_id) as one: images and annotations are numbered anew from 1, in the
    order of files. Numbers come from counts of files, so only a row for each file is put in one order."""
    per = rows.groupBy(*order).agg(F.count_distinct("image_id").alias("_i"), F.count("*").alias("_a"))
    ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumns({"_bi": F.coalesce(F.sum("_i").over(ahead), F.lit(0)), "_ba": F.coalesce(F.sum("_a").over(ahead), F.lit(0))}).drop("_i", "_a")
    own = rows.withColumn("_di", F.dense_rank().over(Window.partitionBy(*order).orderBy("image_id"))).withColumn("_da", F.row_number().over(Window.partitionBy(*order).orderBy("image_id", "annotation_id")))
    return own.join(before, order).withColumns({"new_image_id": F.col("_bi") + F.col("_di"), "new_annotation_id": F.col("_ba") + F.col("_da")}).drop("_bi", "_ba", "_di", "_da")


# Boxes by themselves
def _int(x: Column) -> Column:
    return x.cast("int")


def _whole(x: Column) -> Column:
    """Rounded, halves to the even number."""
    return F.bround(x, 0).cast("int")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(_int(x1).alias("x1"), _int(y1).alias("y1"), _int(x2).alias("x2"), _int(y2).alias("y2"))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A box on its page, a pixel wide and high at least."""
    low = lambda v, most: F.greatest(F.lit(0), F.least(v, most - 1))
    return box(low(x1, width), low(y1, height), F.greatest(low(x1, width) + 1, F.least(x2, width)), F.greatest(low(y1, height) + 1, F.least(y2, height)))


def suggestion_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least_share: float = 0.0005) -> Column:
    """A suggested place as a box of whole pixels on its page; null for one that is tiny or under 8 pixels."""
    x1, y1 = F.greatest(F.lit(0), _whole(x)), F.greatest(F.lit(0), _whole(y))
    x2, y2 = F.least(_int(width), _whole(x + w)), F.least(_int(height), _whole(y + h))
    good = (w > 0) & (h > 0) & (w * h / F.greatest(width * height, F.lit(1)) >= least_share) & (x2 - x1 >= 8) & (y2 - y1 >= 8)
    return F.when(good, box(x1, y1, x2, y2))


def padded(b: Column, width: Column, height: Column, ratio: float = 0.04) -> Column:
    """A box with more room around it, more for small ones, and no less above and below than beside."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    short = F.least(w, h)
    boost = F.when(short < 300, F.greatest(F.lit(8), _whole(short * 0.12))).otherwise(0)
    px = F.greatest(F.lit(4), _whole(w * ratio)) + boost
    py = F.greatest(F.greatest(F.lit(4), _whole(h * ratio)) + boost, px)
    return box(F.greatest(F.lit(0), b["x1"] - px), F.greatest(F.lit(0), b["y1"] - py), F.least(width, b["x2"] + px), F.least(height, b["y2"] + py))


def crop_box(b: Column, width: Column, height: Column, line_like: Column) -> Column:
    """What is cut out around a region: more above and below a line."""
    w, h = F.greatest(F.lit(1), b["x2"] - b["x1"]), F.greatest(F.lit(1), b["y2"] - b["y1"])
    pad = lambda n, share, wide, least: F.when(line_like, F.greatest(F.lit(10), _whole(n * share))).otherwise(F.greatest(F.lit(least), _whole(n * wide)))
    px, py = pad(w, 0.08, 0.04, 8), pad(h, 0.45, 0.12, 8)
    return box(F.greatest(F.lit(0), b["x1"] - px), F.greatest(F.lit(0), b["y1"] - py), F.least(width, b["x2"] + px), F.least(height, b["y2"] + py))


def rescaled(b: Column, scale: Column) -> Column:
    """A box (x1…y2, area) of a page made smaller by `scale`, on the page itself; a scale of 1 or more, or none, changes nothing."""
    k = F.when((scale > 0) & (scale < 1), 1 / scale).otherwise(1.0)
    return F.struct(*[(b[c] * k).alias(c) for c in G.BOX], (b["area"] * k * k).alias("area"))


def translated(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def polygon_area(points: Column) -> Column:
    """Half the absolute sum of cross products around a polygon, closed or not."""
    n = F.size(points)
    at = lambda i: F.get(points, F.pmod(i, n))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i - 1)["y"] - at(i)["y"] * at(i - 1)["x"])
    return F.when(n == 0, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def region_upscale(b: Column, factor: int) -> Column:
    """The factor for regions under 120 pixels high and for those of unknown height, else 1."""
    return F.when(b.isNull() | (b["y2"] - b["y1"] < 120), factor).otherwise(1)


def page_box(polygon: Column, b: Column) -> Column:
    """The box around a polygon, else the box itself, else a unit box; doubles."""
    xs, ys = F.transform(polygon, lambda p: p["x"].cast("double")), F.transform(polygon, lambda p: p["y"].cast("double"))
    of = lambda *v: F.struct(*[x.cast("double").alias(c) for c, x in zip(G.BOX, v, strict=True)])
    own = F.when(b.isNotNull(), of(b["x1"], b["y1"], b["x2"], b["y2"])).otherwise(of(*map(F.lit, (0, 0, 1, 1))))
    return F.when(F.size(polygon) > 0, of(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(own)


def closed(points: Column) -> Column:
    return once(points, lambda p: F.when((F.size(p) > 0) & (F.get(p, F.lit(0)) != F.element_at(p, -1)), F.concat(p, F.slice(p, 1, 1))).otherwise(p))


def in_crop(points: Column, crop_x: Column, crop_y: Column, scale: Column, width: Column, height: Column) -> Column:
    """Page points in a crop's own coordinates, clamped to it, as a closed boundary."""
    put = lambda v, o, most: F.least(F.greatest((v - o) * scale, F.lit(0.0)), (most - 1).cast("double"))
    return closed(F.transform(points, lambda p: F.struct(put(p["x"], crop_x, width).alias("x"), put(p["y"], crop_y, height).alias("y"))))


def rotated(points: Column, degrees: Column, width: Column, height: Column) -> Column:
    """Points turned about the centre of a picture; under a hundredth of a degree nothing moves."""
    c, s, x0, y0 = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), (width - 1) / 2, (height - 1) / 2
    turn = lambda p: F.struct((x0 + (p["x"] - x0) * c - (p["y"] - y0) * s).alias("x"), (y0 + (p["x"] - x0) * s + (p["y"] - y0) * c).alias("y"))
    return F.when(F.abs(degrees) < 0.01, F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).otherwise(F.transform(points, turn))


def crossings(boundary: Column, x: Column) -> Column:
    """The heights at which an upright line cuts a boundary; an upright edge within 1 gives both its ends."""
    pairs = once(boundary, lambda p: F.when(F.size(p) >= 2, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array()))
    none = F.array().cast("array<double>")

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        upright = F.when(F.abs(x - a["x"]) <= 1.0, F.array(a["y"].cast("double"), b["y"].cast("double"))).otherwise(none)
        t = (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
        within = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        return F.when(a["x"] == b["x"], upright).when(within, F.array((a["y"] + t * (b["y"] - a["y"])).cast("double"))).otherwise(none)

    return F.flatten(F.transform(pairs, cut))


def baseline(boundary: Column, width: Column, height: Column, samples: int = 7) -> Column:
    """A line's base from its boundary (points of doubles): at 0.78 of its height in seven places; a flat one for none or a narrow
    boundary."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    flat = F.greatest(F.lit(0.0), (height - 1) * 0.8)

    def of(p: Column) -> Column:
        xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
        low, high = F.greatest(F.lit(0.0), F.array_min(xs)), F.least((width - 1).cast("double"), F.array_max(xs))
        bottom = F.array_max(ys) - F.greatest(F.lit(1.0), height * 0.12)
        return once(F.struct(low.alias("low"), high.alias("high"), bottom.alias("bottom")), lambda x: line(p, x))

    def line(p: Column, x: Column) -> Column:
        low, high, bottom = x["low"], x["high"], x["bottom"]
        height_at = lambda ys: F.when(F.size(ys) >= 2, F.array_min(ys) + 0.78 * (F.array_max(ys) - F.array_min(ys))).when(F.size(ys) == 1, F.get(ys, F.lit(0))).otherwise(bottom)
        at = lambda i: once(low + (high - low) * (i / (samples - 1)), lambda v: point(v, once(crossings(p, v), height_at)))
        many = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)
        return F.when(F.size(p) == 0, F.array(point(F.lit(0.0), flat), point(width - 1, flat))).when(high - low < 5, F.array(point(low, bottom), point(high, bottom))).otherwise(many)

    return once(boundary, of)


def midpoint(points: Column) -> Column:
    """The middle point of an odd number, else the mean of the two in the middle."""
    n = F.size(points)
    a, b = F.get(points, F.floor((n - 1) / 2).cast("int")), F.get(points, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))


def mean_confidence(confidences: Column) -> Column:
    """The mean of per-character confidences; null for none."""
    return F.when(F.size(confidences) > 0, F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / F.size(confidences))


# Tiles and seams
def band_count(height: Column) -> Column:
    """How many bands a block of text is read in: one under 280 pixels, else 5 to 8 of about 260, none under 90."""
    n = F.greatest(F.lit(5), F.least(F.lit(8), _whole(height / 260.0)))
    return F.when(height < 280, 1).otherwise(F.when(F.floor(height / n) < 90, F.greatest(F.lit(1), _int(F.floor(height / 90)))).otherwise(n))


def tile_boxes(b: Column, width: Column, height: Column) -> Column:
    """A block, and its bands with an overlap of 12 %, in two columns with 5 % from a width of 1100 on."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    whole = F.array(box(b["x1"], b["y1"], b["x2"], b["y2"]))

    def tiles(m: Column) -> Column:
        n, band = m["n"], m["band"]
        oy, ox, mid = F.greatest(F.lit(8), _whole(band * 0.12)), F.greatest(F.lit(18), _whole(w * 0.05)), b["x1"] + _int(F.floor(w / 2))
        edges = lambda i: F.struct(
            F.when(i == 0, b["y1"]).otherwise(F.greatest(b["y1"], b["y1"] + i * band - oy)).alias("top"), F.when(i == n - 1, b["y2"]).otherwise(F.least(b["y2"], b["y1"] + (i + 1) * band + oy)).alias("bottom")
        )
        two = lambda y: F.array(clipped(b["x1"], y["top"], mid + ox, y["bottom"], width, height), clipped(mid - ox, y["top"], b["x2"], y["bottom"], width, height))
        one = lambda y: F.array(box(b["x1"], y["top"], b["x2"], y["bottom"]))
        of = lambda i: once(edges(i), lambda y: F.when(w >= 1100, two(y)).otherwise(one(y)))
        return F.when((F.least(w, h) < 120) | (n <= 1), whole).otherwise(F.concat(whole, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of))))

    return once(once(band_count(h), lambda n: F.struct(n.alias("n"), F.greatest(F.lit(1), _whole(h / n)).alias("band"))), tiles)


def tile_clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    low = lambda v, most: F.greatest(F.lit(0), F.least(v, most - 1))
    high = lambda v, most: F.greatest(F.lit(1), F.least(v, most))
    return box(low(x1, width), low(y1, height), high(x2, width), high(y2, height))


def grid(rows: int, columns: int, width: Column, height: Column, overlap: float = 0.15, shift: float = 0.0) -> Column:
    """The boxes of a grid that covers a page, neighbours overlapping by a share of a tile, 4 pixels at least."""
    side = lambda most, parts: F.greatest(F.lit(1), _int(F.floor(most / parts)))
    over = lambda size: F.greatest(F.lit(4), _int(F.floor(size * overlap)))

    def tiles(m: Column) -> Column:
        th, tw, oy, ox, off = (m[c] for c in ("th", "tw", "oy", "ox", "off"))
        out = []
        for r in range(rows):
            for c in range(columns):
                y1 = F.lit(0) if r == 0 else F.greatest(F.lit(0), r * th + off - oy)
                y2 = height if r == rows - 1 else F.least(height, (r + 1) * th + off + oy)
                x1 = F.lit(0) if c == 0 else F.greatest(F.lit(0), c * tw - ox)
                x2 = width if c == columns - 1 else F.least(width, (c + 1) * tw + ox)
                out.append(tile_clip(x1, y1, x2, y2, width, height))
        return F.array(*out)

    sizes = F.struct(side(height, rows).alias("th"), side(width, columns).alias("tw"))
    return once(once(sizes, lambda s: F.struct(s["th"].alias("th"), s["tw"].alias("tw"), over(s["th"]).alias("oy"), over(s["tw"]).alias("ox"), _int(F.floor(s["th"] * shift)).alias("off"))), tiles)


def same_boxes(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def grid_shift(tiles: Column, width: Column, height: Column) -> Column:
    """grid and boxes of the first grid of a fixed series that differs from the tiles used before; a shifted one if none does."""
    out = F.struct(F.lit("3x1_offset").alias("grid"), grid(3, 1, width, height, 0.15, 0.33).alias("boxes"))
    for r, c in reversed(GRIDS):
        new = grid(r, c, width, height)
        out = F.when(~same_boxes(new, tiles), F.struct(F.lit(f"{r}x{c}").alias("grid"), new.alias("boxes"))).otherwise(out)
    return out


def expanded(tiles: Column, width: Column, height: Column, share: float = 0.22) -> Column:
    """Tiles grown on every side by a share of their size, 4 pixels at least."""

    def grow(b: Column) -> Column:
        dx, dy = F.greatest(F.lit(4), _int(F.floor((b["x2"] - b["x1"]) * share))), F.greatest(F.lit(4), _int(F.floor((b["y2"] - b["y1"]) * share)))
        return tile_clip(b["x1"] - dx, b["y1"] - dy, b["x2"] + dx, b["y2"] + dy, width, height)

    return F.transform(tiles, grow)


def _clusters(values: Column, apart: int) -> Column:
    def of(v: Column) -> Column:
        steps = lambda o: F.filter(F.zip_with(F.slice(o, 2, F.greatest(F.lit(0), F.size(o) - 1)), F.slice(o, 1, F.greatest(F.lit(0), F.size(o) - 1)), lambda b, a: b - a), lambda s: s > apart)
        return F.when(F.size(v) > 0, 1 + F.size(once(F.array_sort(F.array_distinct(v)), steps))).otherwise(0)

    return once(values, of)


def inferred_grid(tiles: Column) -> Column:
    """Rows and columns of tiles by their centres, which part where they are over 50 pixels apart: 2x3."""
    middle = lambda ts, a, b: F.transform(ts, lambda t: F.floor((t[a] + t[b]) / 2))
    return once(tiles, lambda ts: F.concat(_clusters(middle(ts, "y1", "y2"), 50).cast("string"), F.lit("x"), _clusters(middle(ts, "x1", "x2"), 50).cast("string")))


def seams(tiles: Column, axis: str = "y") -> Column:
    """Where tiles that share half of the smaller extent across an axis follow one another along it, with no gap over a quarter
    of the smaller length; seams under 8 pixels apart are one."""
    other = "x" if axis == "y" else "y"
    a1, a2, c1, c2 = f"{axis}1", f"{axis}2", f"{other}1", f"{other}2"

    def meets(a: Column, b: Column) -> Column:
        shared = F.greatest(F.lit(0), F.least(a[c2], b[c2]) - F.greatest(a[c1], b[c1]))
        beside = shared >= 0.5 * F.least(a[c2] - a[c1], b[c2] - b[c1])
        near = b[a1] - a[a2] <= 0.25 * F.least(a[a2] - a[a1], b[a2] - b[a1])
        return (a[a1] + a[a2] < b[a1] + b[a2]) & beside & near

    found = once(tiles, lambda ts: F.flatten(F.transform(ts, lambda a: F.transform(F.filter(ts, lambda b: meets(a, b)), lambda b: _int(F.floor((a[a2] + b[a1]) / 2))))))
    empty = F.array().cast("array<int>")
    return F.aggregate(F.array_sort(found), empty, lambda m, s: F.when((F.size(m) > 0) & (s - F.coalesce(F.element_at(m, -1), F.lit(0)) < LEAST_GAP), m).otherwise(F.concat(m, F.array(s))))


def _edges(at: Column, most: Column, band: int) -> Column:
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(at, lambda s: F.greatest(F.lit(0), s - band)), F.transform(at, lambda s: F.least(most, s + band)), F.array(most))))
    cut = lambda b: F.aggregate(F.slice(b, 2, F.greatest(F.lit(0), F.size(b) - 1)), F.array(F.lit(0)), lambda e, y: F.when(y - F.element_at(e, -1) >= LEAST_BAND, F.concat(e, F.array(y))).otherwise(e))
    return once(once(bounds, cut), lambda e: F.when(F.element_at(e, -1) != most, F.concat(e, F.array(most))).otherwise(e))


def seam_bands(tiles: Column, width: Column, height: Column, band: int = SEAM_BAND) -> Column:
    """Boxes between the seams of tiles, cut at a band on either side, without slivers and without bands on a seam (unless none
    else is left); without seams null."""
    spans = lambda edges: once(edges, lambda e: F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def of(s: Column) -> Column:
        ys, xs = s["ys"], s["xs"]
        crossed = lambda x_spans: F.flatten(F.transform(spans(_edges(ys, height, band)), lambda y: F.transform(x_spans, lambda x: tile_clip(x["a"], y["a"], x["b"], y["b"], width, height))))
        boxes = F.filter(once(spans(_edges(xs, width, band)), crossed), lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) >= LEAST_BAND**2)
        on_seam = lambda b: F.exists(ys, lambda s: (b["y1"] <= s + band) & (b["y2"] >= s - band) & (b["y2"] - b["y1"] < 3 * band))
        without = lambda every: once(F.filter(every, lambda b: ~on_seam(b)), lambda left: F.when(F.size(left) > 0, left).otherwise(every))
        return F.when((F.size(ys) > 0) | (F.size(xs) > 0), once(boxes, without))

    return once(once(tiles, lambda ts: F.struct(seams(ts, "y").alias("ys"), seams(ts, "x").alias("xs"))), of)


def retry_tiles(tiles: Column, width: Column, height: Column) -> Column:
    """strategy and boxes of another try: the first of a new grid, bands without seams and grown tiles that differs from the tiles
    used before, else the page in three shifted parts."""
    of = lambda name, boxes: F.struct(F.lit(name).alias("strategy"), boxes.alias("boxes"))
    quarter = F.greatest(F.lit(1), _int(F.floor(height / 4)))
    half, low, high = _int(F.floor(height / 2)), _int(F.floor(height / 4)), _int(F.floor(3 * height / 4))
    parts = F.array(tile_clip(F.lit(0), F.lit(0), width, half + quarter, width, height), tile_clip(F.lit(0), low, width, high + quarter, width, height), tile_clip(F.lit(0), half, width, height, width, height))
    shifted, bands, grown = grid_shift(tiles, width, height)["boxes"], seam_bands(tiles, width, height), expanded(tiles, width, height)
    return F.when(~same_boxes(shifted, tiles), of("grid_shift", shifted)).when(F.coalesce(~same_boxes(bands, tiles), F.lit(False)), of("seam_band_crop", bands)).when(~same_boxes(grown, tiles), of("expand_overlap", grown)).otherwise(of("fallback_quarter_shift", parts))


def is_noop(old_digest: Column, new_digest: Column, old: Column, new: Column) -> Column:
    """Whether another try changed neither text nor tiles; unknown digests don't count."""
    same = F.coalesce((old_digest != "") & (old_digest == new_digest), F.lit(False))
    return same | same_boxes(old, new)


def merged_rects(boxes: DataFrame, page: str = "page", distance: int = 10) -> DataFrame:
    """page, x1…y2: boxes of a page that overlap or are within a distance become one, again and again until none are."""

    def merge(group: list[dict]) -> list[dict]:
        rects, changed = [[r[c] for c in G.BOX] for r in group], True
        while changed:
            changed, out = False, []
            for r in rects:
                for o in out:
                    if o[0] - distance <= r[2] and o[2] + distance >= r[0] and o[1] - distance <= r[3] and o[3] + distance >= r[1]:
                        o[:] = [min(o[0], r[0]), min(o[1], r[1]), max(o[2], r[2]), max(o[3], r[3])]
                        changed = True
                        break
                else:
                    out.append(list(r))
            rects = out
        return [{page: group[0][page]} | dict(zip(G.BOX, r, strict=True)) for r in rects]

    schema = StructType([boxes.schema[page], *[StructField(c, boxes.schema[c].dataType) for c in G.BOX]])
    return G.by_page(boxes, (page,), ["y1", "x1", "box_id"], merge, schema)
