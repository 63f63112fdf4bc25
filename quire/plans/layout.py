"""Queries on page layout: line items are boxes, their orders pages, parts page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as Y
from quire.operators.geometry import side
from quire.plans.queries import BOXES, INTER, _boxes, query, table
from quire.session import spread

NAMES = ("Main script black", "MarginTextZone", "DefaultLine", "NumberingZone", "Table", "MainZone", "Embellished", "DropCapitalZone", "Diagram", "GraphicZone", "Page Number")
NAMED = f"named AS (SELECT *, [{', '.join(repr(n) for n in NAMES)}][CAST(box_id % 11 AS INTEGER) + 1] AS name FROM boxes)"
AREA = "((a.x2 - a.x1) * (a.y2 - a.y1))"
OTHER = "((b.x2 - b.x1) * (b.y2 - b.y1))"
quoted = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).withColumn("name", F.get(F.array(*map(F.lit, NAMES)), (F.col("box_id") % 11).cast("int")))


MAIN, SECONDARY = ("mainzone", "main script black"), ("MarginTextZone", "MainZone", "DefaultLine")


@query(f"WITH {BOXES}, {NAMED} SELECT page, box_id, CASE WHEN lower(name) IN {quoted(MAIN)} THEN 'main' WHEN name IN {quoted(SECONDARY)} THEN 'secondary' ELSE 'layout' END AS lane FROM named")
def lane_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("page", "box_id", Y.lane(F.col("name"), MAIN, SECONDARY).alias("lane"))


@query()
def split_lanes(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d).withColumn("score", F.col("score") * 8)
    return Y.split_lanes(rows, MAIN, SECONDARY).select("page", "box_id", "lane", "position")


@query(f"WITH {BOXES} SELECT a.page, a.box_id AS a_box_id, b.box_id AS b_box_id, round({INTER} / CAST(greatest(1, {AREA}) AS DOUBLE), 6) AS part FROM boxes a JOIN boxes b USING (page) WHERE a.kind = 0 AND b.kind = 1")
def overlap_of_left(spark: SparkSession, d: str) -> DataFrame:
    both = side(_boxes(spark, d).filter("kind = 0"), "a_", "page").join(side(_boxes(spark, d).filter("kind = 1"), "b_", "page"), "page")
    return both.select("page", "a_box_id", "b_box_id", F.round(Y.overlap_of_left("a_", "b_"), 6).alias("part"))


IN = "(a.x1 + a.x2) / 2.0 BETWEEN b.x1 - 0.02 * (b.x2 - b.x1) AND b.x2 + 0.02 * (b.x2 - b.x1) AND (a.y1 + a.y2) / 2.0 BETWEEN b.y1 - 0.02 * (b.y2 - b.y1) AND b.y2 + 0.02 * (b.y2 - b.y1)"
MARKED = f"hit AS (SELECT DISTINCT a.page, a.box_id FROM boxes a JOIN boxes b ON a.page = b.page AND b.kind = 0 WHERE a.kind > 0 AND {IN}), marked AS (SELECT page, box_id, (page, box_id) IN (SELECT page, box_id FROM hit) AS in_column FROM boxes WHERE kind > 0)"


@query(f"WITH {BOXES}, {MARKED} SELECT page, box_id, in_column FROM marked")
def rows_in_columns(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return Y.in_columns(boxes.filter("kind > 0"), boxes.filter("kind = 0")).select("page", "box_id", "in_column")


@query(f"""WITH {BOXES}, {MARKED} SELECT m.page, box_id, CASE WHEN h.page IS NULL OR count(*) FILTER (WHERE NOT in_column) OVER w > count(*) OVER w / 3.0 OR in_column THEN 'body' ELSE 'outside' END AS lane
FROM marked m LEFT JOIN (SELECT DISTINCT page FROM boxes WHERE kind = 0) h ON m.page = h.page WINDOW w AS (PARTITION BY m.page)""")
def segmented_lanes(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return Y.segmented_lanes(boxes.filter("kind > 0"), boxes.filter("kind = 0")).select("page", "box_id", "lane")


@query(f"""WITH {BOXES}, m AS (SELECT a.page, a.box_id, b.box_id AS c, {INTER} / CAST(greatest(1, {AREA}) AS DOUBLE) + CASE WHEN (a.x1 + a.x2) / 2.0 BETWEEN b.x1 AND b.x2 THEN 0.25 ELSE 0 END AS s FROM boxes a JOIN boxes b ON a.page = b.page AND b.kind = 0 WHERE a.kind > 0),
k AS (SELECT page, box_id, CASE WHEN max(s) > 0.05 THEN arg_max(c, (s, -c)) END AS column_id FROM m GROUP BY page, box_id)
SELECT a.page, a.box_id, column_id, CAST(row_number() OVER (PARTITION BY a.page ORDER BY column_id NULLS LAST, y1, x1, a.box_id) - 1 AS INTEGER) AS position FROM boxes a LEFT JOIN k ON a.page = k.page AND a.box_id = k.box_id WHERE kind > 0""")
def best_columns(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return Y.by_best_column(boxes.filter("kind > 0"), boxes.filter("kind = 0")).select("page", "box_id", "column_id", "position")


@query()
def columns_from_rows(spark: SparkSession, d: str) -> DataFrame:
    return Y.without_columns(_boxes(spark, d)).select("page", "box_id", "position")


@query(f"""WITH {BOXES}, g AS (SELECT *, (x1 + x2) / 2.0 AS x FROM boxes), h AS (SELECT *, lead(x) OVER (PARTITION BY page ORDER BY x, box_id) - x AS gap FROM g),
c AS (SELECT page, max(gap) AS gap, arg_max(x, (gap, -x)) FILTER (WHERE gap IS NOT NULL) AS cut, max(x2) - min(x1) AS width FROM h GROUP BY page)
SELECT page, box_id, CASE WHEN c.gap > 0.08 * width AND x > cut THEN 1 ELSE 0 END AS "column" FROM g JOIN c USING (page)""")
def two_columns(spark: SparkSession, d: str) -> DataFrame:
    return Y.two_columns(_boxes(spark, d)).select("page", "box_id", "column")


TOUCH = "b.x1 <= a.x2 AND b.x2 >= a.x1 AND b.y1 <= a.y2 AND b.y2 >= a.y1"


def _rules_sql() -> str:
    parts = []
    for names, against, share, divide, itself in Y.RULES:
        i = f"({INTER})"
        value = {"new": f"{i} / CAST({AREA} AS DOUBLE)", "old": f"{i} / CAST({OTHER} AS DOUBLE)", "both": f"least({i} / CAST({AREA} AS DOUBLE), {i} / CAST({OTHER} AS DOUBLE))"}[divide]
        parts.append(f"SELECT a.page, {'a' if itself else 'b'}.box_id FROM named a JOIN named b ON a.page = b.page AND b.box_id < a.box_id WHERE a.name IN {quoted(names)} AND b.name IN {quoted(against)} AND {TOUCH} AND {value} > {share}")
    line = f"SELECT a.page, a.box_id FROM named a JOIN named b ON a.page = b.page AND b.box_id < a.box_id WHERE a.name = 'DefaultLine' AND b.name IN {quoted(Y.NO_DEFAULT_LINE)} AND {TOUCH}"
    under = f"SELECT a.page, b.box_id FROM named a JOIN named b ON a.page = b.page AND b.box_id < a.box_id WHERE a.name = 'DefaultLine' AND b.name = 'Main script black' AND {TOUCH} AND ({INTER}) / CAST({OTHER} AS DOUBLE) > 0.6 AND (a.page, a.box_id) NOT IN ({line})"
    return " UNION ".join([*parts, line, under])


@query(f"WITH {BOXES}, {NAMED}, gone AS ({_rules_sql()}) SELECT page, box_id FROM gone")
def suppression_rules(spark: SparkSession, d: str) -> DataFrame:
    return Y.suppressed(_named(spark, d))


@query(f"WITH {BOXES}, {NAMED}, gone AS ({_rules_sql()}) SELECT name, count(*) AS n FROM named WHERE (page, box_id) NOT IN (SELECT page, box_id FROM gone) GROUP BY name")
def deleted_positions_filter(spark: SparkSession, d: str) -> DataFrame:
    return Y.not_suppressed(_named(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query()
def same_class_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d).withColumn("name", F.lit("MainZone"))
    return Y.without_contained(rows).select("page", "box_id")


@query(f"WITH {BOXES} SELECT page, a.box_id AS point_id, (SELECT count(*) FROM boxes b WHERE b.page = a.page AND b.kind = 1 AND (a.x1 + a.x2) / 2.0 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2.0 BETWEEN b.y1 AND b.y2) > 0 AS inside FROM boxes a WHERE kind = 2")
def point_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    points = boxes.filter("kind = 2").select("page", F.col("box_id").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return Y.in_any_box(points, boxes.filter("kind = 1")).select("page", "point_id", "inside")


@query(f"WITH {BOXES}, {NAMED} SELECT CASE name WHEN 'Table' THEN 'TableZone' WHEN 'Diagram' THEN 'GraphicZone' ELSE name END AS name, count(*) AS n FROM named GROUP BY 1")
def class_unification(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("Table", "TableZone"), ("Diagram", "GraphicZone")], "name string, unified string")
    return Y.unified_names(_named(spark, d), names).groupBy("name").agg(F.count("*").alias("n"))


CATEGORIES = [("MainZone", 1), ("Table", 2), ("DefaultLine", 3), ("MarginTextZone", 4)]
CATEGORIES_SQL = "(VALUES ('MainZone', 1), ('Table', 2), ('DefaultLine', 3), ('MarginTextZone', 4)) c(name, category_id)"
ROWS = f"coco AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY box_id) AS INTEGER) AS annotation_id, category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area FROM named JOIN {CATEGORIES_SQL} USING (name))"


@query(f"WITH {BOXES}, {NAMED}, {ROWS} SELECT page, annotation_id, category_id, x1, y1, w, h, area FROM coco")
def coco_rows(spark: SparkSession, d: str) -> DataFrame:
    return Y.mappable(_named(spark, d), spark.createDataFrame(CATEGORIES, "name string, category_id int"))[0]


@query(f"WITH {BOXES}, {NAMED} SELECT name, count(*) AS dropped FROM named WHERE name NOT IN ('MainZone', 'Table', 'DefaultLine', 'MarginTextZone') GROUP BY name")
def unmappable_classes(spark: SparkSession, d: str) -> DataFrame:
    return Y.mappable(_named(spark, d), spark.createDataFrame(CATEGORIES, "name string, category_id int"))[1]


@query(f"WITH {BOXES}, {NAMED}, {ROWS} SELECT file, image_id, annotation_id, dense_rank() OVER (ORDER BY file, image_id) AS new_image_id, row_number() OVER (ORDER BY file, image_id, annotation_id) AS new_annotation_id FROM (SELECT page % 50 AS file, page AS image_id, annotation_id FROM coco)")
def merged_layouts(spark: SparkSession, d: str) -> DataFrame:
    rows = Y.mappable(_named(spark, d), spark.createDataFrame(CATEGORIES, "name string, category_id int"))[0]
    return Y.merged_layouts(rows.select((F.col("page") % 50).alias("file"), F.col("page").alias("image_id"), "annotation_id"), ["file"])


# Boxes by themselves
SIZES = "p AS (SELECT p_partkey AS k, CAST(60 + p_size * 40 AS INTEGER) AS w, CAST(80 + p_size * 50 AS INTEGER) AS h, CAST(p_partkey % 300 AS INTEGER) AS x1, CAST(p_partkey % 200 AS INTEGER) AS y1, CAST(p_partkey % 300 + 10 + p_size * 9 AS INTEGER) AS x2, CAST(p_partkey % 200 + 5 + p_size * 7 AS INTEGER) AS y2 FROM part)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    b = Y.box(k % 300, k % 200, k % 300 + 10 + s * 9, k % 200 + 5 + s * 7)
    return spread(table(spark, d, "part")).select(k.alias("k"), (60 + s * 40).cast("int").alias("w"), (80 + s * 50).cast("int").alias("h"), b.alias("b"))


def _flat(df: DataFrame, value: Column) -> DataFrame:
    return df.select("k", value.alias("o")).select("k", "o.*")


@query(f"WITH {SIZES} SELECT k, greatest(0, least(x1, w - 1)) AS x1, greatest(0, least(y1, h - 1)) AS y1, greatest(greatest(0, least(x1, w - 1)) + 1, least(x2, w)) AS x2, greatest(greatest(0, least(y1, h - 1)) + 1, least(y2, h)) AS y2 FROM p")
def clipped_boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _flat(_pages(spark, d), Y.clipped(c("b.x1"), c("b.y1"), c("b.x2"), c("b.y2"), c("w"), c("h")))


@query(f"""WITH {SIZES}, q AS (SELECT k, greatest(0, CAST(round_even(x1 + 0.4, 0) AS INTEGER)) AS x1, greatest(0, CAST(round_even(y1 + 0.6, 0) AS INTEGER)) AS y1, least(w, CAST(round_even(x1 + 0.4 + (x2 - x1) / 3.0, 0) AS INTEGER)) AS x2, least(h, CAST(round_even(y1 + 0.6 + (y2 - y1) / 2.0, 0) AS INTEGER)) AS y2, (x2 - x1) / 3.0 * (y2 - y1) / 2.0 / (w * h) AS share FROM p)
SELECT k, x1, y1, x2, y2 FROM q WHERE share >= 0.0005 AND x2 - x1 >= 8 AND y2 - y1 >= 8""")
def suggestion_boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    out = _pages(spark, d).select("k", Y.suggestion_box(c("b.x1") + 0.4, c("b.y1") + 0.6, (c("b.x2") - c("b.x1")) / 3.0, (c("b.y2") - c("b.y1")) / 2.0, c("w"), c("h")).alias("o"))
    return out.filter("o is not null").select("k", "o.*")


@query(f"""WITH {SIZES}, q AS (SELECT *, CASE WHEN least(x2 - x1, y2 - y1) < 300 THEN greatest(8, CAST(round_even(least(x2 - x1, y2 - y1) * 0.12, 0) AS INTEGER)) ELSE 0 END AS boost FROM p),
r AS (SELECT *, greatest(4, CAST(round_even((x2 - x1) * 0.04, 0) AS INTEGER)) + boost AS px, greatest(4, CAST(round_even((y2 - y1) * 0.04, 0) AS INTEGER)) + boost AS y0 FROM q)
SELECT k, greatest(0, x1 - px) AS x1, greatest(0, y1 - greatest(px, y0)) AS y1, least(w, x2 + px) AS x2, least(h, y2 + greatest(px, y0)) AS y2 FROM r""")
def padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_pages(spark, d), Y.padded(F.col("b"), F.col("w"), F.col("h")))


@query(f"""WITH {SIZES}, q AS (SELECT *, CASE WHEN k % 2 = 0 THEN greatest(10, CAST(round_even((x2 - x1) * 0.08, 0) AS INTEGER)) ELSE greatest(8, CAST(round_even((x2 - x1) * 0.04, 0) AS INTEGER)) END AS px, CASE WHEN k % 2 = 0 THEN greatest(10, CAST(round_even((y2 - y1) * 0.45, 0) AS INTEGER)) ELSE greatest(8, CAST(round_even((y2 - y1) * 0.12, 0) AS INTEGER)) END AS py FROM p)
SELECT k, greatest(0, x1 - px) AS x1, greatest(0, y1 - py) AS y1, least(w, x2 + px) AS x2, least(h, y2 + py) AS y2 FROM q""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_pages(spark, d), Y.crop_box(F.col("b"), F.col("w"), F.col("h"), F.col("k") % 2 == 0))


@query(f"WITH {SIZES} SELECT k, x1 * f AS x1, y1 * f AS y1, x2 * f AS x2, y2 * f AS y2, (x2 - x1) * (y2 - y1) * f * f AS area FROM (SELECT *, CASE k % 3 WHEN 0 THEN 1.0 / 0.5 WHEN 1 THEN 1.0 ELSE 1.0 / 0.25 END AS f FROM p)")
def rescaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = F.struct("b.*", ((F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))).alias("area"))
    return _flat(_pages(spark, d), Y.rescaled(b, F.when(F.col("k") % 3 == 0, 0.5).when(F.col("k") % 3 == 1, 1.5).otherwise(0.25)))


def _polygon(df: DataFrame) -> DataFrame:
    """A five-sided figure in each box."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    mid = (c("b.x1") + c("b.x2")) / 2
    return df.withColumn("g", F.array(p(c("b.x1"), c("b.y1")), p(mid, c("b.y1") + 2), p(c("b.x2"), c("b.y1")), p(c("b.x2"), c("b.y2")), p(c("b.x1"), c("b.y2"))))


FIGURE = "g AS (SELECT *, [x1, (x1 + x2) / 2.0, x2, x2, x1]::DOUBLE[] AS xs, [y1, y1 + 2, y1, y2, y2]::DOUBLE[] AS ys FROM p)"


@query(f"WITH {SIZES}, {FIGURE} SELECT k, abs(list_sum(list_transform(range(1, 6), lambda i: xs[i] * ys[CASE WHEN i = 1 THEN 5 ELSE i - 1 END] - ys[i] * xs[CASE WHEN i = 1 THEN 5 ELSE i - 1 END]))) / 2 AS area FROM g")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return _polygon(_pages(spark, d)).select("k", Y.polygon_area(F.col("g")).alias("area"))


@query(f"WITH {SIZES}, {FIGURE} SELECT k, list_sum(list_transform(xs, lambda x: x + 7)) AS sx, list_sum(list_transform(ys, lambda y: y - 3)) AS sy FROM g")
def translated_lines(spark: SparkSession, d: str) -> DataFrame:
    moved = _polygon(_pages(spark, d)).withColumn("m", Y.translated(F.col("g"), F.lit(7), F.lit(-3)))
    total = lambda c: F.aggregate("m", F.lit(0.0), lambda a, p: a + p[c])
    return moved.select("k", total("x").alias("sx"), total("y").alias("sy"))


@query(f"WITH {SIZES} SELECT k, CASE WHEN y2 - y1 < 120 THEN 2 ELSE 1 END AS factor FROM p")
def region_upscale(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("k", Y.region_upscale(F.col("b"), 2).alias("factor"))


@query(f"WITH {SIZES}, {FIGURE} SELECT k, CASE WHEN k % 3 = 2 THEN 0.0 ELSE x1 END AS x1, CASE WHEN k % 3 = 2 THEN 0.0 ELSE y1 END AS y1, CASE WHEN k % 3 = 2 THEN 1.0 ELSE x2 END AS x2, CASE WHEN k % 3 = 2 THEN 1.0 ELSE y2 END AS y2 FROM g")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _polygon(_pages(spark, d))
    m = F.col("k") % 3
    return _flat(rows, Y.page_box(F.when(m == 0, F.col("g")).otherwise(F.slice("g", 1, 0)), F.when(m == 1, F.col("b"))))


CROPPED = "c AS (SELECT *, list_transform(xs, lambda x: least(greatest((x - (x1 - 5)) * 2, 0.0), 119.0)) AS cx, list_transform(ys, lambda y: least(greatest((y - (y1 - 4)) * 2, 0.0), 89.0)) AS cy FROM g)"


def _cropped(spark: SparkSession, d: str) -> DataFrame:
    rows = _polygon(_pages(spark, d))
    return rows.withColumn("c", Y.in_crop(F.col("g"), F.col("b.x1") - 5, F.col("b.y1") - 4, F.lit(2), F.lit(120), F.lit(90)))


@query(f"WITH {SIZES}, {FIGURE}, {CROPPED} SELECT k, 6 AS n, list_sum(cx) + cx[1] AS sx, list_sum(cy) + cy[1] AS sy FROM c")
def page_to_crop(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.aggregate("c", F.lit(0.0), lambda a, p: a + p[c])
    return _cropped(spark, d).select("k", F.size("c").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query(f"WITH {SIZES}, {FIGURE}, {CROPPED}, r AS (SELECT k, cx[3] - 59.5 AS dx, cy[3] - 44.5 AS dy, radians(CASE WHEN k % 2 = 0 THEN 15.0 ELSE 0.0 END) AS t FROM c) SELECT k, round(59.5 + dx * cos(t) - dy * sin(t), 6) AS x, round(44.5 + dx * sin(t) + dy * cos(t), 6) AS y FROM r")
def rotated_points(spark: SparkSession, d: str) -> DataFrame:
    turned = F.get(Y.rotated(F.col("c"), F.when(F.col("k") % 2 == 0, 15.0).otherwise(0.0), F.lit(120), F.lit(90)), F.lit(2))
    return _cropped(spark, d).select("k", F.round(turned["x"], 6).alias("x"), F.round(turned["y"], 6).alias("y"))


CUTS = """e AS (SELECT k, bx, unnest(list_transform(range(1, 6), lambda i: {'a': cx[i], 'b': cy[i], 'c': cx[i % 5 + 1], 'd': cy[i % 5 + 1]})) AS e, x FROM (SELECT *, list_min(cx) AS bx, unnest(list_transform(range(0, 7), lambda i: greatest(0.0, list_min(cx)) + (least(119.0, list_max(cx)) - greatest(0.0, list_min(cx))) * (i / 6.0))) AS x FROM c)),
y AS (SELECT k, x, unnest(CASE WHEN e.a = e.c THEN CASE WHEN abs(x - e.a) <= 1 THEN [e.b, e.d] ELSE [] END WHEN x BETWEEN least(e.a, e.c) AND greatest(e.a, e.c) THEN [e.b + (x - e.a) / (e.c - e.a) * (e.d - e.b)] ELSE [] END) AS y FROM e)"""


@query(f"WITH {SIZES}, {FIGURE}, {CROPPED}, {CUTS} SELECT k, count(*) AS cuts, round(sum(y), 4) AS total FROM y GROUP BY k")
def vertical_crossings(spark: SparkSession, d: str) -> DataFrame:
    xs = F.transform("c", lambda p: p["x"])
    low, high = F.greatest(F.lit(0.0), F.array_min(xs)), F.least(F.lit(119.0), F.array_max(xs))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: low + (high - low) * (i / 6)))
    rows = _cropped(spark, d).select("k", "c", at.alias("x")).select("k", Y.crossings(F.col("c"), F.col("x")).alias("ys"))
    return rows.groupBy("k").agg(F.sum(F.size("ys")).alias("cuts"), F.round(F.sum(F.aggregate("ys", F.lit(0.0), lambda a, y: a + y)), 4).alias("total"))


@query(f"WITH {SIZES}, {FIGURE}, {CROPPED}, {CUTS}, b AS (SELECT k, x, min(y) + 0.78 * (max(y) - min(y)) AS y FROM y GROUP BY k, x) SELECT k, 7 AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy FROM b GROUP BY k")
def line_baselines(spark: SparkSession, d: str) -> DataFrame:
    rows = _cropped(spark, d).withColumn("l", Y.baseline(F.col("c"), F.lit(120), F.lit(90)))
    total = lambda c: F.round(F.aggregate("l", F.lit(0.0), lambda a, p: a + p[c]), 4)
    return rows.select("k", F.size("l").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query(f"WITH {SIZES}, {FIGURE} SELECT k, CASE WHEN k % 2 = 0 THEN xs[3] ELSE (xs[2] + xs[3]) / 2 END AS x, CASE WHEN k % 2 = 0 THEN ys[3] ELSE (ys[2] + ys[3]) / 2 END AS y FROM g")
def line_midpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = _polygon(_pages(spark, d))
    return _flat(rows, Y.midpoint(F.when(F.col("k") % 2 == 0, F.col("g")).otherwise(F.slice("g", 1, 4))))


@query("SELECT user_id, round(CASE WHEN n > 0 THEN s / n END, 6) AS confidence FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n, sum(value) FILTER (WHERE event_type = 'click') AS s FROM events GROUP BY user_id)")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("value"))).alias("c"))
    return per.select("user_id", F.round(Y.mean_confidence(F.col("c")), 6).alias("confidence"))


# Tiles and seams
BANDS = "CASE WHEN {0} < 280 THEN 1 WHEN {0} // greatest(5, least(8, CAST(round_even({0} / 260.0, 0) AS INTEGER))) < 90 THEN greatest(1, {0} // 90) ELSE greatest(5, least(8, CAST(round_even({0} / 260.0, 0) AS INTEGER))) END"


@query(f"WITH {SIZES} SELECT k, CAST({BANDS.format('h')} AS INTEGER) AS bands FROM p")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("k", Y.band_count(F.col("h")).alias("bands"))


CLIP = "greatest(0, least({0}, w - 1)) AS x1, greatest(0, least({1}, h - 1)) AS y1, greatest(greatest(0, least({0}, w - 1)) + 1, least({2}, w)) AS x2, greatest(greatest(0, least({1}, h - 1)) + 1, least({3}, h)) AS y2"


@query(f"""WITH {SIZES}, n AS (SELECT k, w, h, w - 10 AS bw, h - 10 AS bh FROM p), m AS (SELECT *, CAST({BANDS.format('bh')} AS INTEGER) AS n FROM n),
s AS (SELECT *, greatest(1, CAST(round_even(bh / CAST(n AS DOUBLE), 0) AS INTEGER)) AS band FROM m), o AS (SELECT *, greatest(8, CAST(round_even(band * 0.12, 0) AS INTEGER)) AS oy, greatest(18, CAST(round_even(bw * 0.05, 0) AS INTEGER)) AS ox FROM s),
t AS (SELECT *, CASE WHEN i = 0 THEN 5 ELSE greatest(5, 5 + i * band - oy) END AS top, CASE WHEN i = n - 1 THEN h - 5 ELSE least(h - 5, 5 + (i + 1) * band + oy) END AS bottom FROM (SELECT *, unnest(range(0, n)) AS i FROM o WHERE n > 1 AND least(bw, bh) >= 120))
SELECT k, CAST(count(*) AS INTEGER) AS tiles, CAST(sum(x1 + 2 * y1 + 3 * x2 + 5 * y2) AS BIGINT) AS digest FROM (
SELECT k, 5 AS x1, 5 AS y1, w - 5 AS x2, h - 5 AS y2 FROM n UNION ALL SELECT k, 5, top, w - 5, bottom FROM t WHERE bw < 1100
UNION ALL SELECT k, {CLIP.format("5", "top", "5 + bw // 2 + ox", "bottom")} FROM t WHERE bw >= 1100 UNION ALL SELECT k, {CLIP.format("5 + bw // 2 - ox", "top", "w - 5", "bottom")} FROM t WHERE bw >= 1100) GROUP BY k""")
def tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("t", Y.tile_boxes(Y.box(F.lit(5), F.lit(5), F.col("w") - 5, F.col("h") - 5), F.col("w"), F.col("h")))
    digest = F.aggregate("t", F.lit(0).cast("long"), lambda a, b: a + b["x1"] + 2 * b["y1"] + 3 * b["x2"] + 5 * b["y2"])
    return rows.select("k", F.size("t").alias("tiles"), digest.alias("digest"))


def _digest(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b["x1"] + 2 * b["y1"] + 3 * b["x2"] + 5 * b["y2"])


def grid_sql(rows: int, columns: int) -> str:
    """x1 + 2 y1 + 3 x2 + 5 y2, summed over a grid's tiles."""
    th, tw = f"greatest(1, h // {rows})", f"greatest(1, w // {columns})"
    oy, ox = f"greatest(4, CAST(floor({th} * 0.15) AS INTEGER))", f"greatest(4, CAST(floor({tw} * 0.15) AS INTEGER))"
    parts = []
    for r in range(rows):
        for c in range(columns):
            y1 = "0" if r == 0 else f"greatest(0, {r} * {th} - {oy})"
            y2 = "h" if r == rows - 1 else f"least(h, {r + 1} * {th} + {oy})"
            x1 = "0" if c == 0 else f"greatest(0, {c} * {tw} - {ox})"
            x2 = "w" if c == columns - 1 else f"least(w, {c + 1} * {tw} + {ox})"
            parts.append(f"least({x1}, w - 1) + 2 * least({y1}, h - 1) + 3 * greatest(1, {x2}) + 5 * greatest(1, {y2})")
    return " + ".join(parts)


@query(f"WITH {SIZES} SELECT k, CASE WHEN k % 2 = 0 THEN '3x2' ELSE '2x2' END AS grid, CAST(CASE WHEN k % 2 = 0 THEN {grid_sql(3, 2)} ELSE {grid_sql(2, 2)} END AS BIGINT) AS digest FROM p")
def grid_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    used = F.when(F.col("k") % 2 == 0, Y.grid(2, 2, F.col("w"), F.col("h"))).otherwise(Y.grid(3, 3, F.col("w"), F.col("h")))
    return rows.select("k", Y.grid_shift(used, F.col("w"), F.col("h")).alias("g")).select("k", "g.grid", _digest(F.col("g.boxes")).alias("digest"))


@query(f"""WITH {SIZES}, d AS (SELECT *, greatest(4, CAST(floor((x2 - x1) * 0.22) AS INTEGER)) AS dx, greatest(4, CAST(floor((y2 - y1) * 0.22) AS INTEGER)) AS dy FROM p)
SELECT k, CAST(greatest(0, least(x1 - dx, w - 1)) + 2 * greatest(0, least(y1 - dy, h - 1)) + 3 * greatest(1, least(x2 + dx, w)) + 5 * greatest(1, least(y2 + dy, h)) AS BIGINT) AS digest FROM d""")
def expanded_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("k", _digest(Y.expanded(F.array("b"), F.col("w"), F.col("h"))).alias("digest"))


@query(f"WITH {SIZES} SELECT k, CASE WHEN h > 300 THEN '3x2' ELSE 'flat' END AS grid FROM p WHERE h > 300 AND w > 220")
def inferred_grids(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).filter("h > 300 and w > 220")
    return rows.select("k", Y.inferred_grid(Y.grid(3, 2, F.col("w"), F.col("h"))).alias("grid"))


@query(f"""WITH {SIZES}, t AS (SELECT k, h, h // 3 AS th, greatest(4, CAST(floor((h // 3) * 0.15) AS INTEGER)) AS o FROM p WHERE h > 300 AND w > 220)
SELECT k, ((th + o) + (th - o)) // 2 || ',' || ((2 * th + o) + (2 * th - o)) // 2 AS ys, 1 AS xs FROM t""")
def tile_seams(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).filter("h > 300 and w > 220").withColumn("g", Y.grid(3, 2, F.col("w"), F.col("h")))
    return rows.select("k", F.array_join(F.transform(Y.seams(F.col("g"), "y"), lambda s: s.cast("string")), ",").alias("ys"), F.size(Y.seams(F.col("g"), "x")).alias("xs"))


@query()
def seam_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("g", Y.seam_bands(Y.grid(2, 2, F.col("w"), F.col("h")), F.col("w"), F.col("h")))
    return rows.select("k", F.size("g").alias("n"), _digest(F.col("g")).alias("digest"))


@query(f"WITH {SIZES} SELECT k, 'grid_shift' AS strategy, CAST({grid_sql(3, 2)} AS BIGINT) AS digest FROM p")
def retry_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return rows.select("k", Y.retry_tiles(Y.grid(2, 2, F.col("w"), F.col("h")), F.col("w"), F.col("h")).alias("r")).select("k", "r.strategy", _digest(F.col("r.boxes")).alias("digest"))


@query(f"WITH {SIZES} SELECT k, k % 3 = 0 OR k % 5 = 0 AS noop FROM p")
def noop_retry(spark: SparkSession, d: str) -> DataFrame:
    k, g = F.col("k"), Y.grid(2, 2, F.col("w"), F.col("h"))
    other = F.when(k % 5 == 0, F.reverse(g)).otherwise(F.array("b"))
    return _pages(spark, d).select("k", Y.is_noop(F.when(k % 3 == 0, "a").otherwise(""), F.when(k % 3 == 0, "a").otherwise(""), g, other).alias("noop"))


@query()
def merged_rects(spark: SparkSession, d: str) -> DataFrame:
    return Y.merged_rects(_boxes(spark, d))
