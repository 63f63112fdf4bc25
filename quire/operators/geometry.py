"""Boxes on pages: overlaps, suppression, reading order, tiles and counts. Boxes are x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

BOX = ("x1", "y1", "x2", "y2")


def area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.lit(0)) * F.greatest(F.col(f"{p}y2") - F.col(f"{p}y1"), F.lit(0))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def side(df: DataFrame, prefix: str, page: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == page else prefix + c) for c in df.columns])


def overlapping_pairs(boxes: DataFrame, page: str = "page", order: str = "box_id", least: float = 0.0) -> DataFrame:
    """page, the ids of pairs of boxes of a page, and their IoU where it is over `least`: an equi-join on the page."""
    both = side(boxes, "a_", page).join(side(boxes, "b_", page), page).filter((F.col(f"a_{order}") < F.col(f"b_{order}")) & (intersection("a_", "b_") > 0))
    return both.select(page, f"a_{order}", f"b_{order}", iou("a_", "b_").alias("iou")).filter(F.col("iou") > least)


def contained_fraction(boxes: DataFrame, containers: DataFrame, page: str = "page", order: str = "box_id") -> DataFrame:
    """boxes with the greatest share of each that lies inside one container of its page."""
    met = side(boxes, "a_", page).join(side(containers, "b_", page), page)
    part = F.when(area("a_") > 0, intersection("a_", "b_") / area("a_")).otherwise(0.0)
    best = met.groupBy(page, F.col(f"a_{order}").alias(order)).agg(F.max(part).alias("inside"))
    return boxes.join(best, [page, order], "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))


def non_degenerate(boxes: DataFrame, least: int = 8) -> DataFrame:
    return boxes.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each run of equal keys; a task's rows are sorted by them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema)


def by_page(boxes: DataFrame, keys: tuple[str, ...], order: list, f: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """f of the rows of each group in order. Groups are small and many, so a task streams over its sorted rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for g in _groups(batches, keys) for r in f(g)), arrow)

    return boxes.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def nms(boxes: DataFrame, threshold: float = 0.5, page: str = "page", kind: str | None = "kind") -> DataFrame:
    """Greedy suppression by page (and kind): best score first, ties in order of box_id; a box goes whose IoU with one kept
    before is at least the threshold. Columns as in boxes."""

    def keep(rows: list[dict]) -> list[dict]:
        kept: list[tuple[dict, int]] = []
        for r in rows:
            own = max(0, r["x2"] - r["x1"]) * max(0, r["y2"] - r["y1"])
            for k, other in kept:
                both = max(0, min(r["x2"], k["x2"]) - max(r["x1"], k["x1"])) * max(0, min(r["y2"], k["y2"]) - max(r["y1"], k["y1"]))
                if both and both / (own + other - both) >= threshold:
                    break
            else:
                kept.append((r, own))
        return [r for r, _ in kept]

    return by_page(boxes, (page,) if kind is None else (page, kind), [F.desc("score"), *map(F.asc, ("box_id", *BOX))], keep, boxes.schema)


def reading_order(boxes: DataFrame, overlap: float = 0.5, page: str = "page") -> DataFrame:
    """boxes with position (from 0): columns from left to right, each from the top. A box joins the first column whose span it
    overlaps by that share of the narrower; spans grow with their boxes."""

    def order(rows: list[dict]) -> list[dict]:
        columns: list[list] = []
        for r in rows:
            for c in columns:
                shared, narrow = min(r["x2"], c[1]) - max(r["x1"], c[0]), min(r["x2"] - r["x1"], c[1] - c[0])
                if shared > 0 and narrow > 0 and shared / narrow >= overlap:
                    c[0], c[1] = min(c[0], r["x1"]), max(c[1], r["x2"])
                    c[2].append(r)
                    break
            else:
                columns.append([r["x1"], r["x2"], [r]])
        columns.sort(key=lambda c: (c[0], c[1]))
        read = [r for c in columns for r in sorted(c[2], key=lambda r: (r["y1"], r["x1"], r["box_id"], r["x2"], r["y2"]))]
        return [r | {"position": n} for n, r in enumerate(read)]

    schema = StructType([*boxes.schema.fields, StructField("position", IntegerType())])
    return by_page(boxes, (page,), ["x1", "y1", "box_id", "x2", "y2"], order, schema)


def class_counts(boxes: DataFrame, names: DataFrame, kind: str = "kind") -> DataFrame:
    """Boxes by class name; a class without a name is cls_<id>."""
    named = boxes.groupBy(kind).agg(F.count("*").alias("boxes")).join(names, kind, "left")
    return named.groupBy(F.coalesce("name", F.concat(F.lit("cls_"), F.col(kind).cast("string"))).alias("name")).agg(F.sum("boxes").alias("boxes"))


def grid_tiles(pages: DataFrame, rows: int, columns: int, overlap: float) -> DataFrame:
    """pages (width, height) with a row for each tile of a grid, widened on every side by a share and clamped to the page."""
    out = pages.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    w, h = F.col("width") / columns, F.col("height") / rows
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.floor(v), most)).cast("long")
    return out.withColumns(
        {
            "x1": clamp(F.col("tile_col") * w - overlap * w, F.col("width")), "x2": clamp((F.col("tile_col") + 1) * w + overlap * w, F.col("width")),
            "y1": clamp(F.col("tile_row") * h - overlap * h, F.col("height")), "y2": clamp((F.col("tile_row") + 1) * h + overlap * h, F.col("height")),
        }
    )


def gaps(boxes: DataFrame, page: str = "page") -> DataFrame:
    """boxes with gap: the distance to the next box of the page from left to right (negative: they overlap; null: the last)."""
    place = Window.partitionBy(page).orderBy("x1", "y1", "box_id", "x2")
    return boxes.withColumn("gap", F.lead("x1").over(place) - F.col("x2"))


def of_classes(images: DataFrame, boxes: DataFrame, kinds: list[int], page: str = "page", kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """Boxes of some classes, and the images that still have any."""
    kept = boxes.filter(F.col(kind).isin(*kinds))
    return images.join(kept, page, "left_semi"), kept
