"""Mentions, merged lines and layout rules by hand."""

from pyspark.sql import functions as F

from quire.operators import layout as Y
from quire.operators import mentions as M
from quire.operators import regions as N


def kinds(text):
    return [(kind, surface) for _, _, surface, kind, *_ in M.spans_of(text)]


def test_name_runs():
    assert kinds("then Jean de Berry came") == [("person", "Jean de Berry")]
    assert kinds("Jean Pierre Paul Marc Luc Jean went")[0] == ("person", "Jean Pierre Paul Marc Luc")
    assert kinds("Jean went") == [] and kinds("Louis XIV reigned") == [] and kinds("Jean de") == []
    ((a, b, sure),) = M.name_runs("Jean de Berry")
    assert (a, b) == (0, 13) and abs(sure - 0.70) < 1e-9
    assert [round(x[2], 9) for x in M.name_runs("Jean Pierre Paul")] == [0.70] and list(M.name_runs("")) == []


def test_anchors_dates_and_titles():
    assert ("place", "Lausanne") in kinds("a Lausanne") and ("title", "euesque") in kinds("li euesque")
    assert ("date", "1432") in kinds("en 1432") and ("date", "MCLXIIII") in kinds("anno MCLXIIII") and ("date", "mil") not in kinds("mil hommes")
    assert ("date", "l'an mil") in kinds("l'an mil") and kinds("La mort le roi\nmore") == [("work", "La mort le roi")]


def test_extraction_keeps_offsets(spark):
    rows = [(1, "Jean de Berry\nvint a Paris"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = M.best_of_each(M.extracted(docs)).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["kind"]) for r in got) == [(1, 0, 13, "person"), (1, 21, 26, "place")]
    tokens = M.token_spans(docs)
    assert [(r["start"], r["end"], r["surface"]) for r in tokens.orderBy("start").collect()][:3] == [(0, 4, "Jean"), (5, 7, "de"), (8, 13, "Berry")]
    names = spark.createDataFrame([(1, "berri"), (1, "uint")], "doc_id int, name_key string")
    further = M.propagated(tokens, M.extracted(docs), names).collect()
    assert [(r["surface"], r["start"]) for r in further] == [("vint", 14)]


def test_tile_lines_merge(spark):
    rows = [(1, 1, "the king rode out at dawn", 0.5), (1, 2, "the king rode out at dawm?", 0.9), (1, 3, "another line here", 0.4), (1, 4, "the king rode out at dawm", 0.8), (1, 5, " ", 0.9), (1, 6, None, None)]
    got = N.merged_lines(spark.createDataFrame(rows, "page int, line_id int, line string, confidence double")).orderBy("line_id").collect()
    assert [r["line"] for r in got] == ["the king rode out at dawm", "another line here"]


def test_rects_merge_and_contained_boxes_go(spark):
    rows = [(1, 1, 0, 0, 10, 10, "a"), (1, 2, 15, 0, 30, 10, "a"), (1, 3, 35, 0, 50, 10, "a"), (1, 4, 200, 200, 210, 210, "a"), (1, 5, 1, 1, 9, 9, "a"), (2, 6, 0, 0, 5, 5, "a")]
    boxes = spark.createDataFrame(rows, "page int, box_id int, x1 int, y1 int, x2 int, y2 int, name string")
    assert sorted(tuple(r) for r in Y.merged_rects(boxes).collect()) == [(1, 0, 0, 50, 10), (1, 200, 200, 210, 210), (2, 0, 0, 5, 5)]
    assert sorted(r["box_id"] for r in Y.without_contained(boxes).collect()) == [1, 2, 3, 4, 6]
    assert [r["position"] for r in Y.without_columns(boxes).orderBy("page", "position").collect()] == [0, 1, 2, 3, 4, 0]


def test_seam_bands_and_empty_tables(spark):
    page = spark.createDataFrame([(400, 600)], "w int, h int")
    tiles = Y.grid(2, 1, F.col("w"), F.col("h"))
    out = page.select(Y.seams(tiles).alias("s"), Y.seam_bands(tiles, F.col("w"), F.col("h")).alias("b"), Y.seam_bands(Y.grid(1, 1, F.col("w"), F.col("h")), F.col("w"), F.col("h")).alias("n")).first()
    assert out["s"] == [300] and [(b["y1"], b["y2"]) for b in out["b"]] == [(0, 284), (284, 600)] and out["n"] is None
    boxes = spark.createDataFrame([], "page int, box_id int, x1 int, y1 int, x2 int, y2 int, name string, score double")
    assert Y.split_lanes(boxes, ("MainZone",), ("MarginTextZone",)).count() == 0 and Y.suppressed(boxes).count() == 0
