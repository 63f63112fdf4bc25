"""Operators on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import evaluation as E
from quire.operators import geometry as G
from quire.operators import linking as L
from quire.operators import quality as Q
from quire.operators import retrieval as R
from quire.operators import runs as U
from quire.sources import files
from quire.streaming import trace as S


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).first()[0]


def of(spark, f, text):
    return value(spark, f(F.col("t")), t=text)


def test_search_terms(spark):
    assert of(spark, T.search_terms, "rois") == [" roi", "rois", "ois "]
    assert of(spark, T.search_terms, "et") == [" et "]
    assert of(spark, T.search_terms, "vir") == of(spark, T.search_terms, "uir")
    assert of(spark, T.search_terms, "Iohannes") == of(spark, T.search_terms, "johannes")
    assert of(spark, T.search_terms, "domi-\nnus") == of(spark, T.search_terms, "dominus")


def test_similarities(spark):
    pair = lambda f, a, b: value(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert pair(F.levenshtein, "kitten", "sitting") == 3 and pair(F.levenshtein, "flaw", "lawn") == 2
    assert pair(T.edit_distance_ratio, "", "") == 0 and pair(T.edit_distance_ratio, "", "x") == 1
    assert pair(T.bigram_overlap, "night", "nacht") == 0.25 and pair(T.bigram_overlap, "a", "ab") == 0
    assert E.distance("a b c".split(), "a x c d".split()) == 2 and E.distance([], ["a"]) == 1


def test_text_signals(spark):
    assert of(spark, T.uncertainty_density, "ab[…]") == pytest.approx(0.8)
    assert of(spark, T.uncertainty_density, None) == 0 and of(spark, T.char_entropy, "") == 0
    assert of(spark, T.char_entropy, "aabb") == pytest.approx(1.0)
    assert of(spark, T.repetition_score, "a b\na b\na b\nc d") == pytest.approx(0.5)
    assert of(spark, T.repetition_score, "\n".join(["one two three four five"] * 4)) == pytest.approx(1.0)
    assert of(spark, T.uncertainty_tokens, "a... b… […]") == "a[…] b[…] […]"
    assert of(spark, T.script_family, "Ελληνικά κείμενα") == "greek" and of(spark, T.script_family, "12 ?") == "unknown" and of(spark, T.script_family, "plain text") == "latin"
    assert of(spark, T.non_wordlike_score, "a") == 0.5 and of(spark, T.non_wordlike_score, "house") == 0 and of(spark, T.non_wordlike_score, "bcdfghk") == pytest.approx(0.65)
    assert of(spark, T.pattern_junk, "????????") and not of(spark, T.pattern_junk, "a line of text")


def test_quality_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "Une bonne ligne de texte ici\net une autre ligne encore")], "doc_id long, text string")
    labels = {r["doc_id"]: r["quality_label"] for r in Q.gates(Q.report(rows)).collect()}
    assert labels[1] == labels[2] == labels[3] == "UNRELIABLE" and labels[4] in ("HIGH", "OK")
    assert Q.report(rows.limit(0)).count() == 0


def test_window_chunks(spark):
    text = "\n".join(f"line number {i} with enough text" for i in range(10))
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "\n".join(["a long enough line of text here"] * 6 + ["x"]))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["idx"], r["line_start"], r["line_end"]) for r in C.window_chunks(rows).collect())
    assert got == [(1, 0, 0, 5), (1, 1, 4, 9), (4, 0, 0, 5), (4, 1, 4, 6)]
    assert all(text[r["start_offset"] : r["end_offset"]] == r["text"] for r in C.window_chunks(rows).filter("doc_id = 1").collect())
    short = spark.createDataFrame([(1, "\n".join("abcdefg"))], "doc_id long, text string")
    assert [(r["line_start"], r["line_end"], r["text"]) for r in C.window_chunks(short).collect()] == [(0, 6, "a\nb\nc\nd\ne\nf\ng")]
    with pytest.raises(ValueError):
        C.window_chunks(rows, 2, 2)


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("d1", "a b"), ("d2", "a a c")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "c"), (2, "zz")], "q long, text string")
    assert [(r["doc_id"], r["rank"]) for r in R.bm25(docs, asked, ["doc_id"], "q", terms=T.word_terms).collect()] == [("d2", 1)]
    first, second = (spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(xs)], "q long, id string, rank int") for xs in ("ab", "bc"))
    got = [(r["id"], r["score"]) for r in R.reciprocal_rank_fusion([first, second], "q", ["id"]).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_dense_leaves_out_what_has_no_direction(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id long, v array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in R.dense_topk(rows.filter("id = 1"), rows, "id", "v", limit=5).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 5, 2)]


def test_runs(spark):
    runs = spark.createDataFrame([("r1", "p", "s1", 1, True), ("r2", "p", "s1", 2, True), ("r3", "p", "s1", 3, False), ("r4", "q", "", 1, None), ("r5", "q", None, 0, True)], "run_id string, asset_ref string, asset_sha256 string, created_at int, search_allowed boolean")
    reports = spark.createDataFrame([("r4", 0, 1, False), ("r4", 1, 1, True)], "run_id string, pass_idx int, created_at int, token_search_allowed boolean")
    got = {r["run_id"] for r in U.searchable_runs(runs, runs, reports).collect()}
    assert got == {"r2", "r4"}
    visits = spark.createDataFrame([(None, 1), ("", 2), ("FR", 2)], "country string, visitor long")
    assert sorted(r["country"] for r in U.visits_by(visits, "country", "visitor").collect()) == ["FR", "Unknown", "Unknown"]


def test_decisions_merge(spark):
    rows = [(1, "REJECT_LINKABLE", 7), (2, "ACCEPT_LINKABLE", 7), (3, "ACCEPT_LINKABLE", 7), (4, None, 8)]
    got = sorted(map(tuple, U.merge_decisions(spark.createDataFrame(rows, "id long, status string, span long"), ["span"], "id").collect()))
    assert got == [(7, 2, "ACCEPT_LINKABLE", ["REJECT_LINKABLE", "ACCEPT_LINKABLE"]), (8, 4, None, [])]


def test_geometry(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0, 0.9), (1, 2, 1, 0, 11, 10, 0, 0.8), (1, 3, 20, 0, 30, 10, 0, 0.7), (2, 1, 0, 0, 4, 4, 0, 0.5)], "page long, box_id long, x1 int, y1 int, x2 int, y2 int, kind int, score double")
    once = G.nms(boxes, 0.5)
    assert sorted((r["page"], r["box_id"]) for r in once.collect()) == [(1, 1), (1, 3), (2, 1)] == sorted((r["page"], r["box_id"]) for r in G.nms(once, 0.5).collect())
    assert [r["box_id"] for r in G.reading_order(boxes.filter("page = 1")).orderBy("position").collect()] == [1, 2, 3]
    assert G.overlapping_pairs(boxes).collect()[0]["iou"] == pytest.approx(90 / 110)


def test_disambiguation(spark):
    rows = [(1, "a", 0.95, 0.9, True, "HIGH"), (1, "b", 0.99, 0.9, False, "HIGH"), (2, "a", 0.9, 0.9, True, "MEDIUM"), (2, "b", 0.89, 0.9, True, "MEDIUM"), (3, "a", 0.99, 0.1, True, "odd"), (4, "a", 0.5, None, None, None)]
    frame = spark.createDataFrame(rows, "mention_id long, candidate_id string, score double, similarity double, type_compatible boolean, quality string")
    assert {r["mention_id"]: (r["selected"], r["status"]) for r in L.disambiguate(frame).collect()} == {1: ("a", "linked"), 2: (None, "ambiguous"), 3: (None, "unresolved"), 4: (None, "unresolved")}


def test_mentions_do_not_overlap(spark):
    rows = [(1, 0, 5, "person", 0.9), (1, 3, 8, "person", 0.8), (1, 3, 8, "place", 0.1), (1, 8, 9, "person", 0.2)]
    got = L.dedupe_mentions(spark.createDataFrame(rows, "doc_id long, start int, end int, kind string, confidence double")).collect()
    assert sorted((r["start"], r["kind"]) for r in got) == [(0, "person"), (3, "place"), (8, "person")]


def test_error_rates(spark):
    pairs = spark.createDataFrame([(1, "", ""), (2, "", "x"), (3, "ab", "ac")], "page_id long, reference string, hypothesis string")
    rates = {r[0]: r[1] for r in pairs.select("page_id", E.cer(F.col("reference"), F.col("hypothesis"))).collect()}
    assert rates[1] == 0 and math.isinf(rates[2]) and rates[3] == 0.5
    one = E.precision_recall(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (one["precision"], one["recall"], one["f1"]) == (1, 1, 1)


def test_deltas():
    assert S.delta("hello", "he") == "llo" and S.delta("lo", "hello") == "" and S.delta("lo w", "hello") == " w" and S.delta("x", "") == "x"


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('# comment\n{"page_id": "a", "text": "x"}\n\n')
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.jsonl"), "page_id string, text string", ["page_id"]).collect()] == [("a", "x")]
    (tmp_path / "r.json").write_text('{"p": {"one": "t1", "two": "t2"}}')
    assert sorted(tuple(r) for r in files.read_readings(spark, str(tmp_path / "r.json")).collect()) == [("p", "one", "t1"), ("p", "two", "t2")]
    regions = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, " ")], "page string, position int, text string")
    text = files.page_text(regions)
    assert text.first()["text"] == "a\nb\n" and "TextLine" in files.page_xml(text).first()["xml"]
    files.write_csv(text, str(tmp_path / "out"))
    files.append_evidence(text, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_names():
    assert N.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6) and N.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert N.jaro("", "") == 1 and N.jaro("a", "") == 0 and N.jaro("DIXON", "DICKSONX") == pytest.approx(0.766667, abs=1e-6)
    assert N.name_similarity("Roland", "roland") == 1
