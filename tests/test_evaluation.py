"""Alignments, projections and intervals against hand-made answers and plain Python."""

import math
import random

from quire.operators import evaluation as E


def test_breakdowns():
    assert E.breakdown(list("kitten"), list("sitting")) == (3, 2, 0, 1) and E.breakdown([], list("abc")) == (3, 0, 0, 3) and E.breakdown(list("abc"), []) == (3, 0, 3, 0)
    assert E.breakdown(list("flaw"), list("lawn"))[0] == 2 and E.breakdown([], []) == (0, 0, 0, 0)
    rng = random.Random(7)
    for _ in range(200):
        a, b = ["".join(rng.choices("abcd ", k=rng.randrange(30))) for _ in "ab"]
        d, s, x, i = E.breakdown(list(a), list(b))
        assert d == E.distance(list(a), list(b)) == s + x + i and len(a) - x + i == len(b)


def test_projections():
    assert E.projected(list("abcd"), list("abxcd")) == [0, 1, 3, 4, 5] and E.projected([], list("ab")) == [2] and E.projected(list("ab"), []) == [0, 0, 0]


def test_word_errors_and_reports(spark):
    rows = [(1, "the cat sat", "the cat sat"), (2, "the cat sat", "cat sit"), (3, "", "x"), (4, "", "")]
    pairs = spark.createDataFrame(rows, "page_id int, reference string, hypothesis string")
    got = {r["page_id"]: (r["word_distance"], r["reference_words"]) for r in E.word_errors(pairs).collect()}
    assert got == {1: (0, 3), 2: (2, 3), 3: (1, 0), 4: (0, 0)}
    report = {r["unit"]: r for r in E.full_corpus_report(pairs).collect()}
    assert report["word"]["micro"] == 3 / 6 and math.isclose(report["word"]["macro"], (0 + 2 / 3 + 0) / 3) and report["word"]["pages"] == 4
    assert [r["page_id"] for r in E.worst_pages(pairs, 2).collect()] == [3, 2]


def test_intervals_draw_item_by_item(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(30)]
    rows = [("a", k, v, 1.0 + k % 3) for k, v in enumerate(values)] + [(None, 0, 1.0, 1.0), (None, 1, 2.0, 1.0), ("one", 0, 5.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, k int, v double, w double")
    got = {r["g"]: r for r in E.bootstrap_interval(frame, "g", "v", "k", resamples=300).collect()}
    pick = random.Random(0)
    means = sorted(sum(values[pick.randrange(30)] for _ in values) / 30 for _ in range(300))
    assert math.isclose(got["a"]["low"], means[math.floor(0.025 * 299)], rel_tol=1e-9) and math.isclose(got["a"]["high"], means[math.ceil(0.975 * 299)], rel_tol=1e-9)
    assert math.isclose(got["a"]["estimate"], sum(values) / 30) and got["one"]["low"] is None and got[None]["estimate"] == 1.5
    clustered = {r["g"]: r for r in E.clustered_interval(frame, "g", "w", "v", "k", resamples=300).collect()}
    assert math.isclose(clustered["a"]["estimate"], sum(values) / 30) and clustered["a"]["low"] <= clustered["a"]["estimate"] <= clustered["a"]["high"]


def test_greedy_matches_and_gold_spans(spark):
    texts = spark.createDataFrame([(1, "Arthur saw Arthur and Lancelot.")], "page int, text string")
    entities = spark.createDataFrame([(1, "Arthur", "person", 2), (1, "Lancelot", "person", 1), (1, "Merlin", "person", 1), (1, "Arthur", "person", 3)], "page int, surface string, kind string, occurrence int")
    gold = E.gold_spans(texts, entities)
    assert sorted((r["start"], r["end"]) for r in gold.collect()) == [(11, 17), (22, 30)]
    ours = spark.createDataFrame([(1, "person", 0, 6), (1, "person", 12, 15), (1, "place", 22, 30)], "page int, kind string, start int, end int")
    assert tuple(E.greedy_matches(ours, gold).first()) == (1, 1, 2, 1)
