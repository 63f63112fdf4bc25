"""Findings of round 3: results on odd rows, and steps whose cost must not grow faster than their input."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from quire.functions import lexicon as X
from quire.functions import rows as W
from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import layout as Y
from quire.operators import mentions as M
from quire.operators import quality as Q
from quire.operators import regions as N
from quire.operators import retrieval as R
from quire.operators import sanity as S
from quire.plans.catalog import QUERIES

ODD = ["", " \n\t", "Straße qxzx bcdfghk 12# a", "b\nde fin-\nle x", "\xa0a\xa0b c d", "ÆRA oeuvre ŵ ĵ ª² Ως", "mmm iii XIIII 3x1# […] ? q?", "a b c d e f\n" * 9, None]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def tables(spark, tmp_path, **dfs):
    for name, df in dfs.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def seconds(f):
    began = time.time()
    f()
    return time.time() - began


def nodes(df):
    """How many expressions a plan holds, by its text."""
    return len(df._jdf.queryExecution().analyzed().toString())


def test_f1_canonical_tokens_are_keyed_where_they_lie(spark, tmp_path):
    docs = docs_of(spark, ["About ABOUT their's Wich which", "Dn̄s vir", None])
    keyed = M.token_spans(docs, keyed=True)
    plain = M.token_spans(docs).withColumn("name_key", X.search_key(F.col("surface")))
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, plain.collect()))
    names = spark.createDataFrame([("UIR", 1), ("Dominus", 2)], "name string, position int")
    assert sorted((r["surface"], r["canonical"]) for r in M.first_canonical(keyed, names).collect()) == [("Dn̄s", "Dominus"), ("vir", "UIR")]
    plan = M.first_canonical(keyed, names)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "regexp" not in plan


def test_f2_hybrid_ranks_without_rows_for_terms(spark, tmp_path):
    docs = docs_of(spark, ["the king rode out", "another line", "king of the hill"])
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, "king"), (1, "line")], "item_id long, text string")
    df = QUERIES["hybrid_topk"](spark, tables(spark, tmp_path, documents=docs, embeddings=vectors, benchmark=asked))
    got = {(r["item_id"], r["doc_id"]): (r["dense_rank"], r["lexical_rank"]) for r in df.collect()}
    assert got[0, 0] == (1, 2) and got[0, 2][1] == 1 and got[1, 1] == (1, 1) and len(got) == 6
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_f3_only_tokens_that_are_some_name_are_shuffled(spark):
    docs = docs_of(spark, ["Berri went by Uint and berri", "Berri"])
    names = spark.createDataFrame([(0, "berri"), (0, "berri"), (0, "by"), (1, "uint")], "doc_id long, name_key string")
    none = spark.createDataFrame([(0, 0, 5, "person")], "doc_id long, start int, end int, kind string")
    df = M.propagated(M.token_spans(docs, keyed=True), none, names)
    assert [(r["doc_id"], r["start"], r["surface"]) for r in df.collect()] == [(0, 23, "berri")]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_f4_report_meets_each_distinct_token_once(spark):
    got = {r["doc_id"]: r for r in Q.signals(docs_of(spark, ODD)).collect()}
    want = docs_of(spark, ODD).select("doc_id", T.char_entropy(F.col("text")).alias("e"), T.rare_bigram_ratio(T.text_or_empty(F.col("text"))).alias("b"), T.repetition_score(F.col("text")).alias("r"), T.leading_fragment_ratio(F.col("text")).alias("l"), T.trailing_fragment_ratio(F.col("text")).alias("t"), T.uncertainty_density(F.col("text")).alias("u"))
    for w in want.collect():
        r = got[w["doc_id"]]
        assert np.allclose([r["char_entropy"], r["rare_bigram_ratio"], r["repetition_score"], r["leading_fragment_ratio"], r["trailing_fragment_ratio"], r["uncertainty_density"]], [w["e"], w["b"], w["r"], w["l"], w["t"], w["u"]])
    calls = []
    memo = W.Memo(lambda t: calls.append(t) or W.token_signals(t))
    assert [memo[t] for t in ["qxzx", "de"] * 500][:2] == [W.token_signals("qxzx"), W.token_signals("de")] and len(calls) == 2


def test_f5_lines_are_likened_only_where_they_can_be_alike(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choices("abcdefghij klmno", k=60)).strip() for _ in range(1500)]
    rows = [(1, 2 * k + j, x + "?" * j, 0.5) for k, x in enumerate(lines) for j in range(2)]
    df = N.merged_lines(spark.createDataFrame(rows, "page int, line_id int, line string, confidence double"))
    began = time.time()
    assert sorted(r["line"] for r in df.collect()) == sorted(lines) and time.time() - began < 60
    assert N._alike("abcd", "abcd?") == 8 / 9 and N._alike("abcx", "abyx") == 0.75


def test_f6_draws_are_those_of_randrange():
    for n, seed in ((2, 0), (7, 3), (64, 0), (1000, 1)):
        pick = random.Random(seed).randrange
        got = np.concatenate(list(E._drawn(n, 50, seed)))
        assert got.tolist() == [[pick(n) for _ in range(n)] for _ in range(50)]
    # of a large group, a few resamples at a time
    parts = [p.size for p in E._drawn(300_000, 20, 0)]
    assert sum(parts) == 6_000_000 and max(parts) <= E.DRAWS


def test_f7_seam_bands_name_each_part_once(spark):
    page = spark.createDataFrame([(900 + k, 1000 + k) for k in range(500)], "w int, h int")
    df = page.select(Y.seam_bands(Y.grid(2, 2, F.col("w"), F.col("h")), F.col("w"), F.col("h")).alias("b"))
    assert nodes(df) < 200_000
    assert all(r["b"][0]["x1"] == 0 and r["b"][-1]["y2"] == 1000 + k for k, r in enumerate(df.collect()))


def test_f8_scores_of_parts_beyond_a_million(spark, tmp_path):
    row = lambda line, part: (6, line, part, 4, 10, 0.05, 0.02, "A")
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int, l_discount double, l_tax double, l_returnflag string"
    d = tables(spark, tmp_path, lineitem=spark.createDataFrame([row(1, 7), row(1, 1_200_007)], kinds))
    first, second = (r["score"] for r in QUERIES["candidate_scores"](spark, d).collect())
    assert first == second


def test_f9_texts_without_consonants_have_no_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aei 12"), (2, ""), (3, "strengths"), (4, None), (3, "a")], "doc_id long, text string")
    assert sorted(map(tuple, QUERIES["consonant_runs"](spark, tables(spark, tmp_path, documents=docs)).collect())) == [(3, 5)]


def test_f10_means_on_a_limit_are_exact(spark):
    assert [W.token_quality(w) for w in ("maison", "ab", "bcd", "bcd12", "b1")] == [95, 60, 45, 20, 0]
    # 0.95 and 0.20 as 7 to 8 have a mean of 0.55, 0.45 and 0.20 as 3 to 2 one of 0.35; sums of doubles miss them for some numbers
    texts = [" ".join(["maison"] * 7 * k + ["bcd12"] * 8 * k) for k in range(1, 40)] + [" ".join(["bcd12"] * 2 * k + ["bcd"] * 3 * k) for k in range(1, 40)]
    got = [r["token_quality"] for r in Q.text_quality(docs_of(spark, [*texts, "", None])).orderBy("doc_id").collect()]
    assert got == [0.55] * 39 + [0.35] * 39 + [0.0] * 2


def test_f11_bm25_held_equals_joined(spark):
    rng = random.Random(4)
    words = ["roi", "l'évesque", "ae", "x", "maison", "œuvre", "the-\nre", "Iohannes", "wi"]
    texts = docs_of(spark, [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + ["roi roi"] * 20 + [None, ""]).repartition(3)
    asked = spark.createDataFrame([(1, "roi maison"), (1, "roi"), (2, "œuvre there"), (3, "zzzz"), (4, None)], "q int, text string")
    for terms in (T.search_terms, T.word_terms):
        held = R.bm25(texts, asked, ["doc_id"], "q", terms, 7)
        joined = R._bm25_joined(texts, asked.filter("text <> 'roi' or text is null"), ["doc_id"], "q", terms, 7)
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.select(held.columns).collect()))
        assert "Generate" not in held._jdf.queryExecution().executedPlan().toString()


def test_f12_forced_marks_by_hand(spark):
    docs = docs_of(spark, ["nbcdfgh xqxq a\n kkk the", "house river", "nbcdfgh ?", None, "#### ####"])
    got = [(r["forced"], r["marked"]) for r in S.forced_marks(S.metrics(docs)).orderBy("doc_id").collect()]
    assert got == [(1, "nbcdfgh? xqxq a\n kkk the"), (0, "house river"), (0, "nbcdfgh ?"), (0, None), (1, "#### #### [?]")]
    assert "lambda" not in S.forced_marks(S.metrics(docs))._jdf.queryExecution().executedPlan().toString()


def test_f13_fused_rankings_come_from_held_terms(spark):
    docs, asked = docs_of(spark, ["roi", "roi maison", "maison"]), spark.createDataFrame([(1, "roi")], "q int, text string")
    df = R.reciprocal_rank_fusion([R.bm25(docs, asked, ["doc_id"], "q", t, 50) for t in (T.search_terms, T.word_terms)], "q", ["doc_id"])
    assert [(r["doc_id"], r["rank"], r["score"]) for r in df.orderBy("rank").collect()] == [(0, 1, round(2 / 61, 9)), (1, 2, round(2 / 62, 9))]
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_f14_spans_stand_where_they_say(spark):
    texts = ["l'Évesque—vint à\nParis […] 12 x-y", "𝔄 été 𝔄 Ῥóδoς", "", None]
    found = M.token_spans(docs_of(spark, texts))
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["surface"] for r in found.collect()) and found.filter("doc_id = 0").count() == 5
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_f15_contrasts_equal_plain_shuffles_many_times_faster():
    rng = random.Random(1)
    texts = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 14))) for _ in range(rng.randint(20, 400))] for _ in range(40)]
    texts += [["aaa"], [], ["abcdefghijklmnopqrstuvwxyzabcd"] * 30, ["dominus"] * 6000]

    def plain(tokens):
        counted = lambda ts: [sum(t[i : i + 3] in p for t in ts for i in range(len(t) - 2)) for p in map(frozenset, X.PROFILES.values())]
        n, found = sum(len(t) - 2 for t in tokens), [[0] * 4, 0]
        if n < 150:
            return None
        for seed in range(8):
            draw = random.Random(seed)
            mixed = []
            for t in tokens:
                letters = list(t)
                draw.shuffle(letters)
                mixed.append("".join(letters))
            found = [[a + b for a, b in zip(found[0], counted(mixed), strict=True)], found[1] + n]
        return [round((r + 4.0) / (n * c / found[1] + 4.0), 4) for r, c in zip(counted(tokens), found[0], strict=True)]

    X.contrasts_of(texts[:1])
    assert X.contrasts_of(texts) == [plain(t) for t in texts]
    # a text of its words takes a fraction of the time of its shuffles one by one
    assert seconds(lambda: X.contrasts_of(texts[:40])) < seconds(lambda: [X._plain_shuffles(t, s) for t in texts[:40] for s in range(8)])


def test_f16_baselines_name_each_part_once(spark):
    box = spark.createDataFrame([(0.0, 0.0, 60.0, 10.0)], "a double, b double, c double, d double")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    df = box.select(Y.baseline(Y.closed(F.array(p("a", "b"), p("c", "b"), p("c", "d"), p("a", "d"))), F.lit(120), F.lit(90)).alias("l"))
    assert [(q["x"], round(q["y"], 6)) for q in df.first()["l"]] == [(10.0 * k, 7.8) for k in range(7)]
    assert nodes(df) < 20_000


def test_f17_gates_of_a_report_run_in_one_function(spark):
    plan = Q.gates(Q.report(docs_of(spark, ODD)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "regexp_extract_all" not in plan


def test_f18_words_alone_rank_without_rows_for_terms(spark):
    df, notes = R.retrieve(spark.createDataFrame([(7, "maison roi")], "q int, text string"), docs_of(spark, ["roi", "maison du roi", "le"]), None, None, "q", "doc_id")
    assert [(r["doc_id"], r["rank"]) for r in df.orderBy("rank").collect()] == [(1, 1), (0, 2)] and notes == ["dense ranking unavailable"]
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_f19_label_of_odd_texts(spark):
    got = [r["quality_label"] for r in Q.report(docs_of(spark, ODD)).orderBy("doc_id").collect()]
    assert got[0] == got[7] == got[8] == "UNRELIABLE" and got[1] == "RISKY"
    assert "transform" not in Q.report(docs_of(spark, ODD))._jdf.queryExecution().executedPlan().toString()


def test_f20_non_wordlike_share_without_lambdas(spark):
    docs = docs_of(spark, ODD)
    long = F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 3)
    plain = T.once(long, lambda ts: T.share(F.size(F.filter(ts, lambda t: T.non_wordlike_score(t) > 0.45)), F.size(ts)))
    both = docs.select(Q.non_wordlike_frac(F.col("text")).alias("a"), plain.alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())
    assert "lambda" not in docs.select(Q.non_wordlike_frac(F.col("text")))._jdf.queryExecution().executedPlan().toString()


def test_f21_caps_measure_a_text_once(spark):
    docs = docs_of(spark, ["bcd fgh the", "house river", None, "### 123 a?b"])
    df = docs.select(S.junk_ratio(F.col("text")).alias("j"), S.capped_confidence(F.lit(0.9), F.col("text")).alias("c"))
    assert [(round(r["j"], 3), r["c"]) for r in df.collect()] == [(0.667, 0.75), (0.0, 0.9), (0.0, 0.9), (1.0, 0.75)]
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()


def test_f22_fits_look_up_each_word(spark):
    text = "dominus et sanctus pater Æterna aoe-\nlan"
    grams = [w[i : i + 3] for w in W.key_words(text) for i in range(len(w) - 2)]
    assert W.key_words(text) == ["dominus", "sanctus", "pater", "eterna", "aelan"]
    got = docs_of(spark, [text, None]).select(X.fits(F.col("text")).alias("f"))
    for name, trigrams in X.PROFILES.items():
        assert abs(got.first()["f"][name] - min(1.0, sum(g in trigrams for g in grams) / len(grams) / 0.55)) < 1e-12
    assert "regexp" not in got._jdf.queryExecution().executedPlan().toString()


def test_f23_inferred_grids_name_each_part_once(spark):
    df = spark.createDataFrame([(400, 600), (90, 90)], "w int, h int").select(Y.inferred_grid(Y.grid(3, 2, F.col("w"), F.col("h"))).alias("g"))
    assert [r["g"] for r in df.collect()] == ["3x2", "1x1"] and nodes(df) < 20_000


def test_f24_only_what_may_be_among_the_best_goes_on(spark):
    docs = docs_of(spark, [("roi " * (1 + k % 50) if k % 50 > 24 else "le ") + "x" for k in range(4000)])
    df = R.bm25(docs, spark.createDataFrame([(1, "roi")], "q int, text string"), ["doc_id"], "q", T.word_terms, 5)
    assert [r["doc_id"] for r in df.orderBy("rank").collect()] == [49, 99, 149, 199, 249]
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_f25_gibberish_takes_one_pass_of_a_text(spark, tmp_path):
    d = tables(spark, tmp_path, documents=docs_of(spark, ["bcdfghk qxzx jqxz " * 40, "the house by the river"]))
    df = QUERIES["gibberish_no_language"](spark, d)
    got = {r["doc_id"]: r["gibberish_score"] for r in df.collect()}
    assert got[0] > 0.6 and got[1] < 0.05
    assert "regexp_extract_all" not in df._jdf.queryExecution().executedPlan().toString()


def test_f26_suspicious_tokens_are_counted_in_their_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "xq xq 12a MCD"), (1, "xq"), (2, None)], "doc_id long, text string")
    df = QUERIES["suspicious_tokens"](spark, tables(spark, tmp_path, documents=docs))
    assert sorted(map(tuple, df.collect())) == [(1, "12a", True, 1), (1, "MCD", False, 1), (1, "xq", False, 3)]
    assert "rlike" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_f27_region_quality_without_lambdas_over_tokens(spark, tmp_path):
    d = tables(spark, tmp_path, documents=docs_of(spark, ODD))
    df = QUERIES["region_quality"](spark, d)
    got = {r["doc_id"]: r["quality"] for r in df.collect()}
    assert got[0] == got[8] == 0.0 and abs(got[2] - round(0.2 * 0.2 + 0.45 * max(X._fit_of(ODD[2])) + 0.35, 4)) < 1e-9
    assert "regexp_extract_all" not in df._jdf.queryExecution().executedPlan().toString()


def test_f28_tile_boxes_name_each_part_once(spark):
    df = spark.createDataFrame([(1300, 1000), (100, 100)], "w int, h int").select(Y.tile_boxes(Y.box(F.lit(0), F.lit(0), F.col("w"), F.col("h")), F.col("w"), F.col("h")).alias("t"))
    many, one = (r["t"] for r in df.collect())
    assert len(many) == 11 and many[0]["x2"] == 1300 and many[1]["x2"] == 715 and many[2]["x1"] == 585 and len(one) == 1
    assert nodes(df) < 30_000


def test_f29_masked_lines_by_hand(spark):
    df = docs_of(spark, ["nbcdfgh the\nthe house of kkk a\n\nMCD", None]).select(S.masked_lines(F.col("text")).alias("m"))
    assert [r["m"] for r in df.collect()] == ["[…]\nthe house of kkk a\n\nMCD", ""]
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_f30_search_keys_by_table_equal_folding(spark):
    texts = [t for t in ODD if t is not None and "iii" not in t]
    got = docs_of(spark, texts).select(X.search_key(F.col("text")).alias("a"), T.folded(X.expanded(F.col("text"))).alias("b"))
    assert all(r["a"] == r["b"] for r in got.collect())
    assert "regexp_replace" not in docs_of(spark, texts).select(X.search_key(F.col("text")))._jdf.queryExecution().executedPlan().toString()
