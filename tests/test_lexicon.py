"""Signs, keys and lexical signals against hand-made answers and plain Python."""

import random

from pyspark.sql import functions as F

from quire.functions import lexicon as X
from quire.operators import quality as Q


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").coalesce(1).select(f(F.col("t"))).collect()]


def test_signs_and_bars(spark):
    assert column(spark, X.expanded, "ꝑt", "cõciẽce", "tẽpus", "tēpus", "España", "⁊", "ꝓ̄", "Nguyễn", None, "") == ["pert", "concience", "tempus", "tempus", "España", "et", "pro̅".replace("̅", "̄"), "Nguyễn", None, ""]
    assert column(spark, lambda t: X.expanded(t, False), "dñs", "cõ") == ["dñs", "co"]


def test_search_keys(spark):
    got = column(spark, X.search_key, "dn̄s", "dominus", "vir", "uir", "Iohannes", "johannes", "Iesus ᾱ dns ht", "oīs", "ꝑ", "ae oe æ aë", "w", None)
    assert got[0] == got[1] == "dominus" and got[2] == got[3] == "uir" and got[4] == got[5] == "iohannes"
    assert got[6].split()[0] == "iesus" and got[6].split()[2:] == ["dominus", "habet"] and got[7:] == ["omnis", "per", "e e e ae", "uu", ""]


def test_rejoined_by_a_lexicon(spark):
    lexicon = ["dominus", "rex", "et"]
    assert column(spark, lambda t: X.rejoined_by(t, lexicon), "domi-\nnus rex", "domi\nnus rex", "rex\net", "a\nb", "", None) == ["dominus rex", "dominus rex", "rex\net", "a\nb", "", ""]


def test_plausibility(spark):
    words = "dominus et sanctus pater in nomine"
    keys = [w for w in "dominus et sanctus pater in nomine".split() if len(w) >= 3]
    trigrams = [w[i : i + 3] for w in keys for i in range(len(w) - 2)]
    want = min(1.0, sum(t in X.PROFILES["latin"] for t in trigrams) / len(trigrams) / 0.55)
    assert abs(column(spark, lambda t: X.lexical_plausibility(t, F.lit("latin")), words)[0] - want) < 1e-9
    assert column(spark, lambda t: X.lexical_plausibility(t, F.lit("greek")), words, "") == [0.5, 0.5]
    assert column(spark, lambda t: X.lexical_plausibility(t, F.lit("latin")), "", None, "a b") == [0.5] * 3


def test_contrast_falls_for_reversed_words(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["dominus", "sanctus", "pater", "nomine", "spiritus", "ecclesia", "confirmamus", "capitulum", "instrumentum", "perpetuo"]) for _ in range(80))
    turned = " ".join(w[::-1] for w in text.split())
    good, bad, short, none = column(spark, lambda t: X.lexical_contrast(X.contrasts(t)), text, turned, "pater", None)
    assert good >= 2.2 > bad and short is None and none is None
    assert column(spark, lambda t: X.reads_as_latin(X.contrasts(t)), text, "pater") == [True, False]
    docs = spark.createDataFrame([(1, text, "latin"), (2, turned, "latin"), (3, None, None), (4, "pater", "greek")], "doc_id int, text string, language string")
    got = {r["doc_id"]: r for r in Q.full_report(docs).collect()}
    assert got[1]["gibberish_score"] < got[2]["gibberish_score"] and got[2]["quality_label"] == "UNRELIABLE" and "token_ner" in got[2]["blocked"]
    assert got[3]["lexical_contrast"] == -1 and got[3]["quality_label"] == "UNRELIABLE" and got[4]["lexical_plausibility"] == 0.5


def test_contrast_equals_plain_counting():
    words = " ".join(random.Random(5).choices(["roy", "pere", "seigneur", "maistre", "ville", "maison"], k=80))
    tokens = words.split()
    grams = lambda ts: [t[i : i + 3] for t in ts for i in range(len(t) - 2)]
    mixed = []
    for seed in range(8):
        rng = random.Random(seed)
        for t in tokens:
            letters = list(t)
            rng.shuffle(letters)
            mixed += grams(["".join(letters)])
    want = []
    for profile in X.PROFILES.values():
        hits = sum(g in profile for g in grams(tokens))
        expected = len(grams(tokens)) * sum(g in profile for g in mixed) / len(mixed)
        want.append(round((hits + 4) / (expected + 4), 4))
    assert X.contrast_of(words) == want
