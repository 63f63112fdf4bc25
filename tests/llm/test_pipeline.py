"""The corpus pipeline: each stage against brute force on what the stage before kept."""

import collections

import corpus_pipeline
import pytest

from quire.llm import toxicity
from quire.llm.shared import table, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, DATA, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "test-stage")
        out.append(docs)
    return out


def test_stages_keep_columns_and_agree_with_run(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
    assert all(k.columns == kept[0].columns for k in kept[:-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_toxic_documents_go(spark, kept):
    model = toxicity.fit(toxicity.sample(kept[0], table(spark, DATA, "labels")))
    rows = kept[0].select("doc_id", "text").collect()
    scores = model.scores([r["text"] for r in rows])
    assert {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD} == {r["doc_id"] for r in kept[1].collect()}


def test_one_of_each_group_stays(kept):
    """The stage's rule: a Jaccard of 0.8 or more on sets of 5-word shingles."""
    grams = {}
    for r in kept[1].collect():
        words = (r["text"] or "").encode().lower().split()
        grams[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in grams.items():
        for b, y in grams.items():
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {find(i) for i in grams} == {r["doc_id"] for r in kept[2].collect()}


def test_mix_takes_half_as_much_again_at_most(kept):
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    times = collections.Counter(r["doc_id"] for r in kept[3].collect())
    assert max(times.values()) <= 2 and 1.2 * size(kept[2]) < size(kept[3]) <= 1.5 * size(kept[2])
    assert set(times) <= {r["doc_id"] for r in kept[2].collect()}


def test_every_document_is_packed_as_often_as_it_was_taken(kept):
    firsts = collections.Counter(r["doc_id"] for r in kept[4].collect() if r["piece"] == 0)
    assert firsts == collections.Counter(r["doc_id"] for r in kept[3].collect())


def test_near_duplicates_reach_a_jaccard_of_0_8(spark):
    from quire.llm import near_copies

    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (None, "no id at all"), (-3, "no id at all"), (-4, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams, has, both = [], collections.defaultdict(list), collections.Counter()
    for k, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
        for g in grams[-1]:
            both.update((j, k) for j in has[g])
            has[g].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [p for p, n in both.items() if n / (len(grams[p[0]]) + len(grams[p[1]]) - n) >= 0.8]
    bare = [k for k, g in enumerate(grams) if not g]
    for j, k in [*links, *zip(bare, bare[1:])]:
        root[find(j)] = find(k)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    assert sorted(map(tuple, near_copies.near_copies(docs).collect()), key=repr) == sorted(((i, first[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([*first.values(), None], key=repr)


def test_near_duplicates_meet_by_their_simhashes(spark):
    """The stage's candidates: SimHashes as by plain Python, whose balls find every pair made at a Jaccard of 0.8."""
    import numpy as np

    from quire.llm import near_copies

    def bit(h, k):
        x, top = (h + (k // 64 + 1) * 0x9E3779B97F4A7C15) % 2**64, 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ x >> 27) * 0x94D049BB133111EB % top
        return (x ^ x >> 31) >> k % 64 & 1

    rng = np.random.default_rng(7)
    sets, pairs = [], []
    for size in (5, 10, 15, 30, 300):
        for _ in range(60):
            x = rng.integers(0, 2**63, size, np.uint64)
            split = int(rng.integers(0, size // 5 + 1))
            pairs.append((len(sets), len(sets) + 1))
            sets += [np.sort(x[split:]), np.sort(np.append(x[:split], x[size // 5 :]))]
    prints = [near_copies.fingerprint(s) for s in sets]
    for s, p in list(zip(sets, prints, strict=True))[:2] + list(zip(sets, prints, strict=True))[-2:]:
        votes = [2 * sum(bit(int(h), k) for h in s) > len(s) for k in range(8 * len(p))]
        assert votes == np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little").astype(bool).tolist()
    nodes = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(prints)], "node long, print binary")
    groups = collections.defaultdict(set)
    for r in near_copies.meetings(nodes).collect():
        groups[r["node"]].add(r["key"])
    assert all(groups[a] & groups[b] for a, b in pairs)


def test_sets_that_meet_are_one_group(spark, monkeypatch):
    """Groups as by comparing all pairs of SimHashes, with one row for a set, however many blocks it shares."""
    import numpy as np
    import pyarrow as pa

    from quire.llm import near_copies

    rng = np.random.default_rng(11)
    base, other = rng.integers(0, 2**63, 60, np.uint64), rng.integers(0, 2**63, 60, np.uint64)
    sets = [np.append(base[: 60 - k % 6], rng.integers(0, 2**63, k % 6, np.uint64)) for k in range(150)]
    sets += [np.append(other[: 60 - k % 20], rng.integers(0, 2**63, k % 20, np.uint64)) for k in range(40)]
    sets += [rng.integers(0, 2**63, n, np.uint64) for n in (1, 4, 5, 6, 30) for _ in range(20)]
    tiny = rng.integers(0, 2**63, 6, np.uint64)
    sets += [tiny[:4], tiny[:5], tiny]
    prints = [near_copies.fingerprint(np.sort(s)) for s in sets]
    nodes = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(prints)], "node long, print binary")
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = 3 * near_copies.BLOCKS
    for j, p in enumerate(prints):
        for k, q in enumerate(prints[:j]):
            bits = [(x ^ y).bit_count() for x, y in zip(p, q)]
            check = sum(bits[at : at + near_copies.TRAVEL])
            for first, most in ((0, near_copies.NEAR), (at + near_copies.CHECK, near_copies.NEAR_TINY)):
                blocks = bits[first : first + at]
                if check <= most and any(sum(blocks[i : i + 3]) <= 2 for i in range(0, len(blocks), 3)):
                    root[max(find(j), find(k))] = min(find(j), find(k))
    expected = collections.Counter(map(find, range(len(prints))))
    expected = sorted((find(k), k) for k in range(len(prints)) if expected[find(k)] > 1)
    assert len(expected) >= 190
    assert sorted((r["key"], r["node"]) for r in near_copies.meetings(nodes).collect()) == expected
    # in parts, as groups of many rows
    rows = nodes.select("node", "print").toArrow().to_batches()
    task = pa.Table.from_batches(near_copies._pieces(0)(iter(rows))).sort_by("key").combine_chunks().to_batches()
    whole = [b.to_pydict() for b in near_copies._met(iter(task))]
    monkeypatch.setattr(near_copies, "VARIANTS", 1000)
    assert [b.to_pydict() for b in near_copies._met(iter(task))] == whole


def test_the_mix_shuffles_texts_once(spark):
    from quire.llm import mixing

    docs = table(spark, DATA, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(mixing.mixed(docs)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    steps = [s.strip() for s in plan.split("\n\n")]
    shuffles = [s for s in steps if s.split("\n")[0].endswith(") Exchange")]
    assert len(shuffles) > 1 and sum("text#" in s for s in shuffles) == 1
