"""Near copies by the Jaccard of their sets of word shingles, found by SimHash with ball hashing.

At a Jaccard of 0.8 SimHashes differ in about 0.15 of their bits, some 10 of 64, which op2's balls don't reach. So a set
gets a longer SimHash, of BLOCKS blocks of 24 bits, and a ball in each: as in op2 balls meet in the middle, a block has
variants within one bit, and two that differ in at most two bits share a variant. Such blocks also have one of their
three bytes in common, so a block is dealt by each of its bytes, in 3 rows, and the variants of the other 16 bits are made
where they meet. Of what shares a variant TRAVEL * 8 further bits of the SimHash are compared. A pair at 0.8 is found with
a computed probability of 0.99999 or more (0.15 of differing bits: 0.9999994; 0.161, the most of sets of 6 shingles or
more: 0.99999; sets of 4 and 5 shingles, which differ in 0.1875, have twice the blocks: 0.99999).

Sets that meet, directly or by others, are a group; a set is in one group at most. ROUND blocks are met at a time, and
what the first round puts in a group counts as one afterwards, so that groups don't meet again in every block.

Every link is verified on the whole shingle sets. Sets that meet are first compared with the smallest ones they meet;
what that leaves in different components is then compared inside its group, where no pair of components goes uncompared
but those that the SimHashes rule out, and only links are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected, local_roots
from quire.llm.shared import shuffle_partitions, written
from quire.llm.simhash import first_rows, shingles
from quire.llm.spotsigs import likeness

THRESHOLD = 0.8
SHINGLE = 5
BLOCKS = 44  # of 3 bytes
CHECK = 28  # bytes besides
TRAVEL = 24  # of those, what travels with a block
PRINT = 3 * BLOCKS + CHECK  # bytes of a SimHash
TINY = 5  # sets of so many shingles or fewer have BLOCKS more blocks, after PRINT
ROUND = 11  # blocks that are shuffled at once
#: Differing bits of TRAVEL up to which two sets that share a variant meet: in the blocks of all sets, and in those of tiny ones.
NEAR, NEAR_TINY = 58, 66
#: Differing bits of PRINT up to which a pair is compared: 0.1875 of them are expected at most at the threshold, 5 deviations more are allowed.
FAR = int(8 * PRINT * 0.1875 + 5 * (8 * PRINT * 0.1875 * 0.8125) ** 0.5)
STEP = 255  # shingles hashed at once; their votes fit a byte
FEW = 64  # rows of a variant that are compared by pairs; more are compared by a spanning forest
LEADERS = 8  # smallest sets met that a set is verified with before groups are
FAN = 64  # pairs of one set that a task verifies
VARIANTS = 1 << 22  # made at once
_FLIPS = np.array([0, *(1 << i for i in range(16))], np.uint64)
_PIECES = "key long, node long, check0 long, check1 long, check2 long"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: of words as in simhash; none of a text without words."""
    return np.unique(shingles(text, shingle))


def node_of(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 42)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of what the shingles' hashes expand to. PRINT bytes,
    3 * BLOCKS more of tiny sets, none of the empty set."""
    if not len(hashes):
        return b""
    size = PRINT + 3 * BLOCKS * (len(hashes) <= TINY)
    add = np.arange(1, -(-size // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * len(add), np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(_mixed(hashes[at : at + STEP, None] + add).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").tobytes()[:size]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints = [], []
        for text in batch["text"]:
            hashes = shingle_set(text.as_py())
            nodes.append(node_of(hashes))
            prints.append(fingerprint(hashes))
        columns = [batch["doc_id"], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "print"])


def _pieces(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks from `first` on, ROUND of them, by each of their bytes: key has the block, which byte, the byte and in its
    lowest 16 bits the other two. Rows are in the order of the blocks, not of the sets."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = range(first, min(first + ROUND, BLOCKS))
        for batch in batches:
            node, every = batch["node"].to_numpy(), batch["print"].to_pylist()
            sizes = np.array([len(p) for p in every])
            for size, of in ((PRINT, blocks), (PRINT + 3 * BLOCKS, [*blocks, *(b + BLOCKS for b in blocks)])):
                own = np.flatnonzero(sizes == size)
                if not len(own):
                    continue
                prints = np.frombuffer(b"".join(every[i] for i in own), np.uint8).reshape(-1, size)
                check = np.tile(prints[:, PRINT - CHECK :][:, :TRAVEL].copy().view("<i8"), (3, 1))
                for b in of:
                    x = prints[:, 3 * b + CHECK * (b >= BLOCKS) :][:, :3].astype(np.int64)
                    keys = [3 * b + k << 24 | x[:, k] << 16 | x[:, (k + 1) % 3] << 8 | x[:, (k + 2) % 3] for k in range(3)]
                    columns = [np.concatenate(keys), np.tile(node[own], 3), *check.T.copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "check0", "check1", "check2"])

    return pieces


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            sets = [shingle_set(t.as_py()) for t in batch["text"][at : at + 200]]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])


def _runs(batches: Iterator[pa.RecordBatch], shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of whole runs of equal keys, without their lowest `shift` bits; the rows of a task are sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy() >> shift
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or (held and held[-1]["key"][0].as_py() >> shift != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _variants(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The variants that several rows share, and those rows: of the rows that have a byte of a block in common (key, sorted)
    the variants of the other 16 bits within one bit. About VARIANTS are held at once."""
    other, shift = key & np.uint64(0xFFFF), np.uint64(len(key).bit_length())
    group = np.cumsum(np.append(False, key[1:] >> np.uint64(16) != key[:-1] >> np.uint64(16))).astype(np.uint64) << np.uint64(16)
    parts = np.uint64(-(-len(key) * len(_FLIPS) // VARIANTS))
    for part in range(int(parts)):
        made = []
        for flip in _FLIPS:
            variant = other ^ flip
            rows = np.flatnonzero(variant * parts >> np.uint64(16) == part)
            made.append((group[rows] | variant[rows]) << shift | rows.astype(np.uint64))
        made = np.sort(np.concatenate(made))
        run = made >> shift
        same = run[1:] == run[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        yield run[shared], (made[shared] & (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b from the smallest to each of the nodes that the variants and checks of a batch connect."""
    for batch in _runs(batches, 16):
        key, node = batch["key"].to_numpy().view(np.uint64), batch["node"].to_numpy()
        check = np.stack([batch[f"check{i}"].to_numpy() for i in range(TRAVEL // 8)], 1).view(np.uint64)
        bound, a, b = np.where(key >> np.uint64(24) < 3 * BLOCKS, NEAR, NEAR_TINY), [], []
        for run, row in _variants(key):
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(run)))
            ends = np.repeat(starts + sizes, sizes)
            i = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
            for s in range(1, FEW):
                i = i[i + s < ends[i]]
                if not len(i):
                    break
                x, y = row[i], row[i + s]
                near = (node[x] != node[y]) & (np.bitwise_count(check[x] ^ check[y]).sum(1) <= bound[x])
                a.append(node[x[near]])
                b.append(node[y[near]])
            for begin, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                rest = row[begin : begin + n]
                while len(rest) > 1:
                    front, rest = [rest[0]], rest[1:]
                    while front and len(rest):
                        at = front.pop()
                        near = (node[rest] == node[at]) | (np.bitwise_count(check[rest] ^ check[at]).sum(1) <= bound[at])
                        a.append(np.full(near.sum(), node[at]))
                        b.append(node[rest[near]])
                        front += rest[near].tolist()
                        rest = rest[~near]
        if not sum(map(len, a)):
            continue
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        linked = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(roots[linked]), pa.array(nodes[linked])], names=["a", "b"])


def _bits(prints: pa.Array) -> np.ndarray:
    """The first PRINT bytes of SimHashes, as rows of words."""
    return np.frombuffer(b"".join(p[:PRINT] for p in prints.to_pylist()), np.uint64).reshape(-1, PRINT // 8)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = np.bitwise_count(_bits(batch["print_a"]) ^ _bits(batch["print_b"])).sum(1)
        yield batch.select(["a", "b"]).filter(pa.array(far <= FAR))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that look alike by their SimHashes to a row of another component in their group."""
    for batch in _runs(batches):
        key, root = batch["key"].to_numpy(), batch["root"].to_numpy()
        prints = _bits(batch["print"])
        found = np.zeros(len(key), bool)
        for order, rest in _groups(key, root):
            p, r = prints[order], root[order]
            for i in range(rest):
                alike = i + 1 + np.flatnonzero((r[i + 1 :] != r[i]) & (np.bitwise_count(p[i + 1 :] ^ p[i]).sum(1) <= FAR))
                found[order[alike]] = True
                found[order[i]] |= len(alike) > 0
        yield batch.select(["key", "node", "root"]).filter(pa.array(found))


def _groups(key: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Of each group with several components its rows with the largest component last, and how many come before: only those
    need to be met with what follows."""
    begin = 0
    for end in np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist():
        _, of, sizes = np.unique(root[begin:end], return_inverse=True, return_counts=True)
        if len(sizes) > 1:
            yield begin + np.argsort(of == sizes.argmax(), kind="stable"), end - begin - int(sizes.max())
        begin = end


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of THRESHOLD or more that connect what such links connect between the components of a group: every pair of
    sets of components that aren't connected yet is compared in whole."""
    for batch in _runs(batches):
        key, node, root = (batch[c].to_numpy() for c in ("key", "node", "root"))
        for order, rest in _groups(key, root):
            n, r = node[order], root[order].copy()
            sets = batch["s"].take(pa.array(order))
            sizes, of = np.diff(sets.offsets.to_numpy()), np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
            starts, held = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(int(of.max()) + 1, bool)
            for i in range(rest):
                if (r[i + 1 :] == r[i]).all():
                    continue
                held[of[starts[i] : starts[i + 1]]] = True
                both = np.add.reduceat(held[of[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
                held[of[starts[i] : starts[i + 1]]] = False
                near = i + 1 + np.flatnonzero(both / (sizes[i] + sizes[i + 1 :] - both) >= THRESHOLD)
                links = []
                for j in near.tolist():
                    if r[j] != r[i]:
                        links.append(j)
                        r[r == r[j]] = r[i]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), n[i])), pa.array(n[links])], names=["a", "b"])


def _sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, s, n: the shingle sets of the nodes asked for, made again from the texts, and their sizes."""
    asked = written(asked.distinct().join(nodes.select("node", "first"), "node"), "near-asked")
    ids = asked.filter("first is not null").select(F.col("first").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(ids, "doc_id", "left_semi").unionAll(rows.filter("doc_id is null")).select("text")
    sets = texts.mapInArrow(_sets, "node long, s array<long>").join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return written(sets.withColumn("n", F.size("s")), "near-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard of THRESHOLD or more."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    # a set that many meet is dealt out with them
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    x = sets.withColumnsRenamed({"node": "a", "s": "s_a", "n": "n_a"}).join(many, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    y = sets.withColumnsRenamed({"node": "b", "s": "s_b", "n": "n_b"})
    met = dealt.select("a", "b", "part").join(y, "b").join(x, ["a", "part"])
    met = met.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * THRESHOLD)
    return written(met.filter(likeness(F.col("s_a"), F.col("s_b")) >= THRESHOLD).select("a", "b"), "near-links")


def met(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and key of every node: key is the smallest node that its SimHash meets, directly or by others. And a, b: the
    meetings that make this so.

    nodes has node and print (as of fingerprint); a node occurs once. Blocks are shuffled ROUND at a time, so that their files
    never are more than that; what has met in the first round is one node in those that follow. Empty table: no rows."""

    def round_of(first: int, named: DataFrame) -> DataFrame:
        pieces = named.select(F.col("key").alias("node"), "print").mapInArrow(_pieces(first), _PIECES)
        runs = pieces.repartition(F.shiftright("key", 16)).sortWithinPartitions("key")
        return written(runs.mapInArrow(_met, "a long, b long").distinct(), "near-met")

    def renamed(keys: DataFrame, links: DataFrame) -> DataFrame:
        roots = connected(links).withColumnRenamed("node", "of")
        return written(keys.join(roots, F.col("key") == F.col("of"), "left").select("node", F.coalesce("root", "key").alias("key")), "near-keys")

    keys = nodes.select("node", F.col("node").alias("key"))
    one = round_of(0, nodes.withColumn("key", F.col("node")))
    keys = renamed(keys, one)
    named = nodes.select("node", "print").join(keys, "node")
    more = reduce(DataFrame.unionAll, [round_of(first, named) for first in range(ROUND, BLOCKS, ROUND)])
    return renamed(keys, more), one.unionAll(more)


def groups(keys: DataFrame) -> DataFrame:
    """The rows (key, node) of keys whose key another node has too."""
    return keys.join(keys.filter("node != key").select("key").distinct(), "key", "left_semi").select("key", "node")


def meetings(nodes: DataFrame) -> DataFrame:
    """key and node: the groups (key) of sets whose SimHashes meet, of two nodes or more each; a node is in one at most."""
    return groups(met(nodes)[0])


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row of docs; texts link whose sets of
    SHINGLE-word shingles have a Jaccard of THRESHOLD or more.

    docs has doc_id and text; other columns are not read. Equal sets are one node, named by a 64-bit hash; texts without
    words (null included) have equal sets. Rows without doc_id link like any other, but name no component. Empty table:
    no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = written(rows.mapInArrow(_prints, "doc_id long, node long, print binary"), "near-prints")
    nodes = held.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("print").alias("print"))
    nodes = written(nodes.repartition(shuffle_partitions(docs.sparkSession), F.col("node")), "near-nodes")
    keys, meet = met(nodes)
    shared = groups(keys)
    stars = meet.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, LEADERS).alias("a"))
    stars = stars.select(F.explode("a").alias("a"), "b")
    for end in ("a", "b"):
        stars = stars.join(nodes.select(F.col("node").alias(end), F.col("print").alias("print_" + end)), end)
    stars = stars.select("a", "b", "print_a", "print_b").mapInArrow(_close, "a long, b long")
    links = _verified(written(stars, "near-pairs"), nodes, docs)
    roots = connected(links)
    rooted = shared.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    rest = rooted.join(split, "key", "left_semi").join(nodes.select("node", "print"), "node").select("key", "node", "root", "print")
    alike = written(rest.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_plausible, "key long, node long, root long"), "near-alike")
    sets = _sets_of(alike.select("node"), nodes, docs).select("node", "s")
    whole = alike.join(sets, "node").select("key", "node", "root", "s").repartition(F.col("key")).sortWithinPartitions("key")
    links = links.unionAll(written(whole.mapInArrow(_joined, "a long, b long").distinct(), "near-links"))
    roots = connected(links)
    classes = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("class"), "first")
    firsts = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    return held.select("doc_id", "node").join(classes.join(firsts, "class").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies, as in simhash.keep_one."""
    return first_rows(docs, near_copies(docs))
