"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 meet in the variants between them. Emitting all 64-bit variants within one and two bits
of every fingerprint would write 2081 rows for each, so the ball is split first: of the four 16-bit blocks at least one
holds a differing bit, and outside it at most two bits differ. For each block left out, every fingerprint emits the
variants of the other 48 bits within half of that, one bit: 49 variants, 196 in all. Any two fingerprints within 3 bits
share a variant. Rows are shuffled on variants; colliding fingerprints are verified on all 64 bits and linked by a
spanning forest of their links, not by all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import connected
from quire.llm.shared import fresh, written

RADIUS = 3
SHINGLE = 3
BLOCKS = 4
WIDTH = 64 // BLOCKS


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of every run of `shingle` words of a text, in order; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], "<u8")
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends]
    return np.array([xxh64_intdigest(joined[a:e], 42) for a, e in zip(starts, ends[shingle - 1 :], strict=False)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingles(text, shingle)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as a bigint of the same bits: words of lower-cased A-Z between ASCII white space, runs of
    `shingle` words hashed by XXH64 with seed 42, and each bit that more than half of the hashes have. A text of fewer
    words is one shingle, a text without words (null included) has fingerprint 0."""

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in x], np.uint64).view(np.int64))

    prints.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(prints, "long")(text)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch["print"].to_numpy().view(np.uint64)
        for at in range(0, len(every), 500):
            own, keys = every[at : at + 500], []
            for block in range(BLOCKS):
                left = [i for i in range(64) if i // WIDTH != block]
                flips = np.array([0, *(1 << i for i in left)], np.uint64)
                out = ~np.uint64(((1 << WIDTH) - 1) << (block * WIDTH))
                keys.append((own & out)[:, None] ^ flips)
            keys = np.concatenate(keys, axis=1)
            # one to one within a block, and apart from the other blocks' variants but for chance, which verifying takes out
            mixed = keys * np.uint64(0x9E3779B97F4A7C15) + np.repeat(np.arange(BLOCKS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), 65 - WIDTH)
            mixed ^= mixed >> np.uint64(32)
            columns = [pa.array(mixed.reshape(-1).view(np.int64)), pa.array(np.repeat(own, keys.shape[1]).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["variant", "print"])


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints (uint64): each one found is compared with those not
    found yet, so that a group of close ones takes one pass, and n passes at most are made."""
    rest, links = prints, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                links += [(at, x) for x in found]
                front += list(found)
                rest = rest[~near]
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the fingerprints of each run of equal variants; the rows of a task are sorted by variant."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        x, y = value[two].view(np.uint64), value[two + 1].view(np.uint64)
        near = (x != y) & (np.bitwise_count(x ^ y) <= RADIUS)
        a.append(x[near])
        b.append(y[near])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = forest(np.unique(value[s : s + n].view(np.uint64)))
            if found:
                pair = np.array(found, np.uint64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([held[0], batch["variant"].to_numpy()])
        value = np.concatenate([held[1], batch["print"].to_numpy()])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last run may go on
        held = key[cut:], value[cut:]
        if cut:
            yield links(key[:cut], value[:cut])
    if len(held[0]):
        yield links(*held)


def print_links(prints: DataFrame) -> DataFrame:
    """a, b: links within RADIUS bits that connect what is connected among the distinct fingerprints of column print.

    Repeats of a fingerprint and a null one count as one and as none; other columns aren't read. Empty table: no rows. A
    variant's run holds at most 49 * 2^16 fingerprints, those that differ in the block left out and in one other bit."""
    variants = prints.select("print").dropna().distinct().mapInArrow(_variants, "variant long, print long")
    met = variants.repartition(F.col("variant")).sortWithinPartitions("variant")
    return met.mapInArrow(_verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs: the smallest doc_id that links reach.

    docs has doc_id and text; other columns are not read. Copies share a fingerprint, so they are one node of the search.
    Null text and texts without words have fingerprint 0 and link like any other; rows without doc_id are fingerprinted
    and linked, but name no component (one of such rows alone: null). Empty table: no rows."""
    held = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash(F.col("text"), shingle).alias("print")), "simhash")
    prints = held.groupBy("print").agg(F.min("doc_id").alias("first"))
    links = written(print_links(prints), "simhash-links")
    roots = connected(links)
    # a component's smallest doc_id
    classes = prints.join(roots, prints["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("class"), "first")
    firsts = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = classes.join(firsts, "class").select("print", "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return held.join(named, "print").select("doc_id", hexed, "component_id")


def first_rows(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of named (doc_id, component_id), one if it repeats, and those
    without doc_id. Columns as in docs."""
    kept = named.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    one, again = fresh(docs, "_kept"), fresh(docs, "_again")
    rows = docs.join(kept.withColumnRenamed("_kept", one), F.col("doc_id") == F.col(one), "left_semi")
    rows = rows.withColumn(again, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).filter(F.col(again) == 1).drop(again)
    return rows.unionAll(docs.filter(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id, one if it repeats.
    Rows without doc_id can't be told apart and stay. Columns as in docs."""
    return first_rows(docs, near_duplicates(docs, shingle))
