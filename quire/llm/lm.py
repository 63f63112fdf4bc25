"""Language-model scores by a weighted backoff automaton.

Every word of the corpus is a state, and so are the start of a text and the empty context. From a state an arc for each
bigram that training saw leads to the state of its second word and weighs the smoothed log probability; a failure arc
leads to the empty context and weighs the state's backoff. One traversal from left to right carries the state and adds
up weights. Bigrams are smoothed by absolute discounting, interpolated with add-one unigrams.

The automaton of a whole corpus fits no machine, so documents are cut into chunks and each chunk is traversed with the
part of the automaton that its own words can reach. A chunk asks for the counts of its distinct words and bigrams: keys
are 64-bit hashes, range-partitioned, packed by chunk and range, summed over all chunks, and the sums come back in the
order of the keys. How many bigrams begin with a word takes a second, smaller exchange.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import shuffle_partitions, written

CHUNK_BYTES = 9 << 20  # of text; a longer document is a chunk of its own
RANGE_BYTES = 24 << 20  # of text for each range of keys
LANE = 1024  # tokens that a lane of the traversal takes
START, END = 0, 1  # local numbers of the start and of the end of a text
#: Blobs are compressed already, and a row group holds few of them.
STORED = {"compression": "uncompressed", "parquet.block.size": str(16 << 20)}
PACKET = "chunk long, range int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each is cut into planes of equal byte places, which compress."""
    import zstandard

    parts, heads = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        heads.append((x.dtype.str, len(x)))
        parts.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b"")
    head = json.dumps(heads).encode()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(head)) + head + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + struct.unpack_from("<I", raw)[0]
    out = []
    for kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * size
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of words have their lowest bit set, those of bigrams don't."""
    return mixed(hashes) | np.uint64(1)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0xD6E8FEB86659FD93) + mixed(second)) & ~np.uint64(1)


def packets(chunk: int, keys: np.ndarray, values: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """What a chunk asks for: one packet for each range that its sorted keys touch, as differences of keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield chunk, int(of[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0)), values[a:b])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PACKET_ARROW = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("blob", pa.binary())])


class Chunk:
    """Token numbers of some documents, with the hashes of their words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b" ": START, b"\n": END}  # no word holds white space
        self.docs: list[tuple[int | None, bool, int]] = []
        self.ids: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, held_out: bool, text: str | None) -> None:
        words = (text or "").encode().lower().split()
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        ids = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
        self.ids += [ids, np.array([END], np.uint32)]
        self.docs.append((doc_id, held_out, len(ids) + 1))
        self.bytes += len(text or "") + 100

    def packed(self) -> bytes:
        from xxhash import xxh64_intdigest

        hashes = np.fromiter((xxh64_intdigest(w) for w in self.number), np.uint64, len(self.number))
        doc_id = np.array([d if d is not None else 0 for d, _, _ in self.docs], np.int64)
        null = np.array([d is None for d, _, _ in self.docs], np.uint8)
        held = np.array([h for _, h, _ in self.docs], np.uint8)
        return pack(doc_id, null, held, np.array([n for _, _, n in self.docs], np.int64), np.concatenate(self.ids), hashes)


class Grams:
    """The distinct words and bigrams of a packed chunk, in the order of their keys."""

    def __init__(self, blob: bytes) -> None:
        self.doc_id, self.null, self.held, self.lengths, self.ids, self.hashes = unpack(blob)
        self.ends = np.cumsum(self.lengths)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.ends - self.lengths] = START
        train = np.repeat(self.held == 0, self.lengths)
        n = len(self.hashes)
        words = word_keys(self.hashes)
        # pairs are told apart by their own numbers; keys come in only for the distinct ones
        pairs, times = np.unique(before.astype(np.uint64) << np.uint64(32) | self.ids, return_inverse=True)
        self.first, self.second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seen = np.bincount(times[train], minlength=len(pairs))
        often = np.bincount(self.ids[train], minlength=n)
        often[START] = int((self.held == 0).sum())
        keys = np.concatenate([words, pair_keys(self.hashes[self.first], self.hashes[self.second])])
        self.pairs = pairs
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.counts = np.concatenate([often, seen])[self.order].astype(np.uint32)
        self.word_order = np.argsort(words, kind="stable")
        self.word_keys = words[self.word_order]

    def answered(self, answers: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """Sums of words, then of bigrams, and True for each bigram that this chunk stands for; answers: range and blob."""
        got = [unpack(b) for _, b in sorted(answers)]
        sums, mine = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        total, own = np.empty(len(sums), np.int64), np.empty(len(sums), bool)
        total[self.order], own[self.order] = sums, mine.astype(bool)
        n = len(self.hashes)
        return [total[:n], total[n:], own[n:]]


def chunk_rows(chunk_bytes: int):
    """The packed documents of every chunk, under range -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        chunk = Chunk()
        for batch in batches:
            for k in range(len(batch)):
                chunk.add(batch["doc_id"][k].as_py(), batch["held_out"][k].as_py(), batch["text"][k].as_py())
                if chunk.bytes >= chunk_bytes:
                    yield batch_of([(number, -1, chunk.packed())], PACKET_ARROW)
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield batch_of([(number, -1, chunk.packed())], PACKET_ARROW)

    return rows


def gram_requests(ranges: int):
    """What every chunk asks for: the counts of its words and bigrams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"], strict=True):
                grams = Grams(blob.as_py())
                for row in packets(chunk, grams.keys, grams.counts, ranges):
                    yield batch_of([row], PACKET_ARROW)

    return ask


SUMMED = PACKET + ", n_tokens long, n_words long, once long, twice long"
SUMMED_ARROW = pa.schema([*PACKET_ARROW, *((x, pa.int64()) for x in ("n_tokens", "n_words", "once", "twice"))])


def summed(start_key: int):
    """The sums of a range's keys, sent back to each chunk in its own order; of the chunks that counted a key, the first
    is told so. A range's totals stand in its first row."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        asked = [unpack(b) for b in table["blob"].to_pylist()]
        keys = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
        values = np.concatenate([a[1].astype(np.int64) for a in asked])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(begins) - 1
        sums = np.add.reduceat(values[order], np.flatnonzero(begins))
        counted = np.flatnonzero(values[order] > 0)
        mine = np.zeros(len(keys), np.uint8)
        mine[order[counted[np.unique(group[counted], return_index=True)[1]]]] = 1
        total = np.empty(len(keys), np.int64)
        total[order] = sums[group]
        distinct = ranked[begins]
        word = (distinct & np.uint64(1)) == 1
        real = word & (distinct != np.uint64(start_key))
        facts = [int(sums[real].sum()), int((sums[real] > 0).sum()), int((sums[~word] == 1).sum()), int((sums[~word] == 2).sum())]
        rows, at = [], 0
        for chunk, number, a in zip(table["chunk"].to_pylist(), table["range"].to_pylist(), asked, strict=True):
            to = at + len(a[0])
            rows.append((chunk, number, pack(total[at:to].astype(np.uint64), mine[at:to]), *(facts if at == 0 else [0] * 4)))
            at = to
        return pa.Table.from_batches([batch_of(rows, SUMMED_ARROW)])

    return answer


def branch_requests(ranges: int):
    """From a chunk's documents and answers: how many bigrams begin with each word, as far as the chunk stands for them."""

    def ask(table: pa.Table) -> pa.Table:
        grams, answers = _read(table)
        _, _, own = grams.answered(answers[0])
        branches = np.bincount(grams.first[own], minlength=len(grams.hashes))[grams.word_order].astype(np.uint32)
        rows = list(packets(table["chunk"][0].as_py(), grams.word_keys, branches, ranges))
        return pa.Table.from_batches([batch_of(rows, PACKET_ARROW)])

    return ask


def _read(table: pa.Table) -> tuple[Grams, list[list[tuple[int, bytes]]]]:
    """A chunk's documents, and the answers to its first and second requests."""
    rows = list(zip(table["kind"].to_pylist(), table["range"].to_pylist(), table["blob"].to_pylist(), strict=True))
    grams = Grams(next(b for k, _, b in rows if k == 0))
    return grams, [[(r, b) for k, r, b in rows if k == kind] for kind in (1, 2)]


class Automaton:
    """States are words by number; one more is the empty context. arcs: sorted state << 32 | word, with weights; unigram:
    weight of each word from the empty context, fail: weight of each state's failure arc, enter: the state after a word."""

    def __init__(self, arcs: np.ndarray, weights: np.ndarray, unigram: np.ndarray, fail: np.ndarray, enter: np.ndarray) -> None:
        self.arcs, self.weights = np.append(arcs, np.uint64(2**64 - 1)), np.append(weights, 0.0)
        self.unigram, self.fail, self.enter = unigram, fail, enter

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word, and the weights of the arcs taken; states without the arc fail to the empty context."""
        at = np.searchsorted(self.arcs, want := state << np.uint64(32) | word)
        weight = np.where(self.arcs[at] == want, self.weights[at], self.fail[state] + self.unigram[word])
        return self.enter[word], weight

    def scores(self, ids: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The sum of weights of each document. Documents run side by side; one longer than a lane goes on in another
        lane, which is entered in the state that the word before it leads to."""
        ends = np.cumsum(lengths)
        pieces = -(-lengths // lane)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (ends - lengths)[doc] + nth * lane
        size = np.minimum(lane, ends[doc] - begin)
        order = np.argsort(-size, kind="stable")
        doc, nth, begin, size = doc[order], nth[order], begin[order], size[order]
        ids = ids.astype(np.uint64)
        state = np.where(nth == 0, np.uint64(START), self.enter[ids[np.maximum(begin - 1, 0)]])
        total = np.zeros(len(doc))
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for i, n in enumerate(live):
            state[:n], weight = self.step(state[:n], ids[begin[:n] + i])
            total[:n] += weight
        return np.bincount(doc, total, len(lengths)) if len(doc) else np.zeros(len(lengths))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(n_tokens: int, n_words: int, discount: float):
    def score(table: pa.Table) -> pa.Table:
        grams, answers = _read(table)
        word, pair, _ = grams.answered(answers[0])
        got = np.concatenate([unpack(b)[0] for _, b in sorted(answers[1])]).astype(np.int64)
        branches = np.empty(len(word), np.int64)
        branches[grams.word_order] = got
        empty = len(word)  # the empty context is the last state
        unigram = (np.where(np.arange(len(word)) == START, 0, word) + 1.0) / (n_tokens + n_words + 1.0)
        is_state = (word > 0) & (np.arange(len(word)) != END)
        share = discount * branches / np.maximum(word, 1)
        known = (pair > 0) & is_state[grams.first]
        a, b = grams.first[known], grams.second[known]
        weights = np.log10((pair[known] - discount) / word[a] + share[a] * unigram[b])
        fail = np.append(np.log10(np.where(is_state, np.maximum(share, 1e-300), 1.0)), 0.0)
        enter = np.where(is_state, np.arange(len(word)), empty).astype(np.uint64)
        if not is_state[START]:
            fail[START] = 0.0
        machine = Automaton(grams.pairs[known], weights, np.log10(unigram), fail, enter)
        starts = grams.ends - grams.lengths
        base = np.add.reduceat(np.log10(unigram)[grams.ids], starts)
        n_known = np.add.reduceat((word[grams.ids] > 0).astype(np.int64), starts)
        columns = [pa.array(grams.doc_id, mask=grams.null.astype(bool)), pa.array(grams.held.astype(bool)), pa.array(grams.lengths), pa.array(n_known), pa.array(np.full(len(starts), n_tokens, np.int64)), pa.array(base), pa.array(machine.scores(grams.ids, grams.lengths))]
        return pa.Table.from_arrays(columns, schema=SCORES_ARROW)

    return score


def log_scores(docs: DataFrame, held_out: Column | None = None, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs: log10 probabilities of its
    whole text under add-one unigrams, and under the bigram automaton, both learnt from the rows not held out.

    docs has doc_id and text; other columns aren't read unless held_out names them (null counts as not held out). Words
    are lower-cased A-Z between ASCII white space; every text has one more token, its end, and null or empty text has
    only that. Rows without doc_id and repeated rows count and are scored like any other. Without training rows every
    probability is that of the only unknown word, 1. Empty table: no rows."""
    from xxhash import xxh64_intdigest

    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(shuffle_partitions(spark), -(-size // range_bytes))
    if size == 0 and rows.isEmpty():
        return spark.createDataFrame([], SCORES)
    start_key = int(word_keys(np.array([xxh64_intdigest(b" ")], np.uint64))[0])
    texts = written(rows.mapInArrow(chunk_rows(chunk_bytes), PACKET), "lm-chunks", **STORED)
    answers = written(texts.mapInArrow(gram_requests(ranges), PACKET).groupBy("range").applyInArrow(summed(start_key), SUMMED), "lm-counts", **STORED)
    n_tokens, n_words, once, twice = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n_tokens", "n_words", "once", "twice")]).first())
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    held_rows = texts.withColumn("kind", F.lit(0)).unionAll(answers.select("chunk", "range", "blob").withColumn("kind", F.lit(1)))
    branches = held_rows.groupBy("chunk").applyInArrow(branch_requests(ranges), PACKET).groupBy("range").applyInArrow(summed(start_key), SUMMED)
    branches = written(branches, "lm-branches", **STORED)
    everything = held_rows.unionAll(branches.select("chunk", "range", "blob").withColumn("kind", F.lit(2)))
    return everything.groupBy("chunk").applyInArrow(scored(n_tokens, n_words, discount), SCORES)
