"""Best-fit packing of documents into sequences, with swap-based local search.

Texts become token ids, are cut only where longer than a sequence, and the pieces are dealt by hash into groups of a
bounded number of pieces. Each group is packed best fit decreasing; then documents move, or are exchanged one for one
or two for one, between underfull sequences wherever that raises the sum of squared fills, until sequences run empty.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import fresh, written

LENGTH = 4096
END_ID = 1
GROUP = 40_000  # pieces packed together: a group loses less than one sequence against packing all together
STEP = 1000  # texts tokenized together
WORDS = 700_000  # distinct words whose ids a worker remembers


class _Learnt(dict):
    """Values that are made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class WordIds:
    """Token ids of texts by a tokenizer that drops white space and whose pretokens don't see each other: the library
    tokenizes each distinct pretoken once, and texts are put together from these. Ids are bytes, four for each,
    little-endian. What is remembered is bounded; a full memory is emptied."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.library.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary shows as they are
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.word = _Learnt(self.of_word)  # between white space
        self.pretoken = _Learnt(self.of_pretoken)

    def whole(self, text: str) -> bytes:
        """The library's own way, for texts with odd strings."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.pretoken[word]
        stem, last = word[:-1], word[-1]
        if last in ".,;:!?" and stem.isalpha():  # as the pattern parts them, too
            return self.pretoken[stem] + self.pretoken[last]
        return b"".join([self.pretoken[p] for p in self.find(word)])

    def of_pretoken(self, p: str) -> bytes:
        if not p.isascii():
            if not p.isprintable():  # controls, and what the library's Unicode may know as something else
                return self.whole(p)
            p = p.encode().decode("latin-1").translate(self.shown)
        elif not p.isprintable():
            return self.whole(p)
        return array("I", [t.id for t in self.model.tokenize(p)]).tobytes()

    def plain(self, text: str) -> bool:
        if not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
            return False  # a sigma whose lower case depends on its place; letters to be composed
        # special strings, and white space to str.split alone
        return not any(c in text for c in (*self.special, "\x1c", "\x1d", "\x1e", "\x1f"))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.word) > WORDS or len(self.pretoken) > WORDS:
            self.word.clear()
            self.pretoken.clear()
        get = self.word.__getitem__
        return [b"".join(map(get, t.lower().split())) if self.plain(t) else self.whole(t) for t in texts]


_ENCODERS: dict[str, WordIds] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document; null text: only the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            encoder = _ENCODERS[path] = WordIds(path)
        end, width = array("I", [end_id]).tobytes(), 4 * length
        for batch in batches:
            rows = []
            for at in range(0, len(batch), STEP):
                step = batch.slice(at, STEP)
                texts = [t or "" for t in step["text"].to_pylist()]
                for doc_id, ids in zip(step["doc_id"].to_pylist(), encoder.ids(texts), strict=True):
                    ids += end
                    for k, x in enumerate(range(0, len(ids), width)):
                        part = ids[x : x + width]
                        rows.append((doc_id, k, x // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of item numbers. The free space of bins is held in a bit set, so that the
    tightest bin is found at once."""
    bins: list[list[int]] = []
    at_free: list[list[int]] = [[] for _ in range(size + 1)]
    free_set = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = at_free[free].pop()
            if not at_free[free]:
                free_set &= ~(1 << free)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(item)
        if free > n:
            at_free[free - n].append(b)
            free_set |= 1 << (free - n)
    return bins


class Bin:
    """Items of a sequence by their length: of equal lengths any will do."""

    def __init__(self, items: list[int], lengths: list[int]) -> None:
        self.of: dict[int, list[int]] = {}
        self.fill = 0
        for i in items:
            self.add(lengths[i], i)

    def add(self, n: int, item: int) -> None:
        self.of.setdefault(n, []).append(item)
        self.fill += n

    def take(self, n: int) -> int:
        item = self.of[n].pop()
        if not self.of[n]:
            del self.of[n]
        self.fill -= n
        return item


def best_exchange(source: Bin, target: Bin, size: int) -> tuple[int, tuple[int, ...], int]:
    """The most tokens that one move, one-for-one or two-for-one exchange takes from source to target, the lengths that
    leave and the one that comes back (0: none). All lengths are tried; distinct ones are few, as they add up to a sequence."""
    room, theirs = size - target.fill, sorted(target.of)
    mine = sorted(source.of, reverse=True)
    best = max(((n, (n,), 0) for n in mine if n <= room), default=(0, (), 0))
    twos = ((a + b, (a, b)) for k, a in enumerate(mine) for b in mine[k:] if a != b or len(source.of[a]) > 1)
    for gives, parts in (*((n, (n,)) for n in mine), *twos):
        if best[0] == room:
            break
        k = bisect.bisect_left(theirs, gives - room)
        if k < len(theirs) and gives - theirs[k] > best[0]:
            best = gives - theirs[k], parts, theirs[k]
    return best


def local_search(bins: list[list[int]], lengths: list[int], size: int, patience: int = 20) -> list[list[int]]:
    """Empty underfull bins: the emptiest gives documents away, by moves, one-for-one and two-for-one exchanges, each of
    which raises the sum of squared fills. Stops at the lower bound, or after `patience` bins in a row that no exchange
    empties."""
    held = [Bin(b, lengths) for b in bins if b]
    least = -(-sum(b.fill for b in held) // size)
    open_ = sorted((b for b in held if b.fill < size), key=lambda b: b.fill)
    alive, failed = len(held), 0
    for source in open_:
        if alive <= least or failed == patience:
            break
        if not source.fill or source.fill == size:
            continue
        moved = True
        while moved and source.fill:
            moved = False
            for target in open_:
                if target is source or not target.fill or target.fill == size:
                    continue
                gain, gives, takes = best_exchange(source, target, size)
                if gain and target.fill + gain > source.fill:  # then the squares grow
                    out = [source.take(n) for n in gives]
                    back = target.take(takes) if takes else None
                    for n, item in zip(gives, out, strict=True):
                        target.add(n, item)
                    if back is not None:
                        source.add(takes, back)
                    moved = True
                    if not source.fill:
                        break
        alive -= not source.fill
        failed = failed + 1 if source.fill else 0
        open_ = [b for b in open_ if b.fill < size]
    return [[i for items in b.of.values() for i in items] for b in held if b.fill]


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset added, or put in place of columns so named; pieces has doc_id, piece and length
    (1 to length), and may have more.

    Pieces are dealt by hash into groups of about `group`, and repeats of one that are more than an eighth of a group to
    several of them; a piece that fills a sequence has it alone. A group's sequence ids begin with its number. Rows without
    doc_id and repeated rows are packed like any other. Empty table: no rows."""
    pieces = pieces.drop("sequence_id", "offset")
    key, of, often = fresh(pieces, "_group"), fresh(pieces, "_salt"), fresh(pieces, "_often")
    n = max(1, -(-pieces.count() // group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    ties = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in pieces.columns]

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows[key].iloc[0])
        rows = rows.sort_values(ties, kind="stable").reset_index(drop=True)
        lengths = rows["length"].astype("int64").tolist()
        bins = local_search(best_fit(lengths, length), lengths, length)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (number << 32) + k, at
                at += lengths[i]
        rows["sequence_id"], rows["offset"] = sequence, offset
        return rows.drop(columns=key)

    same = ["doc_id", "piece", "length"]
    salted, salt = pieces, F.lit(0)
    if n > 1:
        most = max(1, group // 8)
        hot = pieces.groupBy(*same).agg(F.count("*").alias(often)).filter(F.col(often) > most)
        hot = hot.select(*[F.col(c).alias(f"{of}{c}") for c in same], F.ceil(F.col(often) / most).alias(often))
        alike = [F.col(c).eqNullSafe(F.col(f"{of}{c}")) for c in same]
        salted = pieces.join(hot, alike, "left").drop(*[f"{of}{c}" for c in same])
        salt = F.when(F.col(often).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(often)))
    dealt = salted.withColumn(key, F.pmod(F.xxhash64(*same, salt), F.lit(n))).drop(often)
    return dealt.groupBy(key).applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    docs has doc_id and text; other columns are not read. Null text is empty: one piece, the end id. A document is cut
    only if it is longer than a sequence; a very long one gives as many pieces as it needs. Repeated rows are packed
    as often as they stand in docs, and so are rows without doc_id. Empty table: no rows."""
    return pack(written(cut_pieces(docs, path, length, end_id), "pack-pieces"), length)
