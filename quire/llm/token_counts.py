"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary compiles to a deterministic transducer over bytes. Its states hold, for every position at
which a token may still be open, the vocabulary-trie node reached from there and the last token of the text before it;
two tokens may stand side by side only if merging their joined bytes gives the same two, and this leaves one last
token for every prefix. Each transition carries the change in the number of tokens emitted. States are compiled when
first reached, and a table that outgrows its bound is dropped and begun anew.

Texts of a batch form one byte stream, cut into chunks of equal length whatever the texts, and all chunks run in
lockstep. A chunk's map from the state in which it is entered to the state in which it is left is a constant if it holds
a pretoken boundary, since a boundary resets the transducer; of other chunks the map is known for the states that they
were run from. A parallel prefix scan composes the maps pairwise, in as many steps as the logarithm of their number, and
gives every chunk its entry state; only the bytes before a chunk's first boundary are then run again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512  # bytes of a chunk
SLICE = 8 << 20  # bytes that run together
MAX_STATES = 180_000  # rows of the compiled table at most; a row takes 5 bytes for each byte value seen
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
_WHITE = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _char_classes() -> np.ndarray:
    """The class of every code point, as the pretokenizer's pattern sees it."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[list(_WHITE)] = BLANK
    out[32] = SPACE
    return out


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


START = ((0, -1, 0),)  # the state at the beginning of a pretoken


class Full(Exception):
    """The compiled table holds as many states as it may."""


class Transducer:
    """Counts tokens of a byte-level BPE; compiled from a tokenizer's JSON file."""

    def __init__(self, path: str, max_states: int = MAX_STATES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        text = lambda t: bytes(to_byte[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: text(t) for t, i in vocab.items()}
        self.id_of_byte = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, b in self.bytes_of.items():
            at = 0
            for x in b:
                to = self.child[at].get(x)
                if to is None:
                    to = self.child[at][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = to
            self.token[at] = i
        self.classes = _char_classes()
        self.max_states = max_states
        self.beside: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget what was compiled; state 0 is the start of a pretoken."""
        self.states: list[tuple[tuple[int, int, int], ...]] = [START]
        self.number = {self.states[0]: 0}
        self.column = np.zeros(256, np.int64)  # 0: a byte not seen yet
        self.columns, self.width = 1, 64
        self.next = np.zeros(1024 * self.width, np.int32)  # 0: not compiled
        self.delta = np.zeros(1024 * self.width, np.int8)

    def merged(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, -1)) + (i,) for i, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[1] < 0:
                break
            a, b = ids[best[2]], ids[best[2] + 1]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, last: int, token: int) -> bool:
        """True if the two tokens stay as they are when their joined bytes are tokenized; last -1: nothing before."""
        known = self.beside.get((last, token))
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            before = self.bytes_of[last] if last >= 0 else b""
            ids = self.merged([self.id_of_byte[x] for x in before + self.bytes_of[token]])
            known = self.beside[last, token] = ids == ([last, token] if last >= 0 else [token])
        return known

    def state_of(self, what: tuple) -> int:
        n = self.number.get(what)
        if n is None:
            if len(self.states) >= self.max_states:
                raise Full
            n = self.number[what] = len(self.states)
            self.states.append(what)
        return n

    def compile(self, state: int, byte: int) -> None:
        kept, found = [], None
        for node, last, count in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.token[to]
            if found is None and token >= 0 and self.may_follow(last, token):
                found = token, count + 1
            if self.child[to]:
                kept.append((to, last, count))
        token, change = found
        new = (*((node, last, count - change) for node, last, count in kept), (0, token, 0))
        n = self.state_of(new)
        if self.column[byte] == 0:
            self.column[byte] = self.columns
            self.columns += 1
        rows = len(self.next) // self.width
        if self.columns > self.width or n >= rows:
            width, more = self.width + 64 * (self.columns > self.width), rows + rows // 2 * (n >= rows)
            for name in ("next", "delta"):
                old = getattr(self, name).reshape(rows, self.width)
                grown = np.zeros((more, width), old.dtype)
                grown[:rows, : self.width] = old
                setattr(self, name, grown.reshape(-1))
            self.width = width
        at = state * self.width + self.column[byte]
        self.next[at], self.delta[at] = n, change

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes take one byte each: the new states and the changes in count."""
        at = state * self.width + self.column[byte]
        new = self.next[at]
        while not new.all():
            miss = np.flatnonzero(new == 0)
            for pair in np.unique(state[miss].astype(np.int64) * 256 + byte[miss]).tolist():
                self.compile(pair >> 8, pair & 255)
            at = state * self.width + self.column[byte]
            new = self.next[at]
        return new, self.delta[at]

    def boundaries(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """True at every byte that begins a pretoken. starts: the first bytes of texts, at which nothing before counts."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[lead].astype(np.int64)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            at, first = lead[wide], code[wide]
            more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
            two = (first & 0x1F) << 6 | more[at + 1]
            three = (first & 0x0F) << 12 | more[at + 1] << 6 | more[at + 2]
            four = (first & 0x07) << 18 | more[at + 1] << 12 | more[at + 2] << 6 | more[at + 3]
            code[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))
        kind = self.classes[code]
        begins = np.zeros(len(data) + 1, bool)
        begins[starts] = True
        begins = begins[lead]
        joined = np.concatenate([~begins[1:], [False]])  # the next character is of the same text
        before = np.concatenate([[OTHER], kind[:-1]])
        after = np.concatenate([kind[1:], [OTHER]])
        white, white_before = kind >= SPACE, before >= SPACE
        flag = np.where(white, ~white_before | (joined & (after < SPACE)), (before != kind) & (before != SPACE)) | begins
        # contractions: an apostrophe that begins a pretoken and s, t, m, d, re, ve or ll
        for p in np.flatnonzero((code == 39) & (begins | ((before != OTHER) & (before != SPACE))) & joined).tolist():
            x = code[p + 1]
            n = 2 if x in (115, 116, 109, 100) else 0
            if not n and joined[p + 1] and (x, code[p + 2]) in ((114, 101), (118, 101), (108, 108)):
                n = 3
            if n:
                flag[p + 1 : p + n] = False
                if p + n < len(flag):
                    flag[p + n] = True
        out = np.zeros(len(data), bool)
        out[lead[flag]] = True
        return out

    def changes(self, data: np.ndarray, flag: np.ndarray, entry: tuple = START) -> tuple[np.ndarray, tuple]:
        """The change in the number of tokens at every byte, and the state at the end; entry: the state at the beginning.
        Bytes that need more states than the table may hold are halved, and the table is begun anew for each half."""
        try:
            return self._changes(data, flag, self.state_of(entry))
        except Full:
            if len(data) <= CHUNK:
                raise
        half = -(-len(data) // (2 * CHUNK)) * CHUNK
        self.reset()
        left, entry = self.changes(data[:half], flag[:half], entry)
        self.reset()
        right, entry = self.changes(data[half:], flag[half:], entry)
        return np.concatenate([left, right]), entry

    def _changes(self, data: np.ndarray, flag: np.ndarray, entry: int) -> tuple[np.ndarray, tuple]:
        n = -(-len(data) // CHUNK)
        pad = n * CHUNK - len(data)
        lanes = np.ascontiguousarray(np.concatenate([data, np.full(pad, 32, np.uint8)]).reshape(n, CHUNK).T)
        resets = np.ascontiguousarray(np.concatenate([flag, np.ones(pad, bool)]).reshape(n, CHUNK).T)
        out = np.zeros((CHUNK, n), np.int8)
        ends = np.full(n, CHUNK)
        ends[-1] -= pad
        # the constant part of every map: from the first boundary on; a chunk without one is mapped from its neighbour's guess
        first = np.where(resets.any(0), resets.argmax(0), CHUNK)
        first[-1] = min(first[-1], ends[-1])
        free = first == ends
        state, last = np.zeros(n, np.int64), 0
        state[0] = entry
        for i in range(CHUNK):
            state = np.where(resets[i], 0, state)
            state, out[i] = self.step(state, lanes[i])
            if i == ends[-1] - 1:
                last = int(state[-1])  # before the padding
        state[-1] = last
        ran = np.zeros(n, np.int64)  # the state in which each chunk was entered last
        ran[0] = entry
        enter = self.entered(state, free, entry, ran, lambda lane, now: self.heads(lanes, out, first, lane, now))
        todo = np.flatnonzero((first > 0) & (enter != np.where(free, ran, -1)))
        whole = self.heads(lanes, out, first, todo, enter[todo])
        state[todo[free[todo]]] = whole[free[todo]]
        return out.T.reshape(-1)[: len(data)], self.states[state[-1]]

    def heads(self, lanes: np.ndarray, out: np.ndarray, first: np.ndarray, lane: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Run chunks up to their first boundary from the given states; the states reached there."""
        order = np.argsort(-first[lane], kind="stable")
        lane, now = lane[order], now[order]
        size = first[lane]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for i, k in enumerate(live.tolist()):
            now[:k], out[i, lane[:k]] = self.step(now[:k], lanes[i, lane[:k]])
        reached = np.empty_like(now)
        reached[order] = now
        return reached

    @staticmethod
    def entered(state: np.ndarray, free: np.ndarray, entry: int, ran: np.ndarray, run) -> np.ndarray:
        """The state in which every chunk is entered, by a parallel prefix scan over the chunks' maps.

        A chunk with a boundary maps every entry state to state[k]. A free chunk's map is known for the states that it has
        been run from: pairs of entry and exit, one more with each round. Maps compose pairwise, with twice the reach in
        every step; a free chunk whose entry state its map doesn't know is run from its left neighbour's last exit, all
        such chunks at once. Exits meet again soon whatever the entry, so that two rounds are the rule."""
        n = len(state)
        starts, exits = [ran.copy()], [state.copy()]
        enter = np.concatenate([[entry], state[:-1]])
        while True:
            begin, to = np.stack(starts), np.stack(exits)
            many = len(starts)
            nodes = many * n  # (column, chunk), and one more for what isn't known
            # from a chunk entered in its m-th state: the column of the next chunk that this leads to
            follow = np.full((many, n), nodes)
            for m in range(many):
                same = begin[:, 1:] == to[m, :-1]
                follow[m, :-1] = np.where(free[1:] & same.any(0), same.argmax(0) * n + np.arange(1, n), nodes)
            jump = np.append(follow.reshape(-1), nodes)
            real = np.zeros(nodes + 1, bool)
            # where the entry is known: after a chunk that maps to a constant, and at the beginning
            sure = np.flatnonzero(free & np.concatenate([[True], ~free[:-1]]))
            hit = begin[:, sure] == enter[sure]
            real[hit.argmax(0)[hit.any(0)] * n + sure[hit.any(0)]] = True
            for _ in range(n.bit_length()):
                real[jump[real]] = True
                real[nodes] = False
                jump = jump[jump]
            found = real[:-1].reshape(many, n)
            known = found.any(0) | ~free
            column = found.argmax(0)
            out = np.where(free, to[column, np.arange(n)], state)
            guess = np.where(known, out, to[-1])  # what each chunk is left in, or may be
            enter[1:] = guess[:-1]
            if known.all():
                return enter
            again = np.flatnonzero(~known)
            starts.append(np.full(n, -1))
            exits.append(exits[-1].copy())
            starts[-1][again] = enter[again]
            exits[-1][again] = run(again, enter[again])
            ran[again] = enter[again]

    def counts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each text; data: their bytes joined, ends: where each ends."""
        starts = np.concatenate([[0], ends[:-1]])
        out = np.zeros(len(ends), np.int64)
        if not len(data):
            return out
        if 2 * len(self.states) > self.max_states:
            self.reset()  # rather than in the middle
        cuts, marked = [starts], []
        raw = data.tobytes()
        for special in self.special:
            p = raw.find(special)
            while p >= 0:
                k = np.searchsorted(ends, p, "right")
                if p + len(special) <= ends[k]:
                    marked.append((p, p + len(special)))
                    p = raw.find(special, p + len(special))
                else:
                    p = raw.find(special, p + 1)
        cuts.append(np.array([x for pair in marked for x in pair], np.int64))
        begin = np.unique(np.concatenate(cuts))
        change = self.changes(data, self.boundaries(data, begin))[0].astype(np.int64)
        for a, b in marked:
            change[a:b] = 0
            change[a] = 1
        sums = np.concatenate([[0], np.cumsum(change)])
        return sums[ends] - sums[starts]


_MACHINES: dict[str, Transducer] = {}


def count_batch(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of every text of an Arrow array; null counts as empty."""
    machine = _MACHINES.get(path)
    if machine is None:
        machine = _MACHINES[path] = Transducer(path)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    out = np.zeros(len(texts), np.int64)
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        out[at:to] = machine.counts(data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at])
        at = to
    return out


def token_count(text: Column, path: str) -> Column:
    """Tokens of text under the byte-level BPE in the file at path, without added special tokens; null text: 0."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(count_batch(path, x), pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # Spark reads types, not strings
    return F.arrow_udf(count, "long")(text)


def with_token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added, or put in place of columns so named.

    Every row stays as it is otherwise: rows without doc_id, repeated rows and further columns included. Null text
    counts as empty: 0 bytes, 0 tokens. A text of any length is counted whole. Empty table: no rows."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(F.col("text"), path)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
