"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer over bytes that is
determinised lazily. The unique BPE tokenisation of every prefix of a word ends
in one token, so a word's tokenisation passes through some places of the word and
not through others. A state is the list of places from which a longer token may
still grow, each with the tokens that lead to it and the node of the byte trie
reached from there. Reading a byte advances the nodes, drops the dead places,
and opens the place now reached, which is led to by the last token that forms a
stable pair with its predecessor. What all open places have in common is settled:
the move puts these tokens out and the state keeps the rest. No place is older
than the longest token, so the lookahead is bounded; at a word's end a state
gives what is left. States, moves and outputs are computed once and kept in
arrays, over which all distinct words of a batch run side by side.

Decoding runs an incremental UTF-8 state machine over tokens: a state is the
incomplete tail of a character (at most three bytes), and the transition of
(state, token) to (state, characters) is memoised too. Runs of tokens that are
whole characters leave the machine in its first state and are joined at once.
"""
from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States and stable pairs kept in a worker; full memos are emptied, which costs time and changes nothing.
MAX_STATES, MAX_PAIRS = 250_000, 300_000
#: Characters of a text that are split into words at a time, words encoded at a time, and characters put into one result batch.
WINDOW, WORDS, BATCH_CHARS = 1 << 20, 1 << 18, 2 << 20
#: Bytes of distinct words that run side by side, and of a word that runs on its own.
SLICE, LONG = 1 << 17, 256
#: Below this code point texts are split by the standard library's expressions.
NEAR = 0x250


#: A row of cells without moves.
NONE = array("i", [-1] * 16)
_NO_ROWS = array("i", [0] * 16)


def view(a: array) -> np.ndarray:
    """An array of ints for numpy. It must be gone before the array grows."""
    return np.frombuffer(a, np.int32)


class Transducer:
    """The lazily determinised encoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.text_of = ranks, {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[int]] = {}
        self.stable: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        #: A state's key: the last token put out (-1: none; -2: of no account), then for each open place, oldest first, its node, the number of tokens that lead to it, and these.
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        #: By state and high half of a byte a row, by row and low half a move; row 0 has none. A state's last move is its end.
        self.rows, self.cells, self.ends = array("i"), array("i", NONE), array("i")
        self.to, self.n_out, self.at_out, self.out = array("i"), array("i"), array("i"), array("i")
        self.start = self.state((-1, 0, 0))

    def state(self, key: tuple) -> int:
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.rows.extend(_NO_ROWS)
            whole = self.token[key[1]] if key[0] == -1 and key[2] == 0 else -1  # a word of the vocabulary is one token, however its bytes would merge
            at = 1
            while at + 2 + key[at + 1] < len(key):
                at += 2 + key[at + 1]
            self.ends.append(self._move(s, (whole,) if whole >= 0 else key[at + 2 :]))
        return s

    def _move(self, to: int, tokens: tuple) -> int:
        self.at_out.append(len(self.out))
        self.n_out.append(len(tokens))
        self.out.extend(tokens)
        self.to.append(to)
        return len(self.to) - 1

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token, (-1, -1) for a single byte, None if merging its bytes never leads to it."""
        if token not in self.halves:
            word = self.text_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (-1, -1) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of a token as it grows, from the single byte to itself; empty if it never comes about."""
        got = self.edges.get((token, side))
        if got is None:
            halves = self.split(token)
            below = [] if halves is None or halves[0] < 0 else self.edge(halves[side], side)
            got = [] if halves is None or (halves[0] >= 0 and not (below and self.is_stable(-1, halves[1 - side]))) else [*below, token]
            self.edges[token, side] = got
        return got

    def is_stable(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` (-1: the word's start) in a tokenisation.

        Both grow on their own, merge by merge in the order of ranks. They stay
        apart if at no time the tokens that then meet at their border merge with
        a rank that comes before the next merge on either side; of equal ranks
        the one further left comes first.
        """
        key = left << 32 | right
        got = self.stable.get(key)
        if got is None:
            b = self.edge(right, 0)
            if left < 0:
                got = bool(b)
            else:
                a, got, i, j = self.edge(left, 1), True, 0, 0
                while got:
                    next_a, next_b = (a[i + 1] if i + 1 < len(a) else 1 << 60), (b[j + 1] if j + 1 < len(b) else 1 << 60)
                    both = self.ranks.get(self.text_of[a[i]] + self.text_of[b[j]], 1 << 60)
                    if both < next_a and both <= next_b:
                        got = False
                    elif next_a == next_b == 1 << 60:
                        break
                    elif next_a <= next_b:
                        i += 1
                    else:
                        j += 1
            if len(self.stable) > MAX_PAIRS:
                self.stable.clear()
            self.stable[key] = got
        return got

    def step(self, state: int, byte: int) -> int:
        """The move from a state on a byte."""
        key, children, at = self.keys[state], self.children, 1
        paths, nodes, found = [], [], None
        while at < len(key):
            stop = at + 2 + key[at + 1]
            node = children[key[at]].get(byte)
            if node is not None:
                path = key[at + 2 : stop]
                paths.append(path)
                nodes.append(node)
                if found is None and (token := self.token[node]) >= 0 and self.is_stable(path[-1] if path else key[0], token):
                    found = (*path, token)
            at = stop
        if found is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        paths.append(found)
        nodes.append(0)
        low, high, n = min(paths), max(paths), 0
        while n < len(low) and low[n] == high[n]:
            n += 1
        new = [(found[n - 1] if n else key[0]) if len(low) == n else -2]
        for path, node in zip(paths, nodes):
            new += (node, len(path) - n, *path[n:])
        move = self._move(self.state(tuple(new)), found[:n])
        row = state * 16 + (byte >> 4)
        if not self.rows[row]:
            self.rows[row] = len(self.cells) // 16
            self.cells.extend(NONE)
        self.cells[self.rows[row] * 16 + (byte & 15)] = move
        return move

    def moves(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The moves from states on a byte each."""
        high, low = states * 16 + (data >> 4), data & 15
        move = view(self.cells)[view(self.rows)[high].astype(np.int64) * 16 + low]
        missing = move < 0
        if missing.any():
            for k in np.unique(states[missing] * 256 + data[missing]).tolist():
                self.step(k >> 8, k & 255)
            move = view(self.cells)[view(self.rows)[high].astype(np.int64) * 16 + low]
        return move

    def outputs(self, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each move puts out, and all of these."""
        n = view(self.n_out)[moves].astype(np.int64)
        some = np.flatnonzero(n)
        times = n[some]
        at = np.repeat(view(self.at_out)[moves[some]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return n, view(self.out)[at]

    def side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of data, the longest first: how many each has, and all of these."""
        begins = np.cumsum(lengths + 1) - lengths - 1  # of each word's moves, one for each byte and its end
        moves, now = np.empty(int((lengths + 1).sum()), np.int32), np.full(len(lengths), self.start, np.int64)
        for j in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -j))
            move = self.moves(now[:m], data[starts[:m] + j].astype(np.int64))
            moves[begins[:m] + j] = move
            now[:m] = view(self.to)[move]
        moves[begins + lengths] = view(self.ends)[now]
        n, tokens = self.outputs(moves)
        return np.add.reduceat(n, begins) if len(begins) else n, tokens

    def run(self, word: bytes) -> Iterator[np.ndarray]:
        """The tokens of one word, in pieces that come as they are settled."""
        state = self.start
        for at in range(0, len(word), SLICE):
            if len(self.keys) > MAX_STATES:
                key = self.keys[state]
                self._clear()
                state = self.state(key)
            passed = []
            for byte in word[at : at + SLICE]:
                move = self.cells[self.rows[state * 16 + (byte >> 4)] * 16 + (byte & 15)]
                passed.append(move if move >= 0 else self.step(state, byte))
                state = self.to[passed[-1]]
            yield self.outputs(np.array(passed))[1]
        yield self.outputs(view(self.ends)[state : state + 1])[1]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each word has, and all tokens."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        if not len(distinct):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        _, offsets, raw = distinct.buffers()
        ends, data = np.frombuffer(offsets, np.int64)[: len(distinct) + 1], np.frombuffer(raw, np.uint8)
        lengths = np.diff(ends)
        order = np.argsort(-lengths, kind="stable")
        n, pieces = np.zeros(len(distinct), np.int64), []
        alone = int(np.searchsorted(-lengths[order], -LONG))
        for i in order[:alone].tolist():
            own = list(self.run(data[ends[i] : ends[i + 1]].tobytes()))
            n[i] = sum(map(len, own))
            pieces += own
        held = np.cumsum(lengths[order])
        while alone < len(order):
            if len(self.keys) > MAX_STATES:
                self._clear()
            stop = max(alone + 1, int(np.searchsorted(held, (held[alone - 1] if alone else 0) + SLICE)))
            these = order[alone:stop]
            n[these], own = self.side_by_side(data, ends[these], lengths[these])
            pieces.append(own)
            alone = stop
        flat = np.concatenate(pieces)
        at = np.empty(len(order), np.int64)  # of each word's first token
        at[order] = np.cumsum(n[order]) - n[order]
        n = n[which]
        return n, flat[np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Decoder:
    """Tokens to text, a token at a time; bytes that are no UTF-8 become U+FFFD, as soon as that is certain."""

    def __init__(self, text_of: dict[int, bytes]):
        self.text_of = text_of
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        size = max(text_of, default=-1) + 1
        #: The tokens that lead from the first state back to it, and the bytes of all, one after the other.
        self.is_closed, self.lengths = np.zeros(size, bool), np.zeros(size, np.int64)
        for i, b in text_of.items():
            self.lengths[i] = len(b)
            try:
                self.is_closed[i] = bool(b.decode())
            except UnicodeDecodeError:
                continue
        self.bytes, self.begins = np.frombuffer(b"".join(text_of.get(i, b"") for i in range(size)), np.uint8), np.cumsum(self.lengths) - self.lengths

    def step(self, tail: bytes, token: int) -> tuple[bytes, str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = machine.decode(tail + self.text_of[token])
        to = machine.getstate()[0]
        if len(self.moves) > MAX_STATES:
            self.moves = {b"": {}, tail: {}}
        self.moves.setdefault(to, {})
        move = self.moves[tail][token] = (to, text)
        return move

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as they become certain."""
        ids, tail = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64), b""
        for begin in range(0, len(ids), WINDOW):
            part, at = ids[begin : begin + WINDOW], 0
            opens = [*np.flatnonzero(~self.is_closed[part]).tolist(), len(part)]
            names, nth = part.tolist(), 0
            while at < len(names):
                while opens[nth] < at:
                    nth += 1
                if not tail and at < opens[nth]:
                    yield self.raw(part[at : opens[nth]]).decode()
                    at = opens[nth]
                    continue
                tail, text = self.moves[tail].get(names[at]) or self.step(tail, names[at])
                at += 1
                yield text
        if tail:
            yield tail.decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens."""
        n = self.lengths[ids]
        return self.bytes[np.repeat(self.begins[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}


@table
def ranks_of(path: str | None = None) -> dict[bytes, int]:
    """A rank file; the default one comes with the public tokenizers installed on every worker."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return read_ranks(f.read())


@table
def encoder(path: str | None) -> Transducer:
    """The encoder of a rank file, one in each worker."""
    return Transducer(ranks_of(path))


@table
def decoder(path: str | None) -> Decoder:
    return Decoder({i: b for b, i in ranks_of(path).items()})


@lru_cache(2)
def patterns(pattern: str) -> tuple[regex.Pattern, re.Pattern, re.Pattern]:
    """A pattern with classes \\p{L}, \\p{N} and \\s, the same with these written out below NEAR for the standard library's faster machine, and what finds characters from NEAR on."""
    near = [chr(c) for c in range(NEAR)]
    members = {name: "".join(re.escape(c) for c in near if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    spelt = pattern
    for inner in set(re.findall(r"\[[^\]]*\]", pattern)):  # classes inside of classes
        whole = inner
        for name, chars in members.items():
            whole = whole.replace(name, chars)
        spelt = spelt.replace(inner, whole)
    for name, chars in members.items():
        spelt = spelt.replace(name, f"[{chars}]")
    spelt = spelt.replace(r"\S", f"[^{members[r'\s']}]")
    return regex.compile(pattern), re.compile(spelt), re.compile(f"[^\0-{near[-1]}]")


def split(text: str) -> Iterator[list[str]]:
    """The words of a text in lists, so that a very long text never has them all in memory. Each list but the last ends with a match of the pattern."""
    import public_tokenizers

    every, near, far = patterns(public_tokenizers.PATTERN)
    pattern, at = every if far.search(text) else near, 0
    while len(text) - at > 2 * WINDOW:
        end, pieces, stop = at, [], at + WINDOW
        for m in pattern.finditer(text, at):
            end = m.end()
            pieces.append(m[0])
            if end >= stop:
                break
        yield pieces
        at = end
    yield pattern.findall(text, at) if at else pattern.findall(text)


def encode_texts(texts: list[str | None], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has (null: none), and all tokens."""
    machine, n, done = encoder(path), np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
    words: list[str] = []
    owners: list[int] = []
    times: list[int] = []

    def flush() -> None:
        each, tokens = machine.encode(words)
        np.add.at(n, np.repeat(owners, times), each)
        done.append(tokens)
        for x in (words, owners, times):
            x.clear()

    for i, text in enumerate(texts):
        for pieces in split(text or ""):
            words.extend(pieces)
            owners.append(i)
            times.append(len(pieces))
            if len(words) >= WORDS:
                flush()
    if words:
        flush()
    return n, np.concatenate(done)


def encode_text(text: str | None, path: str | None = None) -> list[int]:
    return encode_texts([text], path)[1].tolist()


def decode_ids(ids: Iterable[int], path: str | None = None) -> str:
    return "".join(decoder(path).decode(ids))


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of consecutive rows that reach `most` together, one row at least."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most or i == len(sizes) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, round_trip: bool = False) -> DataFrame:
    """Every row with `ids`, the tokens of its whole text (null or empty: none), as array<int>. No shuffle.

    `round_trip` adds `decoded`, the text that the ids decode to, in the same
    pass. Columns of these names are replaced, others pass through whatever their
    names. Repeated rows are encoded each; a very long text is split and encoded
    in pieces, as a whole; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    names = ["ids", "decoded"][: 1 + round_trip]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for start, stop in groups(sizes, BATCH_CHARS):
                part = batch.slice(start, stop - start)
                n, ids = encode_texts(column.slice(start, stop - start).to_pylist(), path)
                offsets = np.r_[0, np.cumsum(n)]
                new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if round_trip:
                    new.append(pa.array([decode_ids(ids[a:b], path) for a, b in zip(offsets[:-1], offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *names])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added[: len(names)]]))


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with `decoded`, the text of its ids (null: null); a column of that name is replaced. No shuffle."""
    ship(tokens.sparkSession)
    tokens = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, out, size = batch.column(batch.schema.get_field_index(ids_col)), 0, [], 0
            for i in range(len(ids)):
                row = ids[i]
                out.append(decode_ids(row.values.to_pylist(), path) if row.is_valid else None)
                size += len(out[-1] or "")
                if size >= BATCH_CHARS or i == len(ids) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])
                    start, out, size = i + 1, [], 0

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))
