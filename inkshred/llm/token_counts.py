"""Operator 13: token counts by finite-state transducers compiled from a tokenizer's file.

Two deterministic transducers count the tokens of a byte-level BPE tokenizer.

The *splitter* reads characters and says where a piece (a pre-token) begins,
some characters late where its rule looks ahead.  It has eleven states, so a
chunk of text is a map from state to state: the maps of all chunks are
computed side by side, composed by a parallel prefix scan, and give every chunk
the state it is entered in.

The *merger* reads the bytes of a piece and annotates every transition with
by how much the number of tokens changes.  It is the weighted determinisation
of a machine whose states are (last token, place in the next token): two
tokens may follow each other if and only if no merge across their border comes
before the merges that made them, and the sequence in which all neighbours may
is the tokenizer's.  Since that sequence is unique for every prefix, a state
is the set of the ways in which the last bytes may be in the midst of a token,
each with the tokens before it relative to those of the whole prefix.  States
are made when they are first reached, kept in a table, and made anew when the
table is full (which changes no count); all pieces of a block walk together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import carried, mapped, table

#: Characters by what the splitter makes of them: others, letters, numbers, white space but spaces, spaces, apostrophes, letters that end a contraction of two, those that go on by e, l, e, and the end of a stretch.
OTHER, LETTER, NUMBER, WHITE, SPACE, APOSTROPHE, SHORT, LONG, ELL, EE, END = range(11)
#: States: a piece begins here; one space; one other white space; several, the last a space or another; letters; numbers; others; an apostrophe that begins a piece; with r or v; with l.
START, ONE_SPACE, ONE_WHITE, SPACES, WHITES, LETTERS, NUMBERS, OTHERS, MARK, MARK_E, MARK_L = range(11)
STATES, WIDTH = 11, 16
HERE, BACK = 1, 2  # a piece begins at this character; at the one before
CHUNK, PROBE = 128, 16
BLOCK = 1 << 20
#: So few long pieces walk one by one.
FEW = 8
_FAR = 1 << 30


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and flags [state * WIDTH + class] of the rule: contractions; letters, numbers or others after at most one space; white space, whose last character is left to what follows."""
    step, flag = np.zeros(STATES * WIDTH, np.uint8), np.zeros(STATES * WIDTH, np.uint8)
    letters = (LETTER, SHORT, LONG, ELL, EE)
    opens = {**dict.fromkeys(letters, LETTERS), NUMBER: NUMBERS, WHITE: ONE_WHITE, SPACE: ONE_SPACE, APOSTROPHE: MARK, OTHER: OTHERS, END: START}

    def put(state: int, of: int, to: int, said: int) -> None:
        step[state * WIDTH + of], flag[state * WIDTH + of] = to, said

    for state in range(STATES):
        late = BACK if state in (WHITES, MARK_E, MARK_L) else 0
        for of, to in opens.items():
            put(state, of, to, HERE | (late if of not in (SPACE, WHITE, END) or state != WHITES else 0))
    for of in letters:
        put(LETTERS, of, LETTERS, 0)
    put(NUMBERS, NUMBER, NUMBERS, 0)
    for state in (OTHERS, MARK):
        for of in (OTHER, APOSTROPHE):
            put(state, of, OTHERS, 0)
    for state, said in ((ONE_SPACE, 0), (SPACES, BACK)):  # a space goes with what follows it
        for of in (*letters, NUMBER, OTHER, APOSTROPHE):
            put(state, of, OTHERS if of == APOSTROPHE else opens[of], said)
    for state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        put(state, SPACE, SPACES, 0)
        put(state, WHITE, WHITES, 0)
    put(MARK, SHORT, START, 0)
    put(MARK, LONG, MARK_E, 0)
    put(MARK, ELL, MARK_L, 0)
    for state, end in ((MARK_E, EE), (MARK_L, ELL)):
        for of in letters:  # no contraction: letters since the one before
            put(state, of, LETTERS, BACK)
        put(state, end, START, 0)
    return step, flag


def classes(tokenizer) -> np.ndarray:
    """The class of every code point, letters, numbers and white space being what the tokenizer's own splitter takes them for.

    Its Unicode version may be older than this Python's, so each candidate is
    asked for: between a, 1 and exclamation marks, the places where it splits
    tell.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    some = regex.findall(r"[[\p{L}\p{N}\s]--[ ]]", "".join(map(chr, range(0x110000))), regex.VERSION1)
    for a in range(0, len(some), 256):
        part = some[a : a + 256]
        cut = {x[1][0] for x in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"a{c}1!{c}!" for c in part))}
        for i, c in enumerate(part):
            at = 6 * i
            out[ord(c)] = LETTER if at + 1 not in cut else NUMBER if at + 2 not in cut else OTHER if at + 4 not in cut else WHITE
    for of, chars in ((SPACE, " "), (APOSTROPHE, "'"), (SHORT, "stmd"), (LONG, "rv"), (ELL, "l"), (EE, "e")):
        out[[ord(c) for c in chars]] = of
    return out


class Pairs:
    """A map from non-negative integers to integers, many at a time: open addressing, at most half full."""

    def __init__(self, size: int = 1 << 10) -> None:
        self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where its search ends."""
        mask = len(self.keys) - 1
        at = (kernel.mix(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.keys[at[open_]] >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where a key is not there."""
        at = self._slots(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are different and not there."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            size = 1 << int(4 * self.n).bit_length()
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        while len(keys):  # of those that end at the same free place one is put, the others search on
            at = self._slots(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class Merger:
    """The lazily determinised transducer of a BPE vocabulary: merges by rank, and a trie of its tokens.

    Tokens are numbered 0 to 255 for bytes and 256 + rank for merges; parts[t]
    are the two tokens of a merge.  The ways of a state (place in the trie,
    last token, tokens before it relative to the prefix) stand one after
    another in flat arrays, from the one that began first to the empty one;
    all transitions that a step lacks are made together.
    """

    def __init__(self, parts: list[tuple[int, int]], states: int = 1 << 16) -> None:
        self.parts, self.states = parts, states
        self.ranks = {pair: rank for rank, pair in enumerate(parts)}
        spelled = [bytes([b]) for b in range(256)]
        sound = [True] * 256  # whether a token's own bytes give it
        child: dict[int, int] = {}
        token, inner = [-1], [True]  # of a node: its token, and whether it has children
        for rank, (a, b) in enumerate(parts):
            spelled.append(spelled[a] + spelled[b])
            sound.append(sound[a] and sound[b] and not self._torn(a, b, rank))
        for t, text in enumerate(spelled):
            if not sound[t]:
                continue
            node = 0
            for byte in text:
                inner[node] = True
                key = node << 8 | byte
                node = child.get(key, 0)
                if not node:
                    node = child[key] = len(token)
                    token.append(-1)
                    inner.append(False)
            token[node] = t
        self.token, self.inner = np.array(token, np.int32), np.array(inner)
        self.child, self.known = Pairs(), Pairs()
        self.child.put(np.array(list(child), np.int64), np.array(list(child.values()), np.int32))
        self._one = None
        self._restart()

    def _restart(self) -> None:
        """An empty table; state 0 is that before any byte."""
        self.at, self.ways, self.n = np.zeros(self.states + 1, np.int64), np.zeros((3, 8 * self.states), np.int32), 0
        self.marks, self.index = np.zeros(self.states, np.uint64), {}
        self.moves = np.full(self.states << 8, -1, np.int32)
        self._number(np.zeros(1, np.int64), np.array([[0], [-1], [0]], np.int32))

    def _spine(self, token: int, side: int, end: int) -> Iterator[tuple[int, int]]:
        """The tokens at one end of a token while it is made, with the rank of the merge that ends each."""
        while True:
            yield token, end
            if token < 256:
                return
            end = token - 256
            token = self.parts[end][side]

    def _torn(self, a: int, b: int, end: int) -> bool:
        """Whether some merge across the border of a and b comes before those that make them (or before ``end``); of equal ones, the left goes first."""
        left = list(self._spine(b, 0, end))
        for x, dies in self._spine(a, 1, end):
            for y, too in left:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < dies and rank <= too:
                    return True
        return False

    def _follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the tokens may follow the last ones; what was asked before is kept, up to some millions of pairs."""
        key = last.astype(np.int64) << 20 | token
        known = self.known.get(key)
        new = np.unique(key[known < 0])
        if len(new):
            if self.known.n > 1 << 21:
                self.known = Pairs()
                return self._follow(last, token)
            self.known.put(new, np.array([not self._torn(k >> 20, k & 0xFFFFF, _FAR) for k in new.tolist()], np.int32))
            known = self.known.get(key)
        return known > 0

    def _number(self, at: np.ndarray, ways: np.ndarray) -> np.ndarray:
        """The numbers of states by their ways, new ones where they are not in the table; two 64-bit hashes tell them apart."""
        place = (np.arange(ways.shape[1]) - np.repeat(at, np.diff(at, append=ways.shape[1]))).astype(np.uint64)
        word = kernel.mix((ways[0].astype(np.uint64) << np.uint64(32)) ^ (ways[1].astype(np.uint64) << np.uint64(8)) ^ ways[2].astype(np.uint64)) ^ (place * np.uint64(0x9E3779B97F4A7C15))
        one, two = np.add.reduceat(kernel.mix(word), at), np.add.reduceat(kernel.mix(word ^ np.uint64(0xD6E8FEB86659FD93)), at)
        unique, first, back = np.unique(one, return_index=True, return_inverse=True)
        index, n = self.index, self.n
        got = [index.setdefault(h, len(index)) for h in unique.tolist()]
        found = np.array(got, np.int64)
        new = np.flatnonzero(found >= n)
        some = first[new]
        ends = np.append(at, ways.shape[1])
        size = ends[some + 1] - ends[some]
        self.marks[n : n + len(new)] = two[some]
        self.at[n + 1 : n + 1 + len(new)] = self.at[n] + np.cumsum(size)
        a, b = self.at[n], self.at[n + len(new)]
        if b > self.ways.shape[1]:
            self.ways = np.concatenate([self.ways, np.zeros((3, int(b)), np.int32)], 1)
        self.ways[:, a:b] = ways[:, _ranges(ends[some], size)]
        self.n += len(new)
        if (self.marks[found][back] != two).any():
            raise ValueError("two states with one hash")  # one in 2^64
        return found[back]

    def _after(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, ways) of the states after a byte each, and by how many tokens the prefix changed."""
        size = self.at[state + 1] - self.at[state]
        owner = np.repeat(np.arange(len(state)), size)
        node, last, count = self.ways[:, _ranges(self.at[state], size)]
        to = self.child.get(node.astype(np.int64) << 8 | byte[owner])
        live = np.flatnonzero(to >= 0)
        owner, to, last, count = owner[live], to[live], last[live], count[live]
        token = self.token[to]
        whole = np.flatnonzero(token >= 0)
        whole = whole[(last[whole] < 0) | self._follow(np.maximum(last[whole], 0), token[whole])]
        if len(whole) != len(state) or (owner[whole] != np.arange(len(state))).any():
            raise ValueError("no or several token sequences for the same bytes: no BPE vocabulary")
        more = count[whole] + 1
        stay = np.flatnonzero(self.inner[to])
        size = np.bincount(owner[stay], minlength=len(state)) + 1
        ends = np.cumsum(size)
        ways = np.zeros((3, int(ends[-1])), np.int32)
        ways[1, ends - 1] = token[whole]
        spot = np.ones(ways.shape[1], bool)
        spot[ends - 1] = False
        ways[:, spot] = np.stack([to[stay], last[stay], count[stay] - more[owner[stay]]])
        return ends - size, ways, more

    def _grow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Make the transitions that are not in the table; the states, renumbered where it had to be emptied."""
        key = state << 8 | byte
        new = np.unique(key[self.moves[key] < 0])
        at, ways, more = self._after(new >> 8, new & 255)
        if self.n + len(new) > self.states:
            live, back = np.unique(state, return_inverse=True)
            if 2 * (len(live) + len(new)) > self.states:
                self.states = 2 * (len(live) + len(new))
            size = self.at[live + 1] - self.at[live]
            held = self.ways[:, _ranges(self.at[live], size)]
            self._restart()
            return self._grow(self._number(np.cumsum(size) - size, held)[back], byte)
        self.moves[new] = self._number(at, ways) << 8 | (more + 128)
        return state

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The tokens of every piece data[start : start + length], all walking together from the longest on."""
        order = np.argsort(-length, kind="stable")
        start, less = start[order], -length[order]
        total, state, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), 0
        while n := int(np.searchsorted(less, -at, "left")):  # those longer than ``at``
            if n <= FEW and at >= 64:
                for i in range(n):
                    total[i] += self._alone(int(state[i]), data[start[i] + at : start[i] - less[i]].tolist())
                break
            byte = data[start[:n] + at].astype(np.int64)
            move = self.moves[state[:n] << 8 | byte]
            if (move < 0).any():
                state = self._grow(state[:n], byte)
                move = self.moves[state << 8 | byte]
            state = (move >> 8).astype(np.int64)
            total[:n] += (move & 255) - 128
            at += 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


    def _alone(self, state: int, rest: list[int]) -> int:
        """The rest of a long piece by itself: the same transitions, one at a time, kept apart from the table."""
        if self._one is None:
            held = self.child.keys >= 0
            self._one = dict(zip(self.child.keys[held].tolist(), self.child.values[held].tolist(), strict=True)), self.token.tolist(), self.inner.tolist(), {}
        child, token, inner, known = self._one
        ways = [tuple(w) for w in self.ways[:, self.at[state] : self.at[state + 1]].T.tolist()]
        moves: dict[tuple, tuple] = {}
        total, key = 0, tuple(ways)
        for byte in rest:
            move = moves.get((key, byte))
            if move is None:
                stay, made = [], None
                for node, last, count in key:
                    to = child.get(node << 8 | byte)
                    if to is None:
                        continue
                    t = token[to]
                    if t >= 0 and made is None:
                        pair = (last, t)
                        if last >= 0 and pair not in known:
                            if len(known) > 1 << 18:
                                known.clear()
                            known[pair] = not self._torn(last, t, _FAR)
                        if last < 0 or known[pair]:
                            made = t, count + 1
                    if inner[to]:
                        stay.append((to, last, count))
                t, more = made
                move = tuple([(to, last, count - more) for to, last, count in stay] + [(0, t, 0)]), more
                if len(moves) > 1 << 16:
                    moves.clear()
                moves[key, byte] = move
            key, more = move
            total += more
        return total


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Compiled:
    """A tokenizer's file as transducers: class of every code point, the splitter's tables, the merges, and the special strings."""

    classes: np.ndarray
    step: np.ndarray
    flag: np.ndarray
    parts: list[tuple[int, int]]
    special: bytes | None
    _merger: Merger | None = None

    @property
    def merger(self) -> Merger:
        if self._merger is None:
            self._merger = Merger(self.parts)
        return self._merger


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_file(path: str) -> Compiled:
    """The transducers of a byte-level BPE tokenizer's .json file; any other kind is a ValueError."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or told["normalizer"] or any(model.get(x) for x in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    added = told["added_tokens"]
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has special tokens that take more than their own string")
    byte = _alphabet()
    number = {c: b for c, b in byte.items()}
    parts = []
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if number.setdefault(a + b, 256 + len(parts)) != 256 + len(parts):
            raise ValueError(f"{path} makes a token in two ways")
        parts.append((number[a], number[b]))
    names = sorted((x["content"].encode() for x in added), key=lambda x: (-len(x), x))  # of those that begin together, the longest
    special = b"|".join(map(re.escape, names)) or None
    return Compiled(classes(Tokenizer.from_file(path)), *splitter(), parts, special)


def _stretches(data: np.ndarray, offsets: np.ndarray, taken: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the bytes of about BLOCK that begin where a piece surely does: at a text, or at white space after a letter (outside special strings)."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n:
            k = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if k > a:
                b = k
                break
            end = min(n, b + BLOCK, int(offsets[np.searchsorted(offsets, b, "right")]))
            part = data[b - 1 : end]
            letter = ((part[:-1] | 32) >= 97) & ((part[:-1] | 32) <= 122)
            safe = np.flatnonzero(letter & ((part[1:] == 32) | (part[1:] == 10)) & ~taken[b:end])
            if len(safe):
                b += int(safe[0])
                break
            b = end
        yield a, b
        a = b


def entered(cls: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The splitter's state before every chunk of classes [place, chunk]: the chunks' maps, then an exclusive prefix scan of their composition."""
    places, n = cls.shape
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
    for j in range(min(PROBE, places)):
        maps = step[(maps << 4) | cls[j]]
    open_ = np.flatnonzero((maps != maps[0]).any(0))  # the few chunks whose first characters leave the state open
    one, several = maps[0].copy(), maps[:, open_]
    for j in range(PROBE, places):
        one = step[(one << 4) | cls[j]]
        if len(open_):
            several = step[(several << 4) | cls[j][open_]]
    maps[:] = one
    maps[:, open_] = several
    d = 1
    while d < n:
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d], 0)
        d *= 2
    return np.concatenate([np.full(1, START, np.uint8), maps[START, :-1]])


def pieces(data: np.ndarray, cuts: np.ndarray, taken: np.ndarray, c: Compiled) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of ``data``; a stretch ends at every one of ``cuts`` and at the bytes of special strings."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int32)
    point = first.copy()
    at = lambda k: data[np.minimum(lead[wide] + k, len(data) - 1)].astype(np.int32) & 63
    for low, high, mask, more in ((0xC0, 0xE0, 31, 1), (0xE0, 0xF0, 15, 2), (0xF0, 0x100, 7, 3)):
        wide = (first >= low) & (first < high)
        if wide.any():
            value = first[wide] & mask
            for k in range(1, more + 1):
                value = value << 6 | at(k)
            point[wide] = value
    of = c.classes[np.minimum(point, 0x10FFFF)]
    of[taken[lead]] = END
    where = np.searchsorted(lead, cuts)
    cls, place = np.insert(of, where, END), np.insert(lead, where, cuts)
    n = -(-len(cls) // CHUNK)
    grid = np.full(n * CHUNK, END, np.uint8)
    grid[: len(cls)] = cls
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    state, flags = entered(grid, c.step), np.empty_like(grid)
    for j in range(CHUNK):
        key = (state << 4) | grid[j]
        flags[j] = c.flag[key]
        state = c.step[key]
    flags = flags.T.ravel()[: len(cls)]
    begins = (flags & HERE) > 0
    begins[:-1] |= (flags[1:] & BACK) > 0
    begins |= cls == END
    edge = np.flatnonzero(begins)
    start = place[edge]
    length = np.diff(start, append=len(data))
    real = cls[edge] != END
    return start[real], length[real]


def count_texts(text: pa.Array, c: Compiled) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of every text of a column (null: an empty one)."""
    data, offsets = kernel.buffers(text)
    tokens = np.zeros(len(offsets) - 1, np.int64)
    taken = np.zeros(len(data) + 1, bool)
    if c.special is not None:
        find, raw, at = re.compile(c.special).search, data.tobytes(), 0
        while m := find(raw, at):
            owner = int(np.searchsorted(offsets, m.start(), "right")) - 1
            at = m.start() + 1
            if m.end() <= offsets[owner + 1]:  # not half of it in the next text
                taken[m.start() : m.end()] = True
                tokens[owner] += 1
                at = m.end()
    for a, b in _stretches(data, offsets, taken):
        cuts = np.unique(offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]) - a
        start, length = pieces(data[a:b], cuts, taken[a:b], c)
        n = c.merger.count(data[a:b], start, length)
        owner = np.searchsorted(offsets, start + a, "right") - 1
        tokens += np.bincount(owner, n, len(tokens)).astype(np.int64)
    return np.diff(offsets), tokens


def token_counts(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Add n_bytes and n_tokens of every row's whole text, as the tokenizer of the file at ``path`` (read by the driver) counts them.

    Null and empty texts have none; special strings in a text count as their
    token.  Every row is counted by itself, repeated ones alike; columns may
    have any names, those added replace others of their names.  One pass, no
    shuffle; the transducers are broadcast (2 MB) and their states stay in
    each worker, in a table of bounded size.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(compile_file(path))
    docs = docs.drop("n_bytes", "n_tokens")
    x, which = carried(docs), docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = frozen.value
        for batch in batches:
            size, tokens = count_texts(batch.column(which).cast(pa.large_string()), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(tokens)], [*batch.schema.names, "n_bytes", "n_tokens"])

    out = mapped(x, run, T.StructType([*x.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.select(*(F.col(i).alias(c) for i, c in zip(x.columns, docs.columns, strict=True)), "n_bytes", "n_tokens")


def op13(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 1024) -> DataFrame:
    """The tokens of every document by byte_bpe_50k.json, and whether they are over ``limit``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
