"""Token counts by a byte-level BPE tokenizer compiled to finite-state transducers.

The pre-tokenizer is a deterministic transducer of twelve states over twelve classes of code points; each
transition is annotated with where it closes a pre-token. Text is cut into chunks, each chunk's state map (exit state for
each entry state) is found for all chunks at once, and a parallel prefix scan composes the maps into every
chunk's entry state; a second pass then reads off the pre-tokens.

The merges are compiled to a deterministic transducer over bytes, whose transitions are annotated with emitted tokens. It rests on two facts
about merges whose ranks follow their making: the encoding of a prefix is that of a shorter prefix and one more token, and a sequence of
tokens is an encoding if each neighbouring pair is one. A state holds, for each suffix of what was read that some token
begins with, the last token before that suffix and how many tokens fewer there were; reading a byte finds the one token that may stand
last now, and the transition emits the difference of the two prefixes' token counts (which may be negative; the sum over a pre-token is its
count). All pre-tokens of a block, each of which begins in the start state, go through it side by side. States and transitions are
compiled when first met; beyond ``TRANSITIONS`` the table is emptied before the next block, which costs time and changes nothing.

The library's special strings inside a text are one token each, as it treats them by default.

Defined results: a null text is empty and has no tokens; rows that repeat get equal counts; an empty table gives an
empty table; other columns of the input are ignored; a text of any length takes time in proportion to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.bytetext import blocks, string_buffers

#: Code points in a chunk.
CHUNK = 512
#: Compiled transitions that a worker keeps from one block to the next, at most.
TRANSITIONS = 1 << 20
#: Pre-tokens up to this many bytes are read side by side, longer ones one by one.
SIDE_BY_SIDE = 48

# Classes of code points.
END, SPACE, WHITE, NUMBER, OTHER, QUOTE, STMD, R, V, E, L, LETTER = range(12)
# States: nothing open; in letters, numbers, others; an apostrophe that may begin a contraction; one with r or v, with l; a full
# contraction; white space of one or more characters that ends in a space, or in another character.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_QUOTE, IN_RV, IN_L, FULL, SPACE_1, SPACES, WHITE_1, WHITES = range(12)
#: Outputs: a pre-token begins before the current code point; before the previous one.
HERE, BEFORE = 1, 2


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output), each by 12 * state + class."""
    fresh = {END: START, SPACE: SPACE_1, WHITE: WHITE_1, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_QUOTE} | dict.fromkeys(range(STMD, LETTER + 1), IN_LETTERS)
    # What a text goes on with inside each run; all else begins a new pre-token.
    inside = {
        IN_LETTERS: dict.fromkeys(range(STMD, LETTER + 1), IN_LETTERS),
        IN_NUMBERS: {NUMBER: IN_NUMBERS},
        IN_OTHERS: {OTHER: IN_OTHERS, QUOTE: IN_OTHERS},
        IN_QUOTE: {OTHER: IN_OTHERS, QUOTE: IN_OTHERS, STMD: FULL, R: IN_RV, V: IN_RV, L: IN_L},
        IN_RV: {E: FULL},
        IN_L: {L: FULL},
        SPACE_1: {SPACE: SPACES, WHITE: WHITES},
        SPACES: {SPACE: SPACES, WHITE: WHITES},
        WHITE_1: {SPACE: SPACES, WHITE: WHITES},
        WHITES: {SPACE: SPACES, WHITE: WHITES},
        START: {},
        FULL: {},
    }
    step, out = np.zeros(144, np.uint8), np.zeros(144, np.uint8)
    for state in range(12):
        for kind in range(12):
            to, said = fresh[kind], HERE
            if kind in inside[state]:
                to, said = inside[state][kind], 0
            elif state in (IN_RV, IN_L):  # no contraction: its letter began a run of letters
                to, said = (IN_LETTERS, BEFORE) if kind in inside[IN_LETTERS] else (to, BEFORE | HERE)
            elif kind != END and state in (SPACE_1, SPACES):  # the last space belongs to what follows, where an apostrophe begins no contraction
                to, said = (IN_OTHERS if kind == QUOTE else to), BEFORE * (state == SPACES)
            elif kind != END and state == WHITES:
                said = BEFORE | HERE
            step[12 * state + kind], out[12 * state + kind] = to, said
    return step, out


STEP, OUT = _compile()
_table: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """The class of each code point."""
    if not _table:
        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        table[ord(" ")], table[ord("'")] = SPACE, QUOTE
        for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
            for x in letters:
                table[ord(x)] = kind
        _table.append(table)
    return _table[0]


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """The exit state of each chunk (rows) for each entry state (columns)."""
    states = np.repeat(np.arange(12, dtype=np.uint8)[None], len(classes), axis=0)
    for j in range(classes.shape[1]):
        states = STEP[states * np.uint8(12) + classes[:, j, None]]
    return states


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes the composition of maps 0 to i."""
    done, reach = maps.copy(), 1
    while reach < len(done):
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach], axis=1)
        reach *= 2
    return done


def begins(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a sequence of classes in which END follows each text."""
    n = len(classes)
    padded = np.full(-(-max(n, 1) // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(-1, CHUNK)
    state = np.full(len(grid), START, np.uint8)
    state[1:] = scan_maps(chunk_maps(grid))[:-1, START]
    columns = np.ascontiguousarray(grid.T)
    said = np.empty_like(columns)
    for j, column in enumerate(columns):
        at = state * np.uint8(12) + column
        said[j] = OUT[at]
        state = STEP[at]
    said = said.T.reshape(-1)[:n]
    mark = said & HERE > 0
    mark[:-1] |= said[1:] & BEFORE > 0
    return mark


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merges of a byte-level vocabulary file: which tokens are encodings, and which pairs of them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        symbols = _byte_symbols()
        self.byte_ids = [vocab[x] for x in symbols]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            if token in self.made or any(self.made.get(x, (0, 0, -1))[2] < 0 and x not in self.byte_ids for x in (left, right)):
                raise ValueError("every token must have one merge, which follows those of its parts")
            self.ranks[left, right] = rank
            self.made[token] = (left, right, rank)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        if max(vocab.values()) >= 1 << 18 or max(map(len, vocab)) > 500:
            raise ValueError("a vocabulary of that size doesn't fit a state's places")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings aren't supported")
        back, specials = {x: b for b, x in enumerate(symbols)}, {x["content"] for x in spec["added_tokens"]}
        #: Nodes are beginnings of tokens, by (node << 8 | byte); node 0 is empty.
        self.child: dict[int, int] = {}
        self.token_at, self.leaf = [-1], [False]
        for text, token in vocab.items():
            if text in specials:
                continue
            node = 0
            for x in text:
                key = node << 8 | back[x]
                self.leaf[node] = False
                node = self.child.setdefault(key, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.leaf.append(True)
            self.token_at[node] = token
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._forms: dict[int, bool] = {}
        self._joins: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's left (0) or right (1) edge while it is made, with the rank that ends each one."""
        found = self._edges.get((token, side))
        if found is None:
            made = self.made.get(token)
            found = [(token, float("inf"))]
            if made:
                below = self._edge(made[side], side)
                found = [*below[:-1], (below[-1][0], made[2]), found[0]]
            self._edges[token, side] = found
        return found

    def crossed(self, a: int, b: int) -> tuple[int, int] | None:
        """The first two parts that merge over the border of tokens a and b."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get((x, y))
            # Of equal ranks, the one further left is merged first.
            if rank is not None and rank < x_ends and rank <= y_ends:
                return x, y
            if i + 1 == len(left) and j + 1 == len(right):
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def forms(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as this token."""
        found = self._forms.get(token)
        if found is None:
            made = self.made.get(token)
            found = made is None or (self.forms(made[0]) and self.forms(made[1]) and self.crossed(made[0], made[1]) == made[:2])
            self._forms[token] = found
        return found

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a and b are the encoding of their bytes."""
        found = self._joins.get((a, b))
        if found is None:
            if len(self._joins) > TRANSITIONS:
                self._joins.clear()
            found = self._joins[a, b] = self.crossed(a, b) is None
        return found


class Bpe:
    """The transducers of a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = self.merges.special
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        """No transitions, and the start state alone: nothing was read and no token stands last."""
        # A state's places are (node << 28 | last token + 1 << 10 | tokens fewer + 512).
        self.states: list[tuple[int, ...]] = [(512,)]
        self.number = {self.states[0]: 0}
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        self.held, self.single = 0, {}

    def _compile(self, key: int) -> int:
        """The transition of a state and byte (state << 8 | byte): next state << 16 | emitted + 2**15."""
        merges, went, emitted, last_now = self.merges, [], None, -1
        byte = key & 255
        for place in self.states[key >> 8]:
            child = merges.child.get(place >> 28 << 8 | byte)
            if child is None:
                continue
            token, last = merges.token_at[child], (place >> 10 & 0x3FFFF) - 1
            if emitted is None and token >= 0 and merges.forms(token) and (last < 0 or merges.joins(last, token)):
                emitted, last_now = 513 - (place & 1023), token
            if not merges.leaf[child]:
                went.append(child << 28 | place & 0xFFFFFFF)
        if emitted is None:
            raise ValueError("no token can stand last: the merges' ranks don't follow their making")
        state = (*(place + emitted for place in went), last_now + 1 << 10 | 512)
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        return at << 16 | (emitted + (1 << 15))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).view(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add new transitions; the table is at most half full."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.values, self.held = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        self.held += len(keys)
        mask, slots = len(self.keys) - 1, self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[taken], self.values[taken] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & mask

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of the keys, -1 where there are none yet."""
        mask, slots = len(self.keys) - 1, self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.values[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def _step(self, keys: np.ndarray) -> np.ndarray:
        found = self._look(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            self._put(new, np.array([self._compile(k) for k in new.tolist()], np.int64))
            missing = np.flatnonzero(found < 0)
            found[missing] = self._look(keys[missing])
        return found

    def _one(self, word: bytes) -> int:
        """Tokens of one pre-token. No other one is under way, so that the table may be emptied in the midst of it."""
        state, total, single = 0, 0, self.single
        for byte in word:
            key = state << 8 | byte
            value = single.get(key)
            if value is None:
                if len(single) > TRANSITIONS // 4:
                    at = self.states[state]
                    self._empty(1 << 12)
                    single, state = self.single, self.number.setdefault(at, len(self.states))
                    if state == len(self.states):
                        self.states.append(at)
                    key = state << 8 | byte
                value = single[key] = self._compile(key)
            state, total = value >> 16, total + (value & 0xFFFF) - (1 << 15)
        return total

    def emitted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        if max(self.held, len(self.states)) > TRANSITIONS:
            self._empty(1 << 12)
        length = ends - starts
        total = np.zeros(len(starts), np.int64)
        order = np.argsort(-length, kind="stable")
        long = int(np.searchsorted(-length[order], -SIDE_BY_SIDE, "left"))
        for i in order[:long].tolist():
            total[i] = self._one(data[starts[i] : ends[i]].tobytes())
        order = order[long:]
        at, size = starts[order], length[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))
            value = self._step(state[:n] << 8 | data[at[:n] + k])
            state[:n] = value >> 16
            count[:n] += (value & 0xFFFF) - (1 << 15)
        total[order] = count
        return total

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text at ``offsets`` (from 0 to len(data))."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        whole, cuts, alone = data.tobytes(), [], []
        for special in self.special:
            p = whole.find(special)
            while p >= 0:
                if np.searchsorted(offsets, p, "right") == np.searchsorted(offsets, p + len(special) - 1, "right"):
                    cuts += [p, p + len(special)]
                    alone.append(p)
                p = whole.find(special, p + len(special))
        edges = np.unique(np.concatenate([offsets, np.array(cuts, np.int64)]))  # of segments, none empty
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        stop = np.searchsorted(leads, edges[1:])
        classes = np.insert(code_point_classes()[points], stop, END)
        at = np.insert(leads, stop, edges[1:])
        mark = np.flatnonzero(begins(classes))
        kinds = classes[mark]
        starts, follows = at[mark], np.append(at[mark[1:]], len(data))
        starts, follows = starts[kinds != END], follows[kinds != END]
        tokens = self.emitted(data, starts, follows)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        inside = np.diff(sums[np.searchsorted(starts, edges)])
        if alone:
            inside[np.searchsorted(edges, np.array(alone))] = 1
        totals = np.concatenate([[0], np.cumsum(inside)])
        return np.diff(totals[np.searchsorted(edges, offsets)])


_compiled: dict[str, Bpe] = {}


def compiled(path: str) -> Bpe:
    """The process's transducers for a vocabulary file."""
    if path not in _compiled:
        _compiled[path] = Bpe(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``path`` must exist on the executors."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(path)
        for batch in batches:
            data, at = string_buffers(batch.column(1))
            counts = [bpe.counts(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(work, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
