"""Token counts of byte-level BPE by finite-state machines: one cuts texts into pieces, one counts the tokens of pieces, both in chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, texts

LIMIT = 1024
#: Characters in a chunk of the parallel scan.
CHUNK = 512
#: States at which the machine that counts tokens is built anew.
MOST_STATES = 1 << 18
#: The rank of pairs that don't merge; what stands for the last merge of a single byte.
NEVER, _BYTE = 1 << 30, (-1, b"", b"")
#: Bytes of text that are run at a time.
RUN = 1 << 22

# Classes of characters. The letters apart are those of 's 't 'm 'd 're 've 'll.
LETTER, CLOSER, R, V, ELL, E, NUMBER, OTHER, QUOTE, SPACE, BLANK, END, STAY, UNSEEN = range(14)
CLASSES = 13
# States: what the open piece looks like. A number after a state's name counts its characters up to "two or more".
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SPACE1, SPACE2, BLANK1, BLANK2, CLOSED) = range(13)
STATES = 13
_LETTERS = (LETTER, CLOSER, R, V, ELL, E)
_FIRST = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AT_QUOTE, SPACE: SPACE1, BLANK: BLANK1, END: START} | dict.fromkeys(_LETTERS, IN_LETTERS)
_JOINED = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS} | dict.fromkeys(_LETTERS, IN_LETTERS)


def _transition(state: int, c: int) -> tuple[int, bool, bool]:
    """Next state; whether a piece begins at the character before; whether one begins at this character."""
    fresh = (_FIRST.get(c, state), False, True)
    blanks = {SPACE: SPACE2, BLANK: BLANK2}
    if c == STAY:
        return state, False, False
    if state == IN_LETTERS and c in _LETTERS:
        return IN_LETTERS, False, False
    if state == IN_NUMBERS and c == NUMBER:
        return IN_NUMBERS, False, False
    if state == IN_OTHERS and c in (OTHER, QUOTE):
        return IN_OTHERS, False, False
    if state == AT_QUOTE:
        then = {CLOSER: CLOSED, R: QUOTE_R, V: QUOTE_V, ELL: QUOTE_L, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(c)
        return fresh if then is None else (then, False, False)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (ELL if state == QUOTE_L else E):
            return CLOSED, False, False
        return (IN_LETTERS, True, False) if c in _LETTERS else (_FIRST[c], True, True)
    if state in (SPACE1, SPACE2, BLANK1, BLANK2):
        if c in blanks:
            return blanks[c], False, False
        if c == END:
            return fresh
        if state == SPACE1:
            return _JOINED[c], False, False
        if state == SPACE2:
            return _JOINED[c], True, False
        return _FIRST[c], state == BLANK2, True
    return fresh


def _code(state: int, c: int) -> int:
    """Next state in the low four bits; above it whether a piece begins at the character before, and at this one."""
    then, before, here = _transition(state, c)
    return then | before << 4 | here << 5


#: By class * 16 + state.
_TABLE = np.array([_code(s, c) if s < STATES else 0 for c in range(CLASSES) for s in range(16)], dtype=np.uint8)
#: Characters after which the states of a chunk are looked at: few texts keep them apart so long.
_SETTLE = 24


def _maps(grid: np.ndarray) -> np.ndarray:
    """The state map of every chunk (a column of `grid`): the state in which it ends, for each in which it may begin.

    From most states the same one is reached within a few characters; once a map is constant, one state is enough to go on.
    """
    rows = grid.shape[1]
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid[:_SETTLE]:
        maps = _TABLE[column[:, None] | maps] & 15
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    state, rest = maps[:, 0].copy(), maps[open_]
    for column in grid[_SETTLE:]:
        state = _TABLE[column | state] & 15
    if len(open_):
        for column in grid[_SETTLE:, open_]:
            rest = _TABLE[column[:, None] | rest] & 15
    maps[:] = state[:, None]
    maps[open_] = rest
    return maps


def cuts(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in a run of character classes.

    The run is laid out as chunks, side by side. First every chunk's state map is made. A parallel prefix scan composes these maps,
    each step over twice the distance, which gives the state in which every chunk begins. Then every chunk is run once from that
    state, and the transitions say where pieces begin.
    """
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, STAY, dtype=np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T) << 4

    maps = _maps(grid)
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.concatenate((np.full(1, START, dtype=np.uint8), maps[:-1, START]))

    codes = np.empty((CHUNK, rows), dtype=np.uint8)
    for i, column in enumerate(grid):
        codes[i] = _TABLE[column | state]
        state = codes[i] & 15
    codes = codes.T.reshape(-1)
    begins = (codes[:n] & 32) != 0
    begins[:-1] |= (codes[1:n] & 16) != 0
    return np.flatnonzero(begins)


class Machine:
    """The transducer that counts BPE tokens byte by byte, built from merges as far as texts ask for it.

    Having read a prefix of a piece, what BPE makes of it ends in one token, fixed by what it makes of the shorter prefixes: the
    longest vocabulary token that is a suffix of the prefix and that merges keep apart from the last token before it. So a state
    holds, for every place from which a token may still reach beyond the prefix, the last token before that place and how many tokens
    lie behind it, seen from the prefix's end. Prefixes that agree in this are one state. A transition on a byte leads to a state and
    emits by how much the token count changes; a piece's count is the sum of what its bytes emit.

    Transitions stand in one open hash table of numpy arrays, so that many chunks of text make a step at a time. It starts anew when
    MOST_STATES are reached, between two runs.
    """

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], tokens: set[bytes]):
        self.ranks = ranks
        #: Whether a token is what merges make of its own bytes; None until asked.
        self.whole: dict[bytes, bool | None] = dict.fromkeys(tokens)
        self.open = {t[:i] for t in tokens for i in range(1, len(t))}
        #: The merge that made a token last: its rank and both parts.
        self.last: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.reset()

    def reset(self) -> None:
        #: A state's bytes that tokens may begin in, and its places: (bytes from there, the last token before, its count less the state's).
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.keys, self.values, self.used = np.full(1 << 16, -1, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0

    def merged(self, piece: bytes) -> list[bytes]:
        """BPE by its definition: the adjacent pair of lowest rank is merged, the first of equals, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            self.last[parts[i] + parts[i + 1]] = rank, parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _is_whole(self, token: bytes) -> bool:
        own = self.whole.get(token, False)
        if own is None:
            own = self.whole[token] = self.merged(token) == [token]
        return own

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether BPE leaves two tokens side by side. Their last merges are undone, the later first: a merge over the border between
        them would have come before it if its rank is lower, or the same where what was undone lies to the right."""
        before = NEVER
        while True:
            if self.ranks.get((a, b), NEVER) < before:
                return False
            (rank_a, _, right), (rank_b, left, _) = self.last.get(a, _BYTE), self.last.get(b, _BYTE)
            if rank_a == rank_b == -1:
                return True
            if rank_a > rank_b:
                before, a = rank_a, right
            else:
                before, b = rank_b + 1, left

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the change of the count."""
        suffix, places = self.states[state]
        suffix += bytes((byte,))
        for n, last, count in places:
            token = suffix[len(suffix) - n - 1 :]
            if self._is_whole(token) and (last is None or self.apart(last, token)):
                emitted = count + 1
                break
        else:
            raise AssertionError(f"no token ends {suffix!r}")
        live = [(n + 1, last, count - emitted) for n, last, count in places if suffix[len(suffix) - n - 1 :] in self.open]
        then = (suffix[len(suffix) - live[0][0] :] if live else b"", (*live, (0, token, 0)))
        number = self.numbers.setdefault(then, len(self.states))
        if number == len(self.states):
            self.states.append(then)
        return number, emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free place where it would."""
        bits = self.keys.size.bit_length() - 1
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
        there = self.keys[at]
        off = np.flatnonzero((there != keys) & (there != -1))
        while len(off):
            at[off] = (at[off] + 1) & (self.keys.size - 1)
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there != -1)]
        return at

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys, all different, that the table lacks."""
        if 2 * (self.used + len(keys)) > self.keys.size:
            had = self.keys != -1
            keys, values = np.concatenate((self.keys[had], keys)), np.concatenate((self.values[had], values))
            size = self.keys.size
            while 4 * len(keys) > size:
                size *= 2
            self.keys, self.values, self.used = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), 0
        self.used += len(keys)
        while len(keys):
            at = self._slots(keys)
            first = np.unique(at, return_index=True)[1]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and what is emitted, for a byte read in each of many states."""
        keys = state << 8 | byte
        at = self._slots(keys)
        if (new := self.keys[at] != keys).any():
            unknown = np.unique(keys[new])
            made = [self._transition(k >> 8, k & 255) for k in unknown.tolist()]
            self._insert(unknown, np.array([n << 16 | (e + (1 << 15)) for n, e in made], dtype=np.int64))
            at = self._slots(keys)
        found = self.values[at]
        return found >> 16, (found & 0xFFFF) - (1 << 15)

    def emitted(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What every byte of `data` emits; `begins` says where pieces begin, the first byte among them.

        The bytes lie in chunks, side by side. A chunk in which a piece begins ends in one state, whatever the state before: its map
        is constant, and is found by running it from there on. Maps compose by a parallel prefix scan, each step over twice the
        distance, until every chunk has the nearest constant map before it; chunks within one long piece, with maps that aren't
        constant, are then run in turn. Last, the bytes before a chunk's first beginning are run from the state that comes in.
        """
        if len(self.states) > MOST_STATES:
            self.reset()
        n = len(data)
        rows = -(-n // CHUNK)
        grid, first = np.zeros(rows * CHUNK, dtype=np.int64), np.zeros(rows * CHUNK, dtype=bool)
        grid[:n], first[:n] = data, begins
        grid, first = np.ascontiguousarray(grid.reshape(rows, CHUNK).T), np.ascontiguousarray(first.reshape(rows, CHUNK).T)
        out = np.zeros((CHUNK, rows), dtype=np.int32)
        constant, start = first.any(axis=0), np.where(first.any(axis=0), first.argmax(axis=0), CHUNK)
        length = np.full(rows, CHUNK)
        length[-1] = n - (rows - 1) * CHUNK

        def run(which: np.ndarray, state: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            for i in range(int(low.min(initial=CHUNK)), int(high.max(initial=0))):
                on = np.flatnonzero((low <= i) & (i < high))
                at = which[on]
                then, out[i, at] = self.step(np.where(first[i, at], 0, state[on]), grid[i, at])
                state[on] = then
            return state

        ends = np.full(rows, -1, dtype=np.int64)
        some = np.flatnonzero(constant)
        ends[some] = run(some, np.zeros(len(some), dtype=np.int64), start[some], length[some])

        nearest, step = np.where(constant, np.arange(rows), -1), 1
        while step < rows:
            nearest[step:] = np.maximum(nearest[step:], nearest[:-step])
            step *= 2
        depth = np.arange(rows) - nearest
        for d in range(1, int(depth.max(initial=0)) + 1):
            inner = np.flatnonzero(depth == d)
            ends[inner] = run(inner, ends[inner - 1], np.zeros(len(inner), dtype=np.int64), length[inner])
        heads = np.flatnonzero(constant & (start > 0))
        run(heads, ends[heads - 1], np.zeros(len(heads), dtype=np.int64), start[heads])
        return out.T.reshape(-1)[:n]


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """The two machines, compiled from a vocabulary file of byte-level BPE with its usual splitter; other files are refused."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        odd = odd or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if odd or any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{file} is no byte-level BPE with the default splitter")
        self.special = [x["content"] for x in spec["added_tokens"]]
        of = _alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        added = set(self.special)
        self.machine = Machine({(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, {raw(x) for x in model["vocab"] if x not in added})
        self._splitter = Tokenizer.from_file(file).pre_tokenizer
        self.classes = np.full(0x110000, UNSEEN, dtype=np.uint8)
        for c, k in {"'": QUOTE, " ": SPACE, "r": R, "v": V, "l": ELL, "e": E, "s": CLOSER, "t": CLOSER, "m": CLOSER, "d": CLOSER, "\x00": OTHER}.items():
            self.classes[ord(c)] = k

    def _learn(self, points: np.ndarray) -> None:
        """Classes of characters not met before, as the vocabulary's own splitter sees them: joined to a letter, a digit, a mark, or none."""
        for point in points.tolist():
            c = chr(point)
            joins = [k for mark, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(self._splitter.pre_tokenize_str(mark + c)) == 1]
            self.classes[point] = joins[0] if joins else BLANK

    def counts(self, docs: list[str]) -> list[int]:
        """Tokens of each text. Special strings in a text are one token each and part what stands around them."""
        segments, owner, total = [], [], [0] * len(docs)
        for i, text in enumerate(docs):
            for special in self.special:
                if special in text:
                    total[i] += text.count(special)
                    text = text.replace(special, "\x00\x00" + special)
            parts = [text]
            for special in self.special:
                parts = [x for p in parts for x in p.split("\x00\x00" + special)] if total[i] else parts
            for p in parts:
                if p:
                    segments.append(p)
                    owner.append(i)
        if not segments:
            return total
        flat = "\n".join(segments) + "\n"
        points = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        classes = self.classes[points]
        if (unseen := classes == UNSEEN).any():
            self._learn(np.unique(points[unseen]))
            classes = self.classes[points]
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        classes[ends] = END
        at = cuts(classes)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(width)))
        data = np.frombuffer(flat.encode(), dtype=np.uint8)
        begins = np.zeros(len(data), dtype=bool)
        begins[offset[at]] = True
        emitted = np.empty(len(data), dtype=np.int64)
        low, starts = 0, offset[at]
        while low < len(data):  # a run ends where a piece begins, so that nothing is carried over
            high = len(data) if len(data) - low <= RUN else int(starts[max(np.searchsorted(starts, low + RUN, side="right") - 1, np.searchsorted(starts, low, side="right"))]) if starts[-1] > low else len(data)
            emitted[low:high] = self.machine.emitted(data[low:high], begins[low:high])
            low = high
        emitted[offset[ends]] = 0
        sums = np.add.reduceat(emitted, np.concatenate((np.zeros(1, dtype=np.int64), offset[ends[:-1] + 1])))
        return (np.bincount(owner, weights=sums, minlength=len(docs)).astype(np.int64) + np.array(total)).tolist()


@cache
def _compiled(file: str) -> Tokens:
    return Tokens(file)


def _count(schema: T.StructType, column: str, file: str, limit: int):
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _compiled(file)
        for part in slices(batches, column):
            docs = [x.decode("utf-8", "replace") for x in texts(part, column)]
            n = tokens.counts(docs)
            made = {"n_bytes": pa.array([len(x) for x in texts(part, column)], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def count_tokens(docs: DataFrame, file: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens of the whole text in the byte-level BPE of `file`, and over_limit (n_tokens > limit).

    No begin, end or added tokens; special strings inside texts count as one token. `file` is a path that every worker can read.
    Null or empty text: 0. Repeated rows: each counted. Columns named like the new ones are replaced. Empty table: empty.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    schema = T.StructType(rows.schema.fields + list(T.StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean")))
    return rows.mapInArrow(_count(schema, text, file, limit), schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")
