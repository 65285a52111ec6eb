"""Periodic runs of words by recompression: a harmonic grid proposes periods, common extensions in a run-length grammar settle them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, slices, table, texts, word_spans

#: A run has so many words, and so many periods, at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Grid points looked at in one go.
BLOCK = 1 << 20
#: Symbols at which the grammar stops; a level of so few is walked through.
TOP = 32
#: Partitions of the alphabet of which a round of pairs takes the one with most pairs.
DRAWS = 4


class Grammar:
    """A run-length grammar of a sequence by recompression, level by level.

    A round of blocks makes one symbol of each run of a symbol. A round of pairs parts the alphabet in two and makes one symbol of
    each pair with a left and a right symbol. What a symbol becomes depends on the symbol and its neighbours alone, so equal
    stretches are cut alike but for their ends. Nodes of all levels lie in one row, each level with an end mark behind it; a node
    knows its parent and its first child, -1 at the top and at the bottom.
    """

    def __init__(self, symbols: np.ndarray):
        levels = [(symbols.astype(np.int64), np.ones(len(symbols), dtype=np.int64), None, False)]
        fresh, salt = int(symbols.max(initial=0)) + 1, 0
        while len(levels[-1][0]) > TOP and salt < 512:
            for compressed in (self._blocks, self._pairs):
                top, sizes = levels[-1][:2]
                made = compressed(top, fresh, salt)
                if made:
                    symbol, first, fresh = made
                    levels.append((symbol, np.add.reduceat(sizes, first), first, compressed == self._blocks))
            salt += DRAWS
        begins = np.cumsum([0, *[len(x[0]) + 1 for x in levels]])
        n = int(begins[-1])
        self.symbol, self.size = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.parent, self.first = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        self.in_block = np.zeros(n, dtype=bool)
        for k, (symbol, sizes, first, block) in enumerate(levels):
            at, end = begins[k], begins[k + 1] - 1
            self.symbol[at:end], self.size[at:end], self.symbol[end] = symbol, sizes, -1 - k
            if k:
                below = begins[k - 1]
                self.first[at:end], self.first[end] = below + first, at - 1
                self.parent[below : at - 1] = at + np.repeat(np.arange(len(first)), np.diff(first, append=at - 1 - below))
                self.parent[at - 1] = end
                self.in_block[below:at] = block

    @staticmethod
    def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        """A new symbol for each distinct key."""
        known, which = np.unique(keys, return_inverse=True)
        return fresh + which, fresh + len(known)

    @classmethod
    def _blocks(cls, top: np.ndarray, fresh: int, _: int):
        first = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1))
        if len(first) == len(top):
            return None
        sizes = np.diff(first, append=len(top))
        symbol, long = top[first], sizes > 1
        symbol[long], fresh = cls._named(symbol[long] << 32 | sizes[long], fresh)
        return symbol, first, fresh

    @classmethod
    def _pairs(cls, top: np.ndarray, fresh: int, salt: int):
        best = np.empty(0, dtype=np.int64)
        for draw in range(DRAWS):
            mixed = (top.astype(np.uint64) + np.uint64(salt + draw)) * np.uint64(0x9E3779B97F4A7C15)
            right = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1
            found = np.flatnonzero(~right[:-1] & right[1:])
            best = found if len(found) > len(best) else best
        if not len(best):
            return None
        stay = np.ones(len(top), dtype=bool)
        stay[best + 1] = False
        named, fresh = cls._named(top[best] << 32 | top[best + 1], fresh)
        symbol = top.copy()
        symbol[best] = named
        return symbol[stay], np.flatnonzero(stay), fresh

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """For each i < j, how many symbols from place i on are those from place j on; with `back`, how many before i those before j.

        All pairs walk at once. Where both places begin (end) equal symbols of the next level, a pair climbs; else it passes equal
        symbols of its level, those of a block together; else it goes down, and is done at the bottom.
        """
        out, which = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        i, j, shift = i.astype(np.int64), j.astype(np.int64), int(back)
        while len(which):
            above_i, above_j = self.parent[i], self.parent[j]
            up = (above_i >= 0) & (self.first[above_i] == i) & (self.first[above_j] == j)
            up &= self.symbol[above_i - shift] == self.symbol[above_j - shift]
            equal = ~up & (self.symbol[i - shift] == self.symbol[j - shift])
            down = ~up & ~equal
            if equal.any():
                a, b = i[equal], j[equal]
                step = np.ones(len(a), dtype=np.int64)
                block = self.in_block[a]
                x, y = a[block], b[block]
                step[block] = np.minimum(x - self.first[self.parent[x - 1]], y - self.first[self.parent[y - 1]]) if back else np.minimum(self.first[self.parent[x] + 1] - x, self.first[self.parent[y] + 1] - y)
                out[which[equal]] += step * self.size[a - shift]
                i[equal], j[equal] = (a - step, b - step) if back else (a + step, b + step)
            i[up], j[up] = above_i[up], above_j[up]
            i[down], j[down] = self.first[i[down]], self.first[j[down]]
            going = i >= 0
            which, i, j = which[going], i[going], j[going]
        return out


def _grid(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x and periods p in [low, high) at which a run may lie: grid points of a text, where the words of a run would have to agree.

    The grid's stride is p, or its greatest multiple up to a third of the least run: a run holds three grid points, and with the first
    of them as x all words from x to x + 2 * stride. Blocks of about BLOCK grid points.
    """
    texts_ = np.flatnonzero(sizes >= MIN_PERIODS * low)
    most = np.minimum(high - 1, sizes[texts_] // MIN_PERIODS)
    of = np.repeat(texts_, most - low + 1)
    p = np.arange(len(of)) - np.repeat(np.cumsum(most - low + 1) - (most - low + 1), most - low + 1) + low
    stride = p * np.maximum(1, least // MIN_PERIODS // p)
    points = np.maximum((sizes[of] - 1) // stride - 1, 0)
    run, at = np.cumsum(points), 0
    while at < len(of):
        stop = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + BLOCK, side="right")))
        part = slice(at, stop)
        pair = np.repeat(np.arange(at, stop), points[part])
        k = np.arange(len(pair)) - np.repeat(run[part] - points[part] - (run[at - 1] if at else 0), points[part])
        s, q = stride[pair], p[pair]
        x = begins[of[pair]] + k * s
        for eighths in (0, 8, 4, 2, 6, 1, 7, 3, 5):
            y = x + s * eighths // 8
            same = words[y] == words[y + q]
            x, q, s = x[same], q[same], s[same]
        yield x, q
        at = stop


def word_runs(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of the texts that lie in `words`, each between marks that stand nowhere else.

    Periods go up in octaves. A place within a run whose period divides the one asked for is passed over: what repeats there is that
    run. Others are extended both ways in the grammar, which is built when the first place asks for it; of a stretch found with several
    periods the smallest stays.
    """
    empty = np.empty(0, dtype=np.int64)
    found, grammar = (empty, empty, empty), None
    low, top = 1, int(sizes.max(initial=0)) // MIN_PERIODS if sizes.max(initial=0) >= least else 0
    while low <= top:
        for x, p in _grid(words, begins, sizes, low, 2 * low, least):
            known = found[1] >= 2 * MIN_PERIODS * found[2]
            starts, ends, periods = found[0][known], (found[0] + found[1])[known], found[2][known]
            if len(starts) and len(x):
                r = np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)
                new = (starts[r] > x) | (ends[r] <= x + p) | (p % periods[r] != 0)
                x, p = x[new], p[new]
            if not len(x):
                continue
            grammar = grammar or Grammar(words)
            before, after = grammar.common(x, x + p, back=True), grammar.common(x, x + p)
            length = before + p + after
            whole = length >= np.maximum(least, MIN_PERIODS * p)
            got = [np.concatenate(pair) for pair in zip(found, ((x - before)[whole], length[whole], p[whole]), strict=True)]
            order = np.lexsort((got[2], got[1], got[0]))
            got = [g[order] for g in got]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1])
            found = tuple(g[first] for g in got)
        low *= 2
    return found


def _numbered(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as numbers, with marks around each text that stand nowhere else; where texts begin, and how many words they have."""
    number: dict[bytes, int] = defaultdict(count(len(docs) + 1).__next__)
    parts, sizes = [np.array([0], dtype=np.int32)], np.zeros(len(docs), dtype=np.int64)
    for d, text in enumerate(docs):
        for words in word_spans(text):
            parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes[d] += len(words)
        parts.append(np.array([d + 1], dtype=np.int32))
    return np.concatenate(parts), np.cumsum(sizes + 1) - sizes, sizes


def _collapsed(text: bytes, n: int, runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space; `runs` has starts, lengths, periods."""
    if not len(runs):
        return b" ".join(w for words in word_spans(text) for w in words)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep, at, out = np.cumsum(change) == 0, 0, []
    for words in word_spans(text):
        out.extend(compress(words, keep[at : at + len(words)]))
        at += len(words)
    return b" ".join(out)


def _best(runs: list[list[int]]) -> list[int]:
    """The run with the greatest length / period; of equals the first by start, then period, as `runs` are ordered."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_NEW = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(schema: T.StructType, column: str, least: int):
    names = [f.name for f in schema]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            docs = texts(part, column)
            words, begins, sizes = _numbered(docs)
            start, length, period = word_runs(words, begins, sizes, least)
            of = np.searchsorted(begins, start, side="right") - 1
            rows = np.stack((start - begins[of], length, period), axis=1)
            bounds = np.searchsorted(of, np.arange(len(docs) + 1))
            own = [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            best = [_best(r.tolist()) if len(r) else None for r in own]
            flat = rows.T.copy()
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["start", "length", "period"])).cast(run_type)
            made = {
                "n_words": pa.array(sizes), "n_runs": pa.array(np.diff(bounds), pa.int64()), "runs": runs,
                **{name: pa.array([b and b[k] for b in best], pa.int64()) for k, name in enumerate(("start", "length", "period"))},
                "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                "collapsed": pa.array([_collapsed(x, n, r) for x, n, r in zip(docs, sizes.tolist(), own, strict=True)], pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def find_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """`docs` with n_words, all `runs` of words (start, length, smallest period) in order of start, then period, and `collapsed`.

    A run is a stretch of at least `least` words (3 or more) and three periods in which words one period apart are the same, and that
    no neighbouring word carries on. `collapsed` is the text without the words that a run contains after its first period, one space
    between words. n_runs counts runs; start, length, period and exponent_milli (1000 * length / period, floored) are those of the
    run with the greatest length / period, ties by start, then period; null without runs.

    Texts are worked on whole, in slices of a few MB; a longer text is a slice of its own, at about 100 bytes a word. No row is
    shuffled. Null or empty text: no words, no runs, collapsed to an empty text. Repeated rows: each searched. Columns named like the
    new ones are replaced, all others, the text among them, pass through. Empty table: empty.
    """
    new = T.StructType.fromDDL(_NEW)
    made = {f.name for f in new}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    schema = T.StructType(rows.schema.fields + new.fields)
    return rows.mapInArrow(_find(schema, text, least), schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where texts whose id's crc32 is a multiple of ten are made to repeat from some word on, with a period of some words.

    Null doc_id: hashed as an empty text. Null text: null. Text without words: as it is.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.select("doc_id", "text", "words", "g", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    rows = rows.select("doc_id", "text", "words", "n", "a", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
