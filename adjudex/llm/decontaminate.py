"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents."""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, slices, table, texts

WINDOW = 10
#: Words of the blocks by which the search shifts.
BLOCK = 2
#: Text of the benchmark that one pass broadcasts; a larger one is searched for in more passes, each over all documents.
PASS_BYTES = 16 << 20

#: A-Z lower-cased; 0-9, a-z and every byte of a non-ASCII character stay, all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Matcher:
    """Wu-Manber over words for windows of one length in a run of item words.

    The shift table has for each block of BLOCK words how far the search may move on; windows lie in buckets by their last block and
    their first, the prefix check, and are then compared word by word. All of it are sorted arrays, some 40 bytes a word.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        """`starts` are the places in `words` where items begin that have windows of `length` words; each ends where the next begins, or with `words`."""
        self.words, self.length, self.block = words, length, min(BLOCK, length)
        self.far = length - self.block + 1
        ends = np.append(starts[1:], len(words))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.arange(len(words)) - starts[of] + 1  # words of the item up to here
        last = np.flatnonzero(at >= self.block)
        keys, shift = self.keys(words)[last - self.block + 1], np.maximum(0, length - at[last])
        order = np.lexsort((shift, keys))
        self.blocks, first = np.unique(keys[order], return_index=True)
        self.shifts = shift[order][first]
        whole = np.flatnonzero(at >= length) - length + 1
        pair = self.pair(self.keys(words), whole)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.places, self.items = pair[order], whole[order], of[whole[order]]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A key of the block of words that begins at each place."""
        return words[:-1] << 32 | words[1:] if self.block == 2 else words

    def pair(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A key of a window's last block and its first."""
        return keys[at + self.length - self.block] * 0x2545F4914F6CDD1D + keys[at]

    def find(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) of every occurrence. A block that ends no window allows to move on by its shift."""
        m, n = self.length, len(words)
        if n < m:
            return
        keys = self.keys(words)
        at = np.minimum(np.searchsorted(self.blocks, keys), len(self.blocks) - 1)
        shifts = np.where(self.blocks[at] == keys, self.shifts[at], self.far).tolist()
        end, hits = m - self.block, []
        while end < len(shifts):
            step = shifts[end]
            if not step:
                hits.append(end - m + self.block)
                step = 1
            end += step
        if hits:
            starts = np.array(hits)
            pair = self.pair(keys, starts)
            low, high = np.searchsorted(self.pairs, pair), np.searchsorted(self.pairs, pair, side="right")
            for start, a, b in zip(hits, low.tolist(), high.tolist(), strict=True):
                here = words[start : start + m]
                for k in range(a, b):
                    place = self.places[k]
                    if (self.words[place : place + m] == here).all():
                        yield start, int(self.items[k])


class Benchmark:
    """Windows of one block of items, and a matcher for each length of window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
        for name, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], dtype=np.int64)
            if len(words):
                by_length[min(window, len(words))].append((name, words))
        self.matchers = []
        for length, own in sorted(by_length.items()):
            starts = np.cumsum([0, *[len(w) for _, w in own[:-1]]])
            self.matchers.append(([name for name, _ in own], Matcher(np.concatenate([w for _, w in own]), starts, length)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences, joined where they overlap, and the items found. Words of no item are 0 and match nothing."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int64)
        spans, items = [], set()
        for names, matcher in self.matchers:
            for start, item in matcher.find(ids):
                spans.append((start, start + matcher.length))
                items.add(names[item])
        return joined(spans), items


#: The benchmark that a worker has built last, by the name of its broadcast: tasks that follow find it made.
_BUILT: dict[str, Benchmark] = {}


def _built(name: str, known, window: int) -> Benchmark:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(pickle.loads(known.value), window)
    return _BUILT[name]


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _search(schema: T.StructType, column: str, name: str, known, window: int, made_: dict[str, str]):
    names = [f.name for f in schema]
    spans_, items_, words_ = made_["spans"], made_["items"], made_["words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _built(name, known, window)
        for part in slices(batches, column):
            spans, items, sizes = [], [], []
            for text, before, had in zip(texts(part, column), part.column(spans_).to_pylist(), part.column(items_).to_pylist(), strict=True):
                words = words_of(text)
                found, who = bench.search(words)
                spans.append([x for s in joined([*found, *zip(before[::2], before[1::2], strict=True)]) for x in s])
                items.append(sorted(who | set(had)))
                sizes.append(len(words))
            made = {spans_: pa.array(spans, pa.list_(pa.int32())), items_: pa.array(items, pa.list_(pa.string())), words_: pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in names], names=names)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, hit_spans (word positions, from and to in turn), n_items, items, items_sha256 and contaminated.

    Windows are `window` consecutive words of an item, or all words of a shorter one. The benchmark goes to every task in blocks of
    about `pass_bytes`, so that what is broadcast has a bound (one item is not parted); a worker builds its tables once. With one
    block no row is shuffled, with more of them each pass writes what it has found, and the next goes on from there.

    Null or empty text, of documents or items: no words, nothing found. Items of one id count once; a null item_id stands as an
    empty string. Repeated documents: each searched. Columns named like the new ones are replaced, all others pass through. Empty
    tables: nothing found, or no rows.
    """
    new = ("n_words", "n_hit", "hit_spans", "n_items", "items", "items_sha256", "contaminated")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    n = {c: free_name(docs, f"found_{c}") for c in ("spans", "items", "words", "text")}
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    passes = max(1, -(-size // pass_bytes))
    rows = docs.select(*kept, F.col(f"`{text}`").alias(n["text"]), F.array().cast("array<int>").alias(n["spans"]), F.array().cast("array<string>").alias(n["items"]), F.lit(0).cast("long").alias(n["words"]))
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == k).collect()
        known = docs.sparkSession.sparkContext.broadcast(pickle.dumps([(r["name"], r["text"].encode()) for r in block]))
        rows = rows.mapInArrow(_search(rows.schema, n["text"], uuid.uuid4().hex, known, window, n), rows.schema)
        if passes > 1:
            rows = saved(rows, "searched")
    spans, found = F.col(n["spans"]), F.col(n["items"])
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")
    rows = rows.withColumn(n["text"], hit)  # the text is not needed any more
    return rows.select(
        *kept, F.col(n["words"]).alias("n_words"), F.col(n["text"]).alias("n_hit"), spans.alias("hit_spans"), F.size(found).cast("long").alias("n_items"), found.alias("items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"), (F.col(n["text"]) > 0).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dp AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
dw AS (SELECT r, i, m, array_to_string(ws[i : i + m - 1], ' ') AS win FROM dp JOIN (SELECT DISTINCT m FROM bw) ON i + m - 1 <= len(ws)),
hits AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS x FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
