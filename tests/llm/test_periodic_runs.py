"""Runs held against brute force over all periods; the grammar against its sequence."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from adjudex.llm.periodic_runs import Grammar, find_runs, word_runs
from adjudex.llm.queries import QUERIES

from ..conftest import SF


def brute_runs(words, least=24):
    """All runs by trying every period: stretches of equal words one period apart; a stretch keeps its smallest period."""
    n, found = len(words), {}
    w = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.empty(0, dtype=int)
    for p in range(1, n // 3 + 1):
        same = np.concatenate(([False], w[p:] == w[:-p], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + p >= max(least, 3 * p):
                found.setdefault((a, b - a + p), p)
    return sorted((s, n_, p) for (s, n_), p in found.items())


def brute_row(words):
    runs = brute_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    return len(runs), *best, digest, hashlib.sha256(collapsed).hexdigest()


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:] == brute_row(planted(r["doc_id"], (docs[r["doc_id"]] or "").encode().split())), r["doc_id"]


def made(rng):
    """A text with repeats of repeats, broken here and there."""
    words = [rng.choice("abcdef") for _ in range(rng.randrange(0, 9))]
    for _ in range(rng.randrange(0, 4)):
        part = words[rng.randrange(len(words) + 1) :] or ["a"]
        words = (words + part * rng.randrange(1, 14))[:900]
        if rng.random() < 0.5 and words:
            words[rng.randrange(len(words))] = rng.choice("abz")
        words += [rng.choice("abcdef") for _ in range(rng.randrange(0, 5))]
    return words


def test_made_up_texts_equal_brute_force():
    rng = random.Random(3)
    docs = [made(rng) for _ in range(300)] + [["a"] * 700, ["a", "b"] * 300, ["a"] * 23, ["a"] * 24, [], ["x"]]
    size = max(map(len, docs))
    for group in (docs, *[[d] for d in docs[-6:]]):
        marks, words, begins = len(group), [0], []
        for k, d in enumerate(group):
            begins.append(len(words))
            words += [marks + 1 + ord(w) for w in d] + [k + 1]
        found = np.stack(word_runs(np.array(words, dtype=np.int32), np.array(begins), np.array([len(d) for d in group])), axis=1).tolist()
        expected = [(b + s, n, p) for d, b in zip(group, begins, strict=True) for s, n, p in brute_runs(d)]
        assert [tuple(x) for x in found] == expected
    assert size > 600


@pytest.mark.parametrize("back", [False, True])
def test_common_extensions_are_those_of_the_sequence(back):
    rng = random.Random(11)
    for _ in range(40):
        body = [2 + ord(w) for w in made(rng)]
        s = np.array([0, *body, 1], dtype=np.int32)
        places = list(range(1, len(body) + 1))
        pairs = [(i, j) for i in places for j in places if i < j]
        pairs = np.array(rng.sample(pairs, min(len(pairs), 200)), dtype=np.int64).reshape(-1, 2)
        got = Grammar(s).common(pairs[:, 0], pairs[:, 1], back)
        for (i, j), n in zip(pairs.tolist(), got.tolist(), strict=True):
            k = 0
            while (s[i - 1 - k] == s[j - 1 - k]) if back else (s[i + k] == s[j + k]):
                k += 1
            assert n == k


def test_grammar_is_small_and_low():
    rng = np.random.default_rng(1)
    s = np.concatenate(([0], rng.integers(2, 50, 40000), np.tile(rng.integers(2, 50, 13), 2000), [1]))
    grammar = Grammar(s)
    assert len(grammar.symbol) < 7 * len(s)
    level, depth = np.array([0]), 0
    while grammar.parent[level[0]] >= 0:
        level, depth = grammar.parent[level], depth + 1
    assert depth < 120


def test_odd_rows(spark):
    long = "one two three " * 20000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, long, "x"), (4, long, "x"), (None, "a b c", "x"), (5, "w" * 200000, "x"), (6, "é " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in find_runs(docs).collect()}
    assert find_runs(docs).count() == len(rows) and find_runs(docs.limit(0)).count() == 0
    assert (got[1]["n_words"], got[1]["n_runs"], got[1]["runs"], got[1]["collapsed"], got[1]["period"]) == (0, 0, [], "", None)
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 60000, 3)] and got[4]["collapsed"] == "one two three" and got[4]["exponent_milli"] == 20000000
    assert [tuple(r) for r in got[6]["runs"]] == [(0, 30, 1)] and got[6]["collapsed"] == "é" and got[None]["collapsed"] == "a b c"
