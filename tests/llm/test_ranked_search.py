"""Ranked search held against brute force: many shards and bundles, ties, nulls, repeated rows, both ways to the vocabulary."""

import math
import random
import re
from collections import Counter

import pytest

from adjudex.llm.ranked_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    held = [(i, Counter(TERM.findall(t.translate(FOLD)))) for i, t, *_ in docs if t and TERM.search(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        rows = []
        for doc, c in held:
            m = 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(i, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_docs": 7, "bundle": 2, "owners": 3}, {"shard_docs": 16, "bundle": 3, "vocabulary_bytes": 0}, {"owners": 1, "bundle": 1, "vocabulary_bytes": 1200}])
def test_search_equals_brute_force(spark, options):
    rng = random.Random(7)
    words = ["The", "of", "é-t", "x1", "Ab", "rare", "seldom", "東京", "mid", "zeta"]
    text = lambda n: " ".join(rng.choices(words, weights=[20, 12, 6, 5, 4, 1, 1, 2, 3, 3], k=n))
    docs = [(i, text(rng.randrange(1, 40)), "x") for i in range(150)]
    docs += [(i, "The copy of rare x1", "x") for i in range(200, 260)] + [(300, "The copy of rare x1", "x")] * 3
    docs += [(None, "rare seldom", "x"), (400, None, "x"), (401, "", "x"), (402, " .,; ", "x"), (403, "the " * 50000 + "seldom", "x")]
    items = [(1, "the OF the"), (2, "rare"), (2, "seldom!"), (3, None), (4, ""), (5, "no such thing"), (None, "東京 é"), (6, "copy"), (7, text(60))]
    got = search(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string"), k=20, **options)
    assert rows(got) == brute(docs, items, 20)


def test_empty_tables_and_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert rows(search(docs.limit(0), items)) == [] and rows(search(docs, items.limit(0))) == []
    assert [r[2] for r in sorted(rows(search(docs, items)), key=lambda r: r[1])] == ["a", "b", None]
