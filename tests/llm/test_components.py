"""Components of links: whatever the order of ids, few rounds, and those of a plain search."""

import random

import pytest

from adjudex.llm import near_dedup


def reachable(links):
    least = {x: x for pair in links for x in pair}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                moved = True
    return least


N = 1000
SHAPES = {
    "ascending": [(i, i + 1) for i in range(N)],
    "zigzag": [(0, 200), *[(i, i - 1) for i in range(200, 100, -1)], (100, 1)],
    "shuffled": (lambda ids: list(zip(ids, ids[1:], strict=False)))(random.Random(1).sample(range(90), 90)),
    "star of the greatest": [(N, i) for i in range(N)],
    "stars in a row": [(10 * i + 9, 10 * i + j) for i in range(100) for j in (0, 3, 8)] + [(10 * i + 3, 10 * i + 13) for i in range(99)],
    "repeats and loops": [(5, 5), (7, 3), (3, 7), (3, 9), (20, 21), (21, 20)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, monkeypatch, shape):
    rounds = []

    def counted(df, name="x", *args):
        rounds.append(name)
        return kept(df, name, *args)

    kept = near_dedup.saved
    monkeypatch.setattr(near_dedup, "saved", counted)
    links = SHAPES[shape]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = reachable([x for x in links if x[0] != x[1]])
    assert got == expected
    assert rounds.count("links") - 1 <= 8 and rounds.count("parents") <= 40
    if shape == "ascending":
        assert rounds.count("links") - 1 == 1 and rounds.count("parents") <= 12


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert near_dedup.components(none).columns == ["node", "component"] and near_dedup.components(none).count() == 0
