"""The pipeline's stages on nulls, empty and very long texts, repeated rows, clashing names, and no rows."""

import random

import pytest

import corpus_pipeline

from ..conftest import SF

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean prism quartz ridge slope tower".split()


def text(seed, n=120):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


ROWS = [
    (1, text(1), "en", "a"), (1, text(1), "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, text(4), None, None), (None, text(5), "en", "b"), (6, text(6) + " Mail me: jo.doe@example.org", "en", "b"),
    (7, text(4), "en", "b"), (8, " ".join(random.Random(8).choices([a + b for a in WORDS for b in WORDS], k=60000)), "en", "b"), (9, "short", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, source, len(t) if t is not None else None, True, "x", "y") for i, t, lang, source in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_entities string, size string")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0))


def run(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), SF).count() == 0
    found = stage(spark, docs, SF)
    assert tuple(found.columns)[:5] == corpus_pipeline.COLUMNS
    return found.collect()


def test_quality_rules(spark, docs):
    got = run(spark, docs, "quality_rules")
    assert ids(got) == [1, 1, 4, 6, 7, 8, None]
    assert {r["doc_id"]: r["text"] for r in got}[4] == text(4) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_dedup(spark, docs):
    got = run(spark, docs, "near_dedup")
    assert ids(got) == [1, 1, 2, 3, 4, 6, 8, 9, None]


def test_decontaminate(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").first()["text"]
    more = docs.unionByName(spark.createDataFrame([(20, f"before {item} after", "en", "a", 1, True, "x", "y")], docs.schema))
    got = run(spark, more, "decontaminate")
    assert ids(got) == ids({"doc_id": r[0]} for r in ROWS)


def test_pii(spark, docs):
    got = {(r["doc_id"], r["text"]) for r in run(spark, docs, "pii")}
    whole = {r[0]: r[1] for r in ROWS}
    (changed,) = (t for i, t in got if i == 6)
    assert {x for x in got if x[0] != 6} == {x for x in whole.items() if x[0] != 6}
    assert changed.startswith(text(6) + " Mail me: ") and changed.endswith(".org") and "jo.doe" not in changed


def test_mix_sources(spark, docs):
    rows = run(spark, docs, "mix_sources")
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS} and all(r["size"] == len((r["text"] or "").split()) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, docs.repartition(3), "mix_sources")))
