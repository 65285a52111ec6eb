import pytest

from adjudex.llm.queries import QUERIES, SQL

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 1024)


def test_html_text_is_the_articles(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op4_html_extraction"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]*$", "", re.sub(r"<(?!\x01)[^>]*>", "", re.sub(r"</?(p|h1|br)>", "\x01", inner))).split("\x01")
        assert r["text"] == " ".join(" ".join(html.unescape(x).split()) for x in parts if x.split())
        assert r["n_chars"] == len(r["text"])


def test_quality_scores_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op7_quality_classifier"](spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_base_scores_are_those_of_counted_words(spark):
    import math
    import zlib
    from collections import Counter

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in docs.items()}
    c = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op10_lm_score"](spark, SF).collect():
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, SF), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before.count()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_keep_what_the_operators_sql_keeps(spark, duck):
    from collections import Counter

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: Counter(r["doc_id"] for r in stages[name](spark, docs, SF).collect())
    rows = lambda sql: duck.execute(sql).fetchall()
    assert ids("quality_rules") == Counter(r[0] for r in rows(f"SELECT doc_id FROM ({SQL['op8_quality_rules']}) WHERE kept"))
    assert ids("decontaminate") == Counter(r[0] for r in rows(f"SELECT doc_id FROM ({SQL['op3_decontaminate']}) WHERE NOT contaminated"))
    mixed = ids("mix_sources")
    for doc_id, size, taken in rows(f"SELECT doc_id, size, taken FROM ({SQL['op9_mix_sources']}) WHERE size > 0"):
        assert mixed[doc_id] * size == taken
