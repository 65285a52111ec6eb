"""What goes to the driver has a bound that tasks don't multiply, and what is picked doesn't hang on them."""

import pytest
from pyspark.sql import functions as F

from adjudex.llm import html_extract, lm_score
from adjudex.llm.common import sampled


def test_samples_are_bounded_and_the_same_on_any_number_of_tasks(spark):
    rows = spark.range(20000)
    key = F.col("id").cast("string")
    few, many = (sampled(rows.repartition(n), 200, key) for n in (2, 64))
    assert 200 <= few.count() <= 200 + 12 * 200**0.5 + 40
    assert {r[0] for r in few.collect()} == {r[0] for r in many.collect()}
    first = lambda df: [r[0] for r in df.orderBy(F.xxhash64(key)).limit(200).collect()]
    assert len(first(few)) == 200 and sampled(rows, 20000, key).count() == 20000 and sampled(rows.limit(0), 5, key).count() == 0


@pytest.mark.parametrize("most", [0, 1, 10, 300, 5000])
def test_frequent_words_are_the_greatest_counts(spark, most):
    words = spark.range(1, 2001).select(F.concat(F.lit("w"), "id").alias("word"), (F.lit(1000000) / F.col("id")).cast("long").alias("c"))
    got = [r["c"] for r in lm_score._frequent(words.repartition(16), most).collect()]
    rest = [r["c"] for r in words.collect()]
    assert len(got) <= most and sorted(got) == sorted(rest)[len(rest) - len(got) :]
    assert len(got) == 2000 if most >= 2000 else len(got) >= most * 0.9 - 1


def test_training_pages(spark):
    page = "<html><nav><a href=/>Home</a></nav><article><p>{}</p></article></html>"
    rows = [(i, page.format("some words of a page " * 20)) for i in range(40)] + [(99, page.format("x " * html_extract.TRAIN_BYTES)), (100, None), (101, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert html_extract.train(pages, most=10) and html_extract.train(pages.limit(0)) and html_extract.train(pages.filter("page_id > 99"))
