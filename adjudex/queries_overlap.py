"""How much documents of a language overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import overlap
from .registry import query, read

_SETS = r"""w AS (SELECT doc_id, lang, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []) AS ws FROM documents),
  s AS (SELECT doc_id, lang, array_to_string(ws, ' ') AS said, list_distinct(list_transform(range(1, greatest(1, len(ws) - 2) + 1), lambda i: array_to_string(ws[i : i + 2], ' '))) AS sh FROM w),
  e AS (SELECT doc_id, lang, len(sh) AS n, unnest(sh) AS g FROM s),
  c AS (SELECT x.lang, x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) + any_value(y.n) AS total FROM e x JOIN e y ON x.lang = y.lang AND x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2, 3),
  p AS (SELECT x.lang, x.doc_id AS a, y.doc_id AS b, coalesce(k / (total - k), 0) AS similarity FROM s x JOIN s y ON x.lang = y.lang AND x.doc_id < y.doc_id LEFT JOIN c ON c.a = x.doc_id AND c.b = y.doc_id)"""


def _cards(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", "doc_id", overlap.words_of(F.col("text")).alias("words"))


@query(f"""WITH {_SETS} SELECT s.lang AS category, count(*) AS cards, count(DISTINCT said) AS constructions, any_value(most) AS max_overlap, any_value(mean) AS mean_overlap
  FROM s JOIN (SELECT lang, max(similarity) AS most, avg(similarity) AS mean FROM p GROUP BY lang) m ON s.lang = m.lang GROUP BY s.lang""")
def language_overlap(spark, sf_dir):
    return overlap.overlap_report(_cards(spark, sf_dir), "lang", "doc_id", "words")[0]


@query(f"WITH {_SETS} SELECT lang AS category, rank::INTEGER AS rank, similarity, a, b FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY similarity DESC, a DESC, b DESC) AS rank FROM p) WHERE rank <= 10")
def closest_documents(spark, sf_dir):
    all_ = overlap.Overlap(_cards(spark, sf_dir), "lang", "doc_id", "words")
    return all_.closest()
