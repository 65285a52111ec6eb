"""A corpus written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators.shared import scratch_dir
from .registry import query, read
from .sources import corpus


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS g, octet_length(encode(to_json({'doc_id': doc_id, 'source': source, 'text': text})::VARCHAR)) + 1 AS size, source, n_chars FROM documents)
  SELECT CASE WHEN substr(g, 1, 1) < '8' THEN 'train' ELSE 'test' END AS split, count(*) AS rows, sum(size)::BIGINT AS bytes, count(DISTINCT g) AS groups, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, count(*) AS rows_read, sum(size)::BIGINT AS bytes_read
  FROM d GROUP BY 1""")
def written_corpus(spark, sf_dir):
    """Documents by a hash of their text into two splits: the manifest's figures, and those of what the locked reader gives back."""
    group = F.sha2(F.coalesce("text", F.lit("")), 256)
    split = F.when(F.substring(group, 1, 1) < "8", "train").otherwise("test")
    record = F.to_json(F.struct("doc_id", "source", "text"), {"ignoreNullFields": "false"})
    counts = F.map_from_arrays(F.array(F.lit("chars"), F.concat(F.lit("source/"), F.coalesce("source", F.lit("")))), F.array(F.col("n_chars").cast("long"), F.lit(1).cast("long")))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), split.alias("split"), group.alias("group_id"), F.array(group).alias("contexts"), record.alias("record"), counts.alias("counts"))
    path = f"{scratch_dir(spark)}/adjudex-corpus-{uuid.uuid4().hex}"
    corpus.write_corpus(rows, path, parts=8)
    splits = corpus.manifest(path)["splits"]
    figures = [(k, s["rows"], s["bytes"], s["groups"], s["counts"]["chars"], sum(c.startswith("source/") for c in s["counts"])) for k, s in splits.items()]
    back = corpus.read_locked(spark, path).groupBy(F.element_at(F.split("file", "/"), 3).alias("split")).agg(F.count(F.lit(1)).alias("rows_read"), F.sum(F.octet_length("value") + 1).alias("bytes_read"))
    return spark.createDataFrame(figures, "split string, rows long, bytes long, groups long, chars long, sources long").join(back, "split")
