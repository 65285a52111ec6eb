"""Queries over checks: suites, predictions, reviews, families, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import probability as P
from .operators import validation as V
from .queries import _PRED, _predictions
from .registry import query, read

_FIELDS = "f AS (SELECT doc_id AS case_id, 'q' || doc_id % 2 AS question_id, doc_id // 6 AS family, 'noul' AS primitive, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 'yes no' END AS answer_space, quality AS expected FROM labels)"
_KINDS = "CASE doc_id % 4 WHEN 0 THEN 'flip' WHEN 1 THEN 'paraphrase' WHEN 2 THEN 'question_contrast' ELSE CASE WHEN doc_id % 16 = 3 THEN 'odd' ELSE 'flip' END END"


@query(f"""WITH {_FIELDS}, r AS (SELECT 'r' || (doc_id - doc_id % 50 // 49) AS id, {_KINDS} AS kind, doc_id AS lc, 'q' || doc_id % 2 AS lq, doc_id + 1 AS rc, 'q' || (doc_id + 1) % 2 AS rq FROM labels),
  t AS (SELECT id, count(*) AS times FROM r GROUP BY id), j AS (SELECT r.*, times, l.family AS lf, l.answer_space AS la, l.expected AS le, x.family AS xf, x.answer_space AS xa, x.expected AS xe FROM r JOIN t USING (id) LEFT JOIN f l ON lc = l.case_id AND lq = l.question_id LEFT JOIN f x ON rc = x.case_id AND rq = x.question_id),
  k AS (SELECT id, CASE WHEN times > 1 THEN 'repeated id' WHEN kind = 'odd' THEN 'unknown kind' WHEN lf IS NULL OR xf IS NULL THEN 'missing endpoint' WHEN lf <> xf THEN 'other family' WHEN la <> xa THEN 'other answer space' WHEN (le = xe) <> (kind = 'paraphrase') THEN 'contradiction' WHEN kind = 'question_contrast' AND lc <> rc THEN 'other case' END AS fault FROM j)
  SELECT DISTINCT id, fault FROM k WHERE fault IS NOT NULL""")
def suite_faults(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    d, q = F.col("doc_id"), lambda x: F.concat(F.lit("q"), (x % 2).cast("string"))
    fields = labels.select(d.alias("case_id"), q(d).alias("question_id"), F.expr("doc_id div 6").alias("family"), F.lit("noul").alias("primitive"), F.when(d % 13 == 0, "other").otherwise("yes no").alias("answer_space"), F.col("quality").alias("expected"))
    relations = labels.select(F.expr("concat('r', doc_id - doc_id % 50 div 49)").alias("id"), F.expr(_KINDS).alias("kind"), d.alias("left_case"), q(d).alias("left_question"), (d + 1).alias("right_case"), q(d + 1).alias("right_question"))
    return V.relation_faults(relations, fields)


@query("""WITH e AS (SELECT doc_id, quality AS label FROM labels), g AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id + 1000000, 0 FROM labels WHERE doc_id % 17 = 0),
  f AS (SELECT doc_id, count(*) AS times, min(label) AS lo, max(label) AS hi FROM g GROUP BY doc_id), j AS (SELECT doc_id, CASE WHEN times IS NULL THEN 'missing' WHEN label IS NULL THEN 'extra' WHEN times > 1 THEN 'repeated' WHEN lo <> label OR hi <> label THEN 'label' END AS fault FROM e FULL JOIN f USING (doc_id)) SELECT * FROM j WHERE fault IS NOT NULL""")
def prediction_faults(spark, sf_dir):
    e = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = e.filter("doc_id % 7 > 0").unionAll(e.filter("doc_id % 11 = 0").select("doc_id", 1 - F.col("label"))).unionAll(e.filter("doc_id % 17 = 0").select(F.col("doc_id") + 1000000, F.lit(0)))
    return V.repeated_or_missing(e, found, ["doc_id"], "label")


@query(_PRED.format("a") + "SELECT doc_id, 'brier' AS figure, brier + CASE WHEN doc_id % 9 = 0 THEN 1e-6 ELSE 0 END AS stored, brier AS computed FROM pred WHERE doc_id % 9 = 0")
def recomputed_figures(spark, sf_dir):
    """Predictions whose stored figures aren't those of their vectors; every ninth has a Brier score that is off."""
    p = _predictions(spark, sf_dir)
    stored = p.withColumn("brier", F.col("brier") + F.when(F.col("doc_id") % 9 == 0, 1e-6).otherwise(0.0))
    v = F.col("probabilities")
    return V.recomputed(stored, ["doc_id"], {"brier": P.brier(v, F.col("expected")), "nll": P.floored_nll(F.get(v, F.col("expected"))), "max_probability": F.array_max(v)})


@query(r"""WITH k AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents) SELECT doc_id FROM k WHERE source <> 'src0' AND key IN (SELECT key FROM k WHERE source = 'src0')""")
def example_overlap(spark, sf_dir):
    from .functions import text as X

    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(X.squeezed(F.col("text")), 256).alias("key"))
    return V.text_overlap(rows.filter("source = 'src0'"), rows.filter("source <> 'src0'"), "key").select("doc_id")


@query("""WITH c AS (SELECT conv_id // 3 AS family, conv_id, list_distinct(list(role)) AS h, count(*) AS n FROM conversations GROUP BY ALL), p AS (SELECT family, count(*) AS cases, sum(2 - len(list_intersect(h, ['assistant', 'user'])))::BIGINT AS missing, sum(n - len(list_intersect(h, ['assistant', 'user'])))::BIGINT AS extra FROM c GROUP BY family)
  SELECT * FROM p WHERE cases <> 3 OR missing > 0 OR extra > 0""")
def family_coverage(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.expr("conv_id div 3").alias("family"), F.col("conv_id").alias("case_id"), "role")
    return V.family_faults(rows, "family", "role", ("user", "assistant"), 3)


@query("""WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, doc_id FROM documents), o AS (SELECT lang, row_number() OVER (ORDER BY r, lang) - 1 AS place FROM r)
  SELECT p AS prefix, lang AS category, count(*) AS n, count(*) = p // 4 AS balanced FROM o, (VALUES (20), (60), (100)) t(p) WHERE place < p GROUP BY p, lang""")
def balanced_prefixes(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("r <= 100")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r", "lang")) - 1)
    return V.prefix_balance(rows, "lang", "place", {20: 5, 60: 15, 100: 25})


@query("""WITH v AS (SELECT event_type AS feature, floor(value) AS value, 30.0::DOUBLE AS threshold FROM events)
  SELECT feature, count(*) AS n, bool_or(value < threshold) AS below, bool_or(value = threshold) AS at_it, bool_or(value > threshold) AS above, count(DISTINCT value) AS different, bool_or(value < threshold) AND bool_or(value = threshold) AND bool_or(value > threshold) AS covered FROM v GROUP BY feature""")
def covered_features(spark, sf_dir):
    return V.feature_coverage(read(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.floor("value").cast("double").alias("value"), F.lit(30.0).alias("threshold")))


@query("SELECT count(*) AS paired, count_if(conv_id % 10 = 0)::BIGINT AS differ, (SELECT count(*) FROM conversations) - count(*) AS unpaired, count_if(conv_id % 4 = 0)::BIGINT AS rendered_anew FROM conversations WHERE turn < 3")
def record_pairs(spark, sf_dir):
    left = read(spark, sf_dir, "conversations")
    right = left.filter("turn < 3").withColumns({"role": F.when(F.col("conv_id") % 10 == 0, F.lit("other")).otherwise(F.col("role")), "text": F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))})
    return V.paired_records(left, right, ["conv_id", "turn"], ["role"], "text")


@query("""SELECT 'missing' AS fault, count(*) AS n FROM labels WHERE doc_id % 8 = 0 HAVING count(*) > 0 UNION ALL SELECT 'invalid', count(*) FROM labels WHERE doc_id % 8 > 0 AND doc_id % 9 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'flagged', count(*) FROM labels WHERE doc_id % 8 > 0 AND doc_id % 10 = 0 HAVING count(*) > 0 UNION ALL SELECT 'disagreement', count(*) FROM labels WHERE doc_id % 8 > 0 AND doc_id % 9 > 0 AND doc_id % 5 = 0 HAVING count(*) > 0""")
def blind_reviews(spark, sf_dir):
    label = F.when(F.col("quality") == 1, "good").otherwise("bad")
    expected = read(spark, sf_dir, "labels").select("doc_id", label.alias("label"))
    d = F.col("doc_id")
    said = F.when(d % 9 == 0, "neither").when(d % 5 == 0, F.when(F.col("label") == "good", "bad").otherwise("good")).otherwise(F.col("label"))
    reviews = expected.filter(d % 8 > 0).select("doc_id", said.alias("label"), (d % 10 == 0).alias("flagged"))
    return V.blind_review(expected, reviews, ["doc_id"], ["good", "bad"])


@query("""WITH p AS (SELECT DISTINCT sha256(least(lang, source) || chr(0) || greatest(lang, source)) AS pair, CASE doc_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM documents)
  SELECT pair, count_if(split <> 'train')::BIGINT AS splits FROM p GROUP BY pair HAVING bool_or(split = 'train') AND count_if(split <> 'train') > 0""")
def program_overlaps(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 7 == 1, "dev").otherwise("train"))
    return V.program_overlap(rows, "split", "lang", "source")


_READY = {"accuracy": "avg(correct::INTEGER) >= 0.6", "loss": "avg(nll) <= 0.7", "size": "count(*) >= 100", "no_ties": "count(predicted) = count(*)"}


@query(_PRED.format("a") + " UNION ALL ".join(f"SELECT '{k}' AS condition, {c} AS holds FROM pred" for k, c in _READY.items()) + " UNION ALL SELECT 'ready', " + " AND ".join(_READY.values()) + " FROM pred")
def readiness(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    n = F.count(F.lit(1))
    return V.conditions(p, {"accuracy": F.avg(F.col("correct").cast("double")) >= 0.6, "loss": F.avg("nll") <= 0.7, "size": n >= 100, "no_ties": F.count("predicted") == n})


@query("WITH b AS (SELECT event_type, event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events WHERE event_id % 50 < 2) SELECT * FROM b WHERE value < before")
def falling_series(spark, sf_dir):
    return V.non_decreasing(read(spark, sf_dir, "events").filter("event_id % 50 < 2"), "event_type", "event_id", "value")
