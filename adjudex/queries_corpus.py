"""Queries over converters, negatives, lookups, views, samples and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import corpus, facts
from .registry import query, read

_KEY = r"'text:' || sha256(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')))"


def _yes_no(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return corpus.yes_no(rows.withColumn("question", F.lit("Is it good?")), "quality", "text", "question", "good", "lang", "doc_id")


@query(f"SELECT sha256('quality|' || doc_id) AS id, 'reading' AS task, (quality = 1)::VARCHAR AS target, {_KEY.format('text')} AS context_key, lang AS original_split FROM documents JOIN labels USING (doc_id)")
def yes_no_cases(spark, sf_dir):
    return _yes_no(spark, sf_dir).select("id", "task", "target", F.col("context_keys")[0].alias("context_key"), "original_split")


def _pairs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    l = turns.filter("turn = 0").select("conv_id", F.col("text").alias("first"))
    r = turns.filter("turn = 1").select("conv_id", F.col("text").alias("second"))
    rows = l.join(r, "conv_id").withColumns({"same": F.length("first") > F.length("second"), "split": F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train")})
    return corpus.sentence_pairs(rows, "turns", "first", "second", "same", "split", "conv_id")


@query(f"""SELECT sha256('turns|' || a.conv_id) AS id, (length(a.text) > length(b.text))::VARCHAR AS target, {_KEY.format('a.text')} AS first_key, {_KEY.format('b.text')} AS second_key, CASE WHEN a.conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS original_split
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1""")
def pair_cases(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "target", F.col("context_keys")[0].alias("first_key"), F.col("context_keys")[1].alias("second_key"), "original_split")


@query("SELECT sha256('events|' || event_id) AS id, ((value >= 5)::INTEGER + (value >= 20)::INTEGER + (value >= 100)::INTEGER)::VARCHAR AS target, '[\"level 0\",\"level 1\",\"level 2\",\"level 3\"]' AS criteria FROM events")
def band_cases(spark, sf_dir):
    return corpus.banded(read(spark, sf_dir, "events"), "events", "event_type", "value", [5, 20, 100], "event_type", "event_id").select("id", "target", "criteria")


@query("""WITH o AS (SELECT DISTINCT source AS option FROM documents), n AS (SELECT doc_id, source, option, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('negative|' || doc_id || '|' || option)) AS r FROM documents, o WHERE option <> source),
  t AS (SELECT doc_id, option FROM n WHERE r <= 3 UNION ALL SELECT doc_id, source FROM documents) SELECT doc_id, string_agg(option, ',' ORDER BY sha256('order|' || doc_id || '|' || option)) AS options FROM t GROUP BY doc_id""")
def negative_options(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.with_negatives(docs, docs, "doc_id", "source", "source", 4).select("doc_id", F.array_join("options", ",").alias("options"))


@query(r"""WITH k AS (SELECT doc_id, lang, sha256(trim(regexp_replace(lower(left(text, 30)), '\s+', ' ', 'g'))) AS key FROM documents), o AS (SELECT key, min(lang) AS lo, max(lang) AS hi FROM k WHERE doc_id % 3 = 0 GROUP BY key)
  SELECT doc_id, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'contradictory' WHEN lo <> lang THEN 'other label' ELSE 'ok' END AS status FROM k LEFT JOIN o USING (key)""")
def lookup_status(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(X.squeezed(F.substring("text", 1, 30)), 256).alias("key"))
    return corpus.looked_up(rows, rows.filter("doc_id % 3 = 0"), "key", "lang").select("doc_id", "status")


_REASON = r"CASE WHEN coalesce(len(regexp_extract_all(text, '\S+')), 0) < 30 THEN 'short' WHEN lang = 'de' THEN 'language' WHEN contains(text, '@') THEN 'address' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT coalesce({_REASON}, 'kept') AS reason FROM documents) GROUP BY reason")
def rejection_reasons(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kept, counts = corpus.rejections(docs, {"short": X.count_words(F.col("text")) < 30, "language": F.col("lang") == "de", "address": F.col("text").contains("@")})
    return counts.unionAll(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


@query("""SELECT sha256('{"dataset":"' || lang || '","parts":["' || least(source, lang) || '","' || greatest(source, lang) || '"]}') AS key, count(*) AS n FROM documents GROUP BY 1""")
def semantic_keys(spark, sf_dir):
    key = corpus.semantic_key(F.col("lang"), F.col("source"), F.col("lang"), unordered=True)
    return read(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT DISTINCT user_id AS root, sha256(event_type || floor(value)::BIGINT) AS k FROM events), b AS (SELECT root, left(k, 2) AS b, sha256(string_agg(k, ',' ORDER BY k)) AS h FROM k GROUP BY ALL)
  SELECT root, sha256(string_agg(b || h, ',' ORDER BY b || h)) AS group_id FROM b GROUP BY root""")
def component_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.concat("event_type", F.floor("value").cast("long").cast("string")).alias("key"))
    return corpus.group_ids(e)


@query("""WITH c AS (SELECT sha256('turns|' || a.conv_id) AS id, length(a.text) > length(b.text) AS same, a.conv_id % 5 = 0 AS test FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)
  SELECT id, unnest([0, 1, 2]) AS view, unnest([NULL, 'complement', 'invariant']) AS relation, unnest([same::VARCHAR, (NOT same)::VARCHAR, same::VARCHAR]) AS target,
  unnest(['Do both', CASE WHEN test THEN 'Is the answer NO' ELSE 'Is it false' END, 'Do both']) AS begins FROM c""")
def bundled_views(spark, sf_dir):
    views = corpus.bundle_views(_pairs(spark, sf_dir).withColumn("split", F.col("original_split")))
    begins = F.regexp_extract("instructions", "^(Do both|Is the answer NO|Is it false)", 1)
    return views.select("id", "view", "relation", "target", begins.alias("begins"))


@query("""WITH r AS (SELECT doc_id, lang, source, toxic, CASE source WHEN 'src0' THEN 12 WHEN 'src1' THEN 3 ELSE 5 END AS q, row_number() OVER (PARTITION BY lang, source, toxic ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents JOIN labels USING (doc_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY r, toxic) AS n FROM r WHERE r <= q) SELECT doc_id, lang, source FROM n WHERE n <= q""")
def quota_samples(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "toxic")
    return corpus.quota_sample(rows, ["toxic"], F.struct(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"), "source", "lang", {"src0": 12, "src1": 3}, 5).select("doc_id", "lang", "source")


@query()
def disjoint_events(spark, sf_dir):
    """Events taken in hash order, no two of one user or of one minute."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("minute", "ts").alias("minute"))
    return corpus.disjoint_picks(e, "event_id", ["user_id", "minute"], F.sha2(F.col("event_id").cast("string"), 256))


# --- facts -----------------------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT event_id, user_id, ts + INTERVAL 1 HOUR AS t FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, ts, min(value) AS lo, max(value) AS hi FROM events WHERE event_type <> 'error' GROUP BY ALL)
  SELECT q.event_id, CASE WHEN lo = hi THEN lo END AS state FROM q ASOF LEFT JOIN m ON q.user_id = m.user_id AND q.t >= m.ts""")
def state_as_of(spark, sf_dir):
    """What each purchase's user did last, an hour later."""
    e = read(spark, sf_dir, "events")
    q = e.filter("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("interval 1 hour")).alias("query_time"))
    return facts.active_at(q, e.filter("event_type <> 'error'"), ["user_id"], "ts", "value").select("event_id", "state")


@query("""SELECT user_id, count_if(event_type = 'purchase') > 0 AND count_if(event_type = 'error') = 0 AS completed, count_if(event_type = 'purchase') = 0 AND count_if(event_type = 'error') > 0 AS failed, count_if(event_type = 'purchase') > 0 AND count_if(event_type = 'error') > 0 AS conflict
  FROM events WHERE value > 20 GROUP BY user_id""")
def adjudicated_users(spark, sf_dir):
    return facts.adjudicated(read(spark, sf_dir, "events").filter("value > 20"), ["user_id"], "event_type", "purchase", "error")


@query("SELECT event_id FROM events WHERE value > 1 AND event_type IN (SELECT event_type FROM events GROUP BY event_type HAVING avg(value) > (SELECT avg(value) FROM events))")
def trusted_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    mean = e.agg(F.avg("value")).first()[0]
    sources = e.groupBy("event_type").agg(F.avg("value").alias("m")).filter(F.col("m") > mean)
    return facts.trusted(e.withColumn("verified", F.col("value") > 1), sources, "event_type").select("event_id")


@query("""WITH s AS (SELECT user_id, event_type, min(CASE WHEN value > 50 THEN 'success' ELSE 'no_effect' END) AS lo, max(CASE WHEN value > 50 THEN 'success' ELSE 'no_effect' END) AS hi FROM events WHERE value > 2 GROUP BY ALL),
  d AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT d.*, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS k FROM d LEFT JOIN s USING (user_id, event_type))
  SELECT user_id, count(*) AS total, count_if(k = 'success')::BIGINT AS success, count_if(k = 'no_effect')::BIGINT AS no_effect, count_if(k = 'unknown')::BIGINT AS unknown, count_if(k = 'unknown') = 0 AS complete FROM r GROUP BY user_id""")
def item_statuses(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return facts.item_rollup(e, e.filter("value > 2").withColumn("status", F.when(F.col("value") > 50, "success").otherwise("no_effect")), "user_id", "event_type")


_STATUS = "CASE WHEN value > 200 THEN 'reversed' WHEN value > 30 THEN 'confirmed' WHEN value > 5 THEN 'no_effect' ELSE 'unknown' END"


@query(f"""WITH l AS (SELECT user_id, event_type, arg_max({_STATUS}, event_id) AS s FROM events GROUP BY ALL), n AS (SELECT user_id, count_if(s = 'confirmed') AS y, count(*) AS n FROM l GROUP BY user_id)
  SELECT user_id, y = n AS all_confirmed, y > 0 AS any_confirmed, y = 0 AS none_confirmed, CASE WHEN y = 0 THEN 0 WHEN y < n THEN 1 ELSE 2 END AS level FROM n""")
def quantified_facts(spark, sf_dir):
    v = F.col("value")
    return facts.quantified(read(spark, sf_dir, "events").withColumn("status", facts.status_of(v > 200, v > 30, v > 5)), "user_id", "event_type", "event_id", "status")


@query("""WITH f AS (SELECT user_id AS record, count(*) AS n, avg(value) AS m, count_if(event_type = 'purchase') AS p FROM events GROUP BY user_id)
  SELECT record, unnest(['busy', 'mean', 'bought']) AS feature, unnest([(n > 10)::INTEGER::DOUBLE, CASE WHEN n >= 3 THEN m ELSE 0 END, CASE WHEN n >= 3 THEN p ELSE 0 END::DOUBLE]) AS target, unnest([1, (n >= 3)::INTEGER, (n >= 3)::INTEGER]) AS mask FROM f""")
def masked_targets(spark, sf_dir):
    f = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    some = F.col("n") >= 3
    return facts.masked(f, {"busy": (F.col("n") > 10).cast("int"), "mean": F.col("m"), "bought": F.col("p")}, {"busy": F.lit(True), "mean": some, "bought": some})


@query("""WITH c AS (SELECT doc_id // 10 AS family, doc_id, quality, row_number() OVER (PARTITION BY doc_id // 10, quality ORDER BY sha256('|' || doc_id)) AS r FROM labels), k AS (SELECT * FROM c WHERE r <= 4),
  p AS (SELECT a.family, a.doc_id AS left_case, b.doc_id AS right_case, row_number() OVER (PARTITION BY a.family ORDER BY sha256('|' || a.doc_id || '|' || b.doc_id)) AS place FROM k a JOIN k b ON a.family = b.family AND a.doc_id < b.doc_id AND a.quality <> b.quality) SELECT * FROM p WHERE place <= 3""")
def contrast_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("family", F.expr("doc_id div 10"))
    return facts.related_pairs(rows, "family", "doc_id", "quality", False, 3).select("family", "left_case", "right_case", "place")
