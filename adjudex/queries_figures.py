"""Queries over figures: summaries, repeats, ratios, cuts, costs, agreement, sampling, tells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import probability as P
from .operators import detector, metrics
from .queries import _CHUNKS, _GROUP, _PRED, _chunks, _predictions
from .registry import query, read


@query(_PRED.format("a") + """, c AS (SELECT doc_id // 3 AS case_id, count(*) AS n, count_if(correct) AS r, sum(brier) AS b, sum(nll) AS l FROM pred GROUP BY ALL), k AS (SELECT DISTINCT doc_id // 3 AS case_id FROM documents),
  x AS (SELECT *, case_id % 10 > 0 AS valid FROM k LEFT JOIN c USING (case_id))
  SELECT count(*) AS evaluations, count_if(n IS NOT NULL)::BIGINT AS labeled, sum(n)::BIGINT AS fields, count_if(valid) / count(*) AS schema_validity, sum(r) / sum(n) AS field_accuracy, count_if(n IS NOT NULL AND valid AND r = n) / count_if(n IS NOT NULL) AS exact_case_accuracy,
  sum(b) / sum(n) AS brier, sum(l) / sum(n) AS log_loss, 1.0::DOUBLE AS probability_coverage, avg(case_id % 100) AS mean_ms FROM x""")
def run_summary(spark, sf_dir):
    """Three neighbouring documents are the fields of a case."""
    fields = _predictions(spark, sf_dir).withColumn("case_id", F.expr("doc_id div 3"))
    labeled = fields.select("case_id").distinct().withColumn("has", F.lit(True))
    cases = read(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("case_id")).distinct().join(labeled, "case_id", "left")
    cases = cases.select("case_id", (F.col("case_id") % 10 > 0).alias("valid"), F.coalesce("has", F.lit(False)).alias("labeled"), (F.col("case_id") % 100).cast("double").alias("elapsed"))
    return metrics.flat_summary(cases, fields)


def _repeats(spark, sf_dir):
    rows = [_predictions(spark, sf_dir, s).select("doc_id", F.lit(i).alias("repeat"), "predicted") for i, s in enumerate("abc")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query(_PRED.format("a") + ", b AS (" + _PRED.format("b") + "SELECT * FROM pred), c AS (" + _PRED.format("c") + """SELECT * FROM pred), r AS (SELECT doc_id, 0 AS repeat, predicted FROM pred UNION ALL SELECT doc_id, 1, predicted FROM b UNION ALL SELECT doc_id, 2, predicted FROM c)
  SELECT repeat, count(*) AS n, count_if(r.predicted <> p.predicted)::BIGINT AS disagreements FROM r JOIN pred p USING (doc_id) GROUP BY repeat""")
def repeated_runs(spark, sf_dir):
    return metrics.repeats(_repeats(spark, sf_dir), ["doc_id"], "repeat", "predicted")


@query("""WITH r AS (SELECT a.value / b.value AS v FROM events a JOIN events b ON a.event_id = b.event_id - 1 WHERE b.value > 0)
  SELECT 'ratio' AS what, count(v) AS n, median(v) AS median, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, avg(v) AS mean, stddev_pop(v) AS deviation FROM r""")
def paired_ratios(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return metrics.paired_ratio(e.select("event_id", "value"), e.select((F.col("event_id") - 1).alias("event_id"), "value"), ["event_id"], "value")


@query(_PRED.format("a") + "SELECT lang, expected::VARCHAR AS expected, coalesce(predicted::VARCHAR, '__tie__') AS said, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.matrix(_predictions(spark, sf_dir), ["lang"])


_TAG = "CASE source WHEN 'src0' THEN 'first' WHEN 'src1' THEN 'second' ELSE lang || '/' || source END"


@query(_PRED.format("a") + f", t AS (SELECT *, {_TAG} AS tag, doc_id % 2 AS half FROM pred) SELECT '' AS cut, '' AS value, {_GROUP} FROM t UNION ALL SELECT 'tag', tag, {_GROUP} FROM t GROUP BY tag UNION ALL SELECT 'lang*half', lang || '|' || half, {_GROUP} FROM t GROUP BY lang, half")
def crossed_cuts(spark, sf_dir):
    rows = metrics.tagged(_predictions(spark, sf_dir), "source", "lang", {"src0": "first", "src1": "second"}).withColumn("half", F.col("doc_id") % 2)
    return metrics.crossed(rows, [[], ["tag"], ["lang", "half"]])


@query("WITH l AS (SELECT user_id, least(floor(value / 20), 4)::DOUBLE AS e, event_id % 5 AS f FROM events) SELECT user_id, count(*) AS n, avg(abs(f - e)) AS mae, avg(abs(f - e) / 4) AS nmae FROM l GROUP BY user_id")
def scale_errors(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.least(F.floor(F.col("value") / 20), F.lit(4)).alias("e"), (F.col("event_id") % 5).alias("f"), F.lit(5).alias("k"))
    return metrics.level_errors(rows, ["user_id"], "e", "f", "k")


@query(_PRED.format("a") + """, qs AS (SELECT source, avg((CASE WHEN p <> 0.5 THEN (p > 0.5) = (expected = 1) ELSE false END)::INTEGER) AS a, bool_and(CASE WHEN p <> 0.5 THEN (p > 0.5) = (expected = 1) ELSE false END) AS j, avg(pow(p - expected, 2)) AS s, count_if(p = 0.5) AS t, count(*) AS n FROM pred GROUP BY source)
  SELECT count(*) AS questions, sum(n)::BIGINT AS candidates, avg(a) AS accuracy, avg(j::INTEGER) AS joint, avg(s) AS squared, sum(t)::BIGINT AS ambiguous FROM qs""")
def fact_figures(spark, sf_dir):
    return metrics.fact_metrics(_predictions(spark, sf_dir), "source", "p", "expected")


@query(_PRED.format("a") + ", s AS (SELECT doc_id % 7 AS step, lang, nll FROM pred), o AS (SELECT step, avg(m) AS macro FROM (SELECT step, lang, avg(nll) AS m FROM s GROUP BY ALL) GROUP BY step) SELECT 'run' AS run, arg_min(step, macro) AS step, min(macro) AS macro FROM o")
def checkpoint_choice(spark, sf_dir):
    scores = metrics.objective(_predictions(spark, sf_dir).withColumn("step", F.col("doc_id") % 7), ["step"], "lang", "nll")
    return metrics.best_step(scores.withColumn("run", F.lit("run")), ["run"], "step", "macro")


@query(_PRED.format("a") + """, c AS (SELECT source AS name, source = 'src0' AS baseline, avg(correct::INTEGER) AS accuracy, 1 - avg(brier) AS stability, avg(max_probability) AS latency FROM pred GROUP BY source), b AS (SELECT * FROM c WHERE baseline),
  e AS (SELECT c.*, c.accuracy >= b.accuracy - 0.01 AND c.stability >= b.stability - 0.02 AND c.latency <= b.latency * 0.99 AS ok FROM c, b WHERE NOT c.baseline)
  SELECT name, NOT ok AS exploratory FROM e ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN latency ELSE -accuracy END, CASE WHEN ok THEN -accuracy ELSE -stability END, CASE WHEN ok THEN 0 ELSE latency END, name LIMIT 1""")
def candidate_choice(spark, sf_dir):
    rows = _predictions(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), (1 - F.avg("brier")).alias("stability"), F.avg("max_probability").alias("latency"))
    return metrics.gated_pick(rows.withColumn("baseline", F.col("name") == "src0"), speed=0.99)


@query("SELECT event_type, count(*) AS n, avg(value) AS seconds, avg(nullif(event_id % 100, 0)) AS tokens, round(sum(event_id % 100) / 1e6 * 0.042, 8) AS cost FROM events GROUP BY event_type")
def run_costs(spark, sf_dir):
    return metrics.costs(read(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 100), ["event_type"], "value", "tokens", 0.042)


@query("WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type) SELECT event_type, n, mean, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, event_type)::INTEGER AS place FROM g")
def event_breakdown(spark, sf_dir):
    return metrics.breakdown(read(spark, sf_dir, "events"), "event_type", "value")


@query(_PRED.format("a") + ", b AS (" + _PRED.format("b") + "SELECT * FROM pred), x AS (SELECT lang, avg(nll) AS nll, avg(brier) AS brier FROM pred GROUP BY lang), y AS (SELECT lang, avg(nll) AS nll, avg(brier) AS brier FROM b GROUP BY lang) SELECT lang, y.nll - x.nll AS nll, y.brier - x.brier AS brier FROM x JOIN y USING (lang)")
def metric_deltas(spark, sf_dir):
    a, b = (_predictions(spark, sf_dir, s).groupBy("lang").agg(F.avg("nll").alias("nll"), F.avg("brier").alias("brier")) for s in "ab")
    return metrics.deltas(a, b, ["lang"], ["nll", "brier"])


@query(_PRED.format("a") + ", b AS (" + _PRED.format("b") + """SELECT * FROM pred), o AS (SELECT doc_id, 'a' AS system, p, predicted FROM pred UNION ALL SELECT doc_id, 'b', p, predicted FROM b WHERE lang <> 'de'), r AS (SELECT doc_id, lang, expected, doc_id % 2 = 0 AS soft FROM pred),
  g AS (SELECT lang, system, count(*) AS k, count_if(NOT soft)::BIGINT AS determinate, count_if(NOT soft AND predicted = expected)::BIGINT AS matches, avg(CASE WHEN soft THEN abs(p - (0.25 + 0.5 * expected)) END) AS variation FROM o JOIN r USING (doc_id) GROUP BY ALL)
  SELECT lang, system, determinate, matches, variation, questions, matches / nullif(determinate, 0) AS agreement FROM g JOIN (SELECT lang, count(*) AS questions FROM r GROUP BY lang) USING (lang) WHERE k = questions""")
def reference_agreements(spark, sf_dir):
    """Even documents have a probabilistic reference, odd ones a label; system b answered no German ones."""
    a, b = _predictions(spark, sf_dir), _predictions(spark, sf_dir, "b").filter("lang <> 'de'")
    out = [df.select("doc_id", F.lit(s).alias("system"), F.col("predicted").cast("string").alias("label"), "probabilities") for df, s in ((a, "a"), (b, "b"))]
    soft, p = F.col("doc_id") % 2 == 0, 0.25 + 0.5 * F.col("expected")
    refs = a.select("doc_id", "lang", F.when(~soft, F.col("expected").cast("string")).alias("label"), F.when(soft, F.array(1 - p, p)).alias("probabilities"), soft.alias("probabilistic"))
    return metrics.reference_agreement(out[0].unionAll(out[1]), refs, ["lang"], "doc_id", "system")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 8 AS z, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), p AS (SELECT vec_id, token, z - CASE WHEN token % 5 = 0 THEN 1.5 ELSE 0 END AS z FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, token) AS r FROM p), t AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM r WHERE r <= 20),
  q AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY vec_id ORDER BY z DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY vec_id) AS before FROM t)
  SELECT vec_id, token, r::INTEGER AS r, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM q WHERE before < 0.95""")
def nucleus_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "z")).withColumns({"z": F.col("z").cast("double") * 8, "seen": F.col("token") % 5 == 0})
    return metrics.nucleus(rows, "vec_id", "token", "z", "seen")


@query("""WITH b AS (SELECT source, doc_id // 8 AS batch, count(*) AS n, sum(n_chars) AS s, max(n_chars) AS m FROM documents GROUP BY ALL) SELECT source, sum(s)::BIGINT AS tokens, sum(n * m)::BIGINT AS padded FROM b GROUP BY source""")
def padded_exposure(spark, sf_dir):
    return metrics.exposure(read(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 8)


@query("SELECT DISTINCT doc_id % 400 AS step, least(doc_id % 400, 200) AS \"distinct\", doc_id % 400 * 20 AS fresh, doc_id % 400 * 3 AS replayed FROM documents")
def step_exposures(spark, sf_dir):
    return read(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("step")).distinct().select("step", metrics.step_exposure(F.col("step")).alias("x")).select("step", "x.*")


@query(_PRED.format("a") + """, t AS (SELECT lang, expected, p, 0.1 + 0.8 * expected AS q FROM pred) SELECT lang,
  avg(0.6 * -ln(greatest(CASE WHEN expected = 1 THEN p ELSE 1 - p END, 1e-12)) + 0.4 * (q * -ln(greatest(p, 1e-12)) + (1 - q) * -ln(greatest(1 - p, 1e-12))) + 0.25 * 2 * pow(p - expected, 2)) AS mixture, avg(pow(p - q, 2)) AS consistency FROM t GROUP BY lang""")
def training_losses(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    q = 0.1 + 0.8 * F.col("expected")
    teacher = F.array(1 - q, q)
    return p.groupBy("lang").agg(F.avg(P.mixture_loss(F.col("probabilities"), F.col("expected"), teacher, 0.4, 0.25)).alias("mixture"), F.avg(P.consistency(F.col("probabilities"), teacher)).alias("consistency"))


# --- text detector ---------------------------------------------------------------------------------------------------------------

_FAMILIES = ("ai_written", "staging", "specifics", "chat_residue")
_STRENGTH = ", ".join(f"('0x' || substr(sha256('{s}:' || conv_id::VARCHAR || ':' || turn::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS {s}" for s in _FAMILIES)


def _with_tells(spark, sf_dir):
    return _chunks(spark, sf_dir).withColumn("tells", detector.tells({s: F.col(s) for s in _FAMILIES}))


@query(f"""WITH c AS (SELECT conv_id, turn, {_STRENGTH} FROM conversations), t AS (SELECT conv_id, turn, unnest({list(_FAMILIES)}) AS family, unnest([{', '.join(f'floor({s} * 1000 + 0.5) / 1000' for s in _FAMILIES)}]) AS strength, unnest([0, 1, 2, 3]) AS i FROM c)
  SELECT conv_id, turn, string_agg(family, ',' ORDER BY strength DESC, i) AS tells FROM t WHERE strength >= 0.6 GROUP BY ALL""")
def chunk_tells(spark, sf_dir):
    rows = _with_tells(spark, sf_dir).filter(F.size("tells") > 0)
    return rows.select("conv_id", "turn", F.array_join(F.transform("tells", lambda t: t["family"]), ",").alias("tells"))


@query(_CHUNKS + f""", j AS (SELECT conv_id, sum(probability * words) / sum(CASE WHEN probability IS NOT NULL THEN words END) AS p, bool_or(probability >= 0.75) AND bool_or(probability < 0.3) AS mixed FROM s GROUP BY conv_id),
  x AS (SELECT conv_id, turn, {_STRENGTH} FROM conversations), t AS (SELECT conv_id, turn, unnest({list(_FAMILIES)}) AS family, unnest([{', '.join(f'floor({s} * 1000 + 0.5) / 1000' for s in _FAMILIES)}]) AS strength FROM x)
  SELECT conv_id, family, max(strength) AS strength FROM t JOIN s USING (conv_id, turn) JOIN j USING (conv_id) WHERE strength >= 0.6 AND probability IS NOT NULL AND NOT (p < 0.3 AND NOT coalesce(mixed, false)) GROUP BY ALL""")
def strongest_tells(spark, sf_dir):
    return detector.sample_tells(_with_tells(spark, sf_dir), "conv_id")


@query("WITH r AS (SELECT conv_id, turn, sha256('m' || chr(10) || role || chr(10) || text) AS cache_key, turn % 2 = 0 AS old, length(text) AS v FROM conversations), c AS (SELECT cache_key, max(v) AS value FROM r WHERE old GROUP BY cache_key) SELECT conv_id, turn, cache_key, c.value, c.value IS NOT NULL AS hit FROM r LEFT JOIN c USING (cache_key)")
def cached_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("model", F.lit("m"))
    key = F.sha2(F.concat_ws("\n", "model", "role", "text"), 256)
    cache = rows.filter("turn % 2 = 0").select(key.alias("cache_key"), F.length("text").cast("long").alias("value"))
    return detector.cached(rows, cache, ["model", "role", "text"]).select("conv_id", "turn", "cache_key", "value", "hit")


@query("""WITH s AS (SELECT conv_id, CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN 'unauthorized' WHEN (conv_id + turn) % 4 = 0 THEN 'timeout' ELSE 'ok' END AS s FROM conversations)
  SELECT conv_id, count_if(s = 'ok')::BIGINT AS ok, count_if(s <> 'ok')::BIGINT AS failed, CASE WHEN count_if(s = 'unauthorized') > 0 OR count_if(s = 'ok') = 0 THEN 'failed' WHEN count_if(s <> 'ok') > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM s GROUP BY conv_id""")
def failed_chunks(spark, sf_dir):
    status = F.when((F.col("conv_id") % 13 == 0) & (F.col("turn") == 0), "unauthorized").when((F.col("conv_id") + F.col("turn")) % 4 == 0, "timeout").otherwise("ok")
    return detector.failures(read(spark, sf_dir, "conversations").withColumn("status", status), "conv_id")
