"""Queries over the given tables, each with SQL that gives the same rows where SQL can.

Labels stand for gold answers, and two systems' answers are derived from hashes of ids, so that the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import probability as P
from .functions import text as X
from .operators import answers, calibration, comparison, corpus, detector, facts, metrics
from .operators.shared import saved
from .registry import QUERIES, SQL, query, read  # noqa: F401
from .streaming.events import windowed

# --- texts -----------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(text) AS digest, 'text:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_key,
  ('0x' || substr(sha256(text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS place, coalesce(len(regexp_extract_all(text, '\S+')), 0)::INTEGER AS words FROM documents""")
def text_keys(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.digest(t).alias("digest"), X.text_key(X.squeezed(t)).alias("text_key"), X.hash_unit(t).alias("place"), X.count_words(t).alias("words"))


@query()
def normalised_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", X.normalised("text").alias("n"))
    return rows.select("doc_id", X.text_key(F.col("n")).alias("text_key"), X.wordbag_key(F.col("n")).alias("wordbag_key"))


@query(r"""SELECT doc_id, trim(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)) AS slug,
  len(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda b: trim(b)), lambda b: b <> ''))::INTEGER AS lines FROM documents""")
def text_slugs(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda b: F.trim(b)), lambda b: b != "")
    return read(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"), F.size(lines).alias("lines"))


@query(r"""WITH c AS (SELECT doc_id, text AS t, left(text, 200) AS cut FROM documents), e AS (SELECT *, 200 - strpos(reverse(cut), ' ') AS last FROM c)
  SELECT doc_id, CASE WHEN regexp_matches(t, '(?m)\*\*|^#{1,4} |^[-*] ') THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^#{1,4} +', '', 'g'), '(?m)^[-*] +', '', 'g'), '(?m)^[0-9]+\. +', '', 'g') ELSE t END AS bare,
    CASE WHEN length(t) <= 200 THEN t WHEN strpos(cut, ' ') > 0 AND last > 160 THEN left(cut, last::INTEGER) ELSE cut END AS cut,
    len(list_filter(list_transform(regexp_split_to_array(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\r?\n\s*\r?\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> ''))::INTEGER AS blocks FROM e""")
def markdown_and_cuts(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.without_markdown(t).alias("bare"), X.truncated(t, 200).alias("cut"), F.size(X.split_blocks(X.plain_newlines(t))).alias("blocks"))


_NAMED = "regexp_replace(p, '<[^>]+>', '', 'g')"
for _mark, _said in (("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
    _NAMED = f"replace({_NAMED}, '&{_mark};', '{_said}')"
_CLEAN = _NAMED
for _pattern in (r"\[[0-9]+\]", r"(?i)\[citation needed\]", r"(?i)\[edit\]", r"Template:[A-Za-z0-9_\-]+"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '', 'g')"
_PARAGRAPHS = "WITH h AS (SELECT page_id, html AS h FROM pages), " + "".join(
    f"h{i} AS (SELECT page_id, regexp_replace(h, '(?is)<{t}.*?</{t}>', '', 'g') AS h FROM {f'h{i - 1}' if i else 'h'}), " for i, t in enumerate(("script", "style", "sup[^>]*>", "table", "nav", "header", "footer"))
).replace("</sup[^>]*>>", "</sup>") + rf"""x AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1)) AS p, generate_subscripts(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), 1) AS i FROM h6),
  c AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS paragraph FROM x),
  d AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS place, paragraph FROM c WHERE paragraph <> '') """


@query(_PARAGRAPHS + "SELECT * FROM d")
def page_paragraphs(spark, sf_dir):
    """The SQL leaves out numeric references, which the pages have none of."""
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(X.paragraphs(F.col("html"))).alias("place", "paragraph"))


@query(_PARAGRAPHS + r""", g AS (SELECT page_id, place, paragraph, coalesce(len(regexp_extract_all(paragraph, '\S+')), 0) AS w FROM d
    WHERE length(paragraph) >= 20 AND NOT regexp_matches(paragraph, '(?i)Jump to navigation|Jump to search|Wayback Machine has not archived|cookie') AND NOT contains(paragraph, '{') AND NOT contains(paragraph, 'Template:')),
  k AS (SELECT *, sum(w) OVER (PARTITION BY page_id ORDER BY place) AS upto FROM g),
  s AS (SELECT *, min(CASE WHEN (upto - w >= 150 AND upto > 400) OR upto - w >= 400 THEN place END) OVER (PARTITION BY page_id) AS stop FROM k)
  SELECT page_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY place) AS text, sum(w)::INTEGER AS words FROM s WHERE stop IS NULL OR place < stop GROUP BY page_id HAVING sum(w) >= 150""")
def assembled_paragraphs(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", X.assembled(X.paragraphs(F.col("html"))).alias("a"))
    return rows.filter("a is not null").select("page_id", "a.text", "a.words")


@query()
def chunk_packing(spark, sf_dir):
    """Lines of a text stand for its blocks; those over 300 words are split."""
    rows = read(spark, sf_dir, "documents").select("doc_id", corpus.pack_texts(F.split("text", "\n")).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk", "c")).select("doc_id", "chunk", "c.first", "c.last", "c.words")


# --- corpus ----------------------------------------------------------------------------------------------------------------------

_KEY = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def _cases(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", X.squeezed(F.col("text")).alias("key"))


@query(r"""WITH RECURSIVE l AS (SELECT DISTINCT e.user_id AS id, k.key FROM events e, LATERAL (SELECT unnest(['value:' || (value * 100)::BIGINT::VARCHAR, 'minute:' || (epoch(ts)::BIGINT // 600)::VARCHAR]) AS key) k WHERE e.event_type = 'purchase'),
  e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM l a JOIN l b USING (key)), r AS (SELECT a AS id, b AS root FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a) SELECT id, min(root) AS root FROM r GROUP BY id""")
def connected_groups(spark, sf_dir):
    """Users connected over purchases of one value, or within the same ten minutes: keys of two kinds, chains over both."""
    e = read(spark, sf_dir, "events").filter("event_type = 'purchase'")
    keys = F.array(F.concat(F.lit("value:"), F.round(F.col("value") * 100).cast("long")), F.concat(F.lit("minute:"), F.expr("unix_seconds(cast(ts as timestamp)) div 600")))
    return corpus.connected_groups(e.select(F.col("user_id").alias("id"), F.explode(keys).alias("key")))


@query(f"""WITH k AS (SELECT doc_id AS id, source AS target, sha256({_KEY}) AS key FROM documents) SELECT * FROM k WHERE key NOT IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT target) > 1)""")
def conflict_removal(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("id", F.col("source").alias("target"), F.sha2("key", 256).alias("key"))
    return corpus.without_conflicts(rows, "key", "target").select("id", "target", "key")


@query(f"""SELECT id, source, key FROM (SELECT doc_id AS id, source, sha256({_KEY}) AS key, row_number() OVER (PARTITION BY sha256({_KEY}) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1""")
def duplicate_removal(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("id", "source", F.sha2("key", 256).alias("key"))
    return corpus.first_of_each(rows, "key", F.when(F.col("source") == "src0", 0).otherwise(1), F.col("id"))


_SPLIT = """SELECT g, CASE WHEN t THEN 'test' WHEN d THEN CASE WHEN u < 0.5 THEN 'validation' ELSE 'calibration' END WHEN u < 0.8 THEN 'train' WHEN u < 0.87 THEN 'validation' WHEN u < 0.94 THEN 'calibration' ELSE 'test' END AS split
  FROM (SELECT g, bool_or(source = 'src1') AS t, bool_or(source = 'src2') AS d, ('0x' || substr(sha256(g), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM k GROUP BY g)"""


def _splits(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("id", "lang", "source", F.sha2("key", 256).alias("g"))
    groups = rows.groupBy("g").agg(F.bool_or(F.col("source") == "src1").alias("t"), F.bool_or(F.col("source") == "src2").alias("d"))
    return rows, groups.select("g", corpus.split_of(F.col("g"), F.col("t"), F.col("d")).alias("split"))


@query(f"WITH k AS (SELECT doc_id AS id, source, sha256({_KEY}) AS g FROM documents), s AS ({_SPLIT}) SELECT id, split FROM k JOIN s USING (g)")
def split_assignment(spark, sf_dir):
    rows, groups = _splits(spark, sf_dir)
    return rows.join(groups, "g").select("id", "split")


@query(f"WITH k AS (SELECT doc_id AS id, lang, source, sha256({_KEY}) AS g FROM documents), s AS ({_SPLIT}) SELECT split, lang, count(*) AS examples, count(DISTINCT g) AS groups FROM k JOIN s USING (g) GROUP BY split, lang")
def corpus_manifest(spark, sf_dir):
    rows, groups = _splits(spark, sf_dir)
    return rows.join(groups, "g").groupBy("split", "lang").agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("g").alias("groups"))


_HEAD = "WITH k AS (SELECT doc_id AS id, source, sha256({0}) AS g, sha256(left({0}, 40)) AS head FROM documents), s AS ({1}) "


@query(_HEAD.format(_KEY, _SPLIT) + "SELECT head, count(DISTINCT split) AS splits FROM k JOIN s USING (g) GROUP BY head HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    """First 40 characters that stand in more than one split: near copies that whole keys don't hold together."""
    rows, groups = _splits(spark, sf_dir)
    heads = _cases(spark, sf_dir).select("id", F.sha2(F.substring("key", 1, 40), 256).alias("head"))
    return corpus.leaked(rows.join(groups, "g").join(heads, "id"), "head")


@query("""WITH r AS (SELECT doc_id AS id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents),
  n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, source) AS n FROM r WHERE r <= 40) SELECT id, lang, source FROM n WHERE n <= 40""")
def balanced_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return corpus.balanced_take(rows, ["source"], F.struct(F.sha2(F.col("id").cast("string"), 256), "id"), 40, ["lang"])


@query("SELECT doc_id AS id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 5")
def head_per_source(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return corpus.head_per_source(rows, "source", F.struct(F.sha2(F.col("id").cast("string"), 256), "id"), 5)


@query("SELECT doc_id AS id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('pick:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r = 1")
def category_pick(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return corpus.first_per_category(rows, "lang", F.struct(F.sha2(F.concat(F.lit("pick:"), F.col("id").cast("string")), 256), "id"))


@query("""WITH v AS (SELECT event_type AS feature, 'regression' AS kind, value FROM events UNION ALL SELECT 'high_' || event_type, 'binary', (value > 100)::INTEGER::DOUBLE FROM events),
  g AS (SELECT feature, kind, count(value) AS applicable, count_if(value = 0)::BIGINT AS zeros, count_if(value = 1)::BIGINT AS ones, min(value) AS minimum, max(value) AS maximum, count(DISTINCT value) AS d FROM v GROUP BY ALL)
  SELECT feature, kind, applicable, zeros, ones, minimum, maximum, CASE WHEN kind = 'binary' THEN zeros >= 2 AND ones >= 2 ELSE d >= 2 END AS eligible FROM g""")
def feature_eligibility(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    both = F.array(F.struct(F.col("event_type").alias("feature"), F.lit("regression").alias("kind"), F.col("value").cast("double").alias("value")), F.struct(F.concat(F.lit("high_"), "event_type").alias("feature"), F.lit("binary").alias("kind"), (F.col("value") > 100).cast("double").alias("value")))
    return corpus.eligibility(e.select(F.inline(both)))


# --- predictions -----------------------------------------------------------------------------------------------------------------

_PRED = """WITH h AS (SELECT doc_id, source, lang, quality AS expected, ('0x' || substr(sha256('{0}' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM labels JOIN documents USING (doc_id)),
  q AS (SELECT *, (u + quality_weight * expected) / (1 + quality_weight) AS p FROM h, (SELECT 0.6::DOUBLE AS quality_weight)),
  pred AS (SELECT doc_id, source, lang, expected, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted, (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = expected AS correct,
    -ln(greatest(CASE WHEN expected = 1 THEN p ELSE 1 - p END, 1e-12)) AS nll, 2 * pow(p - expected, 2) AS brier, greatest(p, 1 - p) AS max_probability FROM q) """


def _predictions(spark, sf_dir, system="a"):
    rows = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold")).join(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    u = X.hash_unit(F.concat(F.lit(system), F.col("doc_id").cast("string")), 12)
    p = (u + 0.6 * F.col("gold")) / 1.6
    rows = rows.withColumn("p", p).withColumn("probabilities", F.array(1 - F.col("p"), F.col("p")))
    return answers.predictions(rows).withColumnRenamed("gold", "expected")


@query(_PRED.format("a") + "SELECT doc_id, expected, p, predicted, correct, nll, brier, max_probability FROM pred")
def prediction_view(spark, sf_dir):
    return _predictions(spark, sf_dir).select("doc_id", "expected", "p", "predicted", "correct", "nll", "brier", "max_probability")


_GROUP = """count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) / count(*) AS accuracy, avg(nll) AS mean_nll, avg(brier) AS mean_brier,
  count(*) FILTER (NOT correct AND max_probability >= 0.9) AS wrong_90, count(*) FILTER (NOT correct AND max_probability >= 0.95) AS wrong_95,
  count(*) FILTER (expected = 1 AND predicted = 1) AS tp, count(*) FILTER (expected = 0 AND predicted = 0) AS tn, count(*) FILTER (expected = 0 AND predicted = 1) AS fp, count(*) FILTER (expected = 1 AND predicted = 0) AS fn,
  count(*) FILTER (expected = 1 AND predicted = 1) / nullif(count(*) FILTER (expected = 1), 0) AS recall, count(*) FILTER (expected = 0 AND predicted = 0) / nullif(count(*) FILTER (expected = 0), 0) AS specificity,
  (count(*) FILTER (expected = 1 AND predicted = 1) / nullif(count(*) FILTER (expected = 1), 0) + count(*) FILTER (expected = 0 AND predicted = 0) / nullif(count(*) FILTER (expected = 0), 0)) / 2 AS balanced_accuracy"""


@query(_PRED.format("a") + f"SELECT 'all' AS dimension, '' AS value, {_GROUP} FROM pred UNION ALL SELECT 'lang', lang, {_GROUP} FROM pred GROUP BY lang UNION ALL SELECT 'source', source, {_GROUP} FROM pred GROUP BY source")
def metric_cuts(spark, sf_dir):
    return metrics.cuts(_predictions(spark, sf_dir), ["lang", "source"])


@query(_PRED.format("a") + "SELECT b.bin::INTEGER AS bin, count(p) AS n, avg(max_probability) AS confidence, avg(correct::INTEGER) AS accuracy FROM range(10) b(bin) LEFT JOIN pred ON least(floor(max_probability * 10), 9) = b.bin GROUP BY b.bin")
def reliability_bins(spark, sf_dir):
    return metrics.reliability(_predictions(spark, sf_dir))


@query(_PRED.format("a") + "SELECT sum(n)::BIGINT AS n, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT count(*) AS n, avg(max_probability) AS c, avg(correct::INTEGER) AS a FROM pred GROUP BY least(floor(max_probability * 10), 9))")
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(_predictions(spark, sf_dir))


@query(_PRED.format("a") + """, c AS (SELECT lang, p, count(*) FILTER (expected = 1) AS pos, count(*) FILTER (expected = 0) AS neg FROM pred GROUP BY lang, p),
  w AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS w FROM c)
  SELECT lang, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(w) / nullif(sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY lang""")
def ranking_auc(spark, sf_dir):
    return metrics.auc(_predictions(spark, sf_dir), "expected", "p", ["lang"])


@query(_PRED.format("a") + """, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY max_probability DESC, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM pred)
  SELECT lang, f AS fraction, count(*) AS covered, avg((NOT correct)::INTEGER) AS error FROM r, (SELECT unnest([0.5, 0.75, 0.9, 1.0])::DOUBLE AS f) WHERE r <= greatest(1, ceil(f * n)) GROUP BY lang, f""")
def selective_risk(spark, sf_dir):
    return metrics.selective_risk(_predictions(spark, sf_dir), ["lang"], "doc_id")


@query(_PRED.format("a") + "SELECT avg(m) AS macro, count(*) AS categories FROM (SELECT lang, avg(m) AS m FROM (SELECT lang, source, avg(nll) AS m FROM pred GROUP BY lang, source) GROUP BY lang)")
def macro_nll(spark, sf_dir):
    return metrics.macro(_predictions(spark, sf_dir), "nll", "source", "lang")


@query(_PRED.format("a") + ", other AS (" + _PRED.format("b") + """ SELECT * FROM pred) SELECT count(*) FILTER (l.correct AND r.correct) AS "both", count(*) FILTER (l.correct AND NOT r.correct) AS left_only, count(*) FILTER (NOT l.correct AND r.correct) AS right_only,
  count(*) FILTER (NOT l.correct AND NOT r.correct) AS neither, count(*) FILTER (l.predicted IS DISTINCT FROM r.predicted) AS disagreements FROM pred l JOIN other r USING (doc_id)""")
def error_overlap(spark, sf_dir):
    return metrics.overlap(_predictions(spark, sf_dir, "a"), _predictions(spark, sf_dir, "b"), ["doc_id"])


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def coverage_gaps(spark, sf_dir):
    return metrics.coverage_gaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])


@query()
def paired_bootstrap(spark, sf_dir):
    a, b = (_predictions(spark, sf_dir, s) for s in "ab")
    pairs = a.select("doc_id", "source", "lang", F.col("correct").alias("left")).join(b.select("doc_id", F.col("correct").alias("right")), "doc_id")
    return metrics.paired_bootstrap(pairs, "source", "lang")


@query("""SELECT event_type, count(value) AS n, median(value) AS median, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, avg(value) AS mean, stddev_pop(value) AS deviation FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    return metrics.latencies(read(spark, sf_dir, "events"), "event_type", "value")


# --- answers and calibration -----------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) AS i, len(embedding) AS k FROM embeddings), m AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mx FROM u), e AS (SELECT *, exp(z - mx) AS e FROM m),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
  SELECT vec_id AS request, min('o' || i) FILTER (z = mx) AS choice, (max(p) - 1 / any_value(k)) / (1 - 1 / any_value(k)) AS confidence FROM p GROUP BY vec_id""")
def assembled_choices(spark, sf_dir):
    """Each embedding's elements stand for the logits of so many options."""
    units = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request"), F.posexplode("embedding").alias("place", "logit"))
    units = units.select("request", F.lit(0).alias("question"), F.lit("choice").alias("primitive"), "place", F.concat(F.lit("o"), F.col("place") + 1).alias("option"), F.col("logit").cast("double").alias("logit"))
    return answers.assemble(units).select("request", "choice", "confidence")


@query("SELECT sha256(text) AS request, count(*) AS cases, min(doc_id) AS first_case FROM documents GROUP BY sha256(text)")
def identical_requests(spark, sf_dir):
    return answers.identical_requests(read(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT lang, source, ((row_number() OVER (PARTITION BY lang ORDER BY sha256(source), source) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT lang, source FROM documents)")
def fold_assignment(spark, sf_dir):
    return calibration.folds(read(spark, sf_dir, "documents"), ["lang"], "source", 5).withColumn("fold", F.col("fold").cast("int"))


@query("""WITH d AS (SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, quality, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT lang, count(*) AS k FROM n GROUP BY lang)
  SELECT doc_id, 1 / (2 * k * n) AS weight FROM d JOIN n USING (lang, quality) JOIN k USING (lang)""")
def balanced_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return calibration.balanced_weights(rows, "lang", "quality").select("doc_id", "weight")


def _logits(spark, sf_dir):
    odds = F.ln(F.greatest("p", F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
    return _predictions(spark, sf_dir).select("doc_id", "lang", "source", F.array(F.lit(0.0), odds).alias("logits"), F.col("expected").alias("gold"))


@query()
def temperatures(spark, sf_dir):
    return calibration.fit_temperatures(saved(_logits(spark, sf_dir)), ["lang"])


@query("""WITH d AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL), n AS (SELECT lang, count(*) AS n FROM d GROUP BY lang)
  SELECT lang AS held_out, ((SELECT sum(n) FROM n) - n)::BIGINT AS rows, 2 AS features, true AS flat FROM n""")
def left_out_fits(spark, sf_dir):
    """Quality by two figures of the text, fitted without one language each; at the fits' coefficients the loss has no slope."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("lang", "quality", (F.log1p("n_chars") / 10).alias("long"), (F.col("n_chars") % 7 / 7.0).alias("odd"), F.lit(1.0).alias("w"))
    fits = calibration.fit_left_out_logistic(saved(rows), "lang", ["long", "odd"], "quality", "w", penalty=0.01)
    return fits.select("held_out", "rows", F.size("coefficients").alias("features"), (F.col("gradient") < 1e-8).alias("flat"))


@query()
def crossfitted(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(4)).cast("int"))
    return calibration.crossfit(saved(rows)).select("doc_id", "fold", "temperature", "kept_winner", F.col("probabilities")[1].alias("p"))


@query()
def flag_rate_bounds(spark, sf_dir):
    rows = _predictions(spark, sf_dir).groupBy("lang").agg(F.count_if((F.col("expected") == 0) & (F.col("p") >= 0.5)).alias("k"), F.count_if(F.col("expected") == 0).alias("n"))
    return rows.withColumn("upper95", calibration.upper_bound("k", "n"))


# --- text detector ---------------------------------------------------------------------------------------------------------------

_SIG = ("ai_written", "tells", "staging", "specifics", "chat_residue")
_CHUNKS = "WITH c AS (SELECT conv_id, turn, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::INTEGER AS words, " + ", ".join(
    f"('0x' || substr(sha256('{s}:' || conv_id::VARCHAR || ':' || turn::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE{' * 3' if s == 'tells' else ''} AS {s}" for s in _SIG
) + """ FROM conversations), z AS (SELECT *, 1 / (1 + exp(-(-7.8 + 7.85 * ai_written + 6.32 * (tells / 3) + 2.91 * staging - 2.54 * specifics))) AS p0 FROM c),
  p AS (SELECT *, CASE WHEN chat_residue >= 0.9 THEN greatest(p0, 0.9) ELSE p0 END AS p FROM z),
  v AS (SELECT *, CASE WHEN p >= 0.9 THEN 'very_likely_ai' WHEN p >= 0.75 THEN 'likely_ai' WHEN p < 0.3 THEN 'likely_human' ELSE 'unclear' END AS v FROM p),
  k AS (SELECT *, CASE WHEN chat_residue >= 0.9 THEN 'high' WHEN words < 100 OR v = 'unclear' THEN 'low' WHEN CASE WHEN p >= 0.75 THEN p - 0.75 ELSE 0.3 - p END >= 0.15 THEN 'high' ELSE 'medium' END AS k FROM v),
  s AS (SELECT conv_id, turn, words, CASE WHEN words >= 40 THEN floor(p * 1000 + 0.5) / 1000 END AS probability, CASE WHEN words < 40 THEN 'too_short' WHEN v = 'very_likely_ai' AND k = 'low' THEN 'likely_ai' ELSE v END AS verdict,
    CASE WHEN words >= 40 THEN k ELSE 'low' END AS confidence FROM k) """


def _chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("words", X.count_words(F.col("text")))
    at = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    signals = {s: X.hash_unit(F.concat(F.lit(f"{s}:"), at), 12) * (3 if s == "tells" else 1) for s in _SIG}
    return detector.score_chunks(rows.select("conv_id", "turn", "words", *[c.alias(s) for s, c in signals.items()]))


@query(_CHUNKS + "SELECT * FROM s")
def chunk_scores(spark, sf_dir):
    return _chunks(spark, sf_dir).select("conv_id", "turn", "words", "probability", "verdict", "confidence")


@query(_CHUNKS + """, j AS (SELECT *, CASE WHEN probability IS NOT NULL THEN words END AS w, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS l FROM s),
  a AS (SELECT conv_id, sum(words)::BIGINT AS words, count(probability) AS chunks, sum(probability * w) / sum(w) AS p, coalesce(bool_or(probability >= 0.75) AND bool_or(probability < 0.3), false) AS mixed, floor(sum(l * w) / sum(w) + 0.5) AS level FROM j GROUP BY conv_id),
  b AS (SELECT *, CASE WHEN p IS NULL THEN 'too_short' WHEN p >= 0.9 THEN 'very_likely_ai' WHEN p >= 0.75 THEN 'likely_ai' WHEN p < 0.3 THEN CASE WHEN mixed THEN 'unclear' ELSE 'likely_human' END ELSE 'unclear' END AS v FROM a),
  g AS (SELECT *, CASE WHEN p IS NULL OR mixed OR v = 'unclear' THEN 0 ELSE level END AS k FROM b)
  SELECT conv_id, words, chunks, floor(p * 1000 + 0.5) / 1000 AS probability, mixed, CASE WHEN k = 0 AND v = 'very_likely_ai' THEN 'likely_ai' ELSE v END AS verdict, CASE k WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def sample_scores(spark, sf_dir):
    return detector.score_samples(_chunks(spark, sf_dir), "conv_id")


@query(_CHUNKS + "SELECT role, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in detector.VERDICTS) + " FROM s JOIN conversations USING (conv_id, turn) GROUP BY role")
def verdict_confusion(spark, sf_dir):
    rows = _chunks(spark, sf_dir).join(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.groupBy("role").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in detector.VERDICTS])


@query(_PRED.format("a") + "SELECT t AS threshold, count(*) FILTER (expected = 0 AND p >= t) AS flagged, count(*) FILTER (expected = 1 AND p < t) AS missed FROM pred, (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9])::DOUBLE AS t) GROUP BY t")
def threshold_sweep(spark, sf_dir):
    return detector.threshold_sweep(_predictions(spark, sf_dir), "expected", "p", (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9))


# --- comparisons -----------------------------------------------------------------------------------------------------------------


_RELATIONS = _PRED.format("a") + """, r AS (SELECT a.doc_id AS left_doc_id, b.doc_id AS right_doc_id, CASE WHEN a.expected = b.expected THEN 'invariant' ELSE 'contrast' END AS kind,
  a.correct AND b.correct AS both_correct, abs(a.p - b.p) AS total_variation, a.predicted = b.predicted AS same_prediction,
  CASE WHEN a.expected = b.expected THEN abs(a.p - b.p) <= 0.05 END AS within_tolerance, CASE WHEN a.expected <> b.expected THEN (a.p > b.p) = (a.expected = 1) AND a.p <> b.p END AS direction_correct,
  CASE WHEN a.expected <> b.expected THEN (a.p - b.p) * (CASE WHEN a.expected = 1 THEN 1 ELSE -1 END) END AS margin
  FROM pred a JOIN pred b ON a.doc_id // 2 = b.doc_id // 2 AND a.doc_id < b.doc_id) """


def _relations(spark, sf_dir):
    """Neighbours by id are related: a pair with the same gold label is invariant."""
    p = _predictions(spark, sf_dir)
    ends = p.groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(F.min_by("doc_id", "doc_id").alias("left_doc_id"), F.max("doc_id").alias("right_doc_id"), F.min("expected").alias("lo"), F.max("expected").alias("hi"))
    pairs = ends.filter("left_doc_id < right_doc_id").select("left_doc_id", "right_doc_id", F.when(F.col("lo") == F.col("hi"), "invariant").otherwise("contrast").alias("kind"))
    return comparison.relation_metrics(pairs, p, ["doc_id"])


@query(_RELATIONS + "SELECT * FROM r")
def relation_metrics(spark, sf_dir):
    return _relations(spark, sf_dir)


@query(_RELATIONS + """SELECT kind, count(*) AS n, avg(both_correct::INTEGER) AS both_correct, avg(total_variation) AS total_variation, avg(same_prediction::INTEGER) AS same_prediction,
  avg(within_tolerance::INTEGER) AS within_tolerance, avg(direction_correct::INTEGER) AS direction_correct, avg(margin) AS margin FROM r GROUP BY kind""")
def relation_summary(spark, sf_dir):
    return comparison.relation_summary(_relations(spark, sf_dir), ["kind"])


@query(_PRED.format("a") + """, a AS (SELECT * FROM pred), b AS (WITH """ + _PRED.format("b")[5:] + """SELECT * FROM pred)
  SELECT a.source, count_if(NOT a.correct AND b.correct)::BIGINT AS improved, count_if(a.correct AND NOT b.correct)::BIGINT AS regressed, count_if(a.correct AND b.correct)::BIGINT AS kept_right, count_if(NOT a.correct AND NOT b.correct)::BIGINT AS kept_wrong
  FROM a JOIN b USING (doc_id) GROUP BY a.source""")
def change_sets(spark, sf_dir):
    return comparison.change_sets(_predictions(spark, sf_dir), _predictions(spark, sf_dir, "b"), ["doc_id"], ["source"])


@query(_PRED.format("a") + """, c AS (SELECT source, doc_id // 4 AS family, bool_and(correct) AS ok FROM pred GROUP BY ALL) SELECT source, count(*) AS cases, count_if(ok)::BIGINT AS "right" FROM c GROUP BY source""")
def whole_cases(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("family", F.floor(F.col("doc_id") / 4))
    return comparison.whole_cases(p, ["family"], ["source"])


@query(_PRED.format("a") + """SELECT lang, threshold, count_if(max_probability >= threshold)::BIGINT AS covered, count_if(max_probability >= threshold) / count(*) AS coverage, count_if(max_probability >= threshold AND NOT correct)::BIGINT AS wrong,
  count_if(max_probability >= threshold AND NOT correct) / nullif(count_if(max_probability >= threshold), 0) AS error FROM pred, (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) t(threshold) GROUP BY lang, threshold""")
def confidence_coverage(spark, sf_dir):
    return comparison.confidence_coverage(_predictions(spark, sf_dir), ["lang"])


@query(_PRED.format("a") + """, v AS (SELECT doc_id // 4 AS field, predicted, count(*) AS n FROM pred GROUP BY ALL)
  SELECT field, sum(n)::BIGINT AS layouts, count(*) = 1 AS stable, sum(n * (n - 1) / 2) / nullif(sum(n) * (sum(n) - 1) / 2, 0) AS agreement FROM v GROUP BY field""")
def layout_stability(spark, sf_dir):
    return comparison.layout_stability(_predictions(spark, sf_dir).withColumn("field", F.floor(F.col("doc_id") / 4)), ["field"], "predicted")


@query(_PRED.format("a") + """, j AS (SELECT source, CASE WHEN expected = 1 THEN 'GOOD' ELSE 'BAD' END AS label, CASE WHEN p > 0.5 THEN 'GOOD' ELSE 'BAD' END AS judged FROM pred)
  SELECT source, count(*) AS n, avg((label = judged)::INTEGER) AS accuracy, count_if(label = 'BAD' AND judged = 'GOOD')::BIGINT AS misses, count_if(label = 'BAD')::BIGINT AS n_bad,
  count_if(label = 'BAD' AND judged = 'GOOD') / nullif(count_if(label = 'BAD'), 0) AS miss, count_if(label = 'GOOD' AND judged = 'BAD')::BIGINT AS alarms, count_if(label = 'GOOD')::BIGINT AS n_good,
  count_if(label = 'GOOD' AND judged = 'BAD') / nullif(count_if(label = 'GOOD'), 0) AS alarm FROM j GROUP BY source""")
def judge_scores(spark, sf_dir):
    word = lambda good: F.when(good, "GOOD").otherwise("BAD")
    return comparison.judge_score(_predictions(spark, sf_dir).withColumns({"label": word(F.col("expected") == 1), "judged": word(F.col("p") > 0.5)}), ["source"])


@query(_PRED.format("a") + """, u AS (SELECT lang, expected = 0 AS g, predicted = 0 AS s FROM pred) SELECT lang, count(*) AS n, count_if(g)::BIGINT AS gold, count_if(s)::BIGINT AS said, count_if(g AND s)::BIGINT AS hits,
  count_if(g AND s) / nullif(count_if(g), 0) AS recall, count_if(g AND s) / nullif(count_if(s), 0) AS precision FROM u GROUP BY lang""")
def unknown_rates(spark, sf_dir):
    word = lambda c, no: F.when(F.col(c) == 0, no).otherwise("known")
    p = _predictions(spark, sf_dir)
    return metrics.unknown_rates(p.select("lang", word("expected", "unknown").alias("expected"), word("predicted", "Unknown").alias("predicted")), ["lang"])


# --- facts -----------------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id, event_type, ts, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL), m AS (SELECT user_id, event_type, max(ts) AS "at" FROM l GROUP BY ALL)
  SELECT user_id, event_type, "at", CASE WHEN lo = hi THEN lo END AS value FROM m JOIN l USING (user_id, event_type) WHERE l.ts = "at\"""")
def as_of_state(spark, sf_dir):
    return facts.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value")


@query("""WITH q AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 7 DAY AS b FROM events GROUP BY user_id) SELECT event_id FROM events e JOIN q USING (user_id) WHERE e.ts BETWEEN a AND b""")
def window_facts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    q = e.groupBy("user_id").agg(F.min("ts").alias("win_start"), (F.min("ts") + F.expr("interval 7 days")).alias("win_end"))
    return facts.within(e, q, "user_id").select("event_id")


@query("""SELECT event_id FROM events e WHERE value > 0 AND EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_id % 5 = 0 AND r.ts >= e.ts)""")
def reversed_facts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return facts.reversed_by(e.filter("value > 0"), e.filter("event_id % 5 = 0"), "user_id").select("event_id")


@query("""SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type <> e.event_type AND r.ts >= e.ts)""")
def corroborated_facts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return facts.corroborated(e, e, "user_id", "event_type").select("event_id")


RULE = {"all": [{"any": [{"feature": "rich"}, {"not": {"feature": "busy"}}]}, {"compare": "events", "op": ">=", "value": 2}, {"at_least": 1, "of": [{"feature": "rich"}, {"feature": "busy"}, {"feature": "mixed"}]}]}


@query("""WITH f AS (SELECT user_id, count(*) AS events, sum(value) > 500 AS rich, count(*) > 12 AS busy, count(DISTINCT event_type) > 3 AS mixed FROM events GROUP BY user_id)
  SELECT user_id, (rich OR NOT busy) AND events >= 2 AND (rich::INTEGER + busy::INTEGER + mixed::INTEGER) >= 1 AS holds, CASE WHEN events > 20 THEN 2 WHEN events > 10 THEN 1 WHEN events > 0 THEN 0 END AS level FROM f""")
def rule_verdicts(spark, sf_dir):
    f = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), (F.sum("value") > 500).alias("rich"), (F.count(F.lit(1)) > 12).alias("busy"), (F.count_distinct("event_type") > 3).alias("mixed"))
    columns = {c: F.col(c) for c in f.columns}
    return f.select("user_id", facts.rule(RULE, columns).alias("holds"), facts.highest_level([F.col("events") > 0, F.col("events") > 10, F.col("events") > 20]).alias("level"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return windowed(read(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import queries_answers, queries_checks, queries_corpus, queries_figures, queries_overlap, queries_records, queries_sources, queries_study  # noqa: E402, F401  register their queries
