"""Queries over nested records, parted rules, selections and whole comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import metrics, study
from .operators.records import auxiliary_facts, semantic_signatures
from .operators.records import record_features as features
from .queries import _PRED, _predictions
from .queries_study import training_schedule
from .registry import SQL, query, read

#: Each event as a report about its user's record: what kind of report, and its fields, by its number.
_REPORT = {
    "record": "user_id", "kind": "event_id % 8", "time": "event_id", "actor": "'a' || (j % 5) % 2", "operation": "'o' || (j % 7) % 2", "target": "'t' || (j % 3) % 2", "run_id": "'r' || (j % 11) % 2",
    "source": "'s' || j % 4", "verified": "j % 6 <> 1", "mode": "CASE WHEN j % 9 = 4 THEN 'test' ELSE 'live' END", "outcome": "CASE WHEN (j % 13) % 5 = 0 THEN 'no_effect' WHEN (j % 13) % 5 = 1 THEN 'late' ELSE 'success' END",
    "decision": "CASE WHEN (j % 17) % 2 = 0 THEN 'allow' ELSE 'deny' END", "tense": "CASE WHEN (j % 10) % 3 = 0 THEN 'future' ELSE 'completed' END", "polarity": "CASE WHEN (j % 19) % 4 = 0 THEN 'negative' ELSE 'positive' END",
    "endorsed": "j % 12 = 5", "reverses": "'r' || (j % 5) % 2", "item": "'i' || j % 5", "status": "CASE WHEN (j % 23) % 9 = 0 THEN 'no_effect' WHEN (j % 23) % 9 = 1 THEN 'open' ELSE 'success' END", "active": "CASE WHEN j % 14 <> 3 THEN (j % 4) < 2 END",
}
#: Each record's question, by its user and the times of its reports.
_ASKED = {
    "actor": "CASE WHEN user_id % 5 <> 0 THEN 'a' || user_id % 2 END", "operation": "'o' || user_id % 2", "target": "'t' || user_id // 2 % 2", "run_id": "CASE WHEN user_id % 3 <> 0 THEN 'r' || user_id // 3 % 2 END",
    "win_start": "min(event_id) + (max(event_id) - min(event_id)) // 10", "win_end": "max(event_id) - (max(event_id) - min(event_id)) // 10", "asked": "(min(event_id) + max(event_id)) // 2",
    "trusted": "CASE WHEN user_id % 2 = 0 THEN ['s0', 's1', 's2'] ELSE ['s1', 's2', 's3'] END", "whole": "user_id % 4 <> 1", "measurement": "CASE WHEN user_id % 3 = 0 THEN sum(CASE WHEN event_id % 8 = 0 THEN event_id ELSE 0 END)::DOUBLE END",
}
_REPORTS = f"""WITH e AS (SELECT *, event_id // 8 AS j FROM events), r AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _REPORT.items())} FROM e),
  q AS (SELECT user_id AS record, {', '.join(f'{v} AS {"q_" + k if k in ("actor", "operation", "target", "run_id") else k}' for k, v in _ASKED.items())} FROM events GROUP BY user_id),
  m AS (SELECT *, coalesce(actor = q_actor, true) AND operation = q_operation AND target = q_target AS act, time BETWEEN win_start AND win_end AS inside, verified AND list_contains(trusted, source) AS auth FROM r JOIN q USING (record))"""
_FLAT = _REPORTS + """,
  n AS (SELECT *, act AND coalesce(run_id = q_run_id, true) AS run FROM m), x AS (SELECT *, kind IN (2, 3) AND run AND inside AS invoked, mode = 'live' AND auth AS real FROM n),
  w AS (SELECT record, run_id, source, time FROM x WHERE invoked AND real AND outcome = 'success'),
  rev AS (SELECT DISTINCT x.record FROM x JOIN w ON w.record = x.record AND x.reverses = w.run_id AND x.time >= w.time WHERE kind = 4 AND act AND inside AND real AND outcome = 'success'),
  cor AS (SELECT DISTINCT x.record FROM x JOIN w ON w.record = x.record AND x.source <> w.source AND x.time >= w.time WHERE kind = 5 AND run AND inside AND auth AND outcome = 'success'),
  it AS (SELECT record, item, count(DISTINCT status) FILTER (verified AND status <> 'open') AS known, min(status) FILTER (verified AND status <> 'open') AS status FROM x WHERE kind = 6 GROUP BY record, item),
  ic AS (SELECT record, count(*) AS item_count, count(*) FILTER (known = 1 AND status = 'success') AS success_count, count(*) FILTER (known = 1 AND status = 'no_effect') AS failure_count, count(*) FILTER (known <> 1) AS unknown_count FROM it GROUP BY record),
  g AS (SELECT record, any_value(whole) AS whole, any_value(measurement) AS measurement,
    coalesce(bool_or(kind = 0 AND act AND tense = 'future' AND polarity = 'positive'), false) AS intent, bool_or(kind = 0 AND act AND tense = 'completed' AND polarity = 'positive') AS claim,
    bool_or(kind = 0 AND act AND tense = 'completed' AND polarity = 'negative') AS denied_claim, bool_or(kind = 0 AND act AND tense = 'completed' AND polarity = 'positive' AND endorsed) AS endorsement,
    max_by(decision, time) FILTER (kind = 1 AND act AND inside AND auth) AS decision, bool_or(invoked) AS invocation, bool_or(invoked AND real AND outcome = 'success') AS won, bool_or(invoked AND real AND outcome = 'no_effect') AS lost,
    bool_or(invoked AND outcome = 'success') AS success_report, bool_or(invoked AND outcome = 'no_effect') AS failure_report, bool_or(kind IN (2, 3) AND inside AND real AND outcome = 'success') AS any_live_success,
    bool_or(kind IN (2, 3) AND inside AND real AND outcome = 'success' AND NOT run) AS other_live_success, coalesce(bool_or(kind IN (2, 3) AND actor = q_actor), false) AS actor_seen, bool_or(kind IN (2, 3) AND operation = q_operation) AS operation_seen,
    bool_or(kind IN (2, 3) AND target = q_target) AS target_seen, coalesce(bool_or(kind IN (2, 3) AND run_id = q_run_id), false) AS run_seen,
    arg_max_null(active, time) FILTER (kind = 7 AND target = q_target AND auth AND time <= win_end) AS now, arg_max_null(active, time) FILTER (kind = 7 AND target = q_target AND auth AND time <= asked) AS earlier,
    coalesce(bool_or(kind = 7 AND target = q_target AND auth AND time <= win_end AND active), false) AS ever_active FROM x GROUP BY record)
  SELECT record, intent, claim, denied_claim, endorsement, decision IS NOT DISTINCT FROM 'allow' AS approved, decision IS NOT DISTINCT FROM 'deny' AS forbidden, decision IS NULL AS approval_unknown, invocation, won AND NOT lost AS completed, lost AND NOT won AS failed,
    won = lost AS unknown, won AND lost AS conflict, success_report, any_live_success, other_live_success, failure_report, won AND NOT lost AND record IN (FROM rev) AS reversed, won AND NOT lost AND record NOT IN (FROM rev) AS effective,
    won AND NOT lost AND record IN (FROM cor) AS corroborated, actor_seen, operation_seen, target_seen, run_seen, whole AS inventory_complete, coalesce(item_count, 0) AS item_count, coalesce(success_count, 0) AS success_count,
    coalesce(failure_count, 0) AS failure_count, coalesce(unknown_count, 0) AS unknown_count, whole AND coalesce(success_count = item_count, true) AS all_success, whole AND coalesce(failure_count = item_count, true) AS all_failed,
    coalesce(success_count > 0, false) AS any_success, coalesce(failure_count > 0, false) AS any_failure, coalesce(unknown_count > 0, false) OR NOT whole AS item_unknown, now IS NOT DISTINCT FROM true AS active_now, now IS NOT DISTINCT FROM false AS inactive_now,
    now IS NOT NULL AS current_known, earlier IS NOT DISTINCT FROM true AS active_earlier, earlier IS NOT DISTINCT FROM false AS inactive_earlier, earlier IS NOT NULL AS earlier_known, ever_active, measurement IS NOT NULL AS has_measurement, measurement FROM g LEFT JOIN ic USING (record)"""


def _spark_sql(sql: str) -> str:
    """The same expression in Spark's spelling."""
    return sql.replace("//", "div").replace("['s", "array('s").replace("']", "')")


def _records(spark, sf_dir):
    """Each user's events as one record of nested lists, in order of events."""
    events = read(spark, sf_dir, "events").withColumn("j", F.expr("event_id div 8"))
    rows = events.select("user_id", "event_id", *[F.expr(_spark_sql(v)).alias(k) for k, v in _REPORT.items()])
    fields = {
        "statements": ((0,), "actor operation target tense polarity endorsed"), "approvals": ((1,), "actor operation target time source verified decision"),
        "executions": ((2, 3), "actor operation target run_id time source verified mode outcome"), "reversals": ((4,), "actor operation target time source verified mode outcome reverses"),
        "corroborations": ((5,), "actor operation target run_id time source verified outcome"), "items": ((6,), "id status verified"), "state_events": ((7,), "target time source verified active"),
    }
    rows = rows.withColumn("id", F.col("item"))
    in_turn = lambda held: F.transform(F.array_sort(held), lambda x: x["report"])
    lists = [in_turn(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("event_id", F.struct(*names.split()).alias("report"))))).alias(k) for k, (kinds, names) in fields.items()]
    asked = {k: F.expr(_spark_sql(v)) for k, v in _ASKED.items()}
    records = rows.groupBy("user_id").agg(*lists, *[asked[k].alias(k) for k in ("win_start", "win_end", "asked", "measurement")])
    question = F.struct(*[asked[k].alias(k) for k in ("actor", "operation", "target", "run_id")])
    records = records.select("*", question.alias("query"), asked["trusted"].alias("trusted_sources"), F.col("asked").alias("query_time"), asked["whole"].alias("inventory_complete"), F.lit(None).cast("array<string>").alias("item_ids"))
    return records.withColumnRenamed("user_id", "record")


@query(_FLAT)
def nested_record_features(spark, sf_dir):
    return features(_records(spark, sf_dir), "record")


_SEEN = {n: f"kind IN (2, 3) AND {c} IS NOT DISTINCT FROM q_{c}" for n, c in (("actor", "actor"), ("operation", "operation"), ("target", "target"), ("run", "run_id"))}
_AUXILIARY = {
    "statement_claim": "kind = 0 AND act AND tense = 'completed' AND polarity = 'positive'", "statement_intent": "kind = 0 AND act AND tense = 'future' AND polarity = 'positive'",
    "statement_denial": "kind = 0 AND act AND tense = 'completed' AND polarity = 'negative'", "statement_endorsed": "kind = 0 AND act AND tense = 'completed' AND polarity = 'positive' AND endorsed",
    "execution_present": "kind IN (2, 3)", "execution_joint_identity": "kind IN (2, 3) AND run", "execution_joint_in_window": "scoped", "execution_joint_authentic": "scoped AND auth", "execution_joint_live": "scoped AND auth AND mode = 'live'",
    "scoped_untrusted_execution": "scoped AND NOT auth", "scoped_nonlive_execution": "scoped AND mode <> 'live'", "scoped_success_report": "scoped AND outcome = 'success'", "scoped_no_effect_report": "scoped AND outcome = 'no_effect'",
    "live_success_receipt": "scoped AND auth AND mode = 'live' AND outcome = 'success'", "live_no_effect_receipt": "scoped AND auth AND mode = 'live' AND outcome = 'no_effect'", "live_timeout_receipt": "scoped AND auth AND mode = 'live' AND outcome = 'timeout'",
    "other_live_success_receipt": "kind IN (2, 3) AND NOT run AND inside AND auth AND mode = 'live' AND outcome = 'success'", **{f"execution_{n}_seen": c for n, c in _SEEN.items()},
}
_PERMIT = "max_by(decision, time) FILTER (kind = 1 AND act AND inside AND auth) IS NOT DISTINCT FROM"
_STATE = "arg_max_null(active, time) FILTER (kind = 7 AND target = q_target AND auth AND time <= {})"
_MORE = {
    "permission_latest_allow_report": f"{_PERMIT} 'allow'", "permission_latest_deny_report": f"{_PERMIT} 'deny'", "linked_corroboration_receipt": "record IN (FROM cor)", "linked_reversal_success_receipt": "record IN (FROM rev)",
    "state_earlier_known": f"{_STATE.format('asked')} IS NOT NULL", "state_earlier_active": _STATE.format("asked"), "state_current_known": f"{_STATE.format('win_end')} IS NOT NULL", "state_current_active": _STATE.format("win_end"),
    "inventory_complete": "any_value(whole)", "item_scope_count": "3", "item_success_count": "any_value(wins)", "item_no_effect_count": "any_value(losses)", "item_unknown_count": "3 - coalesce(any_value(wins), 0) - coalesce(any_value(losses), 0)",
    "measurement_known": "any_value(measurement) IS NOT NULL", "measurement_value": "any_value(measurement)",
}
_KNOWN = "CASE fact WHEN 'measurement_value' THEN measured WHEN 'state_earlier_active' THEN earlier_known WHEN 'state_current_active' THEN current_known ELSE true END"


@query(_REPORTS.replace("coalesce(actor = q_actor, true)", "actor IS NOT DISTINCT FROM q_actor") + f""", k AS (SELECT *, act AND run_id IS NOT DISTINCT FROM q_run_id AS run, kind IN (2, 3) AND act AND run_id IS NOT DISTINCT FROM q_run_id AND inside AS scoped FROM m),
  w AS (SELECT record, run_id, source, time FROM k WHERE scoped AND auth AND mode = 'live' AND outcome = 'success'),
  rev AS (SELECT DISTINCT k.record FROM k JOIN w ON w.record = k.record AND k.reverses = w.run_id AND k.time >= w.time WHERE kind = 4 AND act AND inside AND auth AND mode = 'live' AND outcome = 'success'),
  cor AS (SELECT DISTINCT k.record FROM k JOIN w ON w.record = k.record AND k.source <> w.source AND k.time >= w.time WHERE kind = 5 AND run AND inside AND auth AND outcome = 'success'),
  it AS (SELECT record, count(*) FILTER (lo = hi AND lo = 'success') AS wins, count(*) FILTER (lo = hi AND lo = 'no_effect') AS losses FROM (SELECT record, item, min(status) AS lo, max(status) AS hi FROM k WHERE kind = 6 AND verified AND status <> 'open' AND item IN ('i0', 'i2', 'i9') GROUP BY ALL) GROUP BY record),
  g AS (SELECT record, {', '.join(f'coalesce(bool_or({c})::INTEGER, 0)::DOUBLE AS {n}' for n, c in _AUXILIARY.items())}, {', '.join(f'coalesce(({c})::DOUBLE, 0) AS {n}' for n, c in _MORE.items())},
    any_value(measurement) IS NOT NULL AS measured, {_STATE.format('asked')} IS NOT NULL AS earlier_known, {_STATE.format('win_end')} IS NOT NULL AS current_known FROM k LEFT JOIN it USING (record) GROUP BY record),
  u AS (UNPIVOT g ON COLUMNS(* EXCLUDE (record, measured, earlier_known, current_known)) INTO NAME fact VALUE target), v AS (SELECT u.record, fact, target, record % 3 < 2 AND ({_KNOWN}) AS mask FROM u)
  SELECT record, fact, CASE WHEN mask THEN target ELSE 0 END AS target, mask FROM v""")
def auxiliary_record_facts(spark, sf_dir):
    names = [*_AUXILIARY, *_MORE]
    rows = _records(spark, sf_dir).withColumns({"item_ids": F.array(*map(F.lit, ("i0", "i2", "i9", "i0"))), "category": F.concat(F.lit("c"), F.col("record") % 3)})
    found = auxiliary_facts(rows, "record", "category", dict.fromkeys(names, ["c0", "c1"]))
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("fact"), F.col("targets").alias("target"), F.col("masks").alias("mask"))
    return found.select("record", F.inline(each).alias("fact", "target", "mask"))


@query()
def record_signatures(spark, sf_dir):
    """Names by role and order have no SQL; the test holds signatures against renamed records."""
    rows = _records(spark, sf_dir)
    record = F.to_json(F.struct("query", "trusted_sources", "win_start", "win_end", "statements", "approvals", "executions", "reversals", "corroborations", "items", "state_events"))
    return semantic_signatures(rows.select(record.alias("record"), F.lit("[]").alias("programs")), "record", "programs").drop("programs")


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '/\*(.|\n)*?\*/', '', 'g'), '//[^\n]*', '', 'g') AS t FROM documents), s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(t, '[.!?] ', chr(10), 'g'), '\n') AS lines FROM d),
  l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s), f AS (SELECT *, regexp_matches(trim(line, ' '), '^[A-F]') AS starts, regexp_matches(trim(line, ' '), '^[X-ZÉ]|^$') AS ends FROM l),
  b AS (SELECT *, count(*) FILTER (starts OR ends) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM f), g AS (SELECT doc_id, b, bool_or(starts) AS rule, string_agg(line, chr(10) ORDER BY i) AS block FROM b WHERE b > 0 GROUP BY doc_id, b)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INTEGER AS place, block FROM g WHERE rule""")
def blocks_of_lines(spark, sf_dir):
    lines = F.regexp_replace("text", "[.!?] ", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.rule_blocks(lines, "^[A-F]", "^[X-ZÉ]|^$")).alias("place", "block"))


_BINS = "SELECT lang, least(floor(max_probability * 10), 9) AS bin, count(*) AS n, avg(max_probability) AS c, avg(correct::INTEGER) AS a FROM pred GROUP BY ALL"


@query(_PRED.format("a") + f""", bins AS ({_BINS}), e AS (SELECT lang, sum(n * abs(c - a)) / sum(n) AS ece, string_agg(bin::INTEGER || ':' || n, ' ' ORDER BY bin) AS bins FROM bins GROUP BY lang),
  m AS (SELECT lang, string_agg(expected || '>' || predicted || ':' || n, ' ' ORDER BY expected, predicted) AS confusion FROM (SELECT lang, expected, predicted, count(*) AS n FROM pred GROUP BY ALL) GROUP BY lang)
  SELECT lang, count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(-ln(greatest(CASE WHEN expected = 1 THEN p ELSE 1 - p END, 1e-12))) AS mean_floored_nll, count(*) FILTER (CASE WHEN expected = 1 THEN p ELSE 1 - p END = 0) AS zero_targets,
    count(*) FILTER (NOT correct AND max_probability >= 0.9) AS wrong_90, any_value(ece) AS ece, any_value(bins) AS bins, any_value(confusion) AS confusion FROM pred JOIN e USING (lang) JOIN m USING (lang) GROUP BY lang""")
def metric_blocks(spark, sf_dir):
    rows = metrics.metric_block(_predictions(spark, sf_dir), ["lang"])
    bins = F.array_join(F.transform("bins", lambda b: F.concat_ws(":", b["bin"], b["n"])), " ").alias("bins")
    said = F.array_join(F.transform("confusion", lambda c: F.concat(c["expected"], F.lit(">"), c["said"], F.lit(":"), c["n"])), " ").alias("confusion")
    return rows.select("lang", "n", "accuracy", "mean_floored_nll", "zero_targets", "wrong_90", "ece", bins, said)


_TWO = _PRED.format("a") + ", other AS (" + _PRED.format("b") + "SELECT * FROM pred) "


@query(_TWO + """SELECT count(*) AS questions, count(*) FILTER (a.predicted <> b.predicted) AS label_changes, max(abs(a.p - b.p)) AS max_difference, avg(abs(a.p - b.p)) AS mean_variation,
  count(*) FILTER (a.correct) AS left_correct, avg(a.nll) AS left_mean_nll, count(*) FILTER (b.correct) AS right_correct, avg(b.nll) AS right_mean_nll FROM pred a JOIN other b USING (doc_id)""")
def compared_systems(spark, sf_dir):
    return metrics.compare_systems(_predictions(spark, sf_dir, "a"), _predictions(spark, sf_dir, "b"), ["doc_id"])


@query(_PRED.format("a") + "SELECT count(*) FILTER (correct) AS right, count(*) AS total, count(*) FILTER (NOT correct AND max_probability >= 0.9) AS confident_wrong FROM pred WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0)".replace(" AS right", ' AS "right"'))
def headline_of_families(spark, sf_dir):
    even = read(spark, sf_dir, "documents").groupBy("source").count().filter("count % 2 = 0")
    return metrics.headline(_predictions(spark, sf_dir), even, "source")


@query(_TWO + """, v AS (SELECT lang, source, 'accuracy' AS metric, sum(a.correct::INTEGER)::DOUBLE AS l, sum(b.correct::INTEGER)::DOUBLE AS r, count(*) AS n FROM pred a JOIN other b USING (doc_id, lang, source) GROUP BY lang, source
    UNION ALL SELECT lang, source, 'nll', sum(a.nll), sum(b.nll), count(*) FROM pred a JOIN other b USING (doc_id, lang, source) GROUP BY lang, source),
  f AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS size FROM (SELECT DISTINCT lang, source FROM v)),
  d AS (SELECT lang, draw, ('0x' || substr(sha256('families|' || draw || '|' || lang || '|' || slot), 1, 12))::BIGINT % size AS slot FROM f, range(1, 201) t(draw)),
  x AS (SELECT metric, draw, sum(r) / sum(n) - sum(l) / sum(n) AS x FROM d JOIN f USING (lang, slot) JOIN v USING (lang, source) GROUP BY metric, draw), o AS (SELECT metric, list(x ORDER BY x) AS xs FROM x GROUP BY metric),
  t AS (SELECT metric, sum(r) / sum(n) - sum(l) / sum(n) AS difference FROM v GROUP BY metric)
  SELECT metric, difference, xs[1 + floor((len(xs) - 1) * 0.025::DOUBLE)::INTEGER] AS low, xs[1 + ceil((len(xs) - 1) * 0.975::DOUBLE)::INTEGER] AS high FROM o JOIN t USING (metric)""")
def family_intervals(spark, sf_dir):
    rows = metrics.both_systems(*(_predictions(spark, sf_dir, s) for s in "ab"), ["doc_id", "lang", "source"])
    of = lambda name, side, c: F.sum(F.col(f"{side}_{c}").cast("double")).alias(name)
    sums = [rows.groupBy("lang", "source").agg(F.lit(m).alias("metric"), of("left_num", "left", c), F.count(F.lit(1)).alias("left_den"), of("right_num", "right", c), F.count(F.lit(1)).alias("right_den")) for m, c in (("accuracy", "correct"), ("nll", "nll"))]
    return metrics.family_bootstrap(sums[0].unionByName(sums[1]), "lang", "source", draws=200)


@query()
def balanced_orders(spark, sf_dir):
    """Exact quotas have no SQL; the test holds them against all selections."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey % 3 AS category", "o_orderkey % 20 AS blueprint", "2 + CAST(o_totalprice AS BIGINT) % 4 AS kind", "o_orderkey AS family")
    return study.balanced_selection(rows, "category", "blueprint", "kind", "family", {2: 5, 3: 5, 4: 5, 5: 5}, "balanced")


@query("""SELECT user_id, event_id, 2 * value + 1 AS value, CASE event_type WHEN 'click' THEN 'k1' WHEN 'view' THEN 'k2' ELSE event_type END AS said, value AS back_value, event_type AS back_said FROM events""")
def disguised_lists(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", F.struct(F.col("value").alias("time"), F.array("event_type").alias("said")).alias("what"))).alias("log"))
    how = dict(aliases={"click": "k1", "view": "k2"}, scale=2.0, offset=1.0)
    there = study.disguised_records(rows, "log", **how).withColumn("kept", F.col("log"))
    back = study.disguised_records(there, "log", inverse=True, **how).select("user_id", F.inline(F.arrays_zip("kept", "log")))
    return back.select("user_id", "kept.event_id", F.col("kept.what.time").alias("value"), F.col("kept.what.said")[0].alias("said"), F.col("log.what.time").alias("back_value"), F.col("log.what.said")[0].alias("back_said"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents) SELECT prefix, lang, count(*) AS n, count(DISTINCT source) AS source, count(DISTINCT n_chars % 50) AS shape
  FROM p JOIN (SELECT unnest([10, 40, 100])::INTEGER AS prefix) ON place < prefix GROUP BY prefix, lang""")
def covered_prefixes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") % 50).alias("shape"), (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).alias("place")).filter("place < 100")
    return study.prefix_coverage(rows, "place", [10, 40, 100], "lang", ["source", "shape"])


@query("SELECT sha256(text) AS signature, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    return study.repeated_signatures(read(spark, sf_dir, "documents").filter("text is not null").select(X.digest(F.col("text")).alias("signature")), "signature")


_REPLAY = SQL[training_schedule.__name__].replace("CASE WHEN doc_id % 2 = 0 THEN 'broad' ELSE 'contrast' END", "'old'")


@query(f"SELECT step, 'new' AS origin, NULL AS primitive, NULL AS source, 1000000000 + step % (SELECT 1 + max(conv_id) FROM conversations) AS id FROM range(300) t(step) UNION ALL SELECT step, origin, primitive, source, id FROM ({_REPLAY})")
def families_in_turn(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    families = talks.select("conv_id", (F.lit(1000000000) + F.col("conv_id")).alias("id"))
    return study.family_schedule(families, "id", "conv_id", read(spark, sf_dir, "documents").select(F.col("lang").alias("primitive"), "source", F.col("doc_id").alias("id")), 300, repeat=1 + talks.agg(F.max("conv_id")).first()[0])
