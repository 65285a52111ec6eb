"""Queries over questions, answers and schemas. Requests are made of the tables' rows, so that SQL knows what they compile to."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import requests as R
from .registry import query, read


def _requests(spark, sf_dir):
    """A request on each turn: its state is the turn's number and role, its questions stand in a tree; every seventh has no question."""
    state = F.format_string('{"turn": %s, "role": "%s"}', F.col("turn"), F.col("role"))
    tree = F.format_string('{"basic": {"polite": {"type": "noul", "instructions": "Is turn %s polite?"}, "none": {}}, "more": [{"type": "choice", "criteria": {"user": "u", "assistant": "a", "turn %s": null}}, {"type": "score", "instructions": {"of": %s}, "criteria": ["low", "mid", "high"]}]}', F.col("turn"), F.col("turn"), F.col("conv_id"))
    tree = F.when(F.col("conv_id") % 7 == 3, "{}").otherwise(tree)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.withColumn("request", F.concat(F.lit('{"questions": '), tree, F.lit(', "state": '), state, F.lit("}")))


_UNITS = """WITH c AS (SELECT conv_id, turn, '{"role":"' || role || '","turn":' || turn || '}' AS state FROM conversations),
  u AS (SELECT conv_id, turn, state, unnest([{'path': '["basic","polite"]', 'primitive': 'noul', 'place': 0, 'option': 'true', 'q': '"Is turn ' || turn || ' polite?"', 'f': 'binary_criteria', 'k': '{"false":null,"true":null}'},
    {'path': '["more",0]', 'primitive': 'choice', 'place': 0, 'option': 'user', 'q': 'null', 'f': 'criterion', 'k': '{"description":"u","name":"user"}'}, {'path': '["more",0]', 'primitive': 'choice', 'place': 1, 'option': 'assistant', 'q': 'null', 'f': 'criterion', 'k': '{"description":"a","name":"assistant"}'},
    {'path': '["more",0]', 'primitive': 'choice', 'place': 2, 'option': 'turn ' || turn, 'q': 'null', 'f': 'criterion', 'k': '{"description":null,"name":"turn ' || turn || '"}'},
    {'path': '["more",1]', 'primitive': 'score', 'place': 0, 'option': '0', 'q': '{"of":' || conv_id || '}', 'f': 'criterion', 'k': '{"description":"low"}'}, {'path': '["more",1]', 'primitive': 'score', 'place': 1, 'option': '1', 'q': '{"of":' || conv_id || '}', 'f': 'criterion', 'k': '{"description":"mid"}'},
    {'path': '["more",1]', 'primitive': 'score', 'place': 2, 'option': '2', 'q': '{"of":' || conv_id || '}', 'f': 'criterion', 'k': '{"description":"high"}'}], recursive := true) FROM c WHERE conv_id % 7 <> 3) """


@query(_UNITS + """SELECT conv_id, turn, NULL AS error, path, primitive, place::INTEGER AS place, option, (primitive = 'noul')::INTEGER AS readout,
  sha256(CASE WHEN f = 'criterion' THEN '{"criterion":' || k || ',"question":' || q || ',"state":' || state || '}' ELSE '{"binary_criteria":' || k || ',"question":' || q || ',"state":' || state || '}' END) AS payload,
  'STATE:' || chr(10) || state || chr(10) || 'QUESTION:' || chr(10) || q || chr(10) || upper(f) || ':' || chr(10) || k AS message FROM u
  UNION ALL SELECT conv_id, turn, 'no question', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE conv_id % 7 = 3""")
def compiled_requests(spark, sf_dir):
    units = R.compile_requests(_requests(spark, sf_dir), keep=("conv_id", "turn"))
    return units.select("conv_id", "turn", "error", "path", "primitive", "place", "option", "readout", F.sha2("payload", 256).alias("payload"), "message")


@query("""SELECT sha256('{"questions":' || CASE WHEN conv_id % 7 = 3 THEN '{}' ELSE '{"basic":{"none":{},"polite":{"instructions":"Is turn ' || turn || ' polite?","type":"noul"}},"more":[{"criteria":{"assistant":"a","turn ' || turn || '":null,"user":"u"},"type":"choice"},{"criteria":["low","mid","high"],"instructions":{"of":' || conv_id || '},"type":"score"}]}' END
  || ',"state":{"role":"' || role || '","turn":' || turn || '}}') AS request, count(*) AS n FROM conversations GROUP BY 1""")
def request_hashes(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy(R.request_hash(F.col("request")).alias("request")).agg(F.count(F.lit(1)).alias("n"))


def _answers(spark, sf_dir, digits=3):
    """An answer tree for each embedding: three elements give a yes/no answer, a choice and levels."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    p = F.round(F.abs(e(1)) % 1, digits)
    tree = F.format_string('{"a": {"noul": %s}, "b": [{"choice": "%s"}, {"probabilities": {"0": %s, "1": %s, "2": 0.25}}]}', p.cast("string"), F.when(e(2) > e(3), "x").otherwise("y"), (p * 0.75).cast("string"), ((1 - p) * 0.75).cast("string"))
    return read(spark, sf_dir, "embeddings").select("vec_id", tree.alias("answers"))


_LEAVES = """WITH e AS (SELECT vec_id, round(abs(embedding[1]::DOUBLE) % 1, 3) AS p, embedding[2] > embedding[3] AS x FROM embeddings),
  l AS (SELECT vec_id, '["a"]' AS path, CASE WHEN p >= 0.5 THEN 'true' ELSE 'false' END AS decision FROM e UNION ALL SELECT vec_id, '["b",0]', CASE WHEN x THEN 'x' ELSE 'y' END FROM e
  UNION ALL SELECT vec_id, '["b",1]', CASE WHEN p * 0.75 >= (1 - p) * 0.75 AND p * 0.75 >= 0.25 THEN '0' WHEN (1 - p) * 0.75 >= 0.25 THEN '1' ELSE '2' END FROM e) """


@query(_LEAVES + "SELECT * FROM l")
def answer_decisions(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("vec_id", F.inline(R.answer_leaves(F.col("answers"))))
    return rows.select("vec_id", "path", R.leaf_decision(F.col("leaf")).alias("decision"))


@query("SELECT vec_id, true AS same FROM embeddings")
def restored_trees(spark, sf_dir):
    """Trees taken apart and put together again are the same."""
    rows = _answers(spark, sf_dir)
    again = R.restore_trees(rows.select("vec_id", F.inline(R.answer_leaves(F.col("answers")))), ["vec_id"]).select("vec_id", F.col("answers").alias("again"))
    return rows.join(again, "vec_id").select("vec_id", (R.canonical(F.col("answers")) == F.col("again")).alias("same"))


@query("""WITH e AS (SELECT vec_id, round(abs(embedding[1]::DOUBLE) % 1, 3) AS p, round(abs(embedding[1]::DOUBLE) % 1, 2) AS r FROM embeddings)
  SELECT vec_id, unnest(['["a"]', '["b",0]', '["b",1]']) AS path, 'both' AS side, unnest([abs(p - r), NULL, greatest(abs(p * 0.75::DOUBLE - r * 0.75::DOUBLE), abs((1 - p) * 0.75::DOUBLE - (1 - r) * 0.75::DOUBLE))]) AS difference FROM e""")
def tree_differences(spark, sf_dir):
    """Against the same answers in fewer digits."""
    return R.tree_difference(_answers(spark, sf_dir), _answers(spark, sf_dir, 2), ["vec_id"])


_SCHEMAS = """CASE label % 4 WHEN 0 THEN '{"good": {"type": "boolean"}, "kind": {"type": "enum", "choices": ["a", "b"]}}' WHEN 1 THEN '{"good": {"type": "boolean"}}' WHEN 2 THEN '{"kind": {"type": "enum", "choices": ["a", "a"]}}' ELSE '{}' END"""
_SAID = """CASE vec_id % 5 WHEN 0 THEN '{"good": true, "kind": "b"}' WHEN 1 THEN '{"good": true}' WHEN 2 THEN '{"good": 1}' WHEN 3 THEN '{"good": true, "good": false}' ELSE 'good' END"""


@query("""SELECT vec_id, CASE label % 4 WHEN 2 THEN 'kind: choices are different texts' WHEN 3 THEN 'a schema is an object with fields' END AS error,
  (label % 4 = 0 AND vec_id % 5 = 0) OR (label % 4 = 1 AND vec_id % 5 = 1) AS valid FROM embeddings""")
def answer_validity(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(_SCHEMAS).alias("schema"), F.expr(_SAID).alias("said"))
    return rows.select("vec_id", R.schema_error(F.col("schema")).alias("error"), R.valid_answer(F.col("said"), F.col("schema")).alias("valid"))


@query("""SELECT conv_id, turn, sha256('CONTEXT (data):' || chr(10) || text || chr(10) || chr(10) || 'Question for "role": Who speaks?' || chr(10) || 'Options:' || chr(10) || 'A: "user"' || chr(10) || 'B: "assistant"' || chr(10) || 'C: "' || role || turn || '"' || chr(10) || 'Answer only the option code.') AS prompt FROM conversations""")
def flat_prompts(spark, sf_dir):
    options = F.array(F.lit("user"), F.lit("assistant"), F.concat("role", F.col("turn").cast("string")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(R.flat_prompt(F.col("text"), F.lit("role"), F.lit("Who speaks?"), options), 256).alias("prompt"))





@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: floor(abs(x::DOUBLE) * 100) / 100) AS v FROM embeddings), s AS (SELECT *, [v[1], v[2], v[3], round(1 - v[1] - v[2] - v[3], 2) + CASE WHEN vec_id % 3 = 0 THEN 0.01 WHEN vec_id % 11 = 0 THEN 0.04 ELSE 0 END] AS p FROM e),
  t AS (SELECT *, p[1] + p[2] + p[3] + p[4] AS s FROM s), n AS (SELECT *, CASE WHEN abs(s - 1) <= 1e-6 THEN p WHEN abs(s - 1) <= 0.020000001 AND list_min(p) >= 0 THEN list_transform(p, lambda x: x / s) END AS q FROM t WHERE list_min(p) >= 0)
  SELECT vec_id, s AS raw, abs(s - 1) > 1e-6 AS normalised, q IS NOT NULL AND q[4] >= list_max(q) - 1e-6 AS ok FROM n""")
def checked_answers(spark, sf_dir):
    """Vectors of four in hundredths, of which the last is the choice; some miss a sum of 1."""
    v = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(F.abs(x.cast("double")) * 100) / 100)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    last = F.round(1 - F.col("v")[0] - F.col("v")[1] - F.col("v")[2], 2) + F.when(F.col("vec_id") % 3 == 0, 0.01).when(F.col("vec_id") % 11 == 0, 0.04).otherwise(0.0)
    rows = rows.withColumn("p", F.concat("v", F.array(last))).filter(F.array_min("p") >= 0)
    options = F.array(*[F.lit(f"o{i}") for i in range(1, 5)])
    view = R.answer_view(F.col("p"), F.lit(None).cast("double"), options, F.lit("o4"))
    return rows.withColumn("view", view).select("vec_id", "view.raw", "view.normalised", "view.ok")


@query("""WITH s AS (SELECT label AS question, vec_id, abs(embedding[1]::DOUBLE) AS a, abs(embedding[2]::DOUBLE) AS b FROM embeddings), v AS (SELECT question, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN a > b THEN 1.0 ELSE 0.0 END ELSE a / (a + b) END AS x, vec_id % 3 > 0 AS soft FROM s),
  g AS (SELECT question, avg(x) AS x, bool_or(soft) AS soft, avg(1 - x) AS y FROM v GROUP BY question)
  SELECT question, CASE WHEN abs(x - y) <= 1e-12 THEN 'tied' ELSE 'ok' END AS status, CASE WHEN abs(x - y) > 1e-12 THEN CASE WHEN x > y THEN 'l' ELSE 'r' END END AS label, x AS p, soft AS probabilistic FROM g""")
def pooled_references(spark, sf_dir):
    """Embeddings of one label are reference sets of one question: two elements give a vector, every third a label only."""
    a, b = F.abs(F.col("embedding")[0].cast("double")), F.abs(F.col("embedding")[1].cast("double"))
    hard = F.col("vec_id") % 3 == 0
    sets = read(spark, sf_dir, "embeddings").select(F.col("label").alias("question"), F.lit("choice").alias("question_type"), F.lit("choice").alias("entry_type"), F.when(~hard, F.array(a / (a + b), b / (a + b))).alias("probabilities"), F.when(hard, F.when(a > b, "l").otherwise("r")).alias("label"), F.array(F.lit("l"), F.lit("r")).alias("options"))
    return R.reference_pool(sets, ["question"]).select("question", "status", "label", F.col("probabilities")[0].alias("p"), "probabilistic")
