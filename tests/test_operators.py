"""Brute force and round trips where SQL has no say."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from adjudex.functions import probability as P
from adjudex.functions import text as X
from adjudex.operators import calibration, corpus, detector, requests
from adjudex.operators.shared import prefix_sums


def test_prefix_sums_in_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 400), rng.randint(-5, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(7)
    one, many = (sorted(map(tuple, prefix_sums(df, [F.col("k"), F.col("id")], {"v_sum": F.col("v"), "n": F.lit(1)}, spread).collect())) for spread in (False, True))
    total, want = 0, []
    for n, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        want.append((i, k, v, total, n))
        total += v
    assert one == many == sorted(want)


def test_disjoint_picks_are_greedy(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 40), rng.choice([None, *range(30)]), rng.random()) for i in range(200)]
    used, want = {("b", 3)}, set()
    for i, a, b, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        keys = {("a", a)} | ({("b", b)} if b is not None else set())
        if not keys & used:
            used |= keys
            want.add(i)
    df = spark.createDataFrame(rows, "i int, a int, b int, rank double")
    got = corpus.disjoint_picks(df, "i", ["a", "b"], F.col("rank"), spark.createDataFrame([("b:3",)], "key string"))
    assert {r["i"] for r in got.collect()} == want


def test_references_and_cleaning(spark):
    rows = spark.createDataFrame([("a &lt;b&gt; &#8212; &#x1F600; &amp;lt; &#99999999; [12] [Citation Needed]  x [edit]\n\n\n\n y &quot;",)], "t string")
    assert rows.select(X.decoded(F.col("t"))).first()[0] == "a <b> — 😀 < &#99999999; [12] [Citation Needed]  x [edit]\n\n\n\n y \""
    assert rows.select(X.cleaned(X.decoded(F.col("t")))).first()[0] == "a <b> — 😀 < &#99999999; x\n\ny \""
    page = "<nav><p>no</p></nav><P class=x>one <b>two</b><sup>[3]</sup></P><table><tr><td><p>no</p></table><p></p><p>a &lt;x&gt;</p>"
    assert spark.range(1).select(X.paragraphs(F.lit(page))).first()[0] == ["one two", "a <x>"]


def test_assembling_stops_in_bounds(spark):
    words = lambda n: " ".join(["words"] * n)
    for sizes, want in (((100, 100, 300), 200), ((100, 40), None), ((100, 320, 10), 420), ((150, 100, 100, 60), 350)):
        got = spark.createDataFrame([([words(n) for n in sizes],)], "p array<string>").select(X.assembled(F.col("p")).alias("a")).first()["a"]
        assert (got and got["words"]) == want


def test_tells_are_sorted_and_stable(spark):
    row = spark.createDataFrame([(0.7, 0.9, 0.59949, 0.7)], "a double, b double, c double, d double")
    got = row.select(detector.tells({c: F.col(c) for c in "abcd"})).first()[0]
    assert [(t["family"], t["strength"]) for t in got] == [("b", 0.9), ("a", 0.7), ("d", 0.7)]


def test_mixed_samples_have_low_confidence(spark):
    rows = spark.createDataFrame([("a", 1000, 0.97, "high"), ("a", 40, 0.2, "low"), ("b", 30, None, "low")], "s string, words int, probability double, confidence string")
    got = {r["s"]: r for r in detector.score_samples(rows, "s").collect()}
    assert (got["a"]["verdict"], got["a"]["confidence"], got["a"]["mixed"], got["a"]["probability"]) == ("likely_ai", "low", True, 0.94)
    assert (got["b"]["verdict"], got["b"]["confidence"], got["b"]["mixed"]) == ("too_short", "low", False)


@pytest.mark.parametrize(("k", "n"), [(1, 44), (3, 10), (50, 60), (499, 1000), (2, 100000)])
def test_upper_bounds_leave_five_percent(spark, k, n):
    p = spark.createDataFrame([(k, n)], "k int, n int").select(calibration.upper_bound("k", "n")).first()[0]
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert sum(terms) == pytest.approx(0.05, rel=1e-6)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_crossfit_uses_other_folds(spark, by):
    rng = random.Random(3)
    rows = [(i, "pq"[i % 2], i % 3, [0.0, rng.gauss(0, 2)], int(rng.random() < 0.3 + 0.4 * (i % 2)), rng.random()) for i in range(90)] + [(99, "lone", 0, [0.0, 1.0], 1, 1.0)] * bool(by)
    df = spark.createDataFrame(rows, "id int, g string, fold int, logits array<double>, gold int, w double")
    fits = calibration.fit_left_out_temperatures(df, "fold", by, weight="w", rounds=5).collect()
    assert len(fits) == (6 if by else 3)
    for r in fits:
        others = df.filter(F.col("fold") != r["fold"]).filter(F.lit(True) if not by else F.col("g") == r["g"])
        alone = calibration.fit_temperatures(others.withColumn("unit", F.lit(0)), ["unit"], weight="w", rounds=5).first()
        assert r["objective"] == pytest.approx(alone["objective"], abs=1e-9) and r["identity_objective"] == pytest.approx(alone["identity_objective"], abs=1e-9)
        assert r["temperature"] == pytest.approx(alone["temperature"], rel=1e-3)
    got = calibration.crossfit(df, by, weight="w", rounds=2).collect()
    assert len(got) == 90 and all(r["kept_winner"] for r in got)


def test_held_labels_change_nothing_of_their_fit(spark):
    rng = random.Random(4)
    rows = [(i % 4, [0.0, rng.gauss(0, 2)], rng.randint(0, 1)) for i in range(80)]
    fit = lambda rows: {r["fold"]: r["temperature"] for r in calibration.fit_left_out_temperatures(spark.createDataFrame(rows, "fold int, logits array<double>, gold int"), "fold", rounds=3).collect()}
    before, after = fit(rows), fit([(f, z, 1 - y if f == 0 else y) for f, z, y in rows])
    assert before[0] == pytest.approx(after[0], rel=1e-9) and any(abs(before[f] / after[f] - 1) > 1e-3 for f in (1, 2, 3))


def test_left_out_logistic_fits(spark):
    rng = random.Random(5)
    rows = [("abcd"[i % 4], rng.gauss(0, 1), rng.gauss(0, 3), rng.random() + 0.1) for i in range(200)]
    rows = [(g, x, z, int(rng.random() < 1 / (1 + math.exp(-x - 0.2 * z))), w) for g, x, z, w in rows]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1, 1.0), ("a", None, 1.0, 0, 1.0)], "g string, x double, z double, y int, w double").repartition(5)
    fits = {r["held_out"]: r for r in calibration.fit_left_out_logistic(df, "g", ["x", "z"], "y", "w", penalty=0.05).collect()}
    for g in "abcd":
        model = calibration.fit_logistic(df.filter(F.col("g") != g), ["x", "z"], "y", "w", penalty=0.05)
        assert fits[g]["rows"] == 150 and [fits[g]["intercept"], *fits[g]["coefficients"]] == pytest.approx([model.intercept, *model.coefficients], abs=1e-5)
    scored = calibration.left_out_scores(df, calibration.fit_left_out_logistic(df, "g", ["x", "z"], "y", "w", penalty=0.05), "g", ["x", "z"]).filter("x is not null").collect()
    assert len(scored) == 201 and all((r["score"] is None) == (r["g"] is None) for r in scored)
    r = next(r for r in scored if r["g"] == "b")
    f = fits["b"]
    assert r["score"] == pytest.approx(1 / (1 + math.exp(-(f["intercept"] + f["coefficients"][0] * r["x"] + f["coefficients"][1] * r["z"]))))
    assert calibration.fit_left_out_logistic(df, "g", ["x"], "y", "w", penalty=0.1, n=2).count() == 2 and calibration.fit_left_out_logistic(df.limit(0), "g", ["x"], "y", "w").count() == 0
    with pytest.raises(RuntimeError, match="not converged"):
        calibration.fit_left_out_logistic(spark.createDataFrame([("a", -1.0, 0, 1.0), ("a", 1.0, 1, 1.0), ("b", -2.0, 0, 1.0), ("b", 2.0, 1, 1.0)], "g string, x double, y int, w double"), "g", ["x"], "y", "w", passes=12)


def test_logistic_regression(spark):
    rows = [(float(x), int(x > 4) if x not in (3, 6) else int(x == 3), 1.0) for x in range(10)]
    model = calibration.fit_logistic(spark.createDataFrame(rows, "x double, y int, w double"), ["x"], "y", "w")
    b, a = model.coefficients[0], model.intercept
    slope = [sum((1 / (1 + math.exp(-(a + b * x))) - y) * z for x, y, _ in rows) for z in (1.0,)]
    assert slope[0] == pytest.approx(0, abs=1e-4) and b > 0


def test_weights_and_binary_metrics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "g string, v int")
    assert sorted(r["weight"] for r in calibration.case_weights(df, "g").collect()) == pytest.approx([1 / 6, 1 / 6, 1 / 3, 1 / 3])
    m = calibration.binary_metrics(spark.createDataFrame([(0.0, 1), (-1.0, 0), (2.0, 0)], "logit double, y int"), []).first()
    assert (m["n"], m["recall"], m["specificity"]) == (3, 1.0, 0.5)


def test_requests_that_are_wrong(spark):
    good = {"state": "s", "questions": {"type": {"a": {"type": "noul"}}, "b": []}}
    wrong = [{"state": 1, "questions": {"type": "noul"}}, {"state": "s"}, {"state": "s", "questions": {"type": "odd"}}, {"state": "s", "questions": {"type": "choice", "criteria": {}}}, {"state": "s", "questions": {"type": "score", "criteria": ["x"]}}, {"state": "s", "questions": {"type": "noul", "criteria": {"maybe": 1}}}, {"state": "s", "questions": {"type": "noul", "more": 1}}, {"state": "s", "questions": "x"}, {"state": "s", "questions": {}}]
    texts = [json.dumps(good), *map(json.dumps, wrong), '{"state": "s", "state": "t", "questions": {"type": "noul"}}', '{"state": NaN}', None]
    rows = requests.compile_requests(spark.createDataFrame(list(enumerate(texts)), "i int, request string"), keep=("i",)).collect()
    assert {r["i"] for r in rows if r["error"] is None} == {0} and len(rows) == len(texts)
    assert [(r["path"], r["primitive"], r["readout"]) for r in rows if r["i"] == 0] == [('["type","a"]', "noul", 1)]


def test_units_keep_their_order_and_texts(spark):
    leaf = {"type": "choice", "instructions": {"b": 1, "a": "é"}, "criteria": {"z\"q": "last", "a": {"y": 1, "x": 2}, "m": None}}
    deep = {"type": "noul", "criteria": {"true": ["t"]}}
    for _ in range(300):
        deep = {"in": [deep]}
    asked = [{"state": ["s", 1.50], "model": " m ", "questions": {"b": leaf, "a": [{"type": "score", "criteria": ["x", {"k": 0}]}, {}], "type": deep}}]
    wrong = [{"state": "s", "questions": {"q": leaf}, "model": m} for m in ("", " \n", 5, None)] + [{"state": "s", "questions": [{"type": 5}]}, {"state": "s", "questions": [{"type": "noul"}, 7]}, ["state", "questions"], {"state": "s", "questions": {"type": "noul", "criteria": []}}]
    rows = requests.compile_requests(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(asked + wrong)], "i int, request string"), keep=("i",)).collect()
    good = [r for r in rows if r["i"] == 0]
    assert [r["error"] is None for r in rows] == [r["i"] == 0 for r in rows] and len(rows) == len(good) + len(wrong)
    assert [(r["primitive"], r["place"], r["option"], r["readout"], r["model"]) for r in good] == [("choice", 0, 'z"q', 0, " m "), ("choice", 1, "a", 0, " m "), ("choice", 2, "m", 0, " m "), ("score", 0, "0", 0, " m "), ("score", 1, "1", 0, " m "), ("noul", 0, "true", 1, " m ")]
    state, said = '["s",1.5]', '{"description":{"x":2,"y":1},"name":"a"}'
    assert good[1]["payload"] == f'{{"criterion":{said},"question":{{"a":"é","b":1}},"state":{state}}}' and json.loads(good[0]["payload"])["criterion"] == {"description": "last", "name": 'z"q'}
    assert good[1]["message"] == f'STATE:\n{state}\nQUESTION:\n{{"a":"é","b":1}}\nCRITERION:\n{said}'
    assert good[5]["message"].endswith('QUESTION:\nnull\nBINARY_CRITERIA:\n{"false":null,"true":["t"]}') and json.loads(good[5]["path"])[:3] == ["type", "in", 0] and len(json.loads(good[5]["path"])) == 601


def test_answers_of_other_kinds(spark):
    r = spark.createDataFrame([('{"a": {"noul": 0.5}, "b": {"noul": 1}}', " B\n", [0.2, 0.5, 0.3], [0.5, 0.3, 0.1])], "t string, said string, p array<double>, odd array<double>")
    got = r.select(
        requests.detector_answers(F.col("t"), ["a", "b"]).alias("both"), requests.detector_answers(F.col("t"), ["a", "c"]).alias("one"), requests.natural_answer(F.col("said"), ["A", "B"]).alias("code"),
        P.display_rounded(F.col("odd")).alias("none"), P.class_loss(F.col("p"), F.lit(1)).alias("loss"), requests.decoded_scores(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit("y"), F.lit("x"))).alias("d"),
        F.array(*[requests.option_code(F.lit(i)) for i in (0, 25, 26, 701, 702)]).alias("codes"), P.mean_within(F.col("p"), F.lit(1.104), F.lit(False)).alias("near"),
    ).first()
    assert got["both"] == {"a": 0.5, "b": 1.0} and got["one"] is None and got["code"] == "B" and got["none"] is None and got["d"] == [0.9, 0.1] and got["near"]
    assert got["loss"] == pytest.approx(math.log(sum(math.exp(v) for v in (0.2, 0.5, 0.3))) - 0.5) and got["codes"] == ["A", "Z", "AA", "ZZ", "AAA"]
