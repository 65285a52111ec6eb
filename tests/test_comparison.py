import pytest
from pyspark.sql import functions as F

from adjudex.operators import comparison, corpus, metrics


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_relations_of_unlike_vectors_and_ties(spark):
    p = spark.createDataFrame([(1, 0, 0, [0.8, 0.2]), (2, 1, 1, [0.3, 0.7]), (3, 0, None, [0.5, 0.5]), (4, 0, 0, [1.0])], "k int, expected int, predicted int, probabilities array<double>")
    r = spark.createDataFrame([("contrast", 1, 2), ("invariant", 3, 3), ("contrast", 1, 4), ("invariant", 1, 9)], "kind string, left_k int, right_k int")
    found = {(x["left_k"], x["right_k"]): x for x in comparison.relation_metrics(r, p, ["k"]).collect()}
    assert set(found) == {(1, 2), (3, 3), (1, 4)}
    assert found[1, 2]["direction_correct"] and abs(found[1, 2]["margin"] - 0.5) < 1e-12 and found[1, 2]["within_tolerance"] is None
    assert not found[3, 3]["both_correct"] and found[3, 3]["same_prediction"] and found[3, 3]["within_tolerance"]
    assert found[1, 4]["total_variation"] is None and found[1, 4]["direction_correct"] is None


def test_layouts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, None), (3, None)], "f int, v string")
    got = {r["f"]: (r["layouts"], r["stable"], r["agreement"]) for r in comparison.layout_stability(a, ["f"], "v").collect()}
    assert got == {1: (3, False, 1 / 3), 2: (1, True, None), 3: (2, True, 1.0)}


def test_unanimous_needs_all_runs(spark):
    runs = spark.createDataFrame([(1, "YES")] * 3 + [(2, "YES"), (2, "NO"), (2, "YES"), (3, "YES"), (3, None), (3, "YES"), (4, "YES")], "c int, v string")
    assert rows(comparison.unanimous(runs, ["c"], "v")) == [(1, "GOOD"), (2, "BAD")]


def test_judge_score_keeps_unknown_validity(spark):
    j = spark.createDataFrame([("BAD", "GOOD", None), ("BAD", "BAD", False), ("GOOD", "BAD", False), ("GOOD", None, True)], "label string, judged string, valid boolean")
    (r,) = comparison.judge_score(j, [], keep=F.col("valid")).collect()
    assert (r["n"], r["accuracy"], r["misses"], r["n_bad"], r["miss"], r["alarms"], r["n_good"], r["alarm"]) == (2, 0.0, 1, 1, 1.0, 1, 1, 1.0)
    assert comparison.judge_score(j.filter("label is null").withColumn("x", F.lit(1)), ["x"]).count() == 0


def test_predictive_value(spark):
    (r,) = spark.range(1).select(comparison.predictive_value(F.lit(0.6), F.lit(0.05), 0.2).alias("v"), comparison.predictive_value(F.lit(0.0), F.lit(0.0), 0.2).alias("none")).collect()
    assert abs(r["v"] - 0.12 / 0.16) < 1e-12 and r["none"] is None


def test_coverage_without_covered_rows(spark):
    p = spark.createDataFrame([("g", 0.92, False), ("g", 0.5, True)], "s string, max_probability double, correct boolean")
    assert rows(comparison.confidence_coverage(p, ["s"])) == [("g", 0.9, 1, 0.5, 1, 1.0), ("g", 0.95, 0, 0.0, 0, None)]


def test_eligibility_and_picks(spark):
    v = spark.createDataFrame([("a", "binary", 0.0), ("a", "binary", 0.0), ("a", "binary", 1.0), ("b", "number", 2.0), ("b", "number", None), ("c", "number", 2.0), ("c", "number", 3.0), ("d", "number", None)], "feature string, kind string, value double")
    assert {r["feature"]: r["eligible"] for r in corpus.eligibility(v).collect()} == {"a": False, "b": False, "c": True, "d": False}
    c = spark.createDataFrame([("x", 3), ("x", 1), ("y", None), (None, 5)], "category string, id int")
    assert rows(corpus.first_per_category(c, "category", F.col("id"))) == [("x", 1), (None, 5)]


def test_unknown_rates_of_nothing(spark):
    p = spark.createDataFrame([("s", "Unknown", None), ("t", "a", "b")], "g string, expected string, predicted string")
    assert rows(metrics.unknown_rates(p, ["g"])) == [("s", 1, 1, 0, 0, 0.0, None), ("t", 1, 0, 0, 0, None, None)]


def test_layout_report_needs_every_answer_once(spark):
    schema = "c int, f string, k string, said string, gold string"
    report = lambda rows: comparison.layout_report(spark.createDataFrame(rows, schema), "c", "f", "k", "said", "gold")
    rows = [(c, f, k, None if c == 0 and k == "l1" else "x", "x") for c in range(4) for f in "pq" for k in ("l1", "l2")]
    got = report(rows).first()
    assert (got["cases"], got["fields"], got["layouts"], got["worst_layout"], got["worst_accuracy"]) == (4, 8, 2, "l1", 0.75)
    assert (got["mean_accuracy"], got["mean_whole_cases"], got["stable_fields"], got["stable_cases"], got["agreement"]) == (0.875, 0.875, 0.75, 0.75, 0.75)
    assert report([r for r in rows if r[2] == "l1"]).first()["agreement"] == 1 and report([]).count() == 0
    for wrong in (rows[1:], [*rows, rows[0]]):
        with pytest.raises(ValueError, match="layouts"):
            report(wrong)
