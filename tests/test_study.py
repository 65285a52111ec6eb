import math
import random

import pytest
from pyspark.sql import functions as F

from adjudex.functions import text as X
from adjudex.operators import calibration, study
from adjudex.operators import requests as R
from adjudex.operators import validation as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_capped_picks_need_enough(spark):
    df = spark.createDataFrame([("a", 3, True), ("a", 1, True), ("a", 2, True), ("a", 0, None), ("b", 5, True)], "kind string, id int, ok boolean")
    assert rows(study.capped_picks(df, "kind", ["a"], F.col("ok"), F.col("id")).select("id", "place")) == [(1, 1), (2, 2)]
    fails(study.capped_picks(df, "kind", ["a", "b"], F.col("ok"), F.col("id")), "too few eligible rows of b")
    fails(study.capped_picks(df.limit(0), "kind", ["a"], F.col("ok"), F.col("id")), "too few eligible rows of a")


def test_covering_picks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([("y", 1, "u", 5), ("x", 2, "u", 9), ("z", 3, None, 9), ("w", 4, "v", None)], "arm string, id int, cat string, size int")
    got = study.covering_picks(df, ["arm", "id"], {"cat": F.col("cat")}, {"size": F.col("size")}, F.col("arm") != "w")
    assert rows(got) == [("x", 2, ["cat:u", "size"])]
    assert study.covering_picks(df.limit(0), ["arm", "id"], {"cat": F.col("cat")}, {"size": F.col("size")}, F.lit(True)).count() == 0


def test_context_groups(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": None, "c": "3"}, ["p", "q", "r"]), (2, {"a": "1"}, [])], "id int, state map<string,string>, questions array<string>")
    got = study.context_groups(df, {"p": ["b", "a"], "q": ["c"], "r": ["a", "b"], "s": ["z"]})
    assert rows(got.select("id", "fields", "questions", "state")) == [(1, ["a", "b"], ["p", "r"], {"a": "1", "b": None}), (1, ["c"], ["q"], {"c": "3"})]
    ask = lambda q: df.withColumn("questions", F.array(F.lit(q)))
    fails(study.context_groups(ask("t"), {"p": ["a"]}), "no fields for question t")
    fails(study.context_groups(ask("s"), {"s": ["z"]}), "lacks one of z")


def test_answer_logits(spark):
    df = spark.createDataFrame([("noul", 1.5, None, ["false", "true"], 1.0), ("score", None, {"1": 2.0, "0": -1.0}, ["0", "1"], 1.0)], "kind string, z double, by map<string,double>, labels array<string>, t double")
    made = lambda d, how="identity-uncalibrated": d.select(study.answer_logits(F.col("kind"), F.col("z"), F.col("by"), F.col("labels"), F.col("t"), F.lit(how)).alias("l"))
    assert rows(made(df)) == [([-1.0, 2.0],), ([0.0, 1.5],)]
    for bad in (df.withColumn("t", F.lit(2.0)), df.withColumn("labels", F.array(F.lit("0"))), df.withColumn("z", F.lit(math.nan)), df.withColumn("z", F.lit(None).cast("double"))):
        fails(made(bad), "logits are calibrated")
    fails(made(df, "other"), "logits are calibrated")


def test_calibration_rows(spark):
    df = spark.createDataFrame([("c", "q", "noul", ["false", "true"], [0.0, 1.0], True)], "case_id string, question_id string, primitive string, labels array<string>, logits array<double>, target boolean")
    assert study.calibration_rows(df, "x").first()["target_index"] == 1
    fails(study.calibration_rows(df.withColumn("target", F.lit("maybe")), "x"), "no label")


def test_disguise_comes_off(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "z"), (-2.5, None)], "t double, s string")
    how = dict(times=["t"], names=["s"], aliases={"a": "b", "b": "a"}, scale=2.0, offset=-1.0)
    there = study.disguised(df, **how)
    assert rows(there) == sorted([(1.0, "b"), (None, "z"), (-6.0, None)], key=str)
    assert rows(study.disguised(there, inverse=True, **how)) == rows(df)
    for bad in ({"aliases": {"a": "c", "b": "c"}}, {"scale": 0.0}):
        with pytest.raises(ValueError):
            study.disguised(df, **{**how, **bad})


def test_interleaved_short_category(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 7), ("q", 1), (None, 2)], "c string, id int")
    assert rows(study.interleaved(df, "c", ["y", "x"], F.col("id"), 3, [2, 4])) == [("x", 0, 1, 2), ("x", 1, 3, 4), ("x", 2, 5, None), ("y", 7, 0, 2)]


def test_set_relations(spark):
    p = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "id int, correct boolean, predicted string")
    pair = lambda *r: spark.createDataFrame([r], "left_id int, right_id int, axis string, contrast_axis string")
    (r,) = study.set_relations(pair(1, 2, None, "k"), p, ["id"]).collect()
    assert (r["axis"], r["both_correct"], r["left_predicted"], r["right_predicted"]) == ("k", False, "a", "b")
    fails(study.set_relations(pair(1, 2, "j", "k"), p, ["id"]), "axis names differ")
    fails(study.set_relations(pair(1, 3, "k", None), p, ["id"]), "lacks a prediction")


def test_effects_of_one_family_a_category(spark):
    df = spark.createDataFrame([("x", "f", 0.0, 0.5, 0.25, 1.0), ("y", "g", 1.0, 0.5, 0.75, 1.0)], "cat string, fam string, a double, b double, c double, d double")
    got = {r["effect"]: (r["estimate"], r["low"], r["high"]) for r in study.factorial_effects(df, "cat", "fam", draws=5).collect()}
    assert set(got) == set(study.EFFECTS) and all(e == low == high for e, low, high in got.values())
    assert got["interaction"][0] == 0.5 and got["rubric_average"][0] == 0.25


def test_schedule_repeats_nothing_within_a_cycle(spark):
    pools = spark.createDataFrame([("o", "k", "s", i) for i in range(5)] + [("o", "k", "t", i + 10) for i in range(40)], "origin string, primitive string, source string, id int")
    got = {r["step"]: (r["source"], r["id"]) for r in study.schedule(pools, 25).collect()}
    assert sorted(got) == list(range(25)) and all(got[i][0] == "st"[i % 2] for i in got)
    s = [got[i][1] for i in range(0, 25, 2)]
    assert set(s[:5]) == set(s[5:10]) == set(range(5)) and len({got[i][1] for i in range(1, 25, 2)}) == 12
    assert rows(study.schedule(pools, 1))[0][0] == 0 and study.schedule(pools.limit(0), 5).count() == 0


def test_blueprints_balance(spark):
    df = spark.createDataFrame([(f"c{c}", a, c * 100 + a * 50 + i) for c in range(3) for a in (0, 1) for i in range(20)], "category string, author int, id int")
    got = study.assigned_blueprints(df).collect()
    assert len(got) == 120 and {r["category_index"] for r in got} == set(range(40))
    for c in ("c0", "c1", "c2"):
        mine = [r for r in got if r["category"] == c]
        same = [r for r in mine if r["low_blueprint"] == r["high_blueprint"]]
        assert len({r["low_blueprint"] for r in mine}) == 20 and len(same) == 20
        assert len({r["low_blueprint"] for r in mine} | {r["high_blueprint"] for r in mine}) == 40
        assert [sum(r["broad_k"] == k for r in same) for k in (2, 3, 4, 5)] == [5, 5, 5, 5]


def test_target_faults_of_nulls(spark):
    wanted = spark.createDataFrame([(i, ["a", "b"], "h", None) for i in (1, 2, 3, 4)], "id int, labels array<string>, request_sha256 string, computed map<string,double>")
    found = spark.createDataFrame([(1, {"a": 0.5, "b": 0.5}, "h"), (2, {"a": None, "b": 1.0}, "h"), (3, None, "h"), (4, {"a": 0.5, "b": 0.5}, None)], "id int, probabilities map<string,double>, request_sha256 string")
    assert rows(V.target_faults(wanted, found, ["id"])) == [(2, "value"), (3, "labels"), (4, "request")]


def test_human_source(spark):
    names = spark.createDataFrame([("a-b.txt",), ("plain.TXT",), ("-x",), ("n.txt.gz",), (None,)], "f string")
    assert rows(names.select(X.human_source(F.col("f")))) == sorted([("a",), ("plain",), ("",), ("n.txt.gz",), (None,)], key=str)


def test_changed_paths(spark):
    pairs = [('{"a":1,"b":[1,{"c":2}]}', '{"a":1.0,"b":[1,{"c":3}],"d":null}'), ('{"a":[1]}', '{"a":[1,2]}'), ("[1]", "{}"), ("1", "1"), ("x", "1"), (None, "1")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string").select("i", R.changed_paths("l", "r").alias("p"))
    assert [p for _, p in rows(df)] == [["record.a", "record.b[1].c", "record.d"], ["record.a"], ["record"], [], None, None]


@pytest.mark.parametrize("affine,spread", [(True, 1.0), (False, 1.0), (True, 400.0), (True, 0.001)])
def test_affine_fit_against_coordinate_bisection(spark, affine, spread):
    rng = random.Random(5)
    data = [(z * spread, float(rng.random() < 1 / (1 + math.exp(-(0.6 * z + 0.8)))), 1 / 60) for z in (rng.gauss(0, 2) for _ in range(60))]
    fit = calibration.fit_affine(spark.createDataFrame(data, "logit double, y double, weight double"), affine=affine)

    def slope(t, k):
        off = [(w * (1 / (1 + math.exp(-max(min(t[0] * z + t[1], 700), -700))) - y), z) for z, y, w in data]
        return sum(o * (z if k == 0 else 1) for o, z in off) + calibration.RIDGE * (t[k] - (1 - k))

    t = [1.0, 0.0]
    for _ in range(300):
        for k in range(2 if affine else 1):
            low, high = (calibration.SCALE, calibration.OFFSET)[k]
            for _ in range(60):
                t[k] = (low + high) / 2
                low, high = (low, t[k]) if slope(t, k) > 0 else (t[k], high)
    assert abs(fit["a"] - t[0]) < 1e-5 * max(1, t[0]) and abs(fit["b"] - t[1]) < 1e-5
    assert fit["objective"] <= fit["identity_objective"]


def test_affine_fit_refuses(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 0.0, 1.0)], "logit double, y double, weight double")
    for bad in (df, df.limit(0)):
        with pytest.raises(ValueError):
            calibration.fit_affine(bad)


def test_places_are_permuted(spark):
    sizes = [1, 2, 3, 4, 5, 16, 17, 100, 1000]
    rows = spark.createDataFrame([(n, i, k) for n in sizes for i in range(n) for k in ("a", "b")], "n long, i long, k string")
    got = {}
    for r in rows.withColumn("to", study.permuted_place(F.col("i"), F.col("n"), F.col("k"))).collect():
        got.setdefault((r["n"], r["k"]), {})[r["i"]] = r["to"]
    assert all(sorted(to.values()) == list(range(n)) for (n, _), to in got.items())
    assert got[1000, "a"] != got[1000, "b"] and sum(i == j for i, j in got[1000, "a"].items()) < 20
    big = spark.range(5).select(study.permuted_place(F.col("id") + (1 << 40), F.lit(1 << 41), F.lit("k"))).collect()
    assert len({r[0] for r in big}) == 5 and all(0 <= r[0] < 1 << 41 for r in big)


def test_paired_schedule(spark):
    pools = [(o, p, s, f"{o}{p}{s}{i}") for o in ("original", "new") for p in ("noul", "choice", "score") for s, n in (("a", 3), ("b", 40)) for i in range(n)]
    df = spark.createDataFrame(pools, "origin string, primitive string, source string, id string")
    rows = study.paired_schedule(df, 50).collect()
    assert sorted((r["step"], r["slot"]) for r in rows) == [(s, k) for s in range(50) for k in range(6)]
    assert {r["slot"]: (r["primitive"], r["origin"]) for r in rows} == dict(enumerate((p, o) for p in ("noul", "choice", "score") for o in ("original", "new")))
    assert all(r["source"] == "ab"[r["step"] % 2] for r in rows)
    ids = [r["id"] for r in sorted(rows, key=lambda r: r["step"]) if r["slot"] == 0 and r["source"] == "a"]
    cycles = [ids[i : i + 3] for i in range(0, 24, 3)]
    assert all(len(set(c)) == 3 for c in cycles) and len({tuple(c) for c in cycles}) > 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, study.paired_schedule(df.repartition(7), 50).collect()))
    for wrong, said in ((df.filter("primitive <> 'score' or origin = 'new'"), "every primitive"), (df.unionAll(df.limit(1)), "2 times")):
        with pytest.raises(ValueError, match=said):
            study.paired_schedule(wrong, 5)


def test_records_that_differ_in_one_field(spark):
    records = [(1, "x", "p", None), (2, "x", "p", "n"), (3, "y", "p", None), (4, "x", "p", None), (5, "z", "q", "n"), (6, "y", "p", "n"), (7, "z", "p", None)]
    got = study.one_field_apart(spark.createDataFrame(records, "id int, a string, b string, c string"), "id", ["a", "b", "c"]).collect()
    assert sorted((r["field"], r["record"], r["next"]) for r in got) == [("a", 1, 3), ("a", 2, 6), ("a", 3, 7), ("c", 1, 2), ("c", 3, 6)]
    assert study.one_field_apart(spark.createDataFrame([], "id int, a string, b string"), "id", ["a", "b"]).count() == 0


def test_partners_in_one_field_take_one_exchange_of_groups(spark):
    records = [(1, "x", "p", None), (2, "x", "p", "n"), (3, "y", "p", None), (4, "x", "p", None), (5, "z", "q", "n"), (6, "y", "p", "n"), (7, "z", "p", None)]
    got = study.one_field_partners(spark.createDataFrame(records, "id int, a string, b string, c string"), "id", ["a", "b", "c"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("a", 2, 1), ("a", 3, 2), ("a", 6, 1), ("a", 7, 2), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1), ("c", 6, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan and plan.count("Aggregate") == 1


def test_block_counts_are_one_multinomial_draw():
    import numpy as np

    total, size, draws = 1037, 100, 4000
    counts = np.array([study.block_counts(total, b, size, draws, "s", "c") for b in range(11)])
    assert (counts.sum(axis=0) == total).all()
    p = np.array([100 / total] * 10 + [37 / total])
    assert np.abs(counts.mean(axis=1) - total * p).max() < 5 * np.sqrt(total * p.max() / draws)
    assert np.abs(counts.var(axis=1) / (total * p * (1 - p)) - 1).max() < 0.15
    assert abs(np.cov(counts[0], counts[7])[0, 1] / (-total * p[0] * p[7]) - 1) < 0.5


def test_pairwise_effects(spark):
    rng = random.Random(8)
    rows = [("big", i, rng.gauss(1, 1), rng.gauss(0, 1)) for i in range(400)] + [("small", i, 2.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "category string, family int, a double, b double")
    got = study.pairwise_effects(df, "category", "family", [("a", "b"), ("b", "a")], draws=1500).orderBy("effect").collect()
    mean = lambda name, i: sum(r[i] for r in rows if r[0] == name) / sum(r[0] == name for r in rows)
    point = (mean("big", 2) - mean("big", 3) + 1) / 2
    spread = math.sqrt(sum((r[2] - r[3] - mean("big", 2) + mean("big", 3)) ** 2 for r in rows if r[0] == "big") / 400 / 400) / 2
    assert got[0]["estimate"] == pytest.approx(point) and got[1]["estimate"] == pytest.approx(-point) and got[0]["low"] == pytest.approx(-got[1]["high"])
    assert got[0]["low"] == pytest.approx(point - 1.96 * spread, abs=0.25 * spread) and got[0]["high"] == pytest.approx(point + 1.96 * spread, abs=0.25 * spread)
    draws = lambda n: sorted(tuple(r) for r in study.macro_draws(df.repartition(n), "category", "family", ["a"], 50, size=64).collect())
    assert [r[0] for r in draws(2)] == list(range(-1, 50)) and [x for r in draws(2) for x in r] == pytest.approx([x for r in draws(9) for x in r])
    with pytest.raises(ValueError, match="finite"):
        study.pairwise_effects(df.unionAll(df.limit(1)), "category", "family", [("a", "b")])
    assert study.pairwise_effects(df.limit(0), "category", "family", [("a", "b")]).count() == 0
