import hashlib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from adjudex.functions import text as X
from adjudex.operators import metrics, study
from adjudex.operators.records import record_features
from adjudex.sources import writers

ACTION = "actor:string,operation:string,target:string"
AT = "time:double,source:string,verified:boolean"
SCHEMA = (
    f"record int, query struct<{ACTION},run_id:string>, win_start double, win_end double, query_time double, trusted_sources array<string>,"
    f"statements array<struct<{ACTION},tense:string,polarity:string,endorsed:boolean>>, approvals array<struct<{ACTION},{AT},decision:string>>,"
    f"executions array<struct<{ACTION},run_id:string,{AT},mode:string,outcome:string>>, reversals array<struct<{ACTION},{AT},mode:string,outcome:string,reverses:string>>,"
    f"corroborations array<struct<{ACTION},run_id:string,{AT},outcome:string>>, items array<struct<id:string,status:string,verified:boolean>>,"
    f"state_events array<struct<target:string,{AT},active:boolean>>, item_ids array<string>, inventory_complete boolean, measurement double"
)
WHO = ("a", "o", "t")


def one(spark, **given):
    base = dict(record=1, query=(*WHO, "r"), win_start=1.0, win_end=9.0, trusted_sources=["s", "u"])
    names = [f.split(" ")[0].strip() for f in ("record", "query", "win_start", "win_end", "query_time", "trusted_sources", "statements", "approvals", "executions", "reversals", "corroborations", "items", "state_events", "item_ids", "inventory_complete", "measurement")]
    row = base | given
    return spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA)


def true_ones(df):
    got = record_features(df, "record").first().asDict()
    assert len(got) == 43
    return {k for k, v in got.items() if v is True}, got


def test_record_without_lists(spark):
    held, got = true_ones(one(spark))
    assert held == {"approval_unknown", "unknown", "item_unknown"} and got["item_count"] == 0
    assert record_features(one(spark).limit(0), "record").count() == 0


def test_record_reversed_and_seconded(spark):
    runs = [(*WHO, "r", 2.0, "s", True, "live", "success"), (*WHO, "q", 2.0, "s", True, "live", "no_effect"), (*WHO, "r", None, "s", True, "live", "no_effect"), (*WHO, "r", 3.0, "x", True, "live", "no_effect")]
    undo = lambda t: [(*WHO, t, "s", True, "live", "success", "r")]
    held, _ = true_ones(one(spark, executions=runs, reversals=undo(2.0), corroborations=[(*WHO, "r", 2.0, "u", True, "success")]))
    assert held == {"approval_unknown", "item_unknown", "invocation", "completed", "success_report", "failure_report", "any_live_success", "reversed", "corroborated", "actor_seen", "operation_seen", "target_seen", "run_seen"}
    held, _ = true_ones(one(spark, executions=runs, reversals=undo(1.5), corroborations=[(*WHO, "r", 2.0, "s", True, "success")]))
    assert "effective" in held and not held & {"reversed", "corroborated"}
    held, _ = true_ones(one(spark, query=(*WHO, None), executions=runs))
    assert "conflict" in held and "run_seen" not in held


def test_record_decisions_states_items(spark):
    decided = lambda *d: [(*WHO, t, "s", True, x) for t, x in d]
    assert "approved" in true_ones(one(spark, approvals=decided((2.0, "deny"), (3.0, "allow"), (99.0, "deny"))))[0]
    assert "approval_unknown" in true_ones(one(spark, approvals=decided((3.0, "deny"), (3.0, "allow"))))[0]
    states = [("t", 0.5, "s", True, True), ("t", 5.0, "s", True, False), ("z", 6.0, "s", True, True), ("t", 7.0, "x", True, True)]
    held, _ = true_ones(one(spark, state_events=states))
    assert held >= {"inactive_now", "active_earlier", "ever_active", "earlier_known"} and "active_now" not in held
    held, _ = true_ones(one(spark, state_events=[*states, ("t", 5.0, "s", True, None)], query_time=0.1))
    assert not held & {"current_known", "earlier_known"}
    held, got = true_ones(one(spark, items=[("i", "success", True), ("i", "success", True), ("j", "success", True), ("j", "no_effect", False), ("k", "no_effect", True)], item_ids=["i", "j", "i"], inventory_complete=True, measurement=2.5))
    assert held >= {"all_success", "has_measurement", "inventory_complete"} and (got["item_count"], got["success_count"]) == (2, 2)


def test_record_faults(spark):
    with pytest.raises(Exception, match="reversed"):
        record_features(one(spark, win_end=0.0), "record").collect()
    with pytest.raises(Exception, match="finite"):
        record_features(one(spark, measurement=math.nan), "record").collect()


def test_rule_blocks(spark):
    text = "module M\n  rule a => b // one\n     requires c\n\nrule <k> x /* two\nlines */ => y\nsyntax Z\nrest\nrule\n p"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.rule_blocks(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in got] == [["  rule a => b \n     requires c", "rule <k> x  => y", "rule\n p"], None, []]


def test_relevant_rules(spark):
    rules = ["rule I1 + I2 => I1 +Int I2", "rule I1 * I2 => x", "rule <k> X * Y </k> => .", "rule f(A) => B", "rule A <= B => C", "rule one two three four * five => six"]
    df = spark.createDataFrame([(rules, "x = 1 + 2"), (rules, "a <= b"), ([], "")], "r array<string>, p string")
    got = [r["k"] for r in df.select(X.relevant_rules(F.col("r"), F.col("p")).alias("k")).collect()]
    assert got == [[rules[0], rules[2], rules[3], rules[5]], [rules[2], rules[3], rules[4], rules[5]], []]


def first_selection(rows, quotas, seed):
    """All selections in order; the first that meets the quotas."""
    order = lambda v: hashlib.sha256(f"{seed}/{v}".encode()).hexdigest()
    blocks = [sorted((r for r in rows if r[0] == b), key=lambda r: order(r[2])) for b in sorted({r[0] for r in rows}, key=order)]
    for pick in itertools.product(*blocks):
        if all(sum(r[1] == k for r in pick) == n for k, n in quotas.items()) and all(r[1] in quotas for r in pick):
            return {r[2] for r in pick}


def test_balanced_selection_is_the_first_of_all(spark):
    made, found = random.Random(3), 0
    for case in range(12):
        rows = [(b, made.choice([2, 2, 3, 9]), f"f{case}-{b}-{i}") for b in range(5) for i in range(made.choice([1, 2, 4]))]
        expected = first_selection(rows, {2: 3, 3: 2}, "s")
        df = spark.createDataFrame([("c", *r) for r in rows], "category string, blueprint int, kind int, family string")
        got = study.balanced_selection(df, "category", "blueprint", "kind", "family", {2: 3, 3: 2}, "s")
        if expected is None:
            with pytest.raises(Exception, match="no balanced selection"):
                got.collect()
        else:
            found += 1
            assert {r["family"] for r in got.collect()} == expected
    assert 2 < found < 12


PREDICTIONS = "id int, family_id string, expected int, predicted int, probabilities array<double>, correct boolean, nll double, brier double, max_probability double"


def test_blocks_headlines_and_systems(spark):
    rows = [(1, "f", 1, 1, [0.1, 0.9], True, 0.1, 0.02, 0.9), (2, "f", 1, None, [0.5, 0.5], False, 0.7, 0.5, 0.5), (3, "g", 1, 0, [1.0, 0.0], False, 27.6, 2.0, 1.0)]
    df = spark.createDataFrame(rows, PREDICTIONS)
    got = metrics.metric_block(df, []).first()
    assert (got["n"], got["zero_targets"], got["wrong_95"], [tuple(c) for c in got["confusion"]]) == (3, 1, 1, [("1", "0", 1), ("1", "1", 1), ("1", "__tie__", 1)])
    assert got["mean_floored_nll"] == pytest.approx((-math.log(0.9) - math.log(0.5) - math.log(1e-12)) / 3) and got["ece"] == pytest.approx((1 * 0.5 + 2 * (0.95 - 0.5)) / 3)  # 0.9 and 1.0 share a bin
    assert [(b["bin"], b["n"]) for b in got["bins"]] == [(5, 1), (9, 2)]
    assert metrics.metric_block(df.limit(0), ["family_id"]).count() == 0
    assert tuple(metrics.headline(df).first()) == (1, 3, 1)
    assert tuple(metrics.headline(df, spark.createDataFrame([("f",), ("f",)], "family_id string")).first()) == (1, 2, 0)
    other = df.withColumn("probabilities", F.array(F.lit(0.5), F.lit(0.5)))
    both = metrics.compare_systems(df, other, ["id"]).first()
    assert (both["questions"], both["label_changes"], both["max_difference"], both["left_correct"]) == (3, 0, 0.5, 1) and both["mean_variation"] == pytest.approx(0.3)
    for bad in (df.filter("id < 3"), df.withColumn("expected", F.lit(0)), df.withColumn("probabilities", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="populations"):
            metrics.compare_systems(df, bad, ["id"]).collect()


def test_family_bootstrap(spark):
    sums = spark.createDataFrame([("c", f"f{i}", "accuracy", 1.0, 2, 2.0, 2) for i in range(4)] + [("c", "f0", "none", 0.0, 0, 0.0, 0)], "category string, family string, metric string, left_num double, left_den long, right_num double, right_den long")
    got = {r["metric"]: (r["difference"], r["low"], r["high"]) for r in metrics.family_bootstrap(sums, "category", "family", 20).collect()}
    assert got == {"accuracy": (0.5, 0.5, 0.5), "none": (None, None, None)}
    assert metrics.family_bootstrap(sums.limit(0), "category", "family", 20).count() == 0


def test_replaced_texts_reports_and_prepared_rows(spark, tmp_path):
    for text in ("one", json.dumps({"two": "é"})):
        writers.replace_text(spark, text, f"{tmp_path}/manifest.json")
        assert (tmp_path / "manifest.json").read_text() == text
    assert not list(tmp_path.glob("*.partial"))
    page = writers.html_report({"a & b": spark.createDataFrame([("<x>", 0.5, None)], "s string, d double, n int")}, "t")
    assert "<h2>a &amp; b</h2>" in page and "<td>&lt;x&gt;</td><td>0.5000</td><td>—</td>" in page
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, n int")
    ask = lambda most, rows=df, key="k": writers.prepared(rows, str(tmp_path), [key], F.col("n"), most)
    kept, rejected = ask(10)
    assert [r["id"] for r in kept.collect()] == [1] and sorted(r["reason"] for r in rejected.collect()) == ["longer than 10: 50", "longer than 10: unknown"]
    assert ask(10, df.limit(0))[0].count() == 1 and ask(60)[0].count() == 2
    with pytest.raises(ValueError, match="no rows"):
        ask(1)


def test_auxiliary_facts(spark):
    from adjudex.operators.records import auxiliary_facts

    runs = [(*WHO, "r", 2.0, "s", True, "live", "success"), (*WHO, "r", 3.0, "x", True, "live", "timeout"), ("b", "o", "t", "r", 3.0, "s", True, "live", "success")]
    df = one(spark, executions=runs, query_time=3.0, state_events=[("t", 2.0, "s", True, True)], item_ids=["i", "i", "j"], items=[("i", "success", True)], approvals=[(*WHO, 2.0, "s", True, "allow"), (*WHO, 2.0, "u", True, "deny")])
    df = df.withColumn("category", F.lit("c"))
    names = ["live_success_receipt", "live_timeout_receipt", "scoped_untrusted_execution", "other_live_success_receipt", "permission_latest_allow_report", "permission_latest_deny_report", "item_scope_count", "item_unknown_count", "state_earlier_active", "measurement_value", "execution_present"]
    got = auxiliary_facts(df, "record", "category", {n: ["z"] if n == "execution_present" else ["c", "z"] for n in names}).first()
    assert got["targets"] == [1, 0, 1, 1, 1, 1, 2, 1, 1, 0, 0] and got["masks"] == [True] * 9 + [False, False]
    empty = auxiliary_facts(one(spark).withColumn("category", F.lit(None).cast("string")), "record", "category", dict.fromkeys(names, ["c"])).first()
    assert empty["targets"] == [0.0] * 11 and not any(empty["masks"])
    with pytest.raises(ValueError, match="unknown facts: odd"):
        auxiliary_facts(df, "record", "category", {"odd": ["c"]})


def test_signatures_forget_names_only(spark):
    from adjudex.operators.records import semantic_signatures

    raw = {"query": {"actor": "ann", "run_id": "r1"}, "trusted_sources": ["s"], "item_ids": ["i", "j"], "executions": [{"actor": "ann", "source": "s", "run_id": "r1", "time": 3}, {"actor": "bob", "source": "x", "run_id": "r2", "time": 4}], "statements": [{"speaker": "ann"}, {"speaker": "kim"}]}
    text = json.dumps(raw)
    renamed = text
    for a, b in (("ann", "zoe"), ("bob", "amy"), ("kim", "lee"), ('"r1"', '"q"'), ('"r2"', '"p"'), ('"s"', '"news"'), ('"x"', '"blog"'), ('"i"', '"one"')):
        renamed = renamed.replace(a, b)
    others = [text.replace("bob", "ann"), text.replace('"x"', '"s"'), text.replace('"time": 4', '"time": 5'), text.replace("kim", "ann")]
    texts = [(t, "{}") for t in (text, renamed, *others)] + [(text, "[1]"), (None, "{}"), ("{}", None), ("no json", None), (text, "{ }")]
    df = spark.createDataFrame([(i, *t, "x") for i, t in enumerate(texts)], "i int, r string, p string, signature string")
    got = [r["signature"] for r in semantic_signatures(df, "r", "p").orderBy("i").collect()]
    assert len(got) == len(texts) and got[0] == got[1] == got[10] and got[7] is None and got[9] is None
    assert len({got[0], *got[2:7], got[8]}) == 7
    assert semantic_signatures(df.limit(0), "r", "p").count() == 0


def test_signatures_of_speakers_and_sources(spark):
    from adjudex.operators.records import semantic_signatures

    base = {"query": {"actor": "ann", "target": "t"}, "trusted_sources": ["s", "s2"], "approvals": [{"actor": "bob"}], "statements": [{"speaker": "bob", "source": "s"}, {"speaker": "kim", "source": "x"}]}
    change = lambda **kw: {**base, **kw}
    same = [base, change(approvals=[{"actor": "kim"}], statements=[{"speaker": "kim", "source": "s2"}, {"speaker": "bob", "source": "y"}]), change(trusted_sources=["s2", "s", "s"])]
    other = [change(trusted_sources=["s"]), change(statements=[{"speaker": "kim", "source": "s"}, {"speaker": "bob", "source": "x"}]), change(statements=[{"speaker": "bob", "source": "s"}, {"speaker": "kim", "source": "s2"}]), change(approvals=[]), change(approvals=[{"actor": "ann"}])]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([*same, *other])], "i int, r string").selectExpr("*", "'[]' AS p")
    got = [r["signature"] for r in semantic_signatures(df, "r", "p").orderBy("i").collect()]
    assert len(set(got[:3])) == 1 and len(set(got)) == 1 + len(other)


def test_leaves_come_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    from adjudex.operators import trees

    monkeypatch.setattr(trees, "LEAVES_AT_ONCE", 10)
    texts = [json.dumps({"a": list(range(i % 7)), "b": None}) for i in range(100)] + ["no json", None, "3"]
    got = list(trees.leaf_batches(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts[:1])])))
    sizes = [sum(len(x or ()) for x in batch.to_pylist()) for batch in got]
    assert max(sizes) < 10 + 8 and sum(map(len, got)) == len(texts) + 1
    rows = [x for batch in got for x in batch.to_pylist()]
    assert rows[100:102] == [None, None] and [[leaf["value"] for leaf in x] for x in rows[:4]] == [["[]", "null"], ["0", "null"], ["0", "1", "null"], ["0", "1", "2", "null"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    assert {r["i"]: r["n"] for r in df.select("i", trees.F.size(trees.tree_leaves("t")).alias("n")).collect()} == {i: None if x is None else len(x) for i, x in enumerate(rows[:-1])}


def test_signatures_take_records_apart_in_one_pass(spark):
    from adjudex.operators.records import semantic_signatures

    df = spark.createDataFrame([("{}", "[]")], "r string, p string")
    plan = semantic_signatures(df, "r", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tree_leaves") == 1


def test_disguised_records_come_back(spark):
    df = spark.createDataFrame([((3.0, [1.0, 5.0], [("ann", 2)], "x"),), ((None, None, [None, (None, None)], None),), (None,)], "r struct<time:double,window:array<double>,who:array<struct<name:string,n:int>>,other:string>")
    how = dict(aliases={"ann": "bob"}, scale=4.0, offset=-1.0)
    there = study.disguised_records(df, "r", **how)
    assert there.first()["r"].asDict(True) == {"time": 11.0, "window": [3.0, 19.0], "who": [{"name": "bob", "n": 2}], "other": "x"}
    assert study.disguised_records(there, "r", inverse=True, **how).collect() == df.collect()
    with pytest.raises(ValueError, match="no number"):
        study.disguised_records(spark.createDataFrame([((True,),)], "r struct<time:boolean>"), "r", **how)
    with pytest.raises(ValueError, match="reversible"):
        study.disguised_records(df, "r", {"a": "c", "b": "c"}, 1.0, 0.0)


def test_family_schedule(spark):
    pools = spark.createDataFrame([("p", "s", "old1"), ("p", "s", "old2")], "primitive string, source string, id string")
    families = spark.createDataFrame([(f"f{i}", i) for i in range(3)], "family string, place int")
    ask = lambda n, **how: sorted((r["step"], r["origin"], r["id"]) for r in study.family_schedule(families, "family", "place", pools, n, **how).collect())
    assert [x[2] for x in ask(3) if x[1] == "new"] == ["f0", "f1", "f2"] and [x[2] for x in ask(5, repeat=2) if x[1] == "new"] == ["f0", "f1", "f0", "f1", "f0"]
    old = lambda rows: [x for x in rows if x[1] == "old" and x[0] < 3]
    assert old(ask(3)) == old(ask(5, repeat=2)) and len(old(ask(3))) == 3
    with pytest.raises(Exception, match="do not cover"):
        ask(4)


def test_prefix_coverage_and_repeats(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 2, None), ("a", 3, "y")], "c string, place int, s string")
    got = {(r["prefix"], r["c"]): (r["n"], r["s"]) for r in study.prefix_coverage(df, "place", [2, 4], "c", ["s"]).collect()}
    assert got == {(2, "a"): (2, 1), (4, "a"): (3, 2), (4, "b"): (1, 0)}
    assert [tuple(r) for r in study.repeated_signatures(df, "s").collect()] == [("x", 2)]
