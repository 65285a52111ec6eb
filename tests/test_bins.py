"""Order statistics of heavy tails and hot keys: like bins, and figures that don't hang on them."""

import random

import pytest
from pyspark.sql import functions as F

from adjudex.operators import facts, metrics
from adjudex.operators.shared import BINS_SIDE, bin_bounds, bin_of


def test_bins_of_heavy_tails_are_alike(spark):
    n = 200000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.pow(F.lit(10.0), F.col("id") % 300 - 150 + F.rand(3)).alias("v")).withColumn("v", F.when(F.rand(5) < 1e-4, 1e300).otherwise(F.col("v")))
    rows = rows.select("g", "v").distinct()
    binned = rows.join(bin_bounds(rows, ["g"], "v", "bounds"), "g").select("v", bin_of(F.col("v"), F.col("bounds")).alias("bin"))
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("bin").collect()
    assert len(per) > 0.9 * BINS_SIDE**2 and max(r["n"] for r in per) <= 2 * sum(r["n"] for r in per) / BINS_SIDE**2
    assert all(a["hi"] <= b["lo"] for a, b in zip(per, per[1:], strict=False))


def test_few_and_missing_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("c", 5.0)], "g string, v double")
    got = rows.join(bin_bounds(rows, ["g"], "v", "bounds"), "g", "left").select("g", "v", bin_of(F.col("v"), F.col("bounds")).alias("bin")).collect()
    assert {(r["g"], r["v"]): r["bin"] >= 0 for r in got} == {(r["g"], r["v"]): True for r in rows.collect()}
    low, high = (next(r["bin"] for r in got if r["v"] == v) for v in (1.0, 2.0))
    assert low < high and next(r["bin"] for r in got if r["g"] == "b") == 0


def test_auc_of_heavy_tails(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), int(rng.random() < 0.4), rng.choice([rng.random(), 10.0 ** rng.randrange(-200, 200), 0.5])) for _ in range(1500)]
    got = {r["g"]: r["auc"] for r in metrics.auc(spark.createDataFrame(rows, "g string, label int, score double"), "label", "score", ["g"]).collect()}
    for g in "xy":
        pos, neg = ([s for k, y, s in rows if k == g and y == label] for label in (1, 0))
        assert got[g] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))


@pytest.mark.parametrize("run", [1 << 16, 50])
def test_one_hot_key_is_parted_by_time(spark, run):
    rng = random.Random(9)
    events = [("hot", rng.randrange(0, 4000), rng.randrange(5)) for _ in range(3000)] + [("cold", i, i) for i in range(0, 40, 7)]
    events += [("hot", 10**9, None)]
    queries = [("hot", rng.choice([rng.randrange(-50, 4100), 10**9 + 1])) for _ in range(800)] + [("cold", i) for i in range(-3, 45)] + [("none", 5)]
    of = {}
    for key, t, v in events:
        of.setdefault(key, {}).setdefault(t, set()).add(v)

    def state(key, at):
        times = [t for t in of.get(key, {}) if t <= at]
        values = of[key][max(times)] - {None} if times else {None}
        return next(iter(values)) if len(values) == 1 else None

    df = facts.active_at(spark.createDataFrame(queries, "k string, query_time long"), spark.createDataFrame(events, "k string, ts long, v int"), ["k"], "ts", "v", run=run)
    got = df.collect()
    assert len(got) == len(queries) and all(r["state"] == state(r["k"], r["query_time"]) for r in got)
