"""Facts from event records: windows, trust, as-of state, reversals, corroboration; rules over facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bin_bounds, bin_of, saved


def matches(query: Column, value: Column) -> Column:
    """A key that the query leaves open matches all."""
    return query.isNull() | (query == value)


def within(events: DataFrame, queries: DataFrame, key: str, time: str = "ts", start: str = "win_start", end: str = "win_end") -> DataFrame:
    """Events inside each query's window, both ends included; joined on the key, the range is what is left to check."""
    return events.join(queries, key).filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end)))


def trusted(events: DataFrame, sources: DataFrame, source: str = "source", verified: str = "verified") -> DataFrame:
    """Verified events of trusted sources."""
    return events.filter(F.col(verified)).join(sources.select(source).distinct(), source, "left_semi")


def latest(events: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """The value at the last time of each key; null where events of that time disagree. One pass, no window: extremes of (time, value) are aggregated first."""
    at = events.groupBy(*key, time).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    last = at.groupBy(*key).agg(F.max_by(F.struct("lo", "hi"), time).alias("v"), F.max(time).alias("at"))
    return last.select(*key, "at", F.when(F.col("v.lo").eqNullSafe(F.col("v.hi")), F.col("v.lo")).alias("value"))


#: Rows of a key that one window takes; a key with more is parted by time.
RUN = 1 << 16


def active_at(queries: DataFrame, events: DataFrame, key: list[str], time: str, value: str, at: str = "query_time", run: int = RUN) -> DataFrame:
    """`queries` with `state`: the value of their key's last event not after `at`; null without one, or where events of that time disagree.

    An as-of join without pairs: both sides stand in one table by key and time, and each query takes the last event before it. A key
    with more than `run` moments is parted into bins of time of like size; a query takes the last event of its bin, or else the one that
    the bins before it end with, which is carried on over one row a bin. So a key of any size is spread over tasks.
    """
    moments = events.groupBy(*key, F.col(time).alias("moment")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    moments = moments.select(*key, "moment", F.lit(0).alias("rank"), F.struct(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).alias("v")).alias("event"), F.lit(False).alias("asks"))
    asked = queries.select(*key, F.col(at).alias("moment")).distinct().select(*key, "moment", F.lit(1).alias("rank"), F.lit(None).cast(moments.schema["event"].dataType).alias("event"), F.lit(True).alias("asks"))
    both = saved(moments.unionByName(asked), "moments")
    hot = both.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > run).select(*key)
    bounds = bin_bounds(both.join(hot, key, "left_semi"), key, "moment", "bounds")
    rows = both.join(bounds, key, "left").withColumn("bin", bin_of(F.col("moment"), F.col("bounds"))).drop("bounds")
    ends = rows.filter("not asks").groupBy(*key, "bin").agg(F.max_by("event", "moment").alias("end"))
    bins = rows.select(*key, "bin").distinct().join(ends, [*key, "bin"], "left")
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select(*key, "bin", carried.alias("carried"))
    last = F.last("event", ignorenulls=True).over(Window.partitionBy(*key, "bin").orderBy("moment", "rank").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("last", last).filter("asks").join(carried, [*key, "bin"]).withColumn("state", F.coalesce("last", "carried"))
    return queries.join(found.select(*key, F.col("moment").alias(at), F.col("state.v").alias("state")), [*key, at], "left")


def adjudicated(reports: DataFrame, key: list[str], outcome: str, success: str = "success", failure: str = "no_effect") -> DataFrame:
    """Per key `completed` (a success, no failure), `failed`, `conflict` (both); reports of neither say nothing."""
    s, f = F.bool_or(F.col(outcome) == success), F.bool_or(F.col(outcome) == failure)
    rows = reports.groupBy(*key).agg(F.coalesce(s, F.lit(False)).alias("s"), F.coalesce(f, F.lit(False)).alias("f"))
    return rows.select(*key, (F.col("s") & ~F.col("f")).alias("completed"), (F.col("f") & ~F.col("s")).alias("failed"), (F.col("s") & F.col("f")).alias("conflict"))


def item_rollup(declared: DataFrame, items: DataFrame, record: str, item: str, status: str = "status", known: tuple[str, ...] = ("success", "no_effect")) -> DataFrame:
    """Per record, over its declared items: how many have each known status, and how many none or conflicting ones (`unknown`); `complete` without such."""
    seen = items.filter(F.col(status).isin(*known)).groupBy(record, item).agg(F.min(status).alias("lo"), F.max(status).alias("hi"))
    rows = declared.select(record, item).distinct().join(seen, [record, item], "left").withColumn("is", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("unknown"))
    counts = rows.groupBy(record).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("is") == k).alias(k) for k in (*known, "unknown")])
    return counts.withColumn("complete", F.col("unknown") == 0)


def reversed_by(done: DataFrame, reversals: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """What was done and reversed at the same time or later: a semi-join on the key and each key's last reversal."""
    last = reversals.groupBy(key).agg(F.max(time).alias("__last"))
    return done.join(last, key).filter(F.col("__last") >= F.col(time)).drop("__last")


def corroborated(claims: DataFrame, reports: DataFrame, key: str, source: str, time: str = "ts") -> DataFrame:
    """Claims that another source reports at the same time or later.

    The last time of the two latest sources per key decides: one of them is another source than the claim's. No pairs are made.
    """
    last = reports.groupBy(key, source).agg(F.max(time).alias("t"))
    top = last.groupBy(key).agg(F.max_by(source, F.struct("t", source)).alias("s1"), F.max("t").alias("t1"))
    second = last.join(top, key).filter(F.col(source) != F.col("s1")).groupBy(key).agg(F.max("t").alias("t2"))
    both = claims.join(top, key).join(second, key, "left")
    return both.filter(F.when(F.col("s1") != F.col(source), F.col("t1")).otherwise(F.col("t2")) >= F.col(time)).drop("s1", "t1", "t2")


def rule(tree: dict, features: dict[str, Column]) -> Column:
    """A boolean column from {"feature": f} | {"not": r} | {"all": [..]} | {"any": [..]} | {"at_least": n, "of": [..]} | {"compare": f, "op": o, "value": v}.

    all of nothing is true, any of nothing false. An unknown feature or operator is an error.
    """
    kind = next((k for k in ("feature", "not", "all", "any", "at_least", "compare") if k in tree), None)
    if kind == "feature":
        return features[tree["feature"]]
    if kind == "not":
        return ~rule(tree["not"], features)
    if kind == "all":
        return reduce(lambda a, b: a & b, [rule(t, features) for t in tree["all"]], F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, [rule(t, features) for t in tree["any"]], F.lit(False))
    if kind == "at_least":
        return reduce(lambda a, b: a + b, [rule(t, features).cast("int") for t in tree["of"]], F.lit(0)) >= tree["at_least"]
    if kind == "compare":
        x, v = features[tree["compare"]], F.lit(tree["value"])
        return {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "==": x == v, "!=": x != v}[tree["op"]]
    raise ValueError(f"no rule: {tree}")


def highest_level(levels: list[Column]) -> Column:
    """Place of the last condition that holds; null if none does."""
    return F.array_max(F.filter(F.array(*[F.when(c, i) for i, c in enumerate(levels)]), lambda i: i.isNotNull()))


def only_choice(options: dict[str, Column]) -> Column:
    """The option whose condition alone holds; null if none or several do."""
    held = F.filter(F.array(*[F.when(c, k) for k, c in options.items()]), lambda o: o.isNotNull())
    return F.when(F.size(held) == 1, held[0])


def status_of(reversed_: Column, confirmed: Column, no_effect: Column) -> Column:
    """By precedence: reversed, confirmed, no_effect, else unknown."""
    hold = lambda c: F.coalesce(c, F.lit(False))
    return F.when(hold(reversed_), "reversed").when(hold(confirmed), "confirmed").when(hold(no_effect), "no_effect").otherwise("unknown")


def quantified(items: DataFrame, record: str, item: str, order: str, status: str) -> DataFrame:
    """Per record, of each item its last report: `all_confirmed`, `any_confirmed`, `none_confirmed` and the rubric `level`: 0 none, 1 some, 2 all."""
    last = items.groupBy(record, item).agg(F.max_by(status, order).alias("status"))
    yes = F.count_if(F.col("status") == "confirmed")
    rows = last.groupBy(record).agg(yes.alias("yes"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("yes") == 0, 0).when(F.col("yes") < F.col("n"), 1).otherwise(2)
    return rows.select(record, (F.col("yes") == F.col("n")).alias("all_confirmed"), (F.col("yes") > 0).alias("any_confirmed"), (F.col("yes") == 0).alias("none_confirmed"), level.alias("level"))


def masked(features: DataFrame, kinds: dict[str, Column], applies: dict[str, Column]) -> DataFrame:
    """Targets with masks: for each name `target`, 0 where it doesn't apply, and `mask`, 1 where it does."""
    each = F.array(*[F.struct(F.lit(k).alias("feature"), F.when(applies[k], v.cast("double")).otherwise(0.0).alias("target"), F.coalesce(applies[k], F.lit(False)).cast("int").alias("mask")) for k, v in kinds.items()])
    return features.select("record", F.inline(each))


def related_pairs(cases: DataFrame, family: str, case: str, target: str, equal: bool, most: int, seed: str = "") -> DataFrame:
    """`most` pairs of a family's cases whose targets are equal, or differ, by the hash of both ids, out of the first `most` + 1 cases of each target by hash."""
    rank = F.row_number().over(Window.partitionBy(family, target).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(case).cast("string")), 256)))
    rows = cases.select(family, case, target).withColumn("r", rank).filter(F.col("r") <= most + 1)
    l, r = (rows.select(family, F.col(case).alias(f"{s}_case"), F.col(target).alias(f"{s}_target")) for s in ("left", "right"))
    same = F.col("left_target") == F.col("right_target")
    pairs = l.join(r, family).filter((F.col("left_case") < F.col("right_case")) & (same if equal else ~same))
    order = Window.partitionBy(family).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col("left_case").cast("string"), F.col("right_case").cast("string")), 256))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
