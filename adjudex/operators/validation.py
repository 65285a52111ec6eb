"""Checks of suites, predictions and corpora. Each returns what breaks it, or named conditions with whether they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVARIANTS = ("paraphrase", "order", "irrelevant")


def conditions(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(`condition`, `holds`) for aggregates over `rows`, and `ready`, which holds if all do; null counts as false."""
    one = rows.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in named.items()])
    every = F.lit(True)
    for k in named:
        every = every & F.col(k)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(k).alias("holds")) for k in named], F.struct(F.lit("ready").alias("condition"), every.alias("holds")))))


def relation_faults(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Relations that are broken, with the first `fault` of each.

    `relations`: id, kind, left_case, left_question, right_case, right_question. `fields`: case_id, question_id, family, primitive,
    answer_space, expected. Faults: repeated id, unknown kind, missing endpoint, other family, other answer space, contradiction (the
    targets are equal exactly for invariant kinds), other case (a question contrast stays in one).
    """
    end = lambda side: fields.select(F.col("case_id").alias(f"{side}_case"), F.col("question_id").alias(f"{side}_question"), F.struct("family", "primitive", "answer_space", "expected").alias(side))
    rows = relations.join(end("left"), ["left_case", "left_question"], "left").join(end("right"), ["right_case", "right_question"], "left")
    rows = rows.join(relations.groupBy("id").agg(F.count(F.lit(1)).alias("times")), "id")
    l, r, kind = F.col("left"), F.col("right"), F.col("kind")
    invariant = kind.isin(*INVARIANTS)
    fault = F.when(F.col("times") > 1, "repeated id").when(~invariant & ~kind.isin("flip", "question_contrast"), "unknown kind").when(l.isNull() | r.isNull(), "missing endpoint")
    fault = fault.when(l["family"] != r["family"], "other family").when((l["primitive"] != r["primitive"]) | (l["answer_space"] != r["answer_space"]), "other answer space")
    fault = fault.when((l["expected"] == r["expected"]) != invariant, "contradiction").when((kind == "question_contrast") & (F.col("left_case") != F.col("right_case")), "other case")
    return rows.select("id", fault.alias("fault")).filter("fault is not null").distinct()


def repeated_or_missing(expected: DataFrame, found: DataFrame, on: list[str], label: str) -> DataFrame:
    """Keys of predictions that are missing, extra, repeated, or whose label differs from the expected one; with the `fault`."""
    f = found.groupBy(*on).agg(F.count(F.lit(1)).alias("times"), F.min(label).alias("low"), F.max(label).alias("high"))
    rows = expected.select(*on, F.col(label).alias("gold"), F.lit(True).alias("is_expected")).join(f, on, "full_outer")
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("is_expected").isNull(), "extra").when(F.col("times") > 1, "repeated")
    fault = fault.when(~F.col("low").eqNullSafe(F.col("gold")) | ~F.col("high").eqNullSafe(F.col("gold")), "label")
    return rows.select(*on, fault.alias("fault")).filter("fault is not null")


def recomputed(rows: DataFrame, key: list[str], pairs: dict[str, Column], within: float = 1e-12) -> DataFrame:
    """(`key`, `figure`, `stored`, `computed`) where a stored figure differs from its recomputation by more than `within`, or one is null."""
    each = F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).cast("double").alias("stored"), c.cast("double").alias("computed")) for k, c in pairs.items()])
    off = F.coalesce(F.abs(F.col("stored") - F.col("computed")) > within, F.col("stored").isNull() != F.col("computed").isNull())
    return rows.select(*key, F.inline(each)).filter(off)


def text_overlap(examples: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """Rows of `evaluated` whose `key` an example has too."""
    return evaluated.join(examples.select(key).distinct(), key, "left_semi")


def family_faults(cases: DataFrame, family: str, question: str, questions: tuple[str, ...], size: int) -> DataFrame:
    """Families that don't have exactly `size` cases with each of `questions`, and no others: (`family`, `cases`, `missing`, `extra`)."""
    each = cases.groupBy(family, "case_id").agg(F.array_sort(F.collect_set(question)).alias("have"), F.count(F.lit(1)).alias("n"))
    want = F.array(*[F.lit(q) for q in sorted(questions)])
    per = each.groupBy(family).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size(F.array_except(want, "have"))).alias("missing"), F.sum(F.col("n") - F.size(F.array_intersect(want, "have"))).alias("extra"))
    return per.filter((F.col("cases") != size) | (F.col("missing") > 0) | (F.col("extra") > 0))


def prefix_balance(rows: DataFrame, category: str, place: str, prefixes: dict[int, int]) -> DataFrame:
    """How many of each category the first rows hold: (`prefix`, `category`, `n`, `balanced`)."""
    each = rows.select(F.col(category).alias("category"), F.explode(F.array(*[F.when(F.col(place) < p, p) for p in prefixes])).alias("prefix")).filter("prefix is not null")
    want = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return each.groupBy("prefix", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("balanced", F.col("n") == want[F.col("prefix")])


def feature_coverage(features: DataFrame, feature: str = "feature", value: str = "value", threshold: str = "threshold") -> DataFrame:
    """Per feature: whether values below, at and above its threshold occur, how many distinct ones, and whether all three do (`covered`).

    Distinct values are counted after an aggregate by value, so a hot feature is no single group.
    """
    v, t = F.col(value), F.col(threshold)
    by_value = features.filter(v.isNotNull()).groupBy(feature, value, threshold).agg(F.count(F.lit(1)).alias("n"))
    out = by_value.groupBy(feature).agg(F.sum("n").alias("n"), F.bool_or(v < t).alias("below"), F.bool_or(v == t).alias("at_it"), F.bool_or(v > t).alias("above"), F.count(F.lit(1)).alias("different"))
    return out.withColumn("covered", F.col("below") & F.col("at_it") & F.col("above"))


def paired_records(left: DataFrame, right: DataFrame, on: list[str], same: list[str], rendered: str) -> DataFrame:
    """Two versions of records: how many are paired, differ in `same`, and differ in how they are `rendered`."""
    whole = lambda: F.sha2(F.to_json(F.struct(*same)), 256)
    l, r = (df.select(*on, whole().alias(f"{s}_same"), F.col(rendered).alias(f"{s}_rendered")) for df, s in ((left, "l"), (right, "r")))
    both = l.join(r, on, "full_outer")
    paired = F.col("l_same").isNotNull() & F.col("r_same").isNotNull()
    return both.agg(F.count_if(paired).alias("paired"), F.count_if(~paired).alias("unpaired"), F.count_if(paired & (F.col("l_same") != F.col("r_same"))).alias("differ"), F.count_if(paired & ~F.col("l_rendered").eqNullSafe(F.col("r_rendered"))).alias("rendered_anew"))


def blind_review(expected: DataFrame, reviews: DataFrame, on: list[str], labels: list[str]) -> DataFrame:
    """Blind reviews against targets: faults by kind (missing, extra, repeated, invalid, flagged, disagreement) with their number; none means approved."""
    r = reviews.groupBy(*on).agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("said"), F.bool_or("flagged").alias("flagged"))
    rows = expected.select(*on, F.col("label").alias("gold"), F.lit(True).alias("known")).join(r, on, "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("times").isNull(), "missing"), F.when(F.col("known").isNull(), "extra"), F.when(F.col("times") > 1, "repeated"), F.when(~F.col("said").isin(*labels), "invalid"),
        F.when(F.col("flagged"), "flagged"), F.when((F.col("times") == 1) & F.col("said").isin(*labels) & (F.col("said") != F.col("gold")), "disagreement")))
    return rows.select(F.explode(kinds).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def program_overlap(programs: DataFrame, split: str, left: str, right: str) -> DataFrame:
    """Unordered pairs of rules, as digests, that stand in training and in another split: (`pair`, `splits`)."""
    pair = F.sha2(F.array_join(F.array_sort(F.array(left, right)), "\x00"), 256)
    per = programs.select(pair.alias("pair"), F.col(split).alias("split")).distinct().groupBy("pair").agg(F.bool_or(F.col("split") == "train").alias("trained"), F.count_if(F.col("split") != "train").alias("splits"))
    return per.filter("trained and splits > 0").select("pair", "splits")


def non_decreasing(rows: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """Steps at which a cumulative series falls: (`series`, `step`, `value`, `before`)."""
    before = F.lag(value).over(Window.partitionBy(series).orderBy(step))
    return rows.withColumn("before", before).filter(F.col(value) < F.col("before")).select(series, step, value, "before")


def target_faults(expected: DataFrame, targets: DataFrame, on: list[str], within: float = 1e-6) -> DataFrame:
    """Why stored targets can't be used: (`on`, `fault`), the first fault of each key; no rows if all can.

    `expected` has `labels`, `request_sha256` and `computed` (a map as recomputed from raw observations, null where none is kept);
    `targets` have `probabilities` (a map by label) and `request_sha256`. Faults: missing, unknown, repeated, request, labels, value
    (null, not finite, outside [0, 1]), sum (off 1 by more than `within`), observation (off the recomputed one by more than 1e-12).
    """
    first = F.min_by(F.struct("probabilities", F.col("request_sha256").alias("hash")), "request_sha256").alias("t")
    found = targets.groupBy(*on).agg(F.count(F.lit(1)).alias("times"), first)
    rows = expected.select(*on, "labels", "request_sha256", "computed", F.lit(True).alias("wanted")).join(found, on, "full_outer")
    p = F.col("t.probabilities")
    values = F.map_values(p)
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    apart = F.exists(F.map_keys(p), lambda k: F.abs(F.try_element_at(p, k) - F.coalesce(F.try_element_at("computed", k), F.lit(float("inf")))) > 1e-12)
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    fault = fault.when(~F.col("t.hash").eqNullSafe(F.col("request_sha256")), "request")
    fault = fault.when(p.isNull() | (F.sort_array(F.map_keys(p)) != F.sort_array("labels")), "labels").when(~sound, "value")
    fault = fault.when(F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) - 1) > within, "sum").when(F.col("computed").isNotNull() & apart, "observation")
    return rows.select(*on, fault.alias("fault")).filter("fault is not null")
