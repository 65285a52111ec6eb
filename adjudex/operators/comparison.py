"""Comparing answers: related questions, two systems, several layouts, judges of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from .metrics import share


def relation_metrics(relations: DataFrame, predictions: DataFrame, key: list[str], tolerance: float = 0.05) -> DataFrame:
    """One row per relation (`kind`, and the `key` columns with left_ and right_ before their names) whose two predictions exist.

    Invariant questions should get near distributions; for others each side should favour its own gold option more than the other does.
    `gold` and `predicted` are places in `probabilities`; a relation between vectors of unlike lengths gives nulls.
    """

    def end(side: str) -> DataFrame:
        values = [F.col(c).alias(f"__{side}_{c}") for c in ("expected", "predicted", "probabilities")]
        return predictions.select(*[F.col(k).alias(f"{side}_{k}") for k in key], *values)

    rows = relations.join(end("left"), [f"left_{k}" for k in key]).join(end("right"), [f"right_{k}" for k in key])
    a, b = F.col("__left_probabilities"), F.col("__right_probabilities")
    aligned, invariant = F.size(a) == F.size(b), F.col("kind") == "invariant"
    ea, eb = F.col("__left_expected"), F.col("__right_expected")
    to_left, to_right = F.get(a, ea) - F.get(b, ea), F.get(b, eb) - F.get(a, eb)
    right = lambda side: F.coalesce(F.col(f"__{side}_predicted") == F.col(f"__{side}_expected"), F.lit(False))
    far = F.when(aligned, P.variation(a, b))
    found = rows.withColumns({
        "both_correct": right("left") & right("right"), "total_variation": far, "same_prediction": F.col("__left_predicted").eqNullSafe(F.col("__right_predicted")),
        "within_tolerance": F.when(invariant, far <= tolerance), "direction_correct": F.when(~invariant & aligned, (to_left > 0) & (to_right > 0)),
        "margin": F.when(~invariant & aligned, (to_left + to_right) / 2),
    })
    return found.drop(*[f"__{s}_{c}" for s in ("left", "right") for c in ("expected", "predicted", "probabilities")])


def relation_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Shares and means of relation metrics; a share of no rows is null."""
    part = lambda c: F.avg(F.col(c).cast("double"))
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[part(c).alias(c) for c in ("both_correct", "total_variation", "same_prediction", "within_tolerance", "direction_correct", "margin")]
    )


def change_sets(before: DataFrame, after: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """What changed between two runs over the rows that both have: improved, regressed, kept right and kept wrong."""
    old, new = before.select(*key, *by, F.col("correct").alias("__old")), after.select(*key, F.col("correct").alias("__new"))
    o, n = F.col("__old"), F.col("__new")
    return old.join(new, key).groupBy(*by).agg(
        F.count_if(~o & n).alias("improved"), F.count_if(o & ~n).alias("regressed"), F.count_if(o & n).alias("kept_right"), F.count_if(~o & ~n).alias("kept_wrong")
    )


def whole_cases(predictions: DataFrame, case: list[str], by: list[str]) -> DataFrame:
    """Cases, and those of which every answer is right."""
    each = predictions.groupBy(*by, *case).agg(F.bool_and("correct").alias("__all"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if("__all").alias("right"))


def confidence_coverage(predictions: DataFrame, by: list[str], thresholds: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """At each threshold of the largest probability: rows covered, their share, wrong ones, and the share of these among the covered.

    Counted in one pass per group; the rows are not repeated for each threshold.
    """
    over = lambda t: F.col("max_probability") >= t
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(over(t)).alias("covered"), F.count_if(over(t) & ~F.col("correct")).alias("wrong")) for t in thresholds]
    rows = predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.array(*parts).alias("__parts")).select(*by, "__n", F.inline("__parts"))
    return rows.select(*by, "threshold", "covered", share(F.col("covered"), F.col("__n")).alias("coverage"), "wrong", share(F.col("wrong"), F.col("covered")).alias("error"))


def layout_stability(answers: DataFrame, field: list[str], answer: str) -> DataFrame:
    """For each field asked in several layouts: `layouts`, whether all answers are the same, and the share of pairs that agree.

    Pairs are counted from counts of equal answers, not made. A null answer equals another null; one layout has no pairs (null).
    """
    votes = answers.groupBy(*field, answer).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    rows = votes.groupBy(*field).agg(F.sum("__n").alias("layouts"), (F.count(F.lit(1)) == 1).alias("stable"), F.sum(n * (n - 1) / 2).alias("__agree"))
    return rows.select(*field, "layouts", "stable", share(F.col("__agree"), F.col("layouts") * (F.col("layouts") - 1) / 2).alias("agreement"))


def layout_report(answers: DataFrame, case: str, field: str, layout: str, answer: str, expected: str) -> DataFrame:
    """One row over all cases asked in several layouts: `cases`, `fields` (of cases), `layouts`, `mean_accuracy` and `worst_accuracy` of layouts, `worst_layout`
    (the first of equals), `mean_whole_cases` (the share of cases with all fields right, averaged over layouts), `stable_fields`, `stable_cases`, `agreement` of pairs of layouts.

    Every field of a case must be answered in every layout once: else it is an error that names one. A null answer is wrong, and equals another null.
    Pairs are counted from counts of equal answers, not made; one layout has agreement 1. Empty table: no row.
    """
    right = F.coalesce(F.col(answer) == F.col(expected), F.lit(False)).cast("int")
    n_layouts = answers.agg(F.count_distinct(layout)).first()[0]
    asked = answers.groupBy(case, field).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(layout).alias("of"))
    bad = asked.filter((F.col("n") != n_layouts) | (F.col("of") != n_layouts)).first()
    if bad:
        raise ValueError(f"{bad[1]} of {bad[0]} has {bad['n']} answers in {bad['of']} of {n_layouts} layouts")
    whole = answers.groupBy(layout, case).agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"))
    of = whole.groupBy(layout).agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.avg((F.col("right") == F.col("n")).cast("double")).alias("whole"))
    by_layout = of.agg(F.count(F.lit(1)).alias("layouts"), F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("worst_accuracy"), F.min_by(layout, F.struct("accuracy", layout)).alias("worst_layout"), F.avg("whole").alias("mean_whole_cases"))
    per = layout_stability(answers, [case, field], answer).withColumn("pairs", F.col("layouts") * (F.col("layouts") - 1) / 2)
    cases = per.groupBy(case).agg(F.bool_and("stable").alias("all"), F.count_if("stable").alias("stable"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("agreement", F.lit(0.0)) * F.col("pairs")).alias("agree"), F.sum("pairs").alias("pairs"))
    fields = cases.agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("fields"), (F.sum("stable") / F.sum("n")).alias("stable_fields"), F.avg(F.col("all").cast("double")).alias("stable_cases"), F.coalesce(share(F.sum("agree"), F.sum("pairs")), F.lit(1.0)).alias("agreement"))
    return by_layout.join(fields).filter("cases > 0").select("cases", "fields", "layouts", "mean_accuracy", "worst_accuracy", "worst_layout", "mean_whole_cases", "stable_fields", "stable_cases", "agreement")


def unanimous(runs: DataFrame, case: list[str], verdict: str, n: int = 3) -> DataFrame:
    """Per case with exactly `n` runs that all gave a verdict: GOOD if each is YES, else BAD."""
    rows = runs.groupBy(*case).agg(F.count(F.lit(1)).alias("__n"), F.count(verdict).alias("__given"), F.bool_and(F.col(verdict) == "YES").alias("__yes"))
    return rows.filter((F.col("__n") == n) & (F.col("__given") == n)).select(*case, F.when(F.col("__yes"), "GOOD").otherwise("BAD").alias("judged"))


def judge_score(judged: DataFrame, by: list[str], label: str = "label", verdict: str = "judged", keep: Column | None = None) -> DataFrame:
    """Accuracy, misses (bad judged good) and alarms (good judged bad) of the rows with a verdict.

    `keep` narrows the bad cases alone, as to those no other check has found; where it is null, they count.
    """
    bad, good = F.col(label) == "BAD", F.col(label) == "GOOD"
    rows = judged.filter(F.col(verdict).isNotNull())
    if keep is not None:
        rows = rows.filter(~bad | F.coalesce(keep, F.lit(True)))
    miss, alarm = F.count_if(bad & (F.col(verdict) == "GOOD")), F.count_if(good & (F.col(verdict) == "BAD"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(verdict) == F.col(label)).cast("double")).alias("accuracy"), miss.alias("misses"), F.count_if(bad).alias("n_bad"),
        share(miss, F.count_if(bad)).alias("miss"), alarm.alias("alarms"), F.count_if(good).alias("n_good"), share(alarm, F.count_if(good)).alias("alarm"),
    )


def predictive_value(caught: Column, flagged: Column, prevalence: float) -> Column:
    """Share of flags that are right, from the rates of true and false flags, where so many cases are positive; null if nothing is flagged."""
    right, wrong = prevalence * caught, (1 - prevalence) * flagged
    return share(right, right + wrong)
