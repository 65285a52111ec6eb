"""Metrics of predictions: groups, cuts, calibration, ranking, comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bin_bounds, bin_of, free_name


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def grouped() -> list[Column]:
    """Figures of a group of predictions (expected, predicted, correct, nll, brier, max_probability)."""
    n = F.count(F.lit(1))
    at = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    recall, specificity = share(at(1, 1), F.count_if(F.col("expected") == 1)), share(at(0, 0), F.count_if(F.col("expected") == 0))
    return [
        n.alias("n"), F.count_if("correct").alias("n_correct"), (F.count_if("correct") / n).alias("accuracy"), F.avg("nll").alias("mean_nll"), F.avg("brier").alias("mean_brier"),
        F.count_if(~F.col("correct") & (F.col("max_probability") >= 0.9)).alias("wrong_90"), F.count_if(~F.col("correct") & (F.col("max_probability") >= 0.95)).alias("wrong_95"),
        at(1, 1).alias("tp"), at(0, 0).alias("tn"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), recall.alias("recall"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
    ]


def cuts(predictions: DataFrame, dims: list[str]) -> DataFrame:
    """The same figures over all rows and by each dimension, in one pass of grouping sets."""
    names = {d: i for i, d in enumerate(dims)}
    rows = predictions.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.grouping_id(*dims).alias("__g"), *grouped())
    which = F.lit("all")
    for d, i in names.items():
        which = F.when(F.col("__g") == (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)), d).otherwise(which)
    return rows.select(which.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit("")).alias("value"), *[c for c in rows.columns if c not in (*dims, "__g")])


def reliability(predictions: DataFrame) -> DataFrame:
    """All ten bins of the largest probability: count, mean probability, accuracy (null if empty)."""
    rows = predictions.groupBy(F.least(F.floor(F.col("max_probability") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("max_probability").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    bins = predictions.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(rows, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration_error(predictions: DataFrame) -> DataFrame:
    return reliability(predictions).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def nearest_rank(x: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) within group (order by {x})")


def _binned(rows: DataFrame, by: list[str], value: str, bin_: str) -> DataFrame:
    """`rows` with a bin that grows with `value`, by bounds that give the bins of a group like numbers of rows; one row of bounds for each group."""
    name = free_name(rows, "bounds")
    bounds = bin_bounds(rows, by, value, name)
    return rows.join(F.broadcast(bounds) if len(by) == 0 else bounds, by).withColumn(bin_, bin_of(F.col(value), F.col(name))).drop(name)


def _running(counts: DataFrame, by: list[str], bin_: str, value: str, sums: list[str]) -> DataFrame:
    """Exclusive running sums, in the order of `value` within each group, of rows unique by (group, value): first over bins, then within each."""
    per = counts.groupBy(*by, bin_).agg(*[F.sum(c).alias(c) for c in sums])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bins = per.select(*by, bin_, *[zero(F.sum(c).over(before(Window.partitionBy(*by).orderBy(bin_)))).alias(f"{c}_to_bin") for c in sums])
    inside = before(Window.partitionBy(*by, bin_).orderBy(value))
    out = counts.withColumns({f"{c}_before": zero(F.sum(c).over(inside)) for c in sums}).join(bins, [*by, bin_])
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_to_bin") for c in sums}).drop(*[f"{c}_to_bin" for c in sums])


def auc(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """P(score of 1 above that of 0) plus half of ties, by groups; null if a class is missing.

    Counts per distinct score come first, so that a tie of any size is one row; running sums go over bins of scores, then within each.
    """
    counts = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = _running(_binned(counts, by, "score", "bin"), by, "bin", "score", ["neg"])
    wins = ranked.withColumn("w", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return wins.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), share(F.sum("w"), F.sum("pos") * F.sum("neg")).alias("auc"))


def selective_risk(predictions: DataFrame, by: list[str], *tiebreak: str, fractions: tuple[float, ...] = (0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Error among the most confident share of each group, at least one row; of equally confident ones the first by `tiebreak`.

    Counts per distinct probability give how many rows of it each share takes: none, all, or some. Only rows of those that are taken
    in part are put in order.
    """
    rows = predictions.select(*by, *tiebreak, (~F.col("correct")).cast("long").alias("wrong"), (-F.col("max_probability")).alias("least"))
    counts = rows.groupBy(*by, "least").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("wrong"))
    ranked = _running(_binned(counts, by, "least", "bin"), by, "bin", "least", ["n", "wrong"])
    shares = counts.groupBy(*by).agg(F.sum("n").alias("all")).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    shares = shares.withColumn("covered", F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("all")))).drop("all")
    cut = ranked.join(shares, by).filter((F.col("n_before") < F.col("covered")) & (F.col("covered") <= F.col("n_before") + F.col("n")))
    cut = cut.select(*by, "fraction", "covered", "least", "wrong_before", (F.col("covered") - F.col("n_before")).alias("some"))
    inside = Window.partitionBy(*by, "fraction", "least").orderBy(*tiebreak)
    part = rows.join(cut, [*by, "least"]).withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= F.col("some"))
    return part.groupBy(*by, "fraction").agg(F.first("covered").alias("covered"), ((F.first("wrong_before") + F.sum("wrong")) / F.first("covered")).alias("error"))


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: n, median (of two middle values their mean), p95 and p99 by nearest rank, mean and population deviation; nulls don't count.

    Values are counted first; running counts over bins of values find the ranks, so no task holds a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = _running(_binned(counts, [by], "v", "bin"), [by], "bin", "v", ["n"])
    every = rows.groupBy(by).agg(F.count(value).alias("all"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    ranks = {"low": F.floor((F.col("all") + 1) / 2), "high": F.floor((F.col("all") + 2) / 2), "p95": F.ceil(F.lit(0.95) * F.col("all")), "p99": F.ceil(F.lit(0.99) * F.col("all"))}
    at = lambda r: F.max(F.when((F.col("n_before") < r) & (r <= F.col("n_before") + F.col("n")), F.col("v")))
    found = ranked.join(every, by).groupBy(by).agg(F.first("all").alias("n"), *[at(r).alias(k) for k, r in ranks.items()], F.first("mean").alias("mean"), F.first("deviation").alias("deviation"))
    return found.select(by, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "p99", "mean", "deviation")


def macro(rows: DataFrame, value: str, family: str, category: str) -> DataFrame:
    """Mean of family means within each category, then the mean of categories."""
    fam = rows.groupBy(category, family).agg(F.avg(value).alias("m"))
    return fam.groupBy(category).agg(F.avg("m").alias("m")).agg(F.avg("m").alias("macro"), F.count(F.lit(1)).alias("categories"))


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Two systems on the same cases: both right, one, none."""
    both = left.select(*on, F.col("correct").alias("l"), F.col("predicted").alias("pl")).join(right.select(*on, F.col("correct").alias("r"), F.col("predicted").alias("pr")), on)
    return both.agg(
        F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(~F.col("l") & F.col("r")).alias("right_only"),
        F.count_if(~F.col("l") & ~F.col("r")).alias("neither"), F.count_if(~F.col("pl").eqNullSafe(F.col("pr"))).alias("disagreements"),
    )


def coverage_gaps(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    e, f = expected.select(*on).distinct().withColumn("e", F.lit(1)), found.select(*on).distinct().withColumn("f", F.lit(1))
    return e.join(f, on, "full_outer").filter("e is null or f is null").select(*on, F.when(F.col("e").isNull(), "extra").otherwise("missing").alias("side"))


def paired_bootstrap(pairs: DataFrame, family: str, category: str, draws: int = 1000, seed: str = "bootstrap") -> DataFrame:
    """Difference of accuracies (`right` less `left`) with a 95 % interval over families redrawn within their category.

    Draws are Poisson weights from hashes of (seed, draw, family), so every family is drawn where it lies, without a shuffle of
    indexes; sums per family come first.
    """
    fam = pairs.groupBy(category, family).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("right").cast("int") - F.col("left").cast("int")).alias("d"))
    from ..functions.text import hash_unit

    each = fam.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = hash_unit(F.concat_ws("|", F.lit(seed), "draw", category, family), 12)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)), F.lit(0))
    drawn = each.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("x"))
    point = fam.agg((F.sum("d") / F.sum("n")).alias("difference"))
    return drawn.agg(nearest_rank("x", 0.025).alias("low"), nearest_rank("x", 0.975).alias("high")).join(point)


def unknown_rates(predictions: DataFrame, by: list[str], label: str = "unknown") -> DataFrame:
    """How often the answer `label`, in any case, is gold, predicted and both; with recall and precision, null where there is nothing to count."""
    is_it = lambda c: F.coalesce(F.lower(F.col(c)) == label, F.lit(False))
    gold, said = F.count_if(is_it("expected")), F.count_if(is_it("predicted"))
    both = F.count_if(is_it("expected") & is_it("predicted"))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), gold.alias("gold"), said.alias("said"), both.alias("hits"), share(both, gold).alias("recall"), share(both, said).alias("precision"))


def flat_summary(cases: DataFrame, fields: DataFrame) -> DataFrame:
    """One row over a run of flat questions.

    `cases`: case_id, valid (the answer fits its schema), labeled, elapsed. `fields` of labeled cases: case_id, correct, brier, nll,
    max_probability (null without probabilities). A missing answer is wrong; a case is exact if it is valid and all its fields are right.
    """
    per = fields.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"), F.count("brier").alias("with_p"), F.sum("brier").alias("brier"), F.sum("nll").alias("nll"))
    rows = cases.join(per, "case_id", "left")
    n, fields_n, with_p = F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("with_p"), F.lit(0))
    exact = F.count_if(F.col("labeled") & F.col("valid") & (F.coalesce("right", F.lit(0)) == F.coalesce("n", F.lit(0))))
    return rows.agg(n.alias("evaluations"), F.count_if("labeled").alias("labeled"), fields_n.alias("fields"), (F.count_if("valid") / n).alias("schema_validity"), share(F.sum("right"), fields_n).alias("field_accuracy"),
        share(exact, F.count_if("labeled")).alias("exact_case_accuracy"), share(F.sum("brier"), with_p).alias("brier"), share(F.sum("nll"), with_p).alias("log_loss"), share(with_p, fields_n).alias("probability_coverage"), F.avg("elapsed").alias("mean_ms"))


def repeats(results: DataFrame, on: list[str], repeat: str, answer: str) -> DataFrame:
    """Runs repeated on the same cases: per repeat the number of answers and of those that differ from repeat 0."""
    first = results.filter(F.col(repeat) == 0).select(*on, F.col(answer).alias("first_answer"))
    both = results.join(first, on)
    return both.groupBy(repeat).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(answer).eqNullSafe(F.col("first_answer"))).alias("disagreements"))


def paired_ratio(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """`n` pairs with the `median`, `p95` and the like of left over right, by `latencies`."""
    pairs = left.select(*on, F.col(value).alias("l")).join(right.select(*on, F.col(value).alias("r")), on).filter("r > 0")
    return latencies(pairs.select(F.lit("ratio").alias("what"), (F.col("l") / F.col("r")).alias("v")), "what", "v")


def matrix(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(`by`, `expected`, `said`, `n`): the confusion of answers, a tie being `__tie__`."""
    said = F.coalesce(F.col("predicted").cast("string"), F.lit("__tie__"))
    return predictions.groupBy(*by, F.col("expected").cast("string").alias("expected"), said.alias("said")).agg(F.count(F.lit(1)).alias("n"))


def tagged(predictions: DataFrame, question: str, category: str, tags: dict[str, str]) -> DataFrame:
    """`predictions` with `tag`: the question's tag, or category/question where it has none."""
    found = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])[F.col(question)] if tags else F.lit(None).cast("string")
    return predictions.withColumn("tag", F.coalesce(found, F.concat_ws("/", category, question)))


def crossed(predictions: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The figures of `grouped` by sets of dimensions, one pass: `cut` names a set's dimensions, `value` their values, joined by `|`."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    rows = predictions.groupingSets(sets, *dims).agg(F.grouping_id(*dims).alias("grouping"), *grouped())
    bit = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    cut, value = F.lit(""), F.lit("")
    for s in sets:
        here = F.col("grouping") == sum(b for d, b in bit.items() if d not in s)
        cut = F.when(here, "*".join(s)).otherwise(cut)
        value = F.when(here, F.concat_ws("|", *[F.col(d).cast("string") for d in s]) if s else F.lit("")).otherwise(value)
    return rows.select(cut.alias("cut"), value.alias("value"), *[c for c in rows.columns if c not in (*dims, "grouping")])


def level_errors(predictions: DataFrame, by: list[str], expected: str, found: str, levels: str) -> DataFrame:
    """Of answers on a scale: mean absolute error of the expected level, and the same as a share of the scale."""
    off = F.abs(F.col(found) - F.col(expected))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.avg(off / (F.col(levels) - 1)).alias("nmae"))


def fact_metrics(candidates: DataFrame, question: str, p: str, y: str) -> DataFrame:
    """Facts behind questions: per question the means over its candidates, and over questions the means of these; exactly one half is ambiguous."""
    right = F.when(F.col(p) != 0.5, (F.col(p) > 0.5) == (F.col(y) == 1)).otherwise(False)
    per = candidates.groupBy(question).agg(F.avg(right.cast("double")).alias("accuracy"), F.bool_and(right).alias("joint"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("squared"), F.count_if(F.col(p) == 0.5).alias("ambiguous"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("questions"), F.sum("n").alias("candidates"), F.avg("accuracy").alias("accuracy"), F.avg(F.col("joint").cast("double")).alias("joint"), F.avg("squared").alias("squared"), F.sum("ambiguous").alias("ambiguous"))


def objective(nlls: DataFrame, by: list[str], primitive: str, value: str, broad: str | None = None) -> DataFrame:
    """(`by`, `macro`): the mean of the primitives' mean losses; with a `broad` loss column the mean of both."""
    per = nlls.groupBy(*by, primitive).agg(F.avg(value).alias("m"), *([F.avg(broad).alias("b")] if broad else []))
    out = per.groupBy(*by).agg(F.avg("m").alias("macro"), *([F.avg("b").alias("b")] if broad else []))
    return out.select(*by, ((F.col("macro") + F.col("b")) / 2 if broad else F.col("macro")).alias("macro"))


def best_step(scores: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """The step of least value for each group, the first of equals."""
    return scores.groupBy(*by).agg(F.min_by(step, F.struct(value, step)).alias(step), F.min(value).alias(value))


def gated_pick(candidates: DataFrame, accuracy: float = 0.01, stability: float = 0.02, speed: float = 0.75) -> DataFrame:
    """The candidate to take over the row with `baseline`: name, accuracy, stability, latency; those within tolerances of it come by latency, else all by accuracy, marked exploratory."""
    base = candidates.filter("baseline").agg(F.max("accuracy").alias("b_accuracy"), F.max("stability").alias("b_stability"), F.max("latency").alias("b_latency"))
    rows = candidates.filter("not baseline").join(F.broadcast(base))
    ok = (F.col("accuracy") >= F.col("b_accuracy") - accuracy) & (F.col("stability") >= F.col("b_stability") - stability) & (F.col("latency") <= F.col("b_latency") * speed)
    order = F.when(ok, F.struct(F.lit(0).alias("tier"), F.col("latency").alias("x"), (-F.col("accuracy")).alias("y"), F.lit(0.0).alias("z"), F.col("name"))).otherwise(F.struct(F.lit(1).alias("tier"), (-F.col("accuracy")).alias("x"), (-F.col("stability")).alias("y"), F.col("latency").alias("z"), F.col("name")))
    return rows.agg(F.min(order).alias("best")).select("best.name", (F.col("best.tier") == 1).alias("exploratory"))


def costs(runs: DataFrame, by: list[str], seconds: str, tokens: str, price: float) -> DataFrame:
    """Per configuration: mean seconds, mean tokens of runs that report some, and the cost of all at `price` a million."""
    t = F.when(F.col(tokens) > 0, F.col(tokens))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("seconds"), F.avg(t).alias("tokens"), F.round(F.coalesce(F.sum(t), F.lit(0)) / 1e6 * price, 8).alias("cost"))


def breakdown(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per value of a dimension: count, mean of non-null values, share of all; the most frequent first, then by name (`place`)."""
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    whole = rows.agg(F.count(F.lit(1)).alias("whole"))
    placed = per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), by)))
    return placed.join(F.broadcast(whole)).select(by, "n", "mean", (F.col("n") / F.col("whole")).alias("share"), "place")


def deltas(left: DataFrame, right: DataFrame, on: list[str], figures: list[str]) -> DataFrame:
    """right less left of each figure; null where either is."""
    r = right.select(*on, *[F.col(f).alias(f"right_{f}") for f in figures])
    return left.join(r, on).select(*on, *[(F.col(f"right_{f}") - F.col(f)).alias(f) for f in figures])


def reference_agreement(outputs: DataFrame, references: DataFrame, by: list[str], question: str, system: str) -> DataFrame:
    """How far systems agree with references, for systems that answered all of a group's questions: `matches` among the `determinate`, mean `variation` from probabilistic ones."""
    from ..functions.probability import variation

    n = references.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"))
    rows = outputs.select(question, system, F.col("label").alias("said"), F.col("probabilities").alias("p")).join(references, question)
    per = rows.groupBy(*by, system).agg(F.count(F.lit(1)).alias("answered"), F.count("label").alias("determinate"), F.count_if(F.col("said") == F.col("label")).alias("matches"), F.avg(F.when(F.col("probabilistic"), variation(F.col("p"), F.col("probabilities")))).alias("variation"))
    return per.join(n, by).filter("answered = questions").withColumn("agreement", share(F.col("matches"), F.col("determinate"))).drop("answered")


def nucleus(rows: DataFrame, by: str, token: str, logit: str, seen: str, penalty: float = 1.5, top: int = 20, mass: float = 0.95) -> DataFrame:
    """Of each group the tokens to sample from, with probability `p`: seen ones lose `penalty`, the `top` by logit stay, and of these the smallest prefix with a mass of `mass`."""
    z = F.col(logit) - F.when(F.col(seen), penalty).otherwise(0.0)
    order = Window.partitionBy(by).orderBy(F.desc("z"), token)
    kept = rows.withColumn("z", z).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    weight = F.exp(F.col("z") - F.max("z").over(Window.partitionBy(by)))
    kept = kept.withColumn("w", weight).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(by)))
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = kept.withColumn("before", before).filter(F.col("before") < mass)
    return kept.select(by, token, "r", (F.col("w") / F.sum("w").over(Window.partitionBy(by))).alias("p"))


def exposure(rows: DataFrame, stream: str, place: str, length: str, batch: int) -> DataFrame:
    """Per stream: the sum of lengths, and what batches of `batch` consecutive rows take when each is padded to its longest."""
    per = rows.groupBy(stream, F.floor(F.col(place) / batch).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("sum"), F.max(length).alias("longest"))
    return per.groupBy(stream).agg(F.sum("sum").alias("tokens"), F.sum(F.col("n") * F.col("longest")).alias("padded"))


def step_exposure(step: Column, unique: int = 200, fresh: int = 20, replay: int = 3) -> Column:
    """What a training step has seen: struct of distinct repeats, new and replayed examples."""
    return F.struct(F.least(step, F.lit(unique)).alias("distinct"), (step * fresh).alias("fresh"), (step * replay).alias("replayed"))


def metric_block(predictions: DataFrame, by: list[str]) -> DataFrame:
    """The figures of `grouped` by groups, and with them all else of a block, one row a group.

    `mean_floored_nll` and `zero_targets` of the probability of the expected answer, `ece` over ten bins, `bins` (bin, n, confidence,
    accuracy) that have rows, and `confusion` (expected, said, n), a tie being `__tie__`. What goes into a list are counts per group
    and bin, or per group and pair of answers. No predictions: no rows.
    """
    from ..functions.probability import floored_nll

    p = F.get("probabilities", F.col("expected"))
    bin_ = F.least(F.floor(F.col("max_probability") * 10), F.lit(9)).cast("int").alias("bin")
    whole = predictions.groupBy(*by).agg(*grouped(), F.avg(floored_nll(p)).alias("mean_floored_nll"), F.count_if(p == 0).alias("zero_targets"))
    bins = predictions.groupBy(*by, bin_).agg(F.count(F.lit(1)).alias("n"), F.avg("max_probability").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    off = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    bins = bins.groupBy(*by).agg(off.alias("ece"), F.sort_array(F.collect_list(F.struct("bin", "n", "confidence", "accuracy"))).alias("bins"))
    said = matrix(predictions, by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("expected", "said", "n"))).alias("confusion"))
    if not by:
        return whole.join(bins).join(said)
    return whole.join(bins, by).join(said, by)


def headline(predictions: DataFrame, families: DataFrame | None = None, family: str = "family_id", confident: float = 0.9) -> DataFrame:
    """How many are right, of how many, and how many are wrong at a largest probability of `confident` or more; of `families` only, where given."""
    rows = predictions if families is None else predictions.join(families.select(family).distinct(), family, "left_semi")
    return rows.agg(F.count_if("correct").alias("right"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col("correct") & (F.col("max_probability") >= confident)).alias("confident_wrong"))


def both_systems(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Each case's two predictions, with `variation` and the largest `difference` of their probabilities; an error where a case is missing on a side or its expected answer or number of answers differs."""
    from ..functions.probability import variation

    names = ("expected", "predicted", "probabilities", "correct", "nll")
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in names])
    rows = side(left, "left").join(side(right, "right"), on, "full_outer")
    a, b = F.col("left_probabilities"), F.col("right_probabilities")
    alike = F.coalesce((F.col("left_expected") == F.col("right_expected")) & (F.size(a) == F.size(b)), F.lit(False))
    rows = rows.filter(F.when(alike, True).otherwise(F.raise_error(F.lit("populations, labels or answers differ")).cast("boolean")))
    return rows.withColumns({"variation": variation(a, b), "difference": F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))})


def compare_systems(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row over `both_systems`: questions, label changes, largest difference, mean variation, and each side's right answers and mean loss."""
    changed = F.count_if(~F.col("left_predicted").eqNullSafe(F.col("right_predicted")))
    each = [f(f"{s}_{c}").alias(f"{s}_{name}") for s in ("left", "right") for c, name, f in (("correct", "correct", F.count_if), ("nll", "mean_nll", F.avg))]
    return both_systems(left, right, on).agg(F.count(F.lit(1)).alias("questions"), changed.alias("label_changes"), F.max("difference").alias("max_difference"), F.avg("variation").alias("mean_variation"), *each)


def family_bootstrap(sums: DataFrame, category: str, family: str, draws: int = 2000, seed: str = "families") -> DataFrame:
    """Per metric: `difference` of right's ratio of sums and left's, with the interval [`low`, `high`] of 95 %.

    `sums`: (category, family, metric, left_num, left_den, right_num, right_den). A draw takes as many families of each category as it
    has, with replacement, each by a hash of (seed, draw, category, slot); the interval's ends are order statistics, the lower rounded
    down, the upper up. A draw whose denominator is 0 doesn't count. Rows are families times draws, so sums per family come first.
    """
    names = ("left_num", "left_den", "right_num", "right_den")
    per = sums.groupBy(category, family, "metric").agg(*[F.sum(c).alias(c) for c in names])
    families = per.select(category, family).distinct()
    families = families.withColumn("slot", F.row_number().over(Window.partitionBy(category).orderBy(family)) - 1).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(category)))
    word = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "draw", category, F.col("slot").cast("string")), 256), 1, 12)
    drawn = families.select(category, "slot", "size", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = drawn.select(category, "draw", (F.conv(word, 16, 10).cast("long") % F.col("size")).alias("slot")).groupBy(category, "slot", "draw").agg(F.count(F.lit(1)).alias("times"))
    picked = drawn.join(families, [category, "slot"]).join(per, [category, family])
    ratio = lambda t: share(F.sum(F.col("right_num") * t), F.sum(F.col("right_den") * t)) - share(F.sum(F.col("left_num") * t), F.sum(F.col("left_den") * t))
    values = picked.groupBy("metric", "draw").agg(ratio(F.col("times")).alias("x")).groupBy("metric").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    last = F.size("xs") - 1
    ends = values.select("metric", F.get("xs", F.floor(last * 0.025).cast("int")).alias("low"), F.get("xs", F.ceil(last * 0.975).cast("int")).alias("high"))
    return per.groupBy("metric").agg(ratio(F.lit(1)).alias("difference")).join(ends, "metric", "left")
