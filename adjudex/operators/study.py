"""Arranging a study: picks that cover, nested prefixes, matched assignments, schedules, contexts, reversible disguises, and effects."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .shared import free_name, saved


def capped_picks(rows: DataFrame, kind: str, kinds: list[str], eligible: Column, rank: Column, n: int = 2) -> DataFrame:
    """Of each of `kinds`, the `n` eligible rows that are first by `rank`, with their `place`; an error where a kind has fewer.

    Null `eligible` counts as false. Each task keeps n rows of a kind before the shuffle.
    """
    firsts = rows.filter(F.coalesce(eligible, F.lit(False))).withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(rank))).filter(F.col("place") <= n)
    wanted = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias(kind))
    found = wanted.join(firsts, kind, "left").withColumn("__n", F.count("place").over(Window.partitionBy(kind)))
    few = F.raise_error(F.concat(F.lit("too few eligible rows of "), F.col(kind))).cast("int")
    return found.withColumn("place", F.when(F.col("__n") >= n, F.col("place")).otherwise(few)).filter("place is not null").drop("__n")


def covering_picks(rows: DataFrame, key: list[str], firsts: dict[str, Column], maxima: dict[str, Column], broad: Column) -> DataFrame:
    """The keys of few rows that cover all: (`key`, `reasons`).

    For each value of each column of `firsts`, the first row by key among the `broad` ones; for each column of `maxima`, the row of the
    greatest value, of ties the first by key. Null values need no cover. Aggregates find them: no task puts rows in order.
    """
    k = F.struct(*key).alias("k")
    values = F.explode(F.array(*[F.concat(F.lit(f"{name}:"), value.cast("string")) for name, value in firsts.items()])).alias("reason")
    first = rows.filter(broad).select(k, values).filter("reason is not null").groupBy("reason").agg(F.min("k").alias("k"))
    least = [F.min(F.when(value.isNotNull(), F.struct((-value).alias("v"), k))).alias(f"m{i}") for i, value in enumerate(maxima.values())]
    top = rows.agg(*least).select(F.inline(F.array(*[F.struct(F.lit(name).alias("reason"), F.col(f"m{i}")["k"].alias("k")) for i, name in enumerate(maxima)])))
    picked = first.unionByName(top.filter("k is not null"))
    return picked.groupBy("k").agg(F.sort_array(F.collect_list("reason")).alias("reasons")).select("k.*", "reasons")


def context_groups(requests: DataFrame, fields: dict[str, list[str]], state: str = "state", questions: str = "questions") -> DataFrame:
    """`requests` once for each set of fields that its questions need: `questions` those that need it, `state` (a map) cut down to it.

    An error for a question that `fields` does not name and for a field that the state lacks; no questions, no rows. Nothing is shuffled.
    """
    known = F.create_map(*[c for q, f in fields.items() for c in (F.lit(q), F.array(*[F.lit(x) for x in sorted(f)]))])
    need = lambda q: F.coalesce(F.try_element_at(known, q), F.raise_error(F.concat(F.lit("no fields for question "), q)).cast("array<string>"))
    groups = requests.withColumn("fields", F.explode(F.array_distinct(F.transform(questions, need))))
    part = F.map_filter(state, lambda name, _: F.array_contains("fields", name))
    lacking = F.raise_error(F.concat(F.lit("state lacks one of "), F.array_join("fields", ", "))).cast("map<string,string>")
    return groups.withColumns({questions: F.filter(questions, lambda q: need(q) == F.col("fields")), state: F.when(F.size(part) == F.size("fields"), part).otherwise(lacking)})


def answer_logits(kind: Column, single: Column, by_label: Column, labels: Column, temperature: Column, calibration: Column) -> Column:
    """Raw logits in the order of `labels`: [0, z] of a noul, else those of the map `by_label`.

    An error unless they are finite, of just these labels, and not calibrated (temperature 1, "identity-uncalibrated").
    """
    finite = lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    rest = F.transform(labels, lambda name: F.try_element_at(by_label, name))
    sound = F.when(kind == "noul", finite(single)).otherwise((F.size(F.map_keys(by_label)) == F.size(labels)) & F.forall(rest, finite))
    as_is = (temperature == 1.0) & (calibration == "identity-uncalibrated")
    wrong = F.raise_error(F.lit("logits are calibrated, not finite, or not of the question's labels")).cast("array<double>")
    return F.when(F.coalesce(sound & as_is, F.lit(False)), F.when(kind == "noul", F.array(F.lit(0.0), single)).otherwise(rest)).otherwise(wrong)


def calibration_rows(answers: DataFrame, origin: str) -> DataFrame:
    """(`case_id`, `question_id`, `origin`, `primitive`, `labels`, `logits`, `target_index`) of answers with their `target`; an error for a target that is no label."""
    place = F.array_position("labels", F.lower("target") if dict(answers.dtypes)["target"] == "boolean" else F.col("target").cast("string"))
    index = F.when(place > 0, (place - 1).cast("int")).otherwise(F.raise_error(F.lit("target is no label")).cast("int"))
    return answers.select("case_id", "question_id", F.lit(origin).alias("origin"), "primitive", "labels", "logits", index.alias("target_index"))


def disguised(rows: DataFrame, times: list[str], names: list[str], aliases: dict[str, str], scale: float, offset: float, inverse: bool = False) -> DataFrame:
    """`rows` with numbers t of `times` turned into scale * t + offset and strings of `names` into their alias; `inverse` turns both back.

    Nulls and strings without an alias stay; one of these that is another's alias can't be told from it when turned back. Two strings
    with one alias, or a scale of 0, are refused.
    """
    if not scale or len(set(aliases.values())) < len(aliases):
        raise ValueError("not reversible")
    pairs = [(b, a) if inverse else (a, b) for a, b in aliases.items()]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair]) if pairs else F.create_map().cast("map<string,string>")
    clock = lambda c: (F.col(c) - offset) / scale if inverse else F.col(c) * scale + offset
    return rows.withColumns({**{c: clock(c) for c in times}, **{c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) for c in names}})


def interleaved(rows: DataFrame, category: str, categories: list[str], rank: Column, each: int, prefixes: list[int]) -> DataFrame:
    """The first `each` rows of each category by `rank`, dealt in turn: `place` from 0, and `prefix`, the shortest of the nested prefixes with the row.

    Categories not named stay out, and one with fewer rows leaves its places empty. Each task keeps `each` rows of a category before the shuffle.
    """
    at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)) - 1
    firsts = rows.filter(at >= 0).withColumn("__r", F.row_number().over(Window.partitionBy(category).orderBy(rank))).filter(F.col("__r") <= each)
    placed = firsts.withColumn("place", (F.col("__r") - 1) * len(categories) + at).drop("__r")
    return placed.withColumn("prefix", F.least(*[F.when(F.col("place") < p, p) for p in prefixes], F.lit(None).cast("int")))


def set_relations(pairs: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """`pairs` (the `key` columns with left_ and right_ before their names) with `both_correct` and both sides' answers.

    `axis` is taken from `axis` or `contrast_axis`; where the two differ, an error. A pair without both predictions is an error too.
    """
    named, other = F.col("axis"), F.col("contrast_axis")
    axis = F.when(named.isNull() | other.isNull() | (named == other), F.coalesce(other, named)).otherwise(F.raise_error(F.lit("axis names differ")).cast("string"))
    out = pairs.withColumn("axis", axis).drop("contrast_axis")
    for side in ("left", "right"):
        half = predictions.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.col("correct").alias(f"__{side}"), F.col("predicted").alias(f"{side}_predicted"))
        out = out.join(half, [f"{side}_{k}" for k in key], "left")
    missing = F.raise_error(F.lit("a pair lacks a prediction")).cast("boolean")
    return out.withColumn("both_correct", F.coalesce(F.col("__left") & F.col("__right"), missing)).drop("__left", "__right")


def source_rollup(views: DataFrame, source: str = "source", view: str = "view") -> DataFrame:
    """Questions, right ones, accuracy, mean loss and Brier score over all views and over the first (`view` 0) alone, by source, and in all (`of` "all")."""
    first = F.col(view) == 0
    figures = lambda p, on: [
        F.count_if(on).alias(f"{p}questions"), F.count_if(on & F.col("correct")).alias(f"{p}correct"), F.avg(F.when(on, F.col("correct").cast("double"))).alias(f"{p}accuracy"),
        F.avg(F.when(on, F.col("nll"))).alias(f"{p}nll"), F.avg(F.when(on, F.col("brier"))).alias(f"{p}brier"),
    ]
    of = F.when(F.grouping(source) == 1, "all").otherwise("source").alias("of")
    return views.rollup(source).agg(of, *figures("", F.lit(True)), *figures("canonical_", first))


def view_residuals(left: DataFrame, right: DataFrame, on: list[str], kind: str) -> DataFrame:
    """(`on`, `kind`, `residual`): the largest difference between two views' probabilities; for a complement, the right side's order is turned round."""
    q = F.reverse("__q") if kind == "complement" else F.col("__q")
    gap = F.array_max(F.zip_with("__p", q, lambda a, b: F.abs(a - b)))
    pair = left.select(*on, F.col("probabilities").alias("__p")).join(right.select(*on, F.col("probabilities").alias("__q")), on)
    return pair.select(*on, F.lit(kind).alias("kind"), gap.alias("residual"))


#: What the four arms' means a, b, c, d are compared by.
EFFECTS = {
    "rubric_at_low": "b - a",
    "language_at_narrow": "c - a",
    "rubric_at_high": "d - c",
    "language_at_broad": "d - b",
    "interaction": "(d - c) - (b - a)",
    "rubric_average": "((b - a) + (d - c)) / 2",
    "language_average": "((c - a) + (d - b)) / 2",
}


def factorial_effects(families: DataFrame, category: str, family: str, draws: int = 2000, seed: str = "42") -> DataFrame:
    """(`effect`, `estimate`, `low`, `high`): effects between arms, with the 95% range of a paired bootstrap of families.

    `families` has one row per family with a figure for each arm, `a` to `d`. Families weigh alike within a category, categories alike.
    Each draw takes as many families of a category as it has, with replacement, the same for all arms; a hash of seed, draw, category
    and slot picks them. Percentiles interpolate. Rows made are families x `draws`, summed up in each task before they are shuffled.
    """
    w = Window.partitionBy(category).orderBy(family)
    placed = families.select(category, *"abcd", (F.row_number().over(w) - 1).alias("i"))
    sizes = placed.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.select(category, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.floor(X.hash_unit(F.concat_ws("/", F.lit(seed), "draw", category, "slot"), 12) * F.col("n")).cast("int")
    times = slots.groupBy("draw", category, pick.alias("i")).agg(F.count(F.lit(1)).alias("times"))
    drawn = times.join(placed, [category, "i"])
    mean = [(F.sum(F.col(arm) * F.col("times")) / F.sum("times")).alias(arm) for arm in "abcd"]
    point = placed.groupBy(category).agg(*[F.avg(arm).alias(arm) for arm in "abcd"]).agg(*[F.avg(arm).alias(arm) for arm in "abcd"])
    each = drawn.groupBy("draw", category).agg(*mean).groupBy("draw").agg(*[F.avg(arm).alias(arm) for arm in "abcd"])
    named = F.inline(F.array(*[F.struct(F.lit(k).alias("effect"), F.expr(v).alias("value")) for k, v in EFFECTS.items()]))
    bounds = each.select(named).groupBy("effect").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    return point.select(named).withColumnRenamed("value", "estimate").join(bounds, "effect")


#: Which of a pair's two families keeps the shared blueprint.
SHARED = [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0]


def assigned_blueprints(blueprints: DataFrame, seed: int = 42) -> DataFrame:
    """Forty families of each category from its blueprints, 20 of each of two authors (the first by hash where there are more).

    Pairs of families share a low blueprint; one of the two gets another for high. The narrow and the broad number of levels go round.
    Neither texts nor labels matter. A category whose author has fewer than 20 gets the families that its blueprints allow.
    """
    order = F.sha2(F.concat(F.lit(f"factorial-language/{seed}/"), F.col("id").cast("string")), 256)
    pool = blueprints.withColumn("local", F.row_number().over(Window.partitionBy("category", "author").orderBy(order)) - 1).filter(F.col("local") < 20)
    rank = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1
    numbered = lambda c: F.broadcast(blueprints.select(c).distinct().withColumn(f"{c}_at", rank(c)))  # noqa: E731  ten categories, two authors
    pool = pool.join(numbered("category"), "category").join(numbered("author"), "author").select("category", "category_at", "author_at", "local", "id")
    # Of an author, a category's first ten blueprints are shared ones; pairs of families take both authors in turn, two pairs each.
    turn = (F.col("author_at") + F.col("category_at")) % 2
    pair = (F.floor(F.col("local") / 2) * 4 + turn * 2 + F.col("local") % 2).cast("int")
    shared = pool.filter("local < 10").withColumn("pair", pair)
    more = pool.filter("local >= 10").select("category", "author_at", (F.col("local") - 10).alias("local"), F.col("id").alias("more"))
    rows = shared.join(more, ["category", "author_at", "local"]).withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1))))
    at = (F.col("pair") * 2 + F.col("offset")).cast("int")
    keeps = F.element_at(F.array(*[F.lit(s) for s in SHARED]), F.col("pair") + 1) == F.col("offset")
    return rows.select("category", at.alias("category_index"), F.col("id").alias("low_blueprint"), F.when(keeps, F.col("id")).otherwise(F.col("more")).alias("high_blueprint"),
        (2 + at % 2).alias("narrow_k"), (2 + at % 4).alias("broad_k"))


def schedule(pools: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """Which row each of `steps` trains on: (`step`, `origin`, `primitive`, `source`, `id`), one for each origin and primitive.

    Sources of an (origin, primitive) take turns. A source's rows come in an order by hash, anew for each cycle through them, so none
    comes again before all have. Of a source larger than its turns, each task keeps no more than `steps` rows before the shuffle.
    """
    stream = ["origin", "primitive", "source"]
    sizes = pools.groupBy(*stream).agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("origin", "primitive")
    turns = sizes.withColumns({"at": F.row_number().over(w.orderBy("source")) - 1, "of": F.count(F.lit(1)).over(w)}).withColumn("uses", F.ceil((steps - F.col("at")) / F.col("of"))).filter("uses > 0")
    rows = pools.select(*stream, "id").join(turns, stream)
    rows = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.ceil(F.col("uses") / F.col("size")).cast("int") - 1)))
    order = F.sha2(F.concat_ws("/", F.lit(str(seed)), *stream, "cycle", "id"), 256)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*stream, "cycle").orderBy(order)) - 1).filter(F.col("r") < steps)
    step = ((F.col("cycle") * F.col("size") + F.col("r")) * F.col("of") + F.col("at")).cast("long")
    return ranked.select(step.alias("step"), *stream, "id").filter(F.col("step") < steps)


def clarified(cases: DataFrame, category: str, wanted: str = "ordered_rubrics", state: str = "state", choice: str = "choice_bands", levels: str = "ordered_levels") -> DataFrame:
    """`cases` with `state` a struct of the old one as `evidence` and, in the wanted category, the definitions of choices and levels as `shared_definitions` (else null)."""
    on = F.col(category).eqNullSafe(wanted)
    shared = F.when(on, F.struct(F.col(choice).alias("choice_bands"), F.col(levels).alias("ordered_levels_low_to_high")))
    layout = F.when(on, "shared_definitions_clarified").otherwise(F.col("layout"))
    return cases.withColumns({state: F.struct(F.col(state).alias("evidence"), shared.alias("shared_definitions")), "layout": layout})


def balanced_selection(rows: DataFrame, category: str, blueprint: str, kind: str, family: str, quotas: dict[int, int], seed: str) -> DataFrame:
    """Of each category one family per blueprint, so that each kind comes up as often as `quotas` says: (category, blueprint, kind, family).

    Of all such selections the first, blueprints and families being in the order of hashes of (seed, name). For each kind only a
    blueprint's first family can be in it, so one row per blueprint and kind is what a category's task gets. No selection is an error,
    a number of blueprints other than the sum of quotas one of its kinds.
    """
    order = lambda c: F.sha2(F.concat_ws("/", F.lit(seed), F.col(c).cast("string")), 256)
    firsts = rows.filter(F.col(kind).isin(*quotas)).groupBy(category, blueprint, kind).agg(F.min(F.struct(order(family).alias("rank"), F.col(family).alias(family))).alias("first"))
    firsts = firsts.select(category, blueprint, kind, order(blueprint).alias("blueprint_rank"), "first.*")
    kinds = list(quotas)

    def choose(part):
        blocks = [b.sort_values("rank") for _, b in part.groupby("blueprint_rank", sort=True)]
        # What quotas the blueprints from each on can use up.
        usable = [{(0,) * len(kinds)}]
        for block in reversed(blocks):
            have = {kinds.index(k) for k in block[kind]}
            more = {left[:i] + (left[i] + 1,) + left[i + 1 :] for left in usable[0] for i in have if left[i] < quotas[kinds[i]]}
            usable.insert(0, more)
        left, taken = tuple(quotas.values()), []
        if left not in usable[0]:
            raise ValueError(f"no balanced selection in {part[category].iloc[0]}")
        for block, after in zip(blocks, usable[1:], strict=True):
            for at, k in zip(block.index, block[kind], strict=True):
                i = kinds.index(k)
                rest = left[:i] + (left[i] - 1,) + left[i + 1 :]
                if rest in after:
                    left = rest
                    taken.append(at)
                    break
        return part.loc[taken, [category, blueprint, kind, family]]

    out = firsts.select(category, blueprint, kind, family).schema
    return firsts.groupBy(category).applyInPandas(choose, out)


def family_schedule(families: DataFrame, family: str, place: str, pools: DataFrame, steps: int, repeat: int | None = None, seed: int = 42) -> DataFrame:
    """(`step`, `origin`, `primitive`, `source`, `id`): a new family for each step by its `place` from 0, and replayed rows of `pools` (primitive, source, id) as by `schedule`.

    With `repeat` the first so many families take turns; without it, fewer families than steps are an error. Replay depends on the step
    alone, so both kinds of schedule see the same old rows at a step.
    """
    active = families.select(F.col(place).cast("long").alias("at"), F.col(family).alias("id")).filter(F.col("at") < (repeat or steps))
    turns = families.sparkSession.range(steps).select(F.col("id").alias("step"), (F.col("id") % (repeat or steps)).alias("at")).join(active, "at", "left")
    known = F.coalesce(F.col("id"), F.raise_error(F.lit("families do not cover the steps")).cast(active.schema["id"].dataType))
    none = F.lit(None).cast("string")
    new = turns.select("step", F.lit("new").alias("origin"), none.alias("primitive"), none.alias("source"), known.alias("id"))
    return new.unionByName(schedule(pools.withColumn("origin", F.lit("old")), steps, seed))


def disguised_records(rows: DataFrame, column: str, aliases: dict[str, str], scale: float, offset: float, inverse: bool = False, clocks: tuple[str, ...] = ("time", "query_time", "window")) -> DataFrame:
    """`rows` with all strings of a nested column in their alias, and numbers of its fields named in `clocks` as scale * t + offset; `inverse` turns both back.

    Structs and arrays may nest at will: the column's type gives the expression. A clock that is no number is refused, as is what
    `disguised` refuses; nulls and strings without an alias stay.
    """
    if not scale or len(set(aliases.values())) < len(aliases):
        raise ValueError("not reversible")
    pairs = [(b, a) if inverse else (a, b) for a, b in aliases.items()]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair]) if pairs else F.create_map().cast("map<string,string>")

    def visit(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[visit(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: visit(x, kind.elementType, name))
        if isinstance(kind, T.StringType) and name not in clocks:
            return F.coalesce(F.try_element_at(table, c), c)
        if name not in clocks:
            return c
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"{name} is no number")
        return (c - offset) / scale if inverse else c * scale + offset

    return rows.withColumn(column, visit(F.col(column), rows.schema[column].dataType, column))


def prefix_coverage(rows: DataFrame, place: str, prefixes: list[int], category: str, signatures: list[str]) -> DataFrame:
    """(`prefix`, category, `n`, and of each of `signatures` the number of distinct values) over nested prefixes of an order from 0.

    A row counts in every prefix longer than its place. Nulls are no value.
    """
    held = F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.col(place) < p)
    return rows.withColumn("prefix", F.explode(held)).groupBy("prefix", category).agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(s).alias(s) for s in signatures])


def repeated_signatures(rows: DataFrame, signature: str) -> DataFrame:
    """Signatures that more than one row has, with `n`; none in a population of different rows."""
    return rows.groupBy(signature).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: Strands into which a source's rows are dealt to be numbered, and times that a place may walk before a permutation is given up: one in 10^32.
STRANDS, WALKS = 256, 256


def permuted_place(place: Column, size: Column, key: Column) -> Column:
    """Where a keyed permutation of the numbers from 0 to `size` - 1 puts `place`: each to one place, without a sort.

    Four Feistel rounds permute the smallest square of a power of two that holds `size`; what lands outside is permuted again until it lands inside.
    """
    half = F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double")) / 2 + F.lit(1e-12)).cast("int")
    side = F.pow(F.lit(2.0), half).cast("long")

    def once(x: Column) -> Column:
        left, right = F.call_function("shiftright", x, half), x % side
        for n in range(4):
            left, right = right, F.pmod(left + F.xxhash64(key, F.lit(n), right) % side, side)
        return left * side + right

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(place.cast("long")), lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("a place walks on")).cast("long"))


def numbered(rows: DataFrame, by: list[str], order: Column, name: str = "number") -> DataFrame:
    """`rows` with a number from 0 within each group of `by`, by strands of the hash of `order`: what a window sorts is a strand, what is summed is a count per strand."""
    strand = free_name(rows, "strand")
    dealt = rows.withColumn(strand, F.pmod(F.xxhash64(order), F.lit(STRANDS)).cast("int"))
    counts = dealt.groupBy(*by, strand).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(strand).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, strand, before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, strand).orderBy(order)) - 1
    return dealt.withColumn(name, inside).join(offsets, [*by, strand]).withColumn(name, F.col(name) + F.col("before")).drop(strand, "before")


def paired_schedule(pools: DataFrame, steps: int, seed: int = 42, origins: tuple[str, ...] = ("original", "new"), primitives: tuple[str, ...] = ("noul", "choice", "score")) -> DataFrame:
    """(`step`, `slot`, `origin`, `primitive`, `source`, `id`): at each step one row of every origin and primitive, slots by primitive, then origin.

    Sources of an origin and primitive take turns in their order; of a source's rows each comes once in a cycle, in an order that a keyed permutation of
    their numbers gives, another one in each cycle. No source is sorted as a whole, and a cycle costs a row one expression.

    An origin without one of the primitives, others than those named, null or repeated ids and fewer steps than one are errors.
    """
    have = {(r["origin"], r["primitive"]) for r in pools.select("origin", "primitive").distinct().collect()}
    if steps < 1 or have != {(o, p) for o in origins for p in primitives}:
        raise ValueError("every origin needs every primitive, and a schedule a step")
    twice = pools.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").first()
    if twice:
        raise ValueError(f"id {twice['id']} stands {twice['n']} times")
    stream = ["origin", "primitive", "source"]
    rows = numbered(pools.select(*stream, "id"), stream, F.col("id"))
    sizes = pools.groupBy(*stream).agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("origin", "primitive")
    turns = sizes.withColumns({"at": F.row_number().over(w.orderBy("source")) - 1, "of": F.count(F.lit(1)).over(w)}).withColumn("uses", F.ceil((F.lit(steps) - F.col("at")) / F.col("of"))).filter("uses > 0")
    rows = rows.join(turns, stream).withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(uses - 1) div size"))))
    place = permuted_place(F.col("number"), F.col("size"), F.concat_ws("/", F.lit(str(seed)), *stream, F.col("cycle").cast("string")))
    rows = rows.withColumn("turn", F.col("cycle") * F.col("size") + place).filter("turn < uses").withColumn("step", F.col("turn") * F.col("of") + F.col("at"))
    slots = F.create_map(*[F.lit(x) for i, p in enumerate(primitives) for j, o in enumerate(origins) for x in (f"{o}/{p}", i * len(origins) + j)])
    return rows.select("step", F.element_at(slots, F.concat_ws("/", "origin", "primitive")).alias("slot"), *stream, "id")


def one_field_groups(records: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(`field`, `group`, `value`, `record`): each record under the digest of all its fields but one, for each field. Records alike in all fields are one, the smallest `record`. Null is a value."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    each = records.groupBy(*fields).agg(F.min(record).alias("record"))
    keys = [F.struct(F.lit(f).alias("field"), F.unhex(F.sha2(F.concat_ws("\x1f", *[text(c) for c in fields if c != f]), 256)).alias("group"), F.col(f).cast("string").alias("value")) for f in fields]
    return each.select("record", F.inline(F.array(*keys))).select("field", "group", "value", "record")


def one_field_partners(records: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(`field`, `record`, `partners`): how many records differ from a record in this field alone, where there are some. Each group is sorted out once; records count as in `one_field_apart`."""
    among = F.count(F.lit(1)).over(Window.partitionBy("field", "group"))
    return one_field_groups(records, record, fields).select("field", "record", (among - 1).alias("partners")).filter("partners > 0")


def one_field_apart(records: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """Records that agree in all `fields` but one: (`field`, `group`, `value`, `record`, `next`, `next_value`), `next` the record with the next value of that field.

    For each field a record stands under the digest of all its other fields, so records that differ in this field alone meet in one group,
    and no family is joined with itself. Records alike in all fields are one, the smallest `record`. A group of n has n - 1 links from value to value, from
    which every pair of it follows; groups of one are left out. Null is a value, before all others.
    """
    met = one_field_groups(records, record, fields).withColumn("group", F.lower(F.hex("group")))
    w = Window.partitionBy("field", "group").orderBy(F.col("value").asc_nulls_first())
    linked = met.withColumns({"next": F.lead("record").over(w), "next_value": F.lead("value").over(w)})
    return linked.filter("next is not null").select("field", "group", "value", "record", "next", "next_value")


#: Families that one task draws for together.
BLOCK = 1024


def _generator(*parts) -> np.random.Generator:
    return np.random.default_rng(np.frombuffer(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest(), dtype=np.uint64))


def block_counts(total: int, block: int, size: int, draws: int, *seed) -> np.ndarray:
    """How often each of `draws` draws of `total` families out of `total`, with replacement, hits `block`, of blocks of `size` families.

    The blocks are leaves of a binary tree. At a node the draws that reach it fall to its left side by a binomial with that side's share of families; its
    generator follows from seed and node alone. So every task that goes down to a leaf of its own finds the same numbers at the nodes that
    it shares with others, and the leaves' counts are one multinomial draw together.
    """
    low, high, counts = 0, -(-total // size), np.full(draws, total, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, total) - low * size)
        left = _generator(*seed, low, high).binomial(counts, share)
        low, high, counts = (low, middle, left) if block < middle else (middle, high, counts - left)
    return counts


def macro_draws(families: DataFrame, category: str, family: str, arms: list[str], draws: int, seed: str = "42", size: int = BLOCK) -> DataFrame:
    """(`draw`, arms): for each draw the mean over categories of the mean over the drawn families of each arm's figure; draw -1 takes each family once.

    A draw takes as many families of a category as it has, with replacement, the same for all arms: exact multinomial counts, by `block_counts` and
    then within a block. A block's task sums its families for all draws, so what moves is a row for each block and draw, not for each family
    and draw, and a category of any size is spread over tasks. Reruns agree, on any number of tasks.

    Families with a null or no number in an arm, or a null category or family, are errors, as are families that stand twice. Empty table: no draws.
    """
    bad = F.lit(False)
    for c in (category, family):
        bad = bad | F.col(c).isNull()
    for arm in arms:
        bad = bad | F.col(arm).isNull() | F.isnan(arm) | (F.abs(arm) == float("inf"))
    faults = families.groupBy(category, family).agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("bad")).filter("n > 1 or bad").first()
    if faults:
        raise ValueError(f"family {faults[1]} of {faults[0]}: one row with finite figures is needed")
    rows = numbered(families.select(F.col(category).cast("string").alias("category"), F.col(family).alias("family"), *[F.col(a).cast("double").alias(a) for a in arms]), ["category"], F.col("family"), "at")
    rows = saved(rows.withColumn("block", F.expr(f"at div {size}")), "families")
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    schema = pa.schema([("category", pa.string()), ("draw", pa.int32()), *[(a, pa.float64()) for a in arms]])

    def drawn(key: tuple, part: pa.Table) -> pa.Table:
        name, block, total = key[0].as_py(), key[1].as_py(), key[2].as_py()
        part = part.sort_by("at")
        figures = np.stack([part.column(a).to_numpy() for a in arms], axis=1)
        counts = block_counts(total, block, size, draws, seed, name)
        times = _generator(seed, name, "block", block).multinomial(counts, np.full(len(figures), 1 / len(figures)))
        sums = np.vstack((figures.sum(axis=0), times @ figures))
        return pa.table({"category": [name] * (draws + 1), "draw": np.arange(-1, draws, dtype=np.int32), **{a: sums[:, i] for i, a in enumerate(arms)}}, schema=schema)

    spread = "category string, draw int, " + ", ".join(f"`{a}` double" for a in arms)
    parts = rows.join(sizes, "category").groupBy("category", "block", "total").applyInArrow(drawn, spread)
    means = parts.groupBy("category", "draw").agg(*[F.sum(a).alias(a) for a in arms]).join(sizes, "category").select("draw", *[(F.col(a) / F.col("total")).alias(a) for a in arms])
    return means.groupBy("draw").agg(*[F.avg(a).alias(a) for a in arms])


def pairwise_effects(families: DataFrame, category: str, family: str, comparisons: list[tuple[str, str]], draws: int = 2000, seed: str = "42") -> DataFrame:
    """(`effect`, `estimate`, `low`, `high`): of each comparison (a, b) the macro mean of a less that of b, named `a-b`, with the 95 % range over `macro_draws`.

    Families weigh alike in a category, categories alike. Percentiles interpolate. With one comparison ("b", "a") this is the paired effect of b.
    Faults as in `macro_draws`; no comparison, or an empty table: no rows.
    """
    if not comparisons:
        return families.sparkSession.createDataFrame([], "effect string, estimate double, low double, high double")
    arms = sorted({x for pair in comparisons for x in pair})
    each = macro_draws(families, category, family, arms, draws, seed)
    values = each.select("draw", F.inline(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("effect"), (F.col(a) - F.col(b)).alias("value")) for a, b in comparisons])))
    ends = [F.percentile(F.when(F.col("draw") >= 0, F.col("value")), q).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))]
    return values.groupBy("effect").agg(F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("estimate"), *ends).select("effect", "estimate", "low", "high")
